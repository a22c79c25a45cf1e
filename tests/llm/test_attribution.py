from collections import Counter

import pytest
from tokenizers import Tokenizer

from emberlog.llm.attribution import RULES, attribute_tokens
from emberlog.llm.tokens import DEFAULT_TOKENIZER

ROWS = [(1, "one two\nthree\n\n\nfour  \n five"), (2, ""), (3, None), (None, "\n\n\n"), (4, "no end"), (4, "été\n\n\n漢字\r\nx" * 3), (5, "word " * 30_000), (6, "a\n")]
WHOLE = Tokenizer.from_file(DEFAULT_TOKENIZER)


def brute(text, sections, rule):
    """Give each token of the whole text to a section, character by character."""
    got = WHOLE.encode(text, add_special_tokens=False)
    begins = [a for a, _ in got.offsets]
    counts = Counter()
    for i, a in enumerate(begins):
        b = max(begins[i + 1] if i + 1 < len(begins) else len(text), a + 1)
        held = [next(s for s, end in enumerate(sections) if c < end) for c in range(a, b)]
        counts[{"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]] += 1
    return counts


@pytest.mark.parametrize("rule", RULES)
def test_lines(spark, rule):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "9 AS section", "text AS n_tokens")
    got = attribute_tokens(docs, rule=rule).collect()
    want = []
    for key, text in ROWS:
        text = text or ""
        lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]
        ends = [sum(map(len, lines[: i + 1])) for i in range(len(lines))] or [0]
        counts = brute(text, ends, rule)
        want += [(key, i, ends[i - 1] if i else 0, end, counts[i]) for i, end in enumerate(ends)]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)


def test_fields(spark):
    docs = spark.createDataFrame([(1, "T", None, "body text"), (2, None, None, None)], "doc_id long, title string, `by` string, body string")
    got = {(r.doc_id, r.section): (r.char_start, r.char_end, r.n_tokens) for r in attribute_tokens(docs, ["title", "by", "body"]).collect()}
    assert got[1, 0] == (0, 2, 2) and got[1, 2][:2] == (3, 12)
    assert sum(n for (d, _), (*_, n) in got.items() if d == 1) == len(WHOLE.encode("T\n\nbody text").ids)
    assert attribute_tokens(docs.limit(0), ["title"]).count() == 0
