import random
import re
from collections import Counter

from emberlog.llm.quality import BASE, RULES, keep_quality, order_rules, quality_report


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [*zip(words, words[1:], words[2:])]
    often = Counter(windows)
    again = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(again) > 50 * n
    kept = not (base or 10 * symbols > n or 2 * dup > len(lines) or not 3 * n <= chars <= 10 * n)
    return n, chars, symbols, dup, len(again), base, kept


def texts():
    rnd = random.Random(1)
    made = ["", None, " \n\t ", "one", "a b", "a b c", "a b c a b c", "x\x0by\x1cz w", "é ü 漢字 🙂\r\nb", "\n".join(["same line here"] * 40), "word " * 70]
    for _ in range(60):
        k = rnd.choice([3, 20, 500])
        made.append("".join(f"w{rnd.randrange(k)}" + rnd.choice([" ", "  ", "\n", "\t", " # ", "|"]) for _ in range(rnd.randrange(300))))
        made.append(" ".join(f"word{rnd.randrange(4000)}" for _ in range(rnd.randrange(40, 400))))
    return made + ["long" + "".join(f" w{i % 700}" for i in range(60_000))]


def test_report_against_brute_force(spark):
    rows = [*enumerate(texts()), (3, "one"), (None, "no id " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_words", "'x' AS __words", "1 AS __alive")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_report(docs).collect())
    assert got == Counter((key, *brute(text)) for key, text in rows)
    kept = keep_quality(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t in rows if brute(t)[-1])


def test_order_and_empty(spark):
    docs = spark.createDataFrame([(i, "few # words" if i % 2 else " ".join(f"word{j * i}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    order = order_rules(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in BASE + RULES)
    # The half that the cheapest rule rejects leaves nothing for the others to reject.
    assert order[0].name in ("few_words", "symbols") and [r.name for r in order[1:]] == [r.name for r in BASE + RULES if r != order[0]]
    costs = {"__words": 4.0, "n_words": 1.0, "n_symbols": 2.0, "__windows": 90.0}
    assert [order_rules(docs, costs=costs)[0].name for _ in range(3)] == ["few_words"] * 3
    assert order_rules(docs, costs=costs | {"__words": 0.1, "n_words": 0.1})[0].name == "few_words"
    empty = docs.limit(0)
    assert quality_report(empty).count() == 0 and keep_quality(empty).count() == 0


def test_native(spark):
    plan = quality_report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
