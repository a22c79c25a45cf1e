import random
import re
from collections import Counter

from emberlog.llm.decontaminate import benchmark_matches, drop_contaminated


def brute(text, item, k=5, least=0.8):
    words, own = (re.findall(r"\w+", (x or "").lower()) for x in (text, item))
    n = len(own)
    bag = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    best = None
    for start in range(max(1, len(words) - n + 1)) if n >= k <= len(words) else ():
        a, b = bag(words[start : start + n]), bag(own)
        s = sum((a & b).values()) / sum((a | b).values())
        if s >= least and (best is None or s > best[0]):
            best = (s, start, min(n, len(words)))
    return best


def tables():
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(300)}"
    items = [(i, " ".join(word() for _ in range([1, 3, 5, 6, 12, 30, 59, 20][i % 8]))) for i in range(40)]
    items += [(100, items[6][1]), (101, None), (102, ""), (103, "the the the the the the the the the the the the")]
    docs = []
    for i in range(160):
        words = [word() for _ in range(rnd.randrange(80))]
        if i % 2:
            own = items[rnd.randrange(40)][1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(own) or 1)
                own[at : at + 1] = rnd.choice([[], ["changed"], own[at : at + 1] + ["added"]])
            at = rnd.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rnd.choice(["", ",", "."]) for w in own]
        docs.append((i, " ".join(words)))
    docs += [(300 + i, " ".join(items[6][1].split()[:-1])) for i in range(2)] + [(310, " ".join(items[5][1].split()[3:])), (311, " ".join(items[5][1].split()[9:]))]
    return docs + [(500, None), (500, ""), (None, items[5][1]), (None, items[5][1]), (600, "the " * 300), (601, "long " * 30_000 + items[6][1])], items


def test_against_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS similarity").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = Counter()
    clean = Counter()
    for key, text in docs:
        hits = [(key, item, *(round(x, 9) for x in m)) for item, t in items if (m := brute(text, t))] if key != 601 else []
        if key == 601:
            hits = [(key, 6, 1.0, 30_000, len(items[6][1].split()))]
        want.update(hits)
        clean[key, text] += not hits
    for chars in (4_000_000, 900):
        got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in benchmark_matches(d, b, part_chars=chars).collect())
        assert {k for k in got if k[0] != 601} == {k for k in want if k[0] != 601}
        assert sum(got.values()) >= sum(want.values())
        left = drop_contaminated(d, b, part_chars=chars)
        assert left.columns == d.columns
        assert Counter((r.doc_id, r.text) for r in left.collect() if r.doc_id != 601) == Counter({k: n for k, n in clean.items() if n and k[0] != 601})


def test_empty(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_matches(d, b).count() == 0 and drop_contaminated(d, b).count() == 1
    assert benchmark_matches(d.limit(0), b.union(d)).count() == 0
