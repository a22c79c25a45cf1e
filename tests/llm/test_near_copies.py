"""The pipeline's near-dedup stage against brute-force Jaccard."""

import random
from itertools import combinations

import corpus_pipeline
from emberlog.functions.storage import stage
from emberlog.llm import near_copies
from emberlog.llm.near_copies import drop_near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Index of the row that each group keeps."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or (len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])):
            old, new = part[b], part[a]
            part = [new if p == old else p for p in part]
    best = {}
    for i, (key, _) in enumerate(rows):
        best.setdefault(part[i], []).append((key is None, key or 0, i))
    return sorted(min(x)[2] for x in best.values())


def documents():
    rnd = random.Random(3)
    rows = [(900, ""), (901, None), (None, " \n"), (None, "alone here"), (None, "Alone  here"), (902, "a b c d"), (903, "A b\tc d"), (904, "a b c e")]
    for g in range(40):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([5, 9, 60, 200, 400]))]
        for _ in range(rnd.choice([1, 2, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append((rnd.randrange(10**6), " ".join(words)))
    return rows


def check(spark):
    rows = documents()
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, at int").coalesce(1)
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r["at"] for r in got.collect()) == brute(rows)
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_against_brute_force(spark):
    check(spark)


def test_groups_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_copies, "CELL_ROWS", 5)
    check(spark)


def test_simhash_and_its_grids_find_candidates_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "probable_links", lambda nodes: nodes.selectExpr("node AS src", "node AS dst").limit(0))
    text = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, text), (2, text + " more"), (3, "first " + text), (4, text[: len(text) // 2]), (5, "x " * 50 + text), (6, None)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert not {2, 3} & {r.doc_id for r in got.collect()} and {1, 4, 6} <= {r.doc_id for r in got.collect()}


def test_names_may_clash(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, text, 1), (1, text + " more", 2), (3, "other " * 9, 3)], "doc_id long, text string, row int").selectExpr("*", "4 AS key", "5 AS n", "6 AS bands", "7 AS Sketch", "8 AS node")
    got = drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.filter("doc_id <> 2").collect()))


def test_stage_removes_all_near_copies(spark):
    data = "/root/testdata/sf0.01"
    good = stage(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{data}/documents.parquet"), data), "test")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    got = corpus_pipeline.STAGES[1][1](spark, good, data)
    assert sorted(r.doc_id for r in got.collect()) == sorted(rows[i][0] for i in brute(rows))
