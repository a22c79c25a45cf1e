from collections import Counter

import numpy as np

from emberlog.llm.sharding import hypergeometric, matrix_row, shard_rows, shard_sizes, split_counts


def test_matrix_adds_up():
    counts = [0, 7, 100, 3, 0, 55, 1]
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = shard_sizes(166, 5, 3)
    rows = [matrix_row(before, sizes, p, 3) for p in range(7)]
    assert [sum(r) for r in rows] == counts and [sum(c) for c in zip(*rows)] == sizes
    assert sorted(sizes) == [33, 33, 33, 33, 34]


def test_draws_follow_the_distribution():
    rng = np.random.default_rng(1)
    got = np.array([split_counts(rng, [5, 3, 2], 4)[0] for _ in range(20_000)])
    chance = np.array([5, 50, 100, 50, 5]) / 210  # C(5,k) C(5,4-k) / C(10,4)
    assert np.abs(np.bincount(got, minlength=5) / 20_000 - chance).max() < 0.015
    large = np.array([hypergeometric(rng, 2_000_000_000, 1_000_000_000, 900_000) for _ in range(400)])
    assert abs(large.mean() - 600_000) < 100 and 350 < large.std() < 550


def test_shards_are_exact_and_uniform(spark):
    docs = spark.range(0, 1000, numPartitions=7).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', NULL) AS text", "1 AS slot", "'x' AS __base_")
    places = np.zeros((16, 8), int)
    for seed in range(4):
        got = shard_rows(docs, 16, seed, bucket_rows=20).select("doc_id", "shard", "slot").collect()
        sizes = Counter(r.shard for r in got)
        assert sorted(r.doc_id for r in got) == list(range(1000)) and set(sizes.values()) == {62, 63}
        for s in range(16):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        for r in got:
            places[r.shard, r.doc_id // 125] += 1
    # Each shard draws from each eighth of the rows alike: chi-square with 105 degrees of freedom.
    assert 55 < ((places - 31.25) ** 2 / 31.25).sum() < 175


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None)] * 40 + [(1, "x" * 200_000)], "doc_id long, text string")
    got = shard_rows(docs, 16).collect()
    assert len(got) == 41 and set(Counter(r.shard for r in got).values()) <= {2, 3}
    assert shard_rows(docs.limit(0), 16).count() == 0


def test_names_and_many_partitions(spark, monkeypatch):
    from emberlog.llm import sharding

    docs = spark.range(0, 60, numPartitions=6).selectExpr("id AS doc_id", *(f"{i} AS {n}" for i, n in enumerate(("part", "at", "key", "bucket", "nth", "base", "__part", "SLOT", "to", "of"))))
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", 2)
    got = shard_rows(docs, 4)
    assert got.columns == [*(c for c in docs.columns if c != "SLOT"), "shard", "slot"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(60)) and sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(15)]
    assert {tuple(r)[1:8] for r in rows} == {tuple(range(7))}
