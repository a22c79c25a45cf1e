"""Texts like given ones: against weights worked out plainly, rows that repeat, rare terms, and what is shuffled."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from emberlog.operators import memory

DOCS = [(1, "Alpha beta-beta gamma1 Kelvin"), (2, None), (3, "beta delta"), (3, "delta epsilon, beta"), (4, "--"), (5, "zeta alpha kelvin"), (None, "alpha beta"), (6, "éalphaé eta"), (7, ""), (8, "beta delta alpha theta iota kappa")]
ASKED = [("q1", "alpha beta"), ("q2", "delta nowhere"), ("q2", "kelvin kappa"), ("q3", None), ("q4", "nowhere")]


def plainly(k):
    def bags(rows):
        out = {}
        for key, text in rows:
            if key is not None and (found := re.findall("[a-z0-9]+", (text or "").lower())):
                out.setdefault(key, Counter()).update(found)
        return out

    docs, df = bags(DOCS), Counter()
    for bag in docs.values():
        df.update(bag.keys())
    idf = {t: math.log((len(DOCS) + 1) / (n + 1)) + 1 for t, n in df.items()}

    def vector(bag):
        w = {t: c / bag.total() * idf.get(t, 1.0) for t, c in bag.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    out = []
    for query, bag in bags(ASKED).items():
        q = vector(bag)
        scores = [(-round(sum(x * v.get(t, 0) for t, x in q.items()), 6), key) for key, v in ((key, vector(b)) for key, b in docs.items()) if q.keys() & v.keys()]
        out += [(query, key, -s) for s, key in sorted(scores)[:k]]
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [1_000_000, 2, 0])
def test_as_worked_out_plainly(spark, vocabulary):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string").repartition(3), spark.createDataFrame(ASKED, "query string, text string")
    got = memory.similar_texts(docs, asked, "id", "text", 2, block_terms=3, vocabulary=vocabulary)
    rows = sorted((r.query, r.id, r.similarity) for r in got.collect())
    want = plainly(2)
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    assert all(abs(r[2] - w[2]) < 2e-6 for r, w in zip(rows, want))


def test_no_queries_and_no_texts(spark):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame(ASKED, "query string, text string")
    assert memory.similar_texts(docs, asked.limit(0), "id", "text").collect() == []
    assert memory.similar_texts(docs.limit(0), asked, "id", "text").collect() == []


def test_terms_of_a_text_stay_in_its_task(spark, monkeypatch):
    """Terms are counted without a shuffle: no row for each text and term."""
    monkeypatch.setattr(memory, "stage", lambda df, name="": df)
    counted = memory.term_counts(spark.range(200).selectExpr("id", "concat('a b c ', id, ' a') AS text"), "id", "text")
    row = counted.filter("key = 7").first()
    assert dict(zip(row.terms, row.counts)) == {"a": 2, "b": 1, "c": 1, "7": 1}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_texts_are_taken_in_slices(spark, monkeypatch):
    monkeypatch.setattr(memory, "CELLS", 3)
    monkeypatch.setattr(memory, "TEXT_BYTES", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a b c d a", "", "x", "b a9"])], ["key", "text"])
    counted = list(memory._count([batch]))
    got = [(r["key"], dict(zip(r["terms"], r["counts"]))) for b in counted for r in b.to_pylist()]
    assert len(counted) == 2 and got == [(1, {"a": 2, "b": 1, "c": 1, "d": 1}), (2, {}), (3, {"x": 1}), (4, {"b": 1, "a9": 1})]
    assert [b.column(0).to_pylist() for b in memory._slices(pa.Table.from_batches(counted).combine_chunks().to_batches())] == [[1], [2, 3, 4]]
