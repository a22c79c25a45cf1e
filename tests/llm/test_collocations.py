"""Collocations against a brute-force count, with odd rows, hot phrases and small blocks."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import collocations as module
from emberlog.llm.collocations import collocations, frequent_phrases


def pieces(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", small)]


def brute(rows, support, most=2000, covered=80):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for p in pieces(text):
            totals[lang or "und" if lang is None else lang] += len(p)
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, found in counts.items():
        found = {g: n for g, n in found.items() if n >= support}
        drop = {g[i : i + m] for g, n in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * n >= covered * found[g[i : i + m]]}
        scored = []
        for g, a in found.items():
            if len(g) > 1 and g not in drop:
                score, _, l, r = min((2_000_000 * a // (found[g[:k]] + found[g[k:]]), k, found[g[:k]], found[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def rows_of(seed):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "dé", "É", " ", "x\x00y", "ß"] + [f"w{i}" for i in range(30)]
    some = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", "; "]) for _ in range(n))
    rows = [(rnd.choice(["en", "de", None, "", "en"]), some(rnd.randint(0, 60))) for _ in range(300)]
    return rows + [("en", None), ("en", ""), (None, None), ("xx", " \t\n."), ("en", "w1 w2 w3 w4 " * 2000)] + [("fr", "La même phrase ici, toujours.")] * 50


@pytest.mark.parametrize("support", [1, 10])
def test_against_brute_force(spark, support, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 700)
    rows = rows_of(support)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS key", "2 AS shard", "'z' AS phrase").repartition(3)
    assert sorted(map(tuple, collocations(docs, support).collect())) == brute(rows, support)


def test_all_shards_and_limits_give_the_same(spark, tmp_path):
    rows = rows_of(5)
    spark.createDataFrame(rows, "lang string, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = [sorted(map(tuple, frequent_phrases(docs, 10, shards)[0].collect())) for shards in (1, 40)]
    assert found[0] == found[1]
    assert sorted(map(tuple, collocations(docs, 3, most=4).collect())) == brute(rows, 3, 4)


def test_equal_keys_are_told_apart_by_words(spark, monkeypatch):
    """Where all keys collide, every phrase is counted by its words."""
    rows = rows_of(7)
    block = module.Words(np.frombuffer(b"a b c a b", np.uint8), np.array([0, 9]), np.array([0]))
    monkeypatch.setattr(module.Words, "keys", lambda self, languages: ((np.zeros(len(self.codes), np.uint64), self.codes >= 0) for _ in range(1)))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(["en"]), pa.array(["a b c a b"])], ["shard", "lang", "text"])
    held = type("Held", (), {"value": np.full(16, -1, np.int64)})
    got = [r for b in module._global(held)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["phrase"], r["n"]) for r in got) == [("a", 2), ("b", 2), ("c", 1)] and len(block.codes) == 5 and rows


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0
