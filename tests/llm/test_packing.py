"""Packing against one piece at a time, for the number of sequences, and against whole-text encoding, for the pieces."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberlog.llm import packing
from emberlog.llm.packing import GAP, PLACED, WAITING, pack, pack_documents, sequences, sweep
from emberlog.llm.tokens import DEFAULT_TOKENIZER


def best_fit(lengths, capacity):
    """Best fit, longest first, one piece at a time: the number of sequences."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def check_places(rows, capacity):
    """``(length, sequence, offset)``: gapless from 0 in each sequence and none over ``capacity``; the number of sequences."""
    places = defaultdict(list)
    for length, sequence, offset in rows:
        places[sequence].append((offset, length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_sweep_gives_each_document_its_successor():
    runs = [(GAP, 90, 0, 1, 1, 90, 0, 0), (WAITING, 80, 0, 1, 0, 0, 0, 0), (GAP, 60, 5, 2, 1, 60, 0, 0), (WAITING, 60, 0, 3, 0, 0, 0, 0), (GAP, 30, 9, 1, 3, 30, 0, 0), (WAITING, 10, 0, 2, 0, 0, 0, 0)]
    out = list(sweep(runs, 100))
    placed = [r[1:5] + r[6:] for r in out if r[0] == PLACED]
    assert placed == [(80, 0, 1, 1, 0, 10), (60, 0, 2, 1, 5, 40), (10, 0, 2, 2, 9, 70)]
    assert [r[:4] for r in out if r[0] == WAITING] == [(WAITING, 60, 2, 1)]
    assert [(r[1], r[4], r[5]) for r in out if r[0] == GAP] == [(30, 1, 10)]


@pytest.mark.parametrize("capacity", [10, 32_768, 65_536, 131_072])
def test_places(spark, capacity):
    rnd = random.Random(capacity)
    lengths = [rnd.randint(1, rnd.choice([capacity, capacity // 3, capacity // 20 + 1])) for _ in range(400 if capacity == 10 else 50)]
    lengths += [capacity] * 3 + [capacity // 2] * 5 + [1] * 40
    rows = spark.createDataFrame([(n,) for n in lengths], "length long").repartition(3)
    got = [tuple(r) for r in pack(rows, capacity).collect()]
    assert Counter(r[0] for r in got) == Counter(lengths)
    assert check_places(got, capacity) <= best_fit(lengths, capacity) + 1


def test_large_lengths(spark):
    got = pack(spark.createDataFrame([(40_000,), (40_000,), (30_000,), (5,)], "length int"), 65_536).collect()
    assert check_places([tuple(r) for r in got], 65_536) == 3


def test_about_as_few_sequences_as_best_fit_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in pack_documents(docs).select("length", "sequence_id", "offset").collect()]
    assert check_places(got, 2048) <= best_fit([r[0] for r in got], 2048) + 1


def test_steps_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_STEPS", 0)
    assert check_places([tuple(r) for r in pack(spark.createDataFrame([(x % 7 + 1,) for x in range(200)], "length long"), 16).collect()], 16) == 50


def test_documents(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["one", "two", "three,"]) for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    rows += [(None, None), (7, ""), (7, ""), (7, ""), (200, "long " * 5000), (201, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS sequence_id")
    packed = pack_documents(docs, capacity=64, keep_ids=True)
    got = packed.collect()
    whole = Tokenizer.from_file(DEFAULT_TOKENIZER)
    by_doc, places = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for key in {k for k, _ in rows} - {7}:
        ids = whole.encode(dict(rows)[key] or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[key], key=lambda r: r.piece)
        assert [i for r in pieces for i in r.ids] == ids
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert all(p.length == 64 for p in pieces[1:])
    assert len(by_doc[7]) == 4
    assert check_places([(r.length, r.sequence_id, r.offset) for r in got], 64) <= best_fit([r.length for r in got], 64) + 1
    assert sorted(map(len, (r.ids for r in sequences(packed).collect()))) == sorted(sum(n for _, n in p) for p in places.values())


def test_no_rows_ties_and_names(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.range(1000).selectExpr("1L AS doc_id", "5 AS length", "2 AS part", "3 AS nth", "4 AS OFFSET", "5 AS size", "6 AS at", "7 AS n", "8 AS base", "9 AS own_length")
    got = same.transform(pack, 16)
    assert got.columns == [*[c for c in same.columns if c != "OFFSET"], "sequence_id", "offset"]
    assert got.select("sequence_id", "offset").distinct().count() == 1000
    assert set(map(tuple, got.select("part", "nth", "size", "at", "n", "base", "own_length").distinct().collect())) == {(2, 3, 5, 6, 7, 8, 9)}
    for bad in ("0", "17", "CAST(NULL AS INT)"):
        with pytest.raises(ValueError):
            pack(spark.range(2).selectExpr(f"{bad} AS length"), 16)
    assert dict(pack_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).dtypes)["piece"] == "int"
