"""Cutting stock: the program against its bound, pieces against whole-text encoding, places without gaps or padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from emberlog.llm import cutting_stock
from emberlog.llm.cutting_stock import _knapsack, generate_columns, pack_cutting_stock, plan
from emberlog.llm.word_tokens import WORD_TOKENIZER


def test_knapsack_prices_the_best_pattern():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = sorted(rnd.sample(range(1, 15), rnd.randint(1, 5)))
        values = [rnd.random() for _ in sizes]

        def best(room):
            return max((v + best(room - s) for s, v in zip(sizes, values) if s <= room), default=0)

        worth, pattern = _knapsack(np.array(sizes), np.array(values), 16)
        assert worth == pytest.approx(best(16)) == pytest.approx(float(pattern @ values)) and pattern @ sizes <= 16


def test_columns_meet_demand_near_the_bound():
    rnd = random.Random(2)
    for m in (1, 2, 7, 40):
        sizes = sorted(rnd.sample(range(1, 65), m))
        demand = [rnd.choice([1, 5, 1000, 10**9]) for _ in sizes]
        patterns, used, bound = generate_columns(sizes, demand, 64)
        assert (patterns @ np.array(sizes) <= 64).all()
        assert (patterns.T @ used >= np.array(demand) * (1 - 1e-6)).all()
        assert bound * (1 - 1e-6) <= used.sum() <= bound * 1.0002 + 1e-6
    # Thirds and halves: the program finds mixed patterns.
    assert generate_columns([20, 30, 44], [100, 100, 100], 64)[1].sum() == pytest.approx(100 + 100 / 2 + 0, rel=1e-3)


def test_plan_leaves_enough_to_fill_the_rest():
    rnd = random.Random(3)
    for capacity, grain in ((64, 4), (256, 1), (4096, 16)):
        lengths = {rnd.randint(1, capacity - 1): rnd.choice([1, 3, 400]) for _ in range(40)}
        places, sequences = plan(lengths, capacity, grain)
        total = sum(k * n for k, n in lengths.items())
        assert total // capacity - 40 <= sequences <= total // capacity
        held = defaultdict(int)
        for size, _, n, each, first, _ in places:
            assert first + n // each <= sequences
            for s in range(first, first + n // each):
                held[s] += size * each * grain
        assert max(held.values(), default=0) <= capacity


def check(got, rows, capacity):
    """Every id once, pieces' checksums, no gaps, no padding but what the last sequence can't help."""
    whole = Tokenizer.from_file(WORD_TOKENIZER)
    whole.encode_special_tokens = True
    ids = {k: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for k, n in {k: sum(k == x for x, _ in rows) for k, _ in rows}.items():
        starts = sorted((r.start, r.length) for r in pieces[k])
        assert sum(length for _, length in starts) == n * len(ids[k])
        if n == 1:
            assert [a for a, _ in starts] == [sum(x for _, x in starts[:i]) for i in range(len(starts))]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at & (at - 1)) == 0
    return len(sequences), sum(map(len, ids.values()))


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_documents(spark, broadcast, monkeypatch):
    monkeypatch.setattr(cutting_stock, "BROADCAST_CUT", broadcast)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["one", "Zwei,", "xylograph", "é"]) for _ in range(rnd.choice([0, 3, 10, 40, 90])))) for i in range(200)]
    rows += [(None, None), (700, ""), (701, "long " * 5000), *[(7000, rows[5][1])] * 40]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rest", "'x' AS part", "3 AS ids").repartition(3)
    check(pack_cutting_stock(docs, capacity=64, grain=4).collect(), rows, 64)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(pack_cutting_stock(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4096)


def test_few_rows(spark):
    assert pack_cutting_stock(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (one,) = pack_cutting_stock(spark.createDataFrame([(5, None)], "doc_id int, text string")).collect()
    assert (one.doc_id, one.start, one.length, one.doc_tokens, one.offset) == (5, 0, 1, 1, 0)
    assert pack_cutting_stock(spark.createDataFrame([(None, "")] * 300, "doc_id long, text string"), capacity=64, grain=4).count() == 300
    with pytest.raises(ValueError):
        pack_cutting_stock(spark.range(1).selectExpr("id AS doc_id", "'' AS text"), capacity=64, grain=7)
