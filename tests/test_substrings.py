"""Long lists of substrings against a search of each value in each text."""

import random

import pytest

from emberlog.operators.intel import substring_matches


@pytest.mark.parametrize("part_chars", [1_000_000, 200_000])
def test_a_hundred_thousand_values(spark, part_chars):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abAB") for _ in range(n))
    values = sorted({word(rnd.choice([1, 2, 3, 7, 9, 12, 17])) for _ in range(40_000)} | {f"Common start {i}" for i in range(80_000)} | {"Ünïcode", "tail", ""})
    assert len(values) > 100_000
    texts = [(i, rnd.choice(["", "Common start 123 ", "COMMON START 79999", "ünÏcode "]) + word(rnd.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (3, "tail"), (3, "tail")]
    got = substring_matches(spark.createDataFrame(texts, "id int, body string"), "body", spark.createDataFrame([(v,) for v in values] + [(None,)], "value string"), part_chars=part_chars)
    low = [(v, v.lower()) for v in values if v]
    assert sorted(map(tuple, got.collect())) == sorted({(i, v) for i, t in texts if t for v, v_low in low if v_low in t.lower()})


def test_short_and_no_lists(spark):
    texts = spark.createDataFrame([(1, "a Fine text"), (2, None)], "id int, body string")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert sorted(map(tuple, substring_matches(texts, "body", values("FINE", "q", None)).collect())) == [(1, "FINE")]
    for listed in (0, 5):
        assert substring_matches(texts, "body", values("x").limit(0), listed=listed).count() == 0
