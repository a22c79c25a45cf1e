"""More values than one automaton holds are joined: none passes through the driver, no text meets them part by part."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import intel


@pytest.mark.parametrize("part_chars", [10, 1_000_000])
def test_long_lists_in_parts_or_not(spark, monkeypatch, part_chars):
    built = []
    monkeypatch.setattr(intel, "_joined_matches", lambda *a, whole=intel._joined_matches: built.append(1) or whole(*a))
    values = [f"Item {i} of a long list" for i in range(300)] + ["item", "ITEM", "em 7 o", "ü", "Straße 7 und", "x" * 40, "list!", "\0"]
    texts = [(1, "see item 7 of a long list!"), (2, "ITEM 29 OF A LONG LISTS"), (3, "Ü und STRAßE 7 UND"), (4, "x" * 41), (4, "x" * 41), (None, "item"), (5, None), (6, ""), (7, "a\0b")]
    got = intel.substring_matches(spark.createDataFrame(texts, "id int, body string"), "body", spark.createDataFrame([(v,) for v in values], "value string"), part_chars=part_chars)
    want = {(i, v) for i, t in texts if t for v in values if v.lower() in t.lower()}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len(built) == (part_chars == 10)
    assert got.filter(F.col("value").isNull()).count() == 0
