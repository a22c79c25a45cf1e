import pytest

from emberlog.llm.url_filter import spread


def test_long_chain_and_cycle(spark):
    # Distrust flows against links: each host of the chain links to the one before it, h0 is blocked.
    links = [(f"h{i + 1}", f"h{i}", 1) for i in range(30)]
    df = spark.createDataFrame(links, "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 0, 1000)], "host string, trusted long, blocked long")
    got = {r.host: r.distrust for r in spread(df, seeds).collect()}
    assert all(abs(got[f"h{i}"] - 150 * 0.85**i) < 1e-3 for i in range(31))
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1000, 0)], "host string, trusted long, blocked long")
    got = {r.host: r.trust for r in spread(ring, seeds).collect()}
    assert abs(got["a"] - 150 / (1 - 0.85**2)) < 1e-3 and abs(sum(got.values()) - 1000) < 2e-3
    with pytest.raises(RuntimeError):
        spread(ring, seeds, rounds=20)
