"""All twelve chains against DuckDB."""

import pytest
from test_registry import DATA, duck, rows  # noqa: F401

from emberlog.operators.correlation import PATTERNS
from emberlog.plans import registry


@pytest.mark.parametrize("name", ("k1_step_tags_all", "k2_match_chains_all", "k3_chain_confidence_all"))
def test_against_sql(spark, duck, name):  # noqa: F811
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
    assert {"ACP005", "ACP009"} <= set(got["pattern"]) <= {p.id for p in PATTERNS}
