"""The native operators run no Python on executors."""

import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.split("_")[0] in ("op7", "op8", "op10")])
def test_native(spark, name):
    p = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "Arrow"))
