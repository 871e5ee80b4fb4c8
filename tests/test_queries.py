import pytest
from oracle import same

from joinwright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)
