import os

import pytest

from siteloom.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_like_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
