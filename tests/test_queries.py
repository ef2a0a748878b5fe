"""Every core query beside its SQL, on the small test tables."""

import os

import pytest

from jointmill.plans import core_queries
from verify import compare, duck

DATA = os.environ.get("JOINTMILL_TESTDATA", "/root/testdata")
#: Gates need more crops than the smallest tables hold.
LARGER = {"split_chosen": "sf0.01"}
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", list(core_queries.queries()))
def test_query(spark, name):
    d = f"{DATA}/{LARGER.get(name, 'sf0.001')}"
    said = compare(spark, duck(d), name, core_queries.queries()[name], core_queries.oracle_sql().get(name), d)
    assert said.startswith(("ok", "rows")), said
