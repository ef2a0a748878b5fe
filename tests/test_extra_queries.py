"""Every further query beside its SQL, on the small test tables."""

import os

import pytest

from jointmill.plans import extra_queries
from verify import compare, duck

DATA = os.environ.get("JOINTMILL_TESTDATA", "/root/testdata")
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", list(extra_queries.queries()))
def test_query(spark, name):
    d = f"{DATA}/sf0.001"
    said = compare(spark, duck(d), name, extra_queries.queries()[name], extra_queries.oracle_sql().get(name), d)
    assert said.startswith(("ok", "rows")), said
