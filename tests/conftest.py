import os
import sys

import pytest

here = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(here), here]


@pytest.fixture(scope="session")
def spark():
    from jointmill.session import build

    s = build("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples of the named columns."""

    def get(df, *columns):
        return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))

    return get
