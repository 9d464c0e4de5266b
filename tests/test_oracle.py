"""Every registered query with an oracle equals DuckDB on sf0.001 (the driver's check, smaller)."""

import duckdb
import pytest

from roomcast.plans.registry import oracles, queries
from roomcast.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import _rows

SKIP = {"session_stream"}  # covered by test_stream_equals_batch


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in oracles() if n not in SKIP))
def test_query_matches_oracle(spark, con, name):
    spd = queries()[name](spark, SF_SMALL).toPandas()
    dpd = con.execute(oracles()[name]).df()
    assert _rows(spd) == _rows(dpd)


def test_stream_equals_batch(spark):
    q = queries()
    a = _rows(q["session_stream"](spark, SF_SMALL).toPandas())
    b = _rows(q["session_decisions"](spark, SF_SMALL).toPandas())
    assert a == b


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "candidates" in df.columns
