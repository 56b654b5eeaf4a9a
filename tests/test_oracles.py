"""Every registered key with an oracle agrees with DuckDB on sf0.001, and
every key without one runs (rows-only)."""

import duckdb
import pytest

import __spark_entry__ as entry
from dsengine.plans.fixtures import TABLES
from tools.check_oracle import compare

# the training-data operators have their own folder of tests
KEYS = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("key", [k for k in KEYS if k in entry.oracle_sql()])
def test_key_matches_oracle(spark, sf, duck, key):
    sdf = entry.queries()[key](spark, sf)
    res = duck.execute(entry.oracle_sql()[key])
    verdict = compare([tuple(r) for r in sdf.collect()], sdf.columns, res.fetchall(),
                      [d[0] for d in res.description])
    assert verdict is None, verdict


@pytest.mark.parametrize("key", [k for k in KEYS if k not in entry.oracle_sql()])
def test_rows_only_key_runs(spark, sf, key):
    assert entry.queries()[key](spark, sf).count() > 0
