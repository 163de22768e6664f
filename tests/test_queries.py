"""Every registered query against its SQL on the smallest tables, whole histories and cut ones."""

import os

import duckdb
import pytest

from check import TABLES, compare
from chronoplane.plans import Tables, load, presented

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(load()))
def test_query(spark, con, name):
    q = load()[name]
    _, _, verdict = compare(presented(q.build(Tables(spark, FOLDER))), con, q.sql)
    assert verdict.startswith(("ok", "rows only")), verdict


CUT = ("entity_features", "lag_ewma", "group_z", "expanding_percentile", "group_baselines", "fit_diagnostics", "bet_totals", "equity_curve", "opp_form", "asof_join")


@pytest.mark.parametrize("name", CUT)
def test_query_with_cut_histories(spark, con, name):
    q = load()[name]
    _, _, verdict = compare(presented(q.build(Tables(spark, FOLDER, hot_rows=40))), con, q.sql)
    assert verdict.startswith("ok"), verdict


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
