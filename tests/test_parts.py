"""Large tables are dealt into more parts than there are shuffle partitions, and give the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoplane import session
from chronoplane.operators.timeline import dealt
from chronoplane.plans import Tables, load, presented
from chronoplane.plans.bindings import meetings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 orders, one of which comes twice, 1500 items, 20 suppliers of 3 nations; some keys are NULL."""
    rnd, path = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))
    orders = [(i if i else None, rnd.randrange(9), "F", 1000.0 * rnd.randrange(300), day(), "1-URGENT") for i in range(300)]
    items = [(rnd.randrange(300) or None, rnd.randrange(20) or None, float(rnd.randrange(1, 50)), float(rnd.randrange(900))) for _ in range(1500)]
    made = {
        "orders": ([*orders, orders[7]], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (items, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double"),
        "supplier": ([(i, f"s{i}", i % 3) for i in range(20)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def test_meetings_of_a_large_table_are_dealt_into_bounded_parts(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    per_task = meetings(Tables(spark, folder)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 60  # over 1000 rows; eight shuffle partitions would have 130 each


def test_dealt_leaves_whole_tables_alone(spark):
    df = spark.range(10)
    assert dealt(df, 5, []) is df and dealt(df, None, ["id"]) is df


@pytest.mark.parametrize("name", ["team_event_totals", "opp_form", "join_opponent_form", "opp_pace", "join_opponent_pace", "head_to_head"])
def test_the_number_of_parts_and_cuts_changes_no_row(spark, folder, monkeypatch, name):
    build = load()[name].build

    def rows(hot_rows):
        return sorted(map(repr, presented(build(Tables(spark, folder, hot_rows))).collect()))

    whole = rows(None)
    monkeypatch.setattr(session, "TASK_ROWS", 40)
    assert len(whole) > 100
    assert rows(1_000_000) == whole
    if name not in ("opp_form", "join_opponent_form"):  # the order of equal keys, an order that comes twice, is free
        assert rows(12) == whole
