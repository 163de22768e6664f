"""Queries of the sources, sinks and streams. Each first lets Spark write a given table in the format read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoplane.operators import ledger as L
from chronoplane.plans.bindings import O_SQL, order_keys, orders
from chronoplane.plans.dataset_queries import season_cv as season_cv_frame
from chronoplane.plans.registry import n, query, r
from chronoplane.session import work_path
from chronoplane.sources import nested as N
from chronoplane.sources import readers as RD
from chronoplane.sources import writers as W
from chronoplane.streaming.ingest import event_stream, stream_ingest as run_ingest
from chronoplane.streaming.settle import settled_bets
from chronoplane.streaming.settle import stream_ledger as run_settle


@query("scan_parquet", f"WITH {O_SQL} SELECT o_orderkey, season, {r('v', 'v')} FROM o WHERE season IN ('1997-98', '1999-00')")
def scan_parquet(t):
    path = work_path(t.spark, "orders")
    orders(t).write.partitionBy("season").parquet(path)
    out = RD.scan_parquet(t.spark, path, "season", ["1997-98", "1999-00"])
    return out.select("o_orderkey", F.col("season").cast("string"), "v")


@query("scan_csv_multi", f"""WITH {O_SQL} SELECT o_orderkey AS "ORDER_ID", o_custkey AS "PLAYER_ID", CASE WHEN season = '1996-97' THEN 'F' ELSE 'none' END AS "STATUS_GROUP",
{r("CASE WHEN season <> '1996-97' THEN v END", '"PRICE"')}, season AS "SEASON" FROM o WHERE season IN ('1995-96', '1996-97', '1997-98')""")
def scan_csv_multi(t):
    """Files of all seasons, of which three are asked for: one has other columns, the others spell a column in mixed case."""
    base = work_path(t.spark, "season-csv")
    o = orders(t)
    plain = o.select(F.col("o_orderkey").alias("Order_ID"), F.col("o_custkey").alias("PLAYER_ID"), F.col("v").alias("PRICE"), "season")
    plain.filter(F.col("season") != "1996-97").write.partitionBy("season").option("header", True).csv(f"{base}/plain")
    other = o.filter(F.col("season") == "1996-97").select(
        F.col("o_orderkey").alias("ORDER_ID"), F.lit("F").alias("STATUS_GROUP"), F.col("o_custkey").alias("PLAYER_ID"), "season"
    )
    other.write.partitionBy("season").option("header", True).csv(f"{base}/other")
    out = RD.scan_csv_multi(
        t.spark, f"{base}/*/*/*.csv", ["1995-96", "1996-97", "1997-98"], {"STATUS_GROUP": "none"},
        {"ORDER_ID": "bigint", "PLAYER_ID": "bigint", "PRICE": "double"},
    )
    return out.select("ORDER_ID", "PLAYER_ID", "STATUS_GROUP", "PRICE", "SEASON")


@query("reconcile_columns", f'SELECT c_custkey AS "CUST_ID", c_nationkey AS "NATION" FROM customer')
def reconcile_columns(t):
    """A file with the id twice, in mixed and in upper case: the upper-case column stays."""
    path = work_path(t.spark, "twins")
    spark = t.spark
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        twins = t.customer.select(
            (F.col("c_custkey") + 1_000_000).alias("Cust_ID"), F.col("c_nationkey").alias("Nation"), F.col("c_custkey").alias("CUST_ID")
        )
        W.write_csv(twins, path)
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)
    return RD.scan_csv_multi(spark, f"{path}/*.csv", types={"CUST_ID": "bigint", "NATION": "bigint"}).select("CUST_ID", "NATION")


@query("scan_partition_dirs", f"WITH {O_SQL} SELECT o_orderkey, {r('v', 'v')}, season FROM o")
def scan_partition_dirs(t):
    path = work_path(t.spark, "dirs")
    o = orders(t).select("o_orderkey", "v", "season")
    o.write.partitionBy("season").option("header", True).csv(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("v", T.DoubleType())])
    return RD.scan_partition_dirs(t.spark, f"{path}/season=*/*.csv", schema)


@query("scan_odds", f"""SELECT CAST(o_custkey AS VARCHAR) AS player_name, CAST(o_orderdate AS DATE) AS event_date, {r('l_quantity', 'line')}, l_returnflag AS bookmaker,
{r('-100 - round(l_discount * 100)', 'over_price')}, {r('NULL', 'under_price')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def scan_odds(t):
    path = work_path(t.spark, "odds")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    quotes = t.lineitem.join(o, "l_orderkey").select(
        F.col("o_custkey").alias("player_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"),
        F.col("l_quantity").alias("line"),
        F.col("l_returnflag").alias("bookmaker"),
        (-100 - F.round(F.col("l_discount") * 100)).alias("over_price"),
        F.lit(None).cast("double").alias("under_price"),
    )
    W.write_csv(quotes, path)
    absent = RD.scan_odds(t.spark, path + "-absent")
    return RD.scan_odds(t.spark, path).unionByName(absent)


@query("scan_latest", "SELECT o_orderkey, year(o_orderdate) AS run FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def scan_latest(t):
    path = work_path(t.spark, "runs")
    t.orders.select("o_orderkey", F.year("o_orderdate").alias("run")).write.partitionBy("run").parquet(path)
    return RD.scan_latest(t.spark.read.parquet(path), "run").select("o_orderkey", F.col("run").cast("long"))


# Lines of an order as a nested odds payload: return flag = bookmaker, linestatus = market, part = player.
_QUOTES = "SELECT l_orderkey, l_returnflag, l_linestatus, CASE WHEN l_linenumber > 1 THEN l_partkey END AS player, l_quantity FROM lineitem"


def payloads(t):
    """Lines nested by order; an order has a handful of lines, so its arrays are small."""
    lines = t.lineitem.select(
        "l_orderkey", "l_returnflag", "l_linestatus",
        F.struct(
            F.when(F.col("l_tax") > 0.04, "Over").otherwise("Under").alias("name"),
            F.when(F.col("l_linenumber") > 1, F.col("l_partkey").cast("string")).alias("description"),
            (-100 - F.round(F.col("l_discount") * 100)).cast("int").alias("price"),
            F.col("l_quantity").alias("point"),
        ).alias("o"),
    )
    markets = lines.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list("o").alias("outcomes"))
    books = markets.groupBy("l_orderkey", "l_returnflag").agg(
        F.collect_list(F.struct(F.col("l_linestatus").alias("key"), "outcomes")).alias("markets")
    )
    events = books.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_returnflag").alias("key"), F.lit("t").alias("title"), "markets")).alias("bookmakers")
    )
    return events.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), "bookmakers")).alias("payload"))


@query("flatten_nested", f"""SELECT CAST(l_orderkey AS VARCHAR) AS event_id, l_returnflag AS bookmaker, l_linestatus AS market, CAST(l_partkey AS VARCHAR) AS player_name,
CASE WHEN l_tax > 0.04e0 THEN 'Over' ELSE 'Under' END AS over_under, {r('l_quantity', 'line')}, {n('-100 - round(l_discount * 100)', 'odds')} FROM lineitem WHERE l_linenumber > 1""")
def flatten_nested(t):
    return N.flatten_nested(payloads(t), "payload")


_PV = f"""q AS (SELECT o_custkey, l_suppkey % 10 AS book, l_linestatus AS market, l_quantity AS line, -100 - round(l_discount * 100) AS odds, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0.04e0),
f AS (SELECT o_custkey, book, arg_min(line, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (market = 'F') AS f, arg_min(line, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (market = 'O') AS o,
  arg_min(odds, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (market = 'F') AS odds FROM q GROUP BY 1, 2)"""


@query("pivot_lines", f"WITH {_PV} SELECT o_custkey AS event_id, book AS bookmaker, {r('f', 'F')}, {r('o', 'O')}, {r('f + o', 'total_line')}, {r('odds', 'total_odds')} FROM f WHERE f IS NOT NULL AND o IS NOT NULL")
def pivot_lines(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    quotes = t.lineitem.join(o, "l_orderkey").select(
        F.col("o_custkey").alias("event_id"), F.lit("p").alias("player_name"), (F.col("l_suppkey") % 10).alias("bookmaker"),
        F.col("l_linestatus").alias("market"), F.when(F.col("l_tax") > 0.04, "Over").otherwise("Under").alias("over_under"),
        F.col("l_quantity").alias("line"), (-100 - F.round(F.col("l_discount") * 100)).alias("odds"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    out = N.pivot_lines(quotes, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ("F", "O"))
    return out.select("event_id", "bookmaker", "F", "O", "total_line", F.col("total_odds").cast("double"))


@query("incremental_ingest", """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, 'old' AS origin FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
m AS (SELECT max(o_orderdate) AS m FROM s), f AS (SELECT o_orderkey, o_custkey, o_orderdate, 'new' AS origin FROM orders, m WHERE o_orderdate > m)
SELECT * FROM s UNION ALL SELECT * FROM f""")
def incremental_ingest(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    stored = o.filter(F.col("o_orderdate") < cut).withColumn("origin", F.lit("old"))
    # The fetch overlaps what is stored.
    fetched = o.filter(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).withColumn("origin", F.lit("new"))
    return RD.incremental_ingest(stored, fetched, ["o_orderkey", "o_custkey"], "o_orderdate", ["o_orderdate"])


@query("write_table", f"WITH {O_SQL} SELECT o_orderkey, o_custkey, season, {r('v', 'v')} FROM o")
def write_table(t):
    path = work_path(t.spark, "table")
    W.write_table(orders(t), path, order_keys(t), "season")
    return t.spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("season").cast("string"), "v")


_CV_COUNT = "SELECT fold, split, CAST(count(*) AS BIGINT) AS rows, min(o_orderkey) AS first_key FROM cv GROUP BY 1, 2"


def _cv_sql():
    from chronoplane.plans.registry import REGISTRY

    return REGISTRY["season_cv"].sql


@query("write_folds", f"WITH cv AS ({_cv_sql()}) {_CV_COUNT}")
def write_folds(t):
    path = work_path(t.spark, "folds")
    W.write_folds(season_cv_frame(t), path)
    return RD.scan_folds(t.spark, path).groupBy(F.col("fold").cast("long").alias("fold"), F.col("split").cast("string").alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key")
    )


# MATERIALIZED: DuckDB 2.0 moves `fold = 1` below the row_number() that makes the fold and then counts wrongly.
@query("scan_folds", f"WITH cv AS MATERIALIZED ({_cv_sql()}) SELECT fold, split, o_orderkey FROM cv WHERE fold = 1")
def scan_folds(t):
    path = work_path(t.spark, "folds")
    W.write_folds(season_cv_frame(t), path)
    one = RD.scan_folds(t.spark, path, 1)
    return one.select(F.col("fold").cast("long"), F.col("split").cast("string"), "o_orderkey")


@query("fold_ids", f"WITH cv AS ({_cv_sql()}) SELECT DISTINCT fold FROM cv")
def fold_ids(t):
    return RD.fold_ids(season_cv_frame(t))


@query("write_csv", f"SELECT o_orderkey, o_orderstatus, {r('o_totalprice', 'o_totalprice')} FROM orders")
def write_csv(t):
    path = work_path(t.spark, "report")
    W.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return t.spark.read.option("header", True).schema("o_orderkey long, o_orderstatus string, o_totalprice double").csv(path)


# --- streams ---------------------------------------------------------------------------------------------

@query("stream_ingest", f"SELECT event_id, user_id, event_type, {r('value', 'value')} FROM events")
def stream_ingest(t):
    """The event table arrives twice, in two folders of files; every event is kept once."""
    spark, src = t.spark, work_path(t.spark, "arrivals")
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(src)
    e.write.mode("append").parquet(src)
    out = work_path(spark, "ingested")
    q = run_ingest(event_stream(spark, src, e.schema, files_per_trigger=1), out, work_path(spark, "ckpt"), ["event_id"])
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query("stream_ledger", """SELECT o_orderkey, CASE WHEN o_totalprice / 1000 > 200 THEN 'won' ELSE 'lost' END AS status FROM orders WHERE o_orderstatus <> 'P'""")
def stream_ledger(t):
    """Every order is an over bet at 200; results of the finished orders arrive as a stream, first wrong, then corrected downwards."""
    spark = t.spark
    ledger, arrivals, settled = (work_path(spark, x) for x in ("ledger", "results", "settled"))
    bets = t.orders.select(
        F.col("o_orderkey"), F.col("o_orderkey").alias("player_name"), F.to_date("o_orderdate").alias("bet_date"),
        F.lit(200.0).alias("betting_line"), F.lit("OVER").alias("direction"), F.lit(0.1).alias("kelly_size"), F.lit(0.05).alias("edge"),
    )
    L.ledger_append(bets, ledger, F.col("bet_date"), F.lit("2024-01-01").cast("timestamp"), keep="o_orderkey")
    done = t.orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("player_name"), F.to_date("o_orderdate").alias("bet_date"), (F.col("o_totalprice") / 1000).alias("actual"), F.lit(2).alias("version")
    )
    wrong = done.withColumns({"actual": F.col("actual") + 1000, "version": F.lit(1)})
    wrong.unionByName(done).repartition(4, "player_name").write.parquet(arrivals)
    stream = event_stream(spark, arrivals, done.schema, files_per_trigger=2)
    q = run_settle(stream, ledger, settled, work_path(spark, "ckpt"), newest="version")
    q.processAllAvailable()
    q.stop()
    return settled_bets(spark, settled).select("o_orderkey", "status")


