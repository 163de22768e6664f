"""Reading stored tables, season files and odds files."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoplane.functions.cleaning import season_id_decode, season_label, to_date_coerce

# Season in a file or folder name (2023-24 or 2023_24).
SEASON_PATTERN = r"(\d{4})[-_](\d{2})"

ODDS_SCHEMA = T.StructType(
    [
        T.StructField("player_name", T.StringType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("line", T.DoubleType()),
        T.StructField("bookmaker", T.StringType()),
        T.StructField("over_price", T.DoubleType()),
        T.StructField("under_price", T.DoubleType()),
    ]
)


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND",)


def scan_parquet(spark: SparkSession, path: str, season: str | None = None, seasons=None,
                 schema: T.StructType | None = None, missing_ok: bool = False) -> DataFrame | None:
    """Stored table, optionally only some seasons; the filter prunes partitions or row groups.

    An absent path is an error, or None with `missing_ok`.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        df = reader.parquet(path)
    except AnalysisException as error:
        if missing_ok and _absent(error):
            return None
        raise
    return df.filter(F.col(season).isin(list(seasons))) if season and seasons else df


def reconcile_columns(columns: list[str]) -> list[tuple[str, str]]:
    """Pairs (column as read, upper-case name); a mixed-case twin of an upper-case column is left out."""
    exact = {c for c in columns if c == c.upper()}
    taken: dict[str, str] = {}
    for c in columns:
        upper = c.upper()
        if c != upper and upper in exact:
            continue
        taken.setdefault(upper, c)
    return [(raw, upper) for upper, raw in taken.items()]


def _season_of(path: Column) -> Column:
    """The season that a path names last: in its file name, else in the nearest folder that has one."""
    found = F.regexp_extract(path, rf"^.*(?<![0-9A-Za-z]){SEASON_PATTERN}(?![0-9A-Za-z])", 1), F.regexp_extract(path, rf"^.*(?<![0-9A-Za-z]){SEASON_PATTERN}(?![0-9A-Za-z])", 2)
    return F.when(found[0] != "", F.concat(found[0], F.lit("-"), found[1]))


def _headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Column names of each file; the first lines are found in one distributed pass, a line per file reaches the driver."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.where("start = 0").withColumn("at", F.monotonically_increasing_id())
    first = placed.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    return {unquote(r["path"]): next(csv.reader([r["line"]])) for r in first.toLocalIterator()}


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, without reading them; a few names per season."""
    try:
        return sorted(map(unquote, spark.read.text(pattern).inputFiles()))
    except AnalysisException as error:
        if not _absent(error):
            raise
        return []


def scan_csv_multi(spark: SparkSession, pattern: str, seasons=None, defaults: dict[str, object] | None = None,
                   types: dict[str, str] | None = None) -> DataFrame:
    """Season files whose columns differ, as one table of upper-case columns with `SEASON`.

    Files with the same header are read together; the header line is all the driver looks at. The season is the
    column if the file has it, else what SEASON_ID says, else GAME_DATE, else the file name. Values are cast by
    `types`, bad ones to NULL.
    """
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for f, columns in sorted(_headers(spark, files).items()):
        by_header.setdefault(tuple(columns), []).append(f)
    tables = []
    for header, group in by_header.items():
        # Columns are read by place under names that differ in more than their case.
        places = {c: f"c{i}" for i, c in enumerate(header)}
        schema = T.StructType([T.StructField(places[c], T.StringType()) for c in header])
        raw = spark.read.option("header", True).schema(schema).csv(group)
        names = reconcile_columns(list(header))
        cols = [F.col(places[source]).alias(name) for source, name in names]
        by_name = {name: F.col(places[source]) for source, name in names}
        if "SEASON" not in by_name:
            known = []
            if "SEASON_ID" in by_name:
                known.append(season_id_decode(by_name["SEASON_ID"]))
            if "GAME_DATE" in by_name:
                known.append(season_label(to_date_coerce(by_name["GAME_DATE"])))
            cols.append(F.coalesce(*known, _season_of(F.col("_metadata.file_path"))).alias("SEASON"))
        tables.append(raw.select(*cols))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    for name, kind in (types or {}).items():
        out = out.withColumn(name, F.col(name).try_cast(kind))
    return out.filter(F.col("SEASON").isin(list(seasons))) if seasons else out


def scan_partition_dirs(spark: SparkSession, pattern: str, schema: T.StructType, name: str = "season") -> DataFrame:
    """CSV files in season folders as one table, with the season taken from the path."""
    raw = spark.read.option("header", True).schema(schema).csv(pattern)
    return raw.withColumn(name, _season_of(F.col("_metadata.file_path")))


def scan_odds(spark: SparkSession, path: str, schema: T.StructType = ODDS_SCHEMA) -> DataFrame:
    """Quoted lines with a real date; an empty table when there is no file."""
    try:
        df = spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        df = spark.createDataFrame([], schema)
    return df.withColumn("event_date", F.to_date("event_date"))


def scan_latest(df: DataFrame, run: str, date=None) -> DataFrame:
    """Rows of one run, or of the newest. On a table partitioned by the run only that partition is read."""
    if date is not None:
        return df.filter(F.col(run) == F.lit(date))
    return df.filter(F.col(run) == df.agg(F.max(run)).scalar())


def scan_folds(spark: SparkSession, path: str, fold: int | None = None) -> DataFrame:
    """Stored folds, or one of them; a fold with an empty part fails."""
    df = spark.read.parquet(path)
    if fold is None:
        return df
    one = df.filter(F.col("fold") == fold)
    parts = ("train", "val", "test")
    found = one.agg(*[F.count_if(F.col("split") == p).alias(p) for p in parts]).first()
    empty = {p for p in parts if not found[p]}
    if empty:
        raise ValueError(f"fold {fold} has no rows in {sorted(empty)}")
    return one


def fold_ids(df: DataFrame) -> DataFrame:
    return df.select("fold").distinct().orderBy("fold")


def incremental_ingest(stored: DataFrame, new: DataFrame, grain, time: str, tie) -> DataFrame:
    """Stored rows plus the new rows after the last stored time; a repeated key keeps its latest row.

    The stored table has each key once, because every ingest leaves it so. Only the new rows are grouped, and
    the stored rows only lose the keys that come again: a join with the small side, not a regrouping of all.
    """
    grain, tie = list(grain), list(tie)
    last = stored.agg(F.max(time)).scalar()
    fresh = new.filter(last.isNull() | (F.col(time) > last))
    rest = [c for c in fresh.columns if c not in (*grain, *tie)]
    lead = [c for c in tie if c not in grain]
    best = F.max(F.struct(*[F.col(c) for c in (*lead, *rest)])).alias("__b")
    latest = fresh.groupBy(*grain).agg(best).select(*grain, "__b.*")
    kept = stored.join(latest.select(*grain), grain, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True).select(*stored.columns)
