"""Joins between facts, reference data, feature tables and quoted lines."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.functions.cleaning import season_lookup
from chronoplane.keys import Keys, as_tuple, day_number, in_days
from chronoplane.operators.timeline import Running, join_same, on_timeline


def unique_or_fail(df: DataFrame, grain) -> DataFrame:
    """The table with a check that fails the job when a key occurs twice.

    The check is a count over the key, so it uses the exchange that the join needs anyway.
    """
    grain = as_tuple(grain)
    n = F.count(F.lit(1)).over(Window.partitionBy(*grain))
    marked = df.withColumn("__dup", n)
    bad = F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws("|", *[F.col(g).cast("string") for g in grain])))
    return marked.withColumn("__dup", F.when(F.col("__dup") > 1, bad.cast("long")).otherwise(F.col("__dup"))).filter(
        F.col("__dup") == 1
    ).drop("__dup")


def join_master(base: DataFrame, tables, grain, check: bool = True) -> DataFrame:
    """Base with every feature table on the grain, one row per base row.

    All joins share the key, so the base is exchanged once. A feature column that the base or an earlier
    table already has is not added a second time.
    """
    grain = as_tuple(grain)
    out = base
    for table in tables:
        new = [c for c in table.columns if c not in out.columns]
        side = table.select(*grain, *new)
        out = out.join(unique_or_fail(side, grain) if check else side, list(grain), "left")
    return out


def join_prev_season(facts: DataFrame, reference: DataFrame, name: str, season: str, most: str) -> DataFrame:
    """Reference columns of the season before, so that no same-season statistic is seen: `prev_<column>`.

    A name that occurs twice in a reference season (moved during it) counts with its largest `most` row.
    The join key (name, season) is as fine as the reference; no side is broadcast by hand.
    """
    once = dedup_max(reference, [name, season], most)
    payload = [c for c in once.columns if c not in (name, season)]
    side = once.select(
        F.col(name), F.col(season).alias("__prev"), *[F.col(c).alias(f"prev_{c}") for c in payload]
    )
    return facts.withColumn("__prev", season_lookup(season)).join(side, [name, "__prev"], "left").drop("__prev")


def dedup_max(df: DataFrame, key, most: str) -> DataFrame:
    """One row per key with the largest `most`; ties go to the largest other columns in order.

    An aggregate of whole rows, so duplicates are removed map-side.
    """
    key = as_tuple(key)
    rest = [c for c in df.columns if c not in key and c != most]
    best = F.max(F.struct(F.col(most), *[F.col(c) for c in rest])).alias("__best")
    return df.groupBy(*key).agg(best).select(*key, "__best.*").select(*df.columns)


def dedup_first(df: DataFrame, key, order) -> DataFrame:
    """One row per key: the first in `order` (columns that exist in the table), also as an aggregate."""
    key, order = as_tuple(key), as_tuple(order)
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("__best")
    return df.groupBy(*key).agg(best).select(*key, "__best.*").select(*df.columns)


def join_baselines(df: DataFrame, baselines: DataFrame, category: str) -> DataFrame:
    """Baselines (one row per category) to rows."""
    return join_same(df, baselines, [category], "left")


def first_line(odds: DataFrame, key, order, values) -> DataFrame:
    """First non-null value per column and key, in `order`."""
    at = F.struct(*[F.col(c) for c in as_tuple(order)])
    return odds.groupBy(*as_tuple(key)).agg(
        *[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(v) for v in as_tuple(values)]
    )


def join_lines(predictions: DataFrame, odds: DataFrame, key, order, values, line: str) -> DataFrame:
    """Predictions with the first quoted line per key, and whether there is one."""
    lines = first_line(odds, key, order, values)
    return predictions.join(lines, list(as_tuple(key)), "left").withColumn("has_line", F.col(line).isNotNull())


def join_multi_line(predictions: DataFrame, odds: DataFrame, key, line: str, odds_col: str, prediction: str,
                    default_odds: float = -110) -> DataFrame:
    """Predictions with every source's line (1:N); the prediction stands in for a missing line."""
    out = predictions.join(odds, list(as_tuple(key)), "left")
    return out.withColumns(
        {
            "line_for_prob": F.coalesce(F.col(line), F.col(prediction)),
            odds_col: F.coalesce(F.col(odds_col), F.lit(default_odds)),
        }
    )


def pick_preferred(df: DataFrame, key, source: str, preferred, order) -> DataFrame:
    """Per key the row of the first preferred source present; keys with none are dropped."""
    key = as_tuple(key)
    rank = reduce(
        lambda case, ip: case.when(F.lower(F.col(source)) == ip[1], ip[0]),
        list(enumerate(preferred))[1:],
        F.when(F.lower(F.col(source)) == preferred[0], 0),
    )
    named = df.withColumn("__rank", rank).filter(F.col("__rank").isNotNull())
    return dedup_first(named, key, ["__rank", *as_tuple(order)]).drop("__rank")


def asof_latest(facts: DataFrame, keys: Keys, columns, before, entities: DataFrame | None = None) -> DataFrame:
    """Latest non-null value per column strictly before one date, for the listed entities.

    A map-side aggregate: one struct maximum per column.
    """
    rows = facts.filter(F.col(keys.time) < before)
    if entities is not None:
        rows = rows.join(entities.select(*keys.entity).distinct(), list(keys.entity), "left_semi")
    at = F.struct(F.col(keys.time), *[F.col(e) for e in keys.event])
    return rows.groupBy(*keys.entity).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in as_tuple(columns)],
        F.max(keys.time).alias("latest_time"),
    )


def asof_join(targets: DataFrame, facts: DataFrame, keys: Keys, columns) -> DataFrame:
    """Latest non-null value per column strictly before each target row's own time.

    Both tables are put on one timeline; facts carry values, targets carry NULL and sort before facts of the
    same time. The latest value is a running maximum of (position, value), so huge histories are cut safely.
    """
    columns = as_tuple(columns)
    extra = [c for c in targets.columns if c not in (*keys.entity, keys.time)]
    left = targets.select(
        *keys.entity, keys.time, F.lit(0).alias("__side"), F.struct(*extra).alias("__t") if extra else F.lit(None).alias("__t"),
        F.monotonically_increasing_id().alias("__tie"), *[F.lit(None).alias(c) for c in columns],
    )
    right = facts.select(
        *keys.entity, keys.time, F.lit(1).alias("__side"), F.lit(None).alias("__t"),
        F.struct(*keys.event).alias("__e"), *columns,
    )
    both = left.unionByName(right, allowMissingColumns=True)
    line = keys.with_(event=("__side", "__e", "__tie"))

    def steps(t):
        t = t.position("__pos")
        return t.running(
            {
                f"__l_{c}": Running("max", F.when(F.col(c).isNotNull(), F.struct(F.col("__pos"), F.col(c).alias("v"))))
                for c in columns
            }
        )

    out = on_timeline(both, line, steps).filter(F.col("__side") == 0)
    return out.select(
        *keys.entity, keys.time, *([f"__t.{c}" for c in extra]), *[F.col(f"__l_{c}.v").alias(c) for c in columns]
    )


def semi_in(df: DataFrame, wanted: DataFrame, key) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(wanted.select(*as_tuple(key)), list(as_tuple(key)), "left_semi")


def training_window(df: DataFrame, time: str, date, years: int = 3) -> DataFrame:
    """Rows in [date - 365 years, date) for one prediction date; the filter reaches the scan."""
    end = dt.date.fromisoformat(str(date))
    return in_days(df, time, end - dt.timedelta(days=365 * years), end)


def window_range_join(dates: DataFrame, date: str, facts: DataFrame, time: str, value: str, days: int = 365 * 3,
                      by=()) -> DataFrame:
    """Count, mean and deviation of the facts in [d - days, d) for every date d, per group.

    Facts are summed per day and the range frame runs over days, so no fact row is repeated per date. Sums are
    taken around the mean of the group, which changes no result and keeps the squares small.
    """
    by = list(as_tuple(by))
    mean = F.coalesce(F.avg(F.col(value).cast("double")), F.lit(0.0)).alias("__m")
    if by:
        facts = join_same(facts, facts.groupBy(*by).agg(mean), by)
    else:
        facts = facts.withColumn("__m", facts.agg(mean).scalar())
    x = F.col(value).cast("double") - F.col("__m")
    per_day = facts.groupBy(*by, day_number(F.col(time)).alias("__day")).agg(
        F.count(x).alias("__n"), F.sum(x).alias("__s"), F.sum(x * x).alias("__q"), F.max("__m").alias("__m")
    )
    wanted = dates.select(*by, date).distinct().withColumn("__day", day_number(F.col(date)))
    both = per_day.unionByName(wanted, allowMissingColumns=True)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy("__day").rangeBetween(-days, -1)
    n, s, q = [F.sum(c).over(w) for c in ("__n", "__s", "__q")]
    sums = both.select(*by, date, n.alias("train_rows"), s.alias("__s"), q.alias("__q"), F.max("__m").over(w).alias("__m")).filter(F.col(date).isNotNull())
    rows = F.coalesce(F.col("train_rows"), F.lit(0))
    spread = F.greatest(F.col("__q") - F.col("__s") * F.col("__s") / F.nullif(rows, F.lit(0)), F.lit(0.0))
    return sums.select(
        *by,
        date,
        rows.alias("train_rows"),
        F.when(rows > 0, F.col("__s") / rows + F.col("__m")).alias("train_mean"),
        F.when(rows > 1, F.sqrt(spread / (rows - 1))).alias("train_std"),
    )


def name_coverage(left: DataFrame, right: DataFrame, left_name: Column, right_name: Column) -> DataFrame:
    """Matched, left-only and right-only distinct names and the matched share of the left, in percent."""
    a = left.select(left_name.alias("__k")).distinct().withColumn("__a", F.lit(1))
    b = right.select(right_name.alias("__k")).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, "__k", "full_outer")
    has_a, has_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    one = both.agg(
        F.count_if(has_a & has_b).alias("matched"),
        F.count_if(has_a & ~has_b).alias("left_only"),
        F.count_if(~has_a & has_b).alias("right_only"),
    )
    left_names = F.col("matched") + F.col("left_only")
    return one.withColumn("match_rate", F.coalesce(F.col("matched") / F.nullif(left_names, F.lit(0)) * 100, F.lit(0.0)))
