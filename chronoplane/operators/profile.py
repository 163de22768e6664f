"""Coverage and distribution reports over an event table. Aggregates with partial combine throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import Keys, day_number
from chronoplane.operators.quantiles import exact_quantiles, medians
from chronoplane.operators.timeline import join_same, on_timeline

# Share of the expected events below which a season is short, last regular month.
SHORT_SEASON, LAST_MONTH = 0.8, 6


def season_coverage(df: DataFrame, season: str, event: str, entity: str, time: str, expected: Column,
                    short: float = SHORT_SEASON, last_month: int = LAST_MONTH, approximate: bool = False) -> DataFrame:
    """Events, entities and first/last time per season; flags short seasons and seasons that end late.

    `approximate` counts with sketches: one small exchange instead of one row per distinct value.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    per = df.groupBy(season).agg(
        distinct(event).alias("events"),
        distinct(entity).alias("entities"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )
    return per.withColumns(
        {
            "is_short": F.coalesce(F.col("events") < expected * short, F.lit(False)),
            "ends_late": F.month("last_time") > last_month,
        }
    )


def expected_events(season: str, normal: float, exceptions: dict[str, float]) -> Column:
    """Expected number of events of a season label, with named exceptions."""
    case = F.lit(None)
    for label, n in exceptions.items():
        case = F.coalesce(case, F.when(F.col(season) == label, F.lit(float(n))))
    return F.coalesce(case, F.lit(float(normal)))


def events_per_entity(df: DataFrame, entity: str, limits=(5, 10), hot_rows: int | None = 1_000_000) -> DataFrame:
    """Distribution of the number of rows per entity, and how many entities stay below each limit."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    summary = per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("n").alias("mean_rows"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        *[F.count_if(F.col("n") < k).alias(f"below_{k}") for k in limits],
    )
    median = exact_quantiles(per, "n", {"median_rows": 0.5}, hot_rows=hot_rows).select("median_rows").scalar()
    return summary.withColumn("median_rows", median)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness, as data frames report it."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def target_distribution(df: DataFrame, value: str, by=(), hot_rows: int | None = 1_000_000) -> DataFrame:
    """Rows, mean, deviation, extremes, skewness and exact quantiles."""
    by = [by] if isinstance(by, str) else list(by)
    x = F.col(value)
    moments = df.groupBy(*by).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        sample_skewness(x).alias("skew"),
    )
    quantiles = exact_quantiles(
        df, value, {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}, by, hot_rows
    )
    if by:
        return join_same(moments, quantiles, by, "left")
    q = quantiles.select(F.struct(*quantiles.columns).alias("q")).scalar()
    return moments.withColumns({c: q.getField(c) for c in quantiles.columns})


def drift_by_season(df: DataFrame, season: str, value: str, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Per season mean, median, deviation and rows, with the spread of the season means over all seasons."""
    per = df.groupBy(season).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )
    med = medians(df, value, season, hot_rows).select(season, "median")
    out = join_same(per, med, [season], "left")
    spread = per.agg((F.max("mean") - F.min("mean")).alias("d")).scalar()
    return out.withColumn("mean_drift", spread)


def multi_team_seasons(df: DataFrame, entity: str, season: str, team: Column) -> DataFrame:
    """Entity-seasons with more than one distinct team."""
    return (
        df.groupBy(entity, season)
        .agg(F.count_distinct(team).alias("num_teams"))
        .filter(F.col("num_teams") > 1)
    )


def high_variance_entities(df: DataFrame, entity: str, value: str, least_rows: int = 20, cv: float = 1.0,
                           top: int | None = 5) -> DataFrame:
    """Entities whose deviation exceeds their mean, most variable first."""
    per = df.groupBy(entity).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )
    out = per.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).filter(
        (F.col("cv") > cv) & (F.col("n") >= least_rows)
    )
    return out if top is None else out.orderBy(F.col("cv").desc(), F.col(entity)).limit(top)


def cohort_counts(df: DataFrame, entity: str, season: str) -> DataFrame:
    """New entities per season."""
    first = df.groupBy(entity).agg(F.min(season).alias(season))
    return first.groupBy(season).agg(F.count(F.lit(1)).alias("new_entities"))


def events_per_day(df: DataFrame, time: str, event: str) -> DataFrame:
    """Days, mean and extreme number of distinct events per day."""
    per = df.groupBy(F.to_date(time).alias("__d")).agg(F.count_distinct(event).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("n").alias("mean_events"),
        F.min("n").alias("min_events"),
        F.max("n").alias("max_events"),
    )


def conditional_means(df: DataFrame, keys: Keys, value: str, played: Column, long_gap: int = 30) -> DataFrame:
    """Mean after a long gap, share and mean of next-day rows against all rows, share of rows not played."""
    day = day_number(F.col(keys.time))
    rows = on_timeline(df, keys, lambda t: t.look_back(1, {"__gap": lambda w: day - F.lag(day).over(w)}))
    gap, x = F.col("__gap"), F.col(value)
    return rows.agg(
        F.count_if(gap > long_gap).alias("long_gap_rows"),
        F.avg(F.when(gap > long_gap, x)).alias("mean_after_long_gap"),
        F.count_if(gap == 1).alias("next_day_rows"),
        (F.count_if(gap == 1) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("next_day_share"),
        (F.avg(F.when(gap == 1, x)) - F.avg(x)).alias("next_day_diff"),
        F.avg(x).alias("mean_all"),
        (F.count_if(~played) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("zero_share"),
    )
