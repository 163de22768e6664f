"""Lagged statistics of one entity's own history. A feature of row t uses rows before t only."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple, day_number
from chronoplane.operators.timeline import (
    POSITION,
    Cols,
    Look,
    LookWith,
    Run,
    Running,
    compose,
    join_same,
    on_timeline,
)

# Window sizes in rows, half-lives in rows.
WINDOWS = (5, 10, 20)
HALF_LIVES = (3, 7, 14)


def rows_before(w, n: int):
    return w.rowsBetween(-n, -1)


def at_least(value: Column, agg: Column, w, k: int) -> Column:
    """`agg` over w where w holds at least k non-null values, else NULL."""
    return agg.over(w) if k <= 1 else F.when(F.count(value).over(w) >= k, agg.over(w))


def lag_roll_mean(df: DataFrame, keys: Keys, values, windows=WINDOWS, min_periods: int = 1) -> DataFrame:
    """Mean of the previous n non-null values: `<value>_mean_<n>`."""
    return _rolling(df, keys, values, windows, {"mean": F.avg}, min_periods)


def lag_roll_std(df: DataFrame, keys: Keys, values, windows=WINDOWS, min_periods: int = 1) -> DataFrame:
    """Sample deviation of the previous n values: `<value>_std_<n>`."""
    return _rolling(df, keys, values, windows, {"std": F.stddev_samp}, min_periods)


def lag_roll(df: DataFrame, keys: Keys, values, windows=WINDOWS, min_periods: int = 1) -> DataFrame:
    """Mean and deviation together; they share one exchange and one sort."""
    return _rolling(df, keys, values, windows, {"mean": F.avg, "std": F.stddev_samp}, min_periods)


def _rolling(df, keys, values, windows, aggs, min_periods):
    return on_timeline(df, keys, compose(roll_steps(values, windows, aggs, min_periods)), reach=max(windows))


def roll_steps(values, windows=WINDOWS, aggs=None, min_periods: int = 1):
    aggs = aggs or {"mean": F.avg, "std": F.stddev_samp}
    cols = {
        f"{v}_{name}_{n}": (
            lambda w, v=v, n=n, f=f: at_least(F.col(v), f(F.col(v)), rows_before(w, n), min_periods)
        )
        for v in as_tuple(values)
        for n in windows
        for name, f in aggs.items()
    }
    return lambda: iter([Look(max(windows), cols)])


def lag_ewma(df: DataFrame, keys: Keys, values, half_lives=HALF_LIVES) -> DataFrame:
    """Exponentially weighted mean of all earlier values: `<value>_ewma_<h>`."""
    return on_timeline(df, keys, compose(ewma_steps(values, half_lives)), reach=ewma_reach(half_lives))


def ewma_reach(half_lives) -> int:
    """Rows after which a weight is below 2^-64 and cannot change a double."""
    return math.ceil(64 * max(half_lives))


def ewma_steps(values, half_lives=HALF_LIVES):
    """Row i of the past weighs 2^(i/h); missing values keep their place; a row costs O(1).

    The weights are running sums inside runs of 900 h rows, because 2^(i/h) leaves the range of a double
    soon after. The sums of the runs just before are added, scaled down by their distance. They come from a
    range frame over the run number, which changes only when the run does.
    """
    values = as_tuple(values)
    run = int(900 * min(half_lives))
    back = math.ceil(64 * max(half_lives) / run)
    tags = {h: str(h).replace(".", "_") for h in half_lives}

    def add_means(df: DataFrame, part: list[str]) -> DataFrame:
        spec = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
        inside = Window.partitionBy(*part, "__run").orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("__run", F.floor(F.col(POSITION) / run).cast("long"))
        df = df.withColumn("__j", (F.col(POSITION) - F.col("__run") * run).cast("double"))
        local, means = {}, {}
        for h, tag in tags.items():
            weight = F.pow(F.lit(2.0), F.col("__j") / h)
            for v in values:
                x = F.col(v).cast("double")
                for kind, term in (("n", x * weight), ("d", F.when(x.isNotNull(), weight))):
                    local[f"__{kind}0_{v}_{tag}"] = F.sum(term).over(inside)
                    for i in range(1, back + 1):
                        earlier = spec.orderBy("__run").rangeBetween(-i, -i)
                        local[f"__{kind}{i}_{v}_{tag}"] = F.sum(term).over(earlier) * 2.0 ** (-i * run / h)
                n, d = (
                    reduce(add, [F.coalesce(F.col(f"__{k}{i}_{v}_{tag}"), F.lit(0.0)) for i in range(back + 1)])
                    for k in "nd"
                )
                means[f"{v}_ewma_{tag}"] = n / F.nullif(d, F.lit(0.0))
        return df.withColumns(local).withColumns(means).drop(*local, "__run", "__j")

    def family():
        yield LookWith(ewma_reach(half_lives), add_means)
        names = [f"{v}_ewma_{tag}" for v in values for tag in tags.values()]
        # After a stretch of missing values longer than the reach the last mean still stands.
        last = {
            f"__l_{c}": Running("max", F.when(F.col(c).isNotNull(), F.struct(F.col(POSITION), F.col(c).alias("m"))))
            for c in names
        }
        yield Run(last)
        yield Cols({c: F.coalesce(F.col(c), F.col(f"__l_{c}.m")) for c in names}, tuple(last))

    return family


def lag_trend(df: DataFrame, keys: Keys, values, window: int = 10, min_points: int = 3) -> DataFrame:
    """Least-squares slope per row over the previous `window` rows: `<value>_trend`."""
    return on_timeline(df, keys, compose(trend_steps(values, window, min_points)), reach=window)


def trend_steps(values, window: int = 10, min_points: int = 3):
    cols = {
        f"{v}_trend": lambda w, v=v: at_least(
            F.col(v), F.regr_slope(F.col(v), F.col(POSITION)), rows_before(w, window), min_points
        )
        for v in as_tuple(values)
    }
    return lambda: iter([Look(window, cols)])


def lag_split_mean(df: DataFrame, keys: Keys, values, flag: Column, window: int = 10,
                   names=("home", "away")) -> DataFrame:
    """Mean over the previous `window` rows of only the rows where flag holds, and of the others."""
    return on_timeline(df, keys, compose(split_steps(values, flag, window, names)), reach=window)


def split_steps(values, flag: Column, window: int = 10, names=("home", "away")):
    values = as_tuple(values)
    cols = {}
    for v in values:
        cols[f"{v}_{names[0]}_avg"] = lambda w, v=v: F.avg(F.when(flag, F.col(v))).over(rows_before(w, window))
        cols[f"{v}_{names[1]}_avg"] = lambda w, v=v: F.avg(F.when(~flag, F.col(v))).over(rows_before(w, window))
    return lambda: iter([Look(window, cols)])


def season_seq(df: DataFrame, keys: Keys, name: str = "games_this_season") -> DataFrame:
    """Number of earlier rows of the entity in the same season."""
    return on_timeline(df, keys, compose(season_steps(keys, name)))


def season_steps(keys: Keys, name: str = "games_this_season"):
    return lambda: iter([Run({name: Running("count", F.lit(1))}, as_tuple(keys.season))])


def gap_days(df: DataFrame, keys: Keys, name: str = "days_since_last", first: int | None = None) -> DataFrame:
    """Days since the entity's previous row; `first` where there is none (NULL when not given)."""
    return on_timeline(df, keys, compose(gap_steps(keys, name, first)))


def gap_steps(keys: Keys, name: str = "days_since_last", first: int | None = None):
    day = day_number(F.col(keys.time))

    def gap(w):
        days = day - F.lag(day).over(w)
        return days if first is None else F.coalesce(days, F.lit(first))

    return lambda: iter([Look(1, {name: gap})])


def gap_flags(df: DataFrame, keys: Keys, first: int = 3) -> DataFrame:
    """Gap in days and its classes: next day, one day between, three days or more."""
    return on_timeline(df, keys, compose(gap_flag_steps(keys, first)))


def gap_flag_steps(keys: Keys, first: int = 3):
    gap = F.col("days_since_last")
    flags = {
        # The gap classes in days.
        "is_back_to_back": (gap == 1).cast("int"),
        "is_one_day_rest": (gap == 2).cast("int"),
        "is_well_rested": (gap >= 3).cast("int"),
    }

    def family():
        yield from gap_steps(keys, "days_since_last", first)()
        yield Cols(flags)

    return family


def count_last_days(df: DataFrame, keys: Keys, days=(7, 14, 30), prefix: str = "games_last") -> DataFrame:
    """Earlier rows of the entity in [d - n, d) days: `<prefix>_<n>_days`.

    Rows are counted per (entity, day) first, so the range frame runs over at most one row per calendar
    day and the row-level join key is (entity, day).
    """
    part = [*keys.entity, "__day"]
    rows = df.withColumn("__day", day_number(F.col(keys.time)))
    per_day = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    base = Window.partitionBy(*keys.entity) if keys.entity else Window.partitionBy(F.lit(0))
    w = base.orderBy("__day")
    counted = per_day.select(
        *part,
        *[
            F.coalesce(F.sum("__n").over(w.rangeBetween(-n, -1)), F.lit(0)).cast("long").alias(f"{prefix}_{n}_days")
            for n in days
        ],
    )
    return join_same(rows, counted, part, "left").drop("__day")


def availability(df: DataFrame, keys: Keys, days: int = 30, expected: int = 12) -> DataFrame:
    """Share of the expected events seen in the last `days` days, as 0 to 100."""
    counted = count_last_days(df, keys, (days,), "games_played_last")
    n = F.col(f"games_played_last_{days}_days")
    return counted.withColumn("availability_score", F.least(F.lit(100.0), n / F.lit(expected) * 100))


# The band of form_flags, the limits of minutes_context.
BAND, HIGH_MINUTES, LOW_MINUTES = 0.1, 28, 20


def form_flags(df: DataFrame, keys: Keys, value: str, band: float = BAND) -> DataFrame:
    """Last value and last-three mean against the mean of the season so far.

    The lag and the three-row mean run across seasons; only the season mean restarts.
    """
    return on_timeline(df, keys, compose(form_steps(keys, value, band)), reach=3)


def form_steps(keys: Keys, value: str, band: float = BAND):
    x = F.col(value)
    mean = F.col("__s") / F.nullif(F.col("__c"), F.lit(0))
    no = F.lit(False)

    def family():
        yield Look(
            3,
            {
                "__last": lambda w: F.lag(x).over(w),
                "__last3": lambda w: F.avg(x).over(rows_before(w, 3)),
            },
        )
        yield Run({"__s": Running("sum", x.cast("double")), "__c": Running("count", x)}, as_tuple(keys.season))
        yield Cols(
            {
                "last_game_above_avg": F.coalesce(F.col("__last") > mean, no).cast("int"),
                "hot_last_3_games": F.coalesce(F.col("__last3") > mean * (1 + band), no).cast("int"),
                "cold_last_3_games": F.coalesce(F.col("__last3") < mean * (1 - band), no).cast("int"),
            },
            ("__last", "__last3", "__s", "__c"),
        )

    return family


def minutes_context(df: DataFrame, keys: Keys, minutes: str, high: float = HIGH_MINUTES, low: float = LOW_MINUTES) -> DataFrame:
    """Previous playing time, its five-row mean and deviation, and high / low flags."""
    return on_timeline(df, keys, compose(minutes_steps(minutes, high, low)), reach=5)


def minutes_steps(minutes: str, high: float = HIGH_MINUTES, low: float = LOW_MINUTES):
    m, avg, no = F.col(minutes), F.col("minutes_avg_last5"), F.lit(False)
    frames = {
        "minutes_last_game": lambda w: F.lag(m).over(w),
        "minutes_avg_last5": lambda w: F.avg(m).over(rows_before(w, 5)),
        "minutes_std_last5": lambda w: F.stddev_samp(m).over(rows_before(w, 5)),
    }
    flags = {
        "is_high_minutes": F.coalesce(avg >= high, no).cast("int"),
        "is_low_minutes": F.coalesce(avg < low, no).cast("int"),
    }
    return lambda: iter([Look(5, frames), Cols(flags)])


def seasons_available(df: DataFrame, keys: Keys, value: str, name: str = "seasons_available",
                      distinct_seasons: bool = False) -> DataFrame:
    """Earlier rows of the entity with the value present; or earlier seasons with at least one such row."""
    present = F.col(value).isNotNull()
    if not distinct_seasons:
        return on_timeline(
            df, keys, lambda t: t.running({name: Running("count", F.when(present, F.lit(1)))})
        )
    per_season = df.groupBy(*keys.entity, keys.season).agg(F.max(present.cast("int")).alias("__has"))
    w = Window.partitionBy(*keys.entity).orderBy(keys.season).rowsBetween(Window.unboundedPreceding, -1)
    seen = per_season.withColumn(name, F.coalesce(F.sum("__has").over(w), F.lit(0)).cast("long")).drop("__has")
    return join_same(df, seen, [*keys.entity, keys.season], "left")


def mid_series_row(df: DataFrame, keys: Keys, features, position: int = 15) -> DataFrame:
    """Per feature: entities that reach row number `position` and those where it is still empty there."""
    rows = on_timeline(df, keys, lambda t: t.position("__at")).filter(F.col("__at") == position)
    features = as_tuple(features)
    one = rows.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in features]
    )
    return (
        one.unpivot(["__n"], list(features), "feature", "n_empty")
        .withColumnRenamed("__n", "n_entities")
        .withColumn("empty_share", F.col("n_empty") / F.nullif(F.col("n_entities"), F.lit(0)))
    )


def rolling_table(df: DataFrame, keys: Keys, values, flag: Column | None = None, windows=WINDOWS,
                  half_lives=HALF_LIVES, trend_window: int = 10) -> DataFrame:
    """All rolling features of the values in one pass over the sorted history."""
    parts = [roll_steps(values, windows), trend_steps(values, trend_window)]
    if flag is not None:
        parts.append(split_steps(values, flag))
    reach = max(*windows, trend_window, 10)
    if half_lives:
        parts.append(ewma_steps(values, half_lives))
        reach = max(reach, ewma_reach(half_lives))
    return on_timeline(df, keys, compose(*parts), reach=reach)
