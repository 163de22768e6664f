"""Gaps, absences and returns in one entity's history.

Counters that restart (rows since a gap, run length) are the distance to the latest restart, which is a
running maximum of row positions: one window, no second grouping by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.keys import Keys, day_number
from chronoplane.operators.history import at_least, gap_steps, rows_before
from chronoplane.operators.timeline import POSITION, Cols, Look, Run, Running, compose, join_same, on_timeline

# Gap above which rows were missed, longest gap inside a season, gap that restarts the
# counter (days); playing time below which a row counts as not played; rate that means planned rest.
MISSED_GAP_DAYS = 7
MISSED_MAX_DAYS = 30
RESET_GAP_DAYS = 10
NOT_PLAYED_BELOW = 3.0
REST_RATE = 0.15


def missed_events(df: DataFrame, keys: Keys, gap: int = MISSED_GAP_DAYS, longest: int = MISSED_MAX_DAYS) -> DataFrame:
    """Flag a gap in (gap, longest] days and estimate the events missed as half a day each beyond three."""
    return on_timeline(df, keys, compose(missed_steps(keys, gap, longest)))


def missed_steps(keys: Keys, gap: int = MISSED_GAP_DAYS, longest: int = MISSED_MAX_DAYS,
                 gap_name: str | None = "days_since_last"):
    days = F.col("__missed_gap")
    flagged = F.coalesce((days > gap) & (days <= longest), F.lit(False))
    cols = {
        "likely_missed": flagged.cast("int"),
        "estimated_missed": F.when(flagged, F.greatest((days - 3) * 0.5, F.lit(0.0))).otherwise(F.lit(0.0)),
    }
    if gap_name:
        cols[gap_name] = days

    def family():
        yield from gap_steps(keys, "__missed_gap")()
        yield Cols(cols, ("__missed_gap",))

    return family


def events_since_reset(df: DataFrame, keys: Keys, gap: int = RESET_GAP_DAYS) -> DataFrame:
    """Rows since the last gap of more than `gap` days (0 on the row after it), and the early-return flags."""
    return on_timeline(df, keys, compose(reset_steps(keys, gap)))


def reset_steps(keys: Keys, gap: int = RESET_GAP_DAYS):
    day = day_number(F.col(keys.time))
    n = F.col("games_since_reset")

    def family():
        yield Look(1, {"__gap": lambda w: day - F.lag(day).over(w)})
        restart = F.when(F.coalesce(F.col("__gap") > gap, F.lit(False)), F.col(POSITION))
        yield Run({"__at": Running("max", restart, prior=False)})
        yield Cols({"games_since_reset": F.col(POSITION) - F.coalesce(F.col("__at"), F.lit(0))}, ("__gap", "__at"))
        yield Cols(
            # Rows that count as returning and as early after a return.
            {"is_returning": ((n > 0) & (n <= 5)).cast("int"), "is_early_return": ((n > 0) & (n <= 2)).cast("int")}
        )

    return family


def _run_length(holds: Column, last_break: str) -> Column:
    """Length of the current run of rows where `holds`, given the position of the last row where it fails."""
    return F.when(holds, F.col(POSITION) - F.coalesce(F.col(last_break), F.lit(-1))).otherwise(F.lit(0)).cast("long")


def dnp_patterns(
    df: DataFrame,
    keys: Keys,
    minutes: str,
    rows: int | None = 30,
    days: int | None = None,
    threshold: float = NOT_PLAYED_BELOW,
    rate: float = REST_RATE,
    lag: bool = False,
) -> DataFrame:
    """Not-played flag, its rate over the previous rows (or days), planned-rest flag and run of played rows.

    The flag, the rest flag and the run read the current row, as a report on the past wants them;
    `lag=True` shifts these three one row back so that they can be used as features.
    """
    out = on_timeline(df, keys, compose(dnp_steps(minutes, rows, days, threshold, rate, lag)), reach=rows or 1)
    if days is None:
        return out
    m = F.col(minutes)
    return _day_rate(out, df, keys, F.coalesce(m < threshold, F.lit(False)), days, rate, m)


def dnp_steps(minutes: str, rows: int | None = 30, days: int | None = None, threshold: float = NOT_PLAYED_BELOW,
              rate: float = REST_RATE, lag: bool = False):
    m = F.col(minutes)
    not_played = F.coalesce(m < threshold, F.lit(False))

    def family():
        yield Cols({"__np": not_played.cast("int")})
        if days is None:
            yield Look(rows, {"dnp_rate": lambda w: F.avg("__np").over(rows_before(w, rows))})
        broken = F.when(F.col("__np") == 1, F.col(POSITION))
        yield Run({"__np_at": Running("max", broken, prior=False)})
        same_row = {
            "is_dnp": F.col("__np"),
            "consecutive_played": _run_length(F.col("__np") == 0, "__np_at"),
        }
        if days is None:
            rested = (F.col("dnp_rate") > rate) & (m > 0)
            same_row["likely_rested"] = F.coalesce(rested, F.lit(False)).cast("int")
        yield Cols(same_row, ("__np", "__np_at"))
        if lag:
            yield from _one_back(same_row)

    return family


def _one_back(names):
    """Move columns one row back, as `<name>_prev`."""
    yield Look(1, {f"{c}_prev": (lambda w, c=c: F.lag(c).over(w)) for c in names})
    yield Cols({}, tuple(names))


def _day_rate(out, df, keys, not_played, days, rate, minutes):
    part = [*keys.entity, "__day"]
    per_day = (
        df.withColumn("__day", day_number(F.col(keys.time)))
        .groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__n"), F.count_if(not_played).alias("__m"))
    )
    w = Window.partitionBy(*keys.entity).orderBy("__day").rangeBetween(-days, -1)
    rates = per_day.select(*part, (F.sum("__m").over(w) / F.sum("__n").over(w)).alias("dnp_rate"))
    joined = join_same(out.withColumn("__day", day_number(F.col(keys.time))), rates, part, "left").drop("__day")
    return joined.withColumn(
        "likely_rested", F.coalesce((F.col("dnp_rate") > rate) & (minutes > 0), F.lit(False)).cast("int")
    )


def recovery(df: DataFrame, keys: Keys, minutes: str, share: float = 0.8, ramp: float = 2.0, lag: bool = False) -> DataFrame:
    """Expected playing time, deficit, ramp-up flag and run of rows well below the expectation.

    Expected is the mean of the previous ten rows once three are there. The ramp is the change over the
    previous three rows per row. Deficit and run read the current row; `lag=True` shifts them one back.
    """
    return on_timeline(df, keys, compose(recovery_steps(minutes, share, ramp, lag)), reach=10)


def recovery_steps(minutes: str, share: float = 0.8, ramp: float = 2.0, lag: bool = False):
    m = F.col(minutes)

    def family():
        yield Look(
            10,
            {
                "expected_minutes": lambda w: at_least(m, F.avg(m), rows_before(w, 10), 3),
                "minutes_ramp": lambda w: (F.lag(m, 1).over(w) - F.lag(m, 3).over(w)) / 3,
            },
        )
        expected = F.col("expected_minutes")
        yield Cols({"__low": F.coalesce(m < expected * share, F.lit(False))})
        yield Run({"__low_at": Running("max", F.when(~F.col("__low"), F.col(POSITION)), prior=False)})
        deficit = F.when(expected.isNotNull() & m.isNotNull(), F.greatest(expected - m, F.lit(0.0)))
        run = _run_length(F.col("__low"), "__low_at")
        yield Cols(
            {
                "minutes_deficit": deficit,
                "is_ramping_up": F.coalesce(F.col("minutes_ramp") > ramp, F.lit(False)).cast("int"),
                "restriction_run": run,
                "is_restricted": (run >= 2).cast("int"),
            },
            ("__low", "__low_at"),
        )
        if lag:
            yield from _one_back(["minutes_deficit", "restriction_run", "is_restricted"])

    return family
