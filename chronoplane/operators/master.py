"""The master feature table of an entity in one pass.

The feature families of one entity share its partitioning and order, so they are steps on one timeline: one
exchange and one sort instead of a table and a join per family. Families with another key (opponent, team,
category) are joined with `join_master`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from chronoplane.keys import Keys
from chronoplane.operators import absence as A
from chronoplane.operators import history as H
from chronoplane.operators.timeline import compose, on_timeline


def entity_features(df: DataFrame, keys: Keys, values, form: str, minutes: str, flag: Column | None = None,
                    windows=H.WINDOWS, half_lives=H.HALF_LIVES) -> DataFrame:
    """Rolling, season, rest, form, playing-time, absence and recovery features of every row.

    Columns that read the row itself (not played, deficits, runs) are lagged by one row, so everything added
    here may be used to predict the row.
    """
    steps = [
        H.roll_steps(values, windows),
        H.trend_steps(values),
        H.gap_flag_steps(keys),
        A.missed_steps(keys, gap_name=None),
        A.reset_steps(keys),
        A.dnp_steps(minutes, lag=True),
        A.recovery_steps(minutes, lag=True),
        H.minutes_steps(minutes),
        H.ewma_steps(values, half_lives),
        H.season_steps(keys),
        H.form_steps(keys, form),
    ]
    if flag is not None:
        steps.insert(2, H.split_steps(values, flag))
    reach = max(*windows, 30, H.ewma_reach(half_lives))
    return on_timeline(df, keys, compose(*steps), reach=reach)
