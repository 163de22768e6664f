"""Features of the other side of an event: opponent form and pace, own team form, past meetings.

Opponents and teams are few, so their histories are long. Their per-event totals are far smaller than the
facts; they are written once and the windows read that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple
from chronoplane.operators.history import rows_before
from chronoplane.operators.timeline import Running, Timeline, dealt, on_timeline
from chronoplane.session import parts_for, stored


def team_event_totals(df: DataFrame, by, values) -> DataFrame:
    """Sums of the values per group; summed map-side before the exchange."""
    return df.groupBy(*as_tuple(by)).agg(*[F.sum(v).alias(v) for v in as_tuple(values)])


def opp_form(df: DataFrame, opponent: str, event: str, time: str, values, window: int = 10,
             hot_rows: int | None = 1_000_000) -> DataFrame:
    """Per (opponent, event): mean totals that the opponent allowed in its previous events."""
    totals = stored(team_event_totals(df, [opponent, event, time], values), "opponent-events")
    keys = Keys(opponent, time, event, hot_rows=hot_rows)
    cols = {
        f"opp_{v}_allowed_avg": (lambda w, v=v: F.avg(v).over(rows_before(w, window))) for v in as_tuple(values)
    }
    out = on_timeline(totals, keys, lambda t: t.look_back(window, cols), reach=window, parts=parts_for(totals))
    return out.select(opponent, event, time, *cols)


def opp_pace(df: DataFrame, opponent: str, time: str, value: str, window: int = 10,
             hot_rows: int | None = 1_000_000) -> DataFrame:
    """Per (opponent, date): mean of the per-date totals over the opponent's previous dates."""
    totals = stored(team_event_totals(df, [opponent, time], [value]), "opponent-dates")
    keys = Keys(opponent, time, (), hot_rows=hot_rows)
    out = on_timeline(
        totals,
        keys,
        lambda t: t.look_back(window, {"opp_pace": lambda w: F.avg(value).over(rows_before(w, window))}),
        reach=window,
    )
    return out.select(opponent, time, "opp_pace")


def team_form(df: DataFrame, team: str, time: str, win: Column, first_by: str, window: int = 10,
              hot_rows: int | None = 1_000_000) -> DataFrame:
    """Per (team, date): share of wins over the team's previous dates; the date counts its first event."""
    per_date = stored(df.groupBy(team, time).agg(F.min_by(win.cast("int"), F.col(first_by)).alias("__win")), "team-dates")
    keys = Keys(team, time, (), hot_rows=hot_rows)
    out = on_timeline(
        per_date,
        keys,
        lambda t: t.look_back(window, {"team_win_rate": lambda w: F.avg("__win").over(rows_before(w, window))}),
        reach=window,
    )
    return out.select(team, time, "team_win_rate")


def head_to_head(df: DataFrame, keys: Keys, opponent: str, values, window: int = 5) -> DataFrame:
    """Means over the entity's previous meetings with the same opponent, and their number.

    `df` is stored: it is read for the lengths of histories, for the short ones and for the long ones.
    """
    df = stored(df, "meetings")
    pair = keys.with_(entity=(*keys.entity, opponent))
    cols = {f"{v}_vs_opp": (lambda w, v=v: F.avg(v).over(rows_before(w, window))) for v in as_tuple(values)}

    def steps(t: Timeline) -> Timeline:
        return t.look_back(window, cols).running({"games_vs_opp": Running("count", F.lit(1))})

    return on_timeline(df, pair, steps, reach=window, parts=parts_for(df))


def join_opponent_form(df: DataFrame, form: DataFrame, opponent: str, event: str, parts: int | None = None) -> DataFrame:
    """Opponent form back to entity rows on (opponent, event). The event in the key spreads hot opponents.

    parts: into how many parts both sides are dealt, where the number of rows is known (`parts_for`).
    """
    time_free = form.select(opponent, event, *[c for c in form.columns if c.startswith("opp_")])
    on = [opponent, event]
    return dealt(df, parts, on).join(dealt(time_free, parts, on), on, "left")


def join_opponent_pace(df: DataFrame, pace: DataFrame, opponent: str, time: str) -> DataFrame:
    """Opponent pace back to entity rows on (opponent, date)."""
    return df.join(pace, [opponent, time], "left")


def join_team_form(df: DataFrame, form: DataFrame, team: str, time: str) -> DataFrame:
    """Own team form back to entity rows on (team, date)."""
    return df.join(form, [team, time], "left")
