"""Chronological splits and cross-validation folds.

Every rule here is stated on the exact global position of a row in time order, which `number_rows` gives
without a global sort: row counts per day, their prefix sum, and a row number inside a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.keys import Keys
from chronoplane.operators.timeline import join_same, number_rows, on_timeline

# Seasons to train on, rows dropped at the start of an entity's test season, least test rows,
# share of validation rows, number of folds.
TRAIN_SEASONS, GAP_ROWS, MIN_TEST_ROWS, VAL_SHARE, FOLDS = 3, 15, 1000, 0.2, 19


def chrono_split(df: DataFrame, time: str, train_end, val_end, name: str = "split") -> DataFrame:
    """train before `train_end`, val before `val_end`, test from there on; NULL times belong to none."""
    t = F.col(time)
    a, b = (c if isinstance(c, Column) else F.lit(c).cast("timestamp_ntz") for c in (train_end, val_end))
    t = t.cast("timestamp_ntz")
    return df.withColumn(name, F.when(t < a, "train").when(t < b, "val").when(t >= b, "test"))


def split_bounds(df: DataFrame, time: str, split: str = "split", by=()) -> DataFrame:
    """Rows, first and last time per split, and whether it starts before an earlier split ends."""
    order = F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).otherwise(2)
    per = df.groupBy(*by, split).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last")
    )
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("overlaps", F.coalesce(F.col("first") < F.max("last").over(w), F.lit(False)))


def global_rank(df: DataFrame, time: str, event, rank: str = "rank", total: str = "total") -> DataFrame:
    """0-based position in time order over the whole table, and the number of rows."""
    return number_rows(df, Keys((), time, event), index=rank, total=total)


def contiguous_folds(df: DataFrame, time: str, event, folds: int = FOLDS, val_share: float = VAL_SHARE) -> DataFrame:
    """Equal consecutive blocks in time; the last takes the rest. The end of each block is its val part."""
    ranked = global_rank(df, time, event, "__r", "__n")
    size = F.floor(F.col("__n") / folds)
    fold = F.when(size > 0, F.least(F.floor(F.col("__r") / size), F.lit(folds - 1))).otherwise(F.lit(folds - 1))
    ranked = ranked.withColumn("fold", fold.cast("int"))
    length = F.when(F.col("fold") == folds - 1, F.col("__n") - size * (folds - 1)).otherwise(size)
    inside = F.col("__r") - size * F.col("fold")
    is_val = inside >= length - F.floor(length * val_share)
    return ranked.withColumn("split", F.when(is_val, "val").otherwise("train")).drop("__r", "__n")


def expanding_folds(df: DataFrame, time: str, event, folds: int = FOLDS, val_share: float = VAL_SHARE) -> DataFrame:
    """Growing train windows: fold i trains on everything before its test block of n // (folds + 1) rows.

    The result stays one row per input row: `train_from` is the first fold that trains on it (it is in the
    train part of every later fold too; NULL when no fold trains on it), `val_fold` the fold it validates.
    """
    ranked = global_rank(df, time, event, "__r", "__n")
    size = F.floor(F.col("__n") / (folds + 1))
    first = F.col("__n") - size * folds
    past = F.floor((F.col("__r") - first) / size)
    train_from = F.when(F.col("__r") < first, F.lit(0)).when(past + 1 < folds, past + 1)
    inside = F.col("__r") - first - past * size
    val_fold = F.when((F.col("__r") >= first) & (inside < F.floor(size * val_share)), past)
    return ranked.withColumns(
        {"train_from": train_from.cast("int"), "val_fold": val_fold.cast("int")}
    ).drop("__r", "__n")


def fold_members(df: DataFrame, fold: int) -> DataFrame:
    """Train and val rows of one expanding fold."""
    return df.filter((F.col("train_from") <= fold) | (F.col("val_fold") == fold)).withColumn(
        "split", F.when(F.col("val_fold") == fold, "val").otherwise("train")
    )


def entity_gap(df: DataFrame, keys: Keys, gap: int = GAP_ROWS, seasons: int = TRAIN_SEASONS,
               name: str = "in_gap") -> DataFrame:
    """True on the rows a test season must leave out: before row `gap` of an entity that has train rows.

    An entity is in train when it has a row in one of the `seasons` seasons before. With `gap` rows or fewer
    in the season nothing is left out.
    """
    part = [*keys.entity, keys.season]
    numbered = on_timeline(df, keys.with_(entity=tuple(part)), lambda t: t.position("__pos"))
    per_season = numbered.groupBy(*part).agg(
        F.min(F.when(F.col("__pos") == gap, F.col(keys.time))).alias("__from")
    )
    index = season_index(df, keys.season)
    per_season = join_same(per_season, index, [keys.season])
    w = Window.partitionBy(*keys.entity).orderBy("__season")
    known = F.coalesce(F.lag("__season").over(w) >= F.col("__season") - seasons, F.lit(False))
    per_season = per_season.select(*part, F.when(known, F.col("__from")).alias("__from"))
    out = join_same(df, per_season, part, "left")
    return out.withColumn(name, F.coalesce(F.col(keys.time) < F.col("__from"), F.lit(False))).drop("__from")


def season_index(df: DataFrame, season: str) -> DataFrame:
    """Seasons in order with a running number; as many rows as there are seasons."""
    rows = df.groupBy(season).agg(F.count(F.lit(1)).alias("__rows"))
    return rows.withColumn(
        "__season", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(season))
    ).drop("__rows")


def season_cv(df: DataFrame, keys: Keys, seasons: int = TRAIN_SEASONS, gap: int = GAP_ROWS,
              min_test: int = MIN_TEST_ROWS, val_share: float = VAL_SHARE) -> DataFrame:
    """Rolling-season folds: train on `seasons` seasons, test on the next; adds `fold` and `split`.

    Seasons follow each other in time, so the train rows of a fold are one range of global positions and the
    last `val_share` of them is a cut inside that range: one numbering serves all folds. Folds whose test part
    is below `min_test` rows, before or after the entity gap, are left out and not counted.
    """
    season = keys.season
    marked = entity_gap(df, keys, gap, seasons)
    ranked = number_rows(marked, Keys((), keys.time, keys.event), index="__r")
    per_season = ranked.groupBy(season).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(~F.col("in_gap")).alias("__kept")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(season)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    window = order.rowsBetween(-seasons, -1)
    plan = per_season.withColumns(
        {
            "__season": F.row_number().over(order),
            "__end": F.coalesce(F.sum("__rows").over(before), F.lit(0)),
            "__train": F.sum("__rows").over(window),
        }
    ).filter(
        (F.col("__season") > seasons) & (F.col("__rows") >= min_test) & (F.col("__kept") >= min_test)
    )
    plan = plan.select(
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__season")) - 1).alias("fold"),
        F.col("__season").alias("__test"),
        (F.col("__end") - F.col("__train") + F.floor(F.col("__train") * (1 - val_share))).alias("__cut"),
    )
    # Role table: one row per (season, fold); (seasons + 1) times the number of folds, so a broadcast is bounded.
    roles = (
        season_index(df, season)
        .join(
            plan.withColumn("__season", F.explode(F.sequence(F.col("__test") - seasons, F.col("__test")))),
            "__season",
        )
        .select(season, "fold", "__cut", (F.col("__season") == F.col("__test")).alias("__is_test"))
    )
    joined = ranked.join(F.broadcast(roles), season)
    split = F.when(F.col("__is_test"), "test").when(F.col("__r") < F.col("__cut"), "train").otherwise("val")
    kept = joined.filter(~(F.col("__is_test") & F.col("in_gap")))
    return kept.withColumn("split", split).drop("__r", "__cut", "__is_test", "in_gap")

