"""Filling missing values from training rows only, and values relative to their category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple
from chronoplane.operators.history import seasons_available
from chronoplane.operators.quantiles import medians
from chronoplane.operators.timeline import join_same


def group_baselines(train: DataFrame, category, values, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Per category (one column or several): `<value>_mean`, `_std`, `_median`, `_count`. One row per category."""
    values, by = as_tuple(values), as_tuple(category)
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count")]
    moments = train.groupBy(*by).agg(*aggs)
    med = (
        medians(train, values, by, hot_rows)
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("column") == v, F.col("median"))).alias(f"{v}_median") for v in values])
    )
    return join_same(moments, med, by, "left")


def fill_values(train: DataFrame, values, strategy: str = "median", hot_rows: int | None = 1_000_000) -> DataFrame:
    """One row with the fill value of every column: median, mean or zero of the training rows."""
    values = as_tuple(values)
    if strategy == "median":
        return medians(train, values, (), hot_rows).agg(
            *[F.max(F.when(F.col("column") == v, F.col("median"))).alias(v) for v in values]
        )
    if strategy == "mean":
        return train.agg(*[F.avg(v).alias(v) for v in values])
    if strategy == "zero":
        return train.agg(*[F.lit(0.0).alias(v) for v in values])
    raise ValueError(f"unknown strategy {strategy}")


def impute_fit_apply(train: DataFrame, target: DataFrame, values, strategy: str = "median",
                     hot_rows: int | None = 1_000_000) -> DataFrame:
    """Fill the target's missing values from the training rows; what training cannot fill becomes 0."""
    values = as_tuple(values)
    fit = fill_values(train, values, strategy, hot_rows).select(F.struct(*values).alias("f")).scalar()
    return target.withColumns({v: F.coalesce(F.col(v), fit.getField(v), F.lit(0.0)) for v in values})


def impute_by_group(df: DataFrame, baselines: DataFrame, category: str, values, method: str = "position_mean") -> DataFrame:
    """Fill from the category's training mean (`position_mean`) or median (any other method)."""
    kind = "mean" if method == "position_mean" else "median"
    values = as_tuple(values)
    side = baselines.select(category, *[F.col(f"{v}_{kind}").alias(f"__f_{v}") for v in values])
    out = join_same(df, side, [category], "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.col(f"__f_{v}")) for v in values}).drop(
        *[f"__f_{v}" for v in values]
    )


def group_relative(df: DataFrame, baselines: DataFrame, category: str, values) -> DataFrame:
    """Difference to the category mean and z-score: `<value>_vs_group`, `<value>_group_z`."""
    values = as_tuple(values)
    side = baselines.select(category, *[f"{v}_{m}" for v in values for m in ("mean", "std")])
    out = join_same(df, side, [category], "left")
    cols = {}
    for v in values:
        diff = F.col(v) - F.col(f"{v}_mean")
        cols[f"{v}_vs_group"] = diff
        cols[f"{v}_group_z"] = diff / F.nullif(F.col(f"{v}_std"), F.lit(0.0))
    return out.withColumns(cols).drop(*[f"{v}_{m}" for v in values for m in ("mean", "std")])


def quality_score(df: DataFrame, keys: Keys, value: str, full: float = 5.0) -> DataFrame:
    """Has-value flag, first-season flag, earlier rows with the value, and their product scaled to 0..1."""
    out = seasons_available(df, keys, value, "history_rows")
    has = F.col(value).isNotNull().cast("int")
    return out.withColumns(
        {
            "has_value": has,
            "is_first": (F.col("history_rows") == 0).cast("int"),
            "data_quality": F.least(F.greatest(has * F.col("history_rows") / full, F.lit(0.0)), F.lit(1.0)),
        }
    )


def impute_pipeline(df: DataFrame, baselines: DataFrame, keys: Keys, category: str, values, primary: str) -> DataFrame:
    """Flags before filling, filling by category mean, relative columns, and empty prior-season columns."""
    values = as_tuple(values)
    flagged = quality_score(df, keys, primary)
    filled = impute_by_group(flagged, baselines, category, values)
    relative = group_relative(filled, baselines, category, values)
    return relative.withColumns({f"prev_season_{v}": F.lit(None).cast("double") for v in values})


__all__ = [
    "fill_values",
    "group_baselines",
    "group_relative",
    "impute_by_group",
    "impute_fit_apply",
    "impute_pipeline",
    "quality_score",
]
