"""Accuracy of point predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.operators.quantiles import exact_quantiles
from chronoplane.operators.timeline import join_same

# Deviations beyond which a residual is an outlier; floor of the relative error's divisor.
OUTLIER_DEVIATIONS = 3.0
RELATIVE_FLOOR = 2.220446049250313e-16


def regression_metrics(df: DataFrame, actual: str, predicted: str, by=(), hot_rows: int | None = 1_000_000) -> DataFrame:
    """RMSE, MAE, R², MAPE (percent), residual mean / deviation / maximum and median absolute error."""
    by = [by] if isinstance(by, str) else list(by)
    held = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumns(
        {"__y": F.col(actual).cast("double"), "__e": F.col(actual).cast("double") - F.col(predicted)}
    )
    held = held.withColumn("__abs", F.abs("__e"))
    y, e = F.col("__y"), F.col("__e")
    one = held.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg("__abs").alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
        (F.avg(F.col("__abs") / F.greatest(F.abs(y), F.lit(RELATIVE_FLOOR))) * 100).alias("mape"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"),
        F.max("__abs").alias("residual_max"),
    )
    med = exact_quantiles(held, "__abs", {"median_ae": 0.5}, by, hot_rows).drop("n")
    if by:
        return join_same(one, med, by, "left")
    return one.withColumn("median_ae", med.scalar())


def residual_summary(df: DataFrame, actual: str, predicted: str, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Mean, deviation, quartiles and extremes of the residual, and its outliers."""
    held = df.select((F.col(actual) - F.col(predicted)).alias("r")).filter(F.col("r").isNotNull())
    stats = held.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))
    s = stats.select(F.struct("mean", "std").alias("s")).scalar()
    q = exact_quantiles(held, "r", {"q25": 0.25, "median": 0.5, "q75": 0.75}, hot_rows=hot_rows)
    quart = q.select(F.struct("q25", "median", "q75").alias("q")).scalar()
    z = F.abs((F.col("r") - F.col("__s.mean")) / F.nullif(F.col("__s.std"), F.lit(0.0)))
    flagged = held.withColumn("__s", s).withColumn("__out", F.coalesce(z > OUTLIER_DEVIATIONS, F.lit(False)))
    one = flagged.agg(
        F.avg("r").alias("mean"),
        F.stddev_pop("r").alias("std"),
        F.min("r").alias("min"),
        F.max("r").alias("max"),
        F.count_if("__out").alias("n_outliers"),
        (F.avg(F.col("__out").cast("double")) * 100).alias("pct_outliers"),
    )
    return one.withColumns({c: quart.getField(c) for c in ("q25", "median", "q75")})


def equal_width_bin(x, low, high, bins: int):
    """Right-closed equal-width bin 0..bins-1, as data frames cut a range."""
    at = F.ceil((x - low) / (high - low) * bins) - 1
    return F.when(x.isNotNull(), F.when(high > low, F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0))).otherwise(0))


def error_by_range(df: DataFrame, actual: str, predicted: str, bins: int = 5) -> DataFrame:
    """Mean absolute error in equal-width bins of the prediction."""
    held = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    lim = held.agg(F.struct(F.min(predicted).alias("lo"), F.max(predicted).alias("hi")).alias("m")).scalar()
    rows = held.withColumn("__m", lim)
    b = equal_width_bin(F.col(predicted), F.col("__m.lo"), F.col("__m.hi"), bins)
    return (
        rows.withColumn("bin", b)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mean_abs_error"))
    )


def temporal_stability(df: DataFrame, actual: str, predicted: str, time: str, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Error of the rows before and from the median date on: RMSE and variance ratio, bias of both halves."""
    held = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn(
        "__d", F.unix_date(F.to_date(time)).cast("double")
    )
    mid = exact_quantiles(held, "__d", {"m": 0.5}, hot_rows=hot_rows).select("m").scalar()
    rows = held.withColumns({"__early": F.col("__d") < mid, "__e": F.col(actual) - F.col(predicted)})
    e, early = F.col("__e"), F.col("__early")
    a, b = F.when(early, e), F.when(~early, e)
    one = rows.agg(
        F.sqrt(F.avg(a * a)).alias("rmse_early"),
        F.sqrt(F.avg(b * b)).alias("rmse_late"),
        F.var_pop(a).alias("var_early"),
        F.var_pop(b).alias("var_late"),
        F.avg(a).alias("bias_early"),
        F.avg(b).alias("bias_late"),
    )
    return one.withColumns(
        {
            "rmse_ratio": F.coalesce(F.col("rmse_late") / F.nullif(F.col("rmse_early"), F.lit(0.0)), F.lit(1.0)),
            "var_ratio": F.coalesce(F.col("var_late") / F.nullif(F.col("var_early"), F.lit(0.0)), F.lit(1.0)),
        }
    )


def cv_summary(metrics: DataFrame, fold: str, names) -> DataFrame:
    """Mean, population deviation, extremes and relative deviation per metric over the folds."""
    long = metrics.unpivot([fold], list(names), "metric", "value")
    per = long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return per.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))


def ensemble_mean(df: DataFrame, key, prediction: str, variance: str | None = None, name: str = "prediction") -> DataFrame:
    """Average prediction (and variance) over the models, one row per key."""
    key = [key] if isinstance(key, str) else list(key)
    aggs = [F.avg(prediction).alias(name), F.count(prediction).alias("n_models")]
    if variance:
        aggs.append(F.avg(variance).alias("variance"))
    return df.groupBy(*key).agg(*aggs)
