"""Gamma predictive distributions: fit, tails, intervals, calibration and its diagnosis.

A prediction is a row with mean and variance; alpha is the shape, beta the rate. Everything but the Gamma
functions themselves is a column expression, and every summary is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.functions.special import gamma_cdf, gamma_quantile, gamma_tail
from chronoplane.keys import Keys, as_tuple
from chronoplane.operators.quantiles import exact_quantiles
from chronoplane.operators.timeline import on_timeline

# Floors of variance, shape and rate; confidence levels; calibration thresholds (percentiles of
# the outcome), number of probability bins, rows a bin needs; diagnosis limits.
MIN_VARIANCE, MIN_ALPHA, MIN_BETA = 0.01, 0.1, 0.01
LEVELS = (0.68, 0.80, 0.90, 0.95)
THRESHOLDS = (0.10, 0.25, 0.50, 0.75, 0.90)
BINS, MIN_BIN_ROWS = 10, 5
EDGE_FACTOR, LOW_PIT, HIGH_PIT = 1.5, 0.4, 0.6


def gamma_fit(df: DataFrame, mean: str, variance: str, strict: bool = False) -> DataFrame:
    """Shape and rate that have the mean and variance.

    Floors keep weak predictions usable; `strict` makes a mean or variance of zero or less an error instead.
    """
    m, v = F.col(mean).cast("double"), F.col(variance).cast("double")
    if strict:
        v = F.when((m <= 0) | (v <= 0), F.raise_error(F.lit("mean and variance must be positive")).cast("double")).otherwise(v)
        return df.withColumns({"alpha": m * m / v, "beta": m / v})
    v = F.when(v.isNotNull(), F.greatest(v, F.lit(MIN_VARIANCE)))
    beta = m / v

    def floor(x: Column, low: float) -> Column:
        return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))

    return df.withColumns({"alpha": floor(m * beta, MIN_ALPHA), "beta": floor(beta, MIN_BETA)})


def gamma_moments(df: DataFrame) -> DataFrame:
    a, b = F.col("alpha"), F.col("beta")
    return df.withColumns({"gamma_mean": a / b, "gamma_std": F.sqrt(a) / b})


def prob_over(df: DataFrame, line: str, name: str = "prob_over") -> DataFrame:
    """P(X > line)."""
    return df.withColumn(name, gamma_tail(F.col("alpha"), F.col("beta"), F.col(line).cast("double")))


def quantiles(df: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantile columns of the predictive distribution."""
    return df.withColumns({n: gamma_quantile(F.col("alpha"), F.col("beta"), F.lit(p)) for n, p in probs.items()})


def interval(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Central prediction interval as `lower` and `upper`."""
    tail = (1 - confidence) / 2
    return quantiles(df, {"lower": tail, "upper": 1 - tail})


def with_pit(df: DataFrame, actual: str, name: str = "pit") -> DataFrame:
    """Distribution function at the outcome."""
    return df.withColumn(name, gamma_cdf(F.col("alpha"), F.col("beta"), F.col(actual).cast("double")))


def ks_statistic(df: DataFrame, pit: str, tie, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Largest distance of the PIT values from uniform, with its asymptotic p-value.

    Ranks come from the numbered timeline, so no task sorts all values.
    """
    held = df.filter(F.col(pit).isNotNull()).select(pit, *as_tuple(tie))
    ranked = on_timeline(held, Keys((), pit, tie, hot_rows=hot_rows or 1_000_000), lambda t: t.position("__i", "__n"))
    i, n, u = F.col("__i"), F.col("__n"), F.col(pit)
    one = ranked.agg(
        F.max(F.greatest((i + 1) / n - u, u - i / n)).alias("ks_statistic"), F.max("__n").alias("n")
    )
    d = F.col("ks_statistic") * F.sqrt("n")
    # Asymptotic tail of the statistic; 100 terms are more than a double can hold apart.
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * d * d),
    )
    return one.withColumn("ks_pvalue", F.when(d < 0.2, 1.0).otherwise(F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0))))


def fit_diagnostics(df: DataFrame, actual: str, tie, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Mean absolute z-score of the outcomes and the uniformity test of their PIT values."""
    a, b = F.col("alpha"), F.col("beta")
    rows = with_pit(df.filter(F.col(actual).isNotNull() & a.isNotNull()), actual)
    z = (F.col(actual) - a / b) / (F.sqrt(a) / b)
    one = rows.agg(F.avg(F.abs(z)).alias("mean_abs_z"))
    ks = ks_statistic(rows, "pit", tie, hot_rows).select(F.struct("ks_statistic", "ks_pvalue", "n").alias("k")).scalar()
    return one.withColumns({c: ks.getField(c) for c in ("ks_statistic", "ks_pvalue", "n")}).withColumn(
        "is_well_fitted", F.col("ks_pvalue") > 0.05
    )


def conformal_quantile(validation: DataFrame, actual: str, mean: str, alpha: float = 0.05,
                       hot_rows: int | None = 1_000_000) -> DataFrame:
    """One row: the (1 - alpha) quantile of the absolute residuals of the validation rows."""
    res = validation.withColumn("__r", F.abs(F.col(actual) - F.col(mean)))
    return exact_quantiles(res, "__r", {"q": 1 - alpha}, hot_rows=hot_rows)


def conformal(df: DataFrame, validation: DataFrame, actual: str, mean: str, alpha: float = 0.05,
              hot_rows: int | None = 1_000_000) -> DataFrame:
    """Shape and rate refitted after adding the squared residual quantile to the variance."""
    q = conformal_quantile(validation, actual, mean, alpha, hot_rows).select("q").scalar()
    a, b = F.col("alpha"), F.col("beta")
    m = a / b
    v = a / (b * b) + q * q
    return df.withColumns(
        {
            "alpha_cal": F.when(a.isNotNull(), F.greatest(m * m / v, F.lit(MIN_ALPHA))),
            "beta_cal": F.when(a.isNotNull(), F.greatest(m / v, F.lit(MIN_BETA))),
        }
    )


def _per_threshold(df: DataFrame, actual: str, probs, hot_rows: int | None) -> DataFrame:
    """Rows once per outcome threshold: a fixed handful of thresholds, attached as one array and exploded."""
    held = df.filter(F.col(actual).isNotNull() & F.col("alpha").isNotNull())
    names = {f"t{i}": p for i, p in enumerate(probs)}
    q = exact_quantiles(held, actual, names, hot_rows=hot_rows)
    cuts = q.select(F.array(*names).alias("t")).scalar()
    slim = held.select("alpha", "beta", F.col(actual).cast("double").alias("y"))
    rows = slim.withColumn("__t", cuts).select("alpha", "beta", "y", F.posexplode("__t").alias("threshold_no", "threshold"))
    return rows.withColumn("p", gamma_tail(F.col("alpha"), F.col("beta"), F.col("threshold")))


def calibration_bins(df: DataFrame, actual: str, probs=THRESHOLDS, bins: int = BINS, least: int = MIN_BIN_ROWS,
                     hot_rows: int | None = 1_000_000) -> DataFrame:
    """Predicted against observed frequency per threshold and probability bin; a probability of 1 is in no bin."""
    rows = _per_threshold(df, actual, probs, hot_rows)
    per = (
        rows.withColumn("bin", F.floor(F.col("p") * bins).cast("int"))
        .filter(F.col("bin") < bins)
        .groupBy("threshold_no", "bin")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.avg("p").alias("predicted_prob"),
            F.avg((F.col("y") > F.col("threshold")).cast("double")).alias("actual_freq"),
        )
        .filter(F.col("n_samples") >= least)
    )
    return per.withColumn("error", F.abs(F.col("predicted_prob") - F.col("actual_freq")))


def ece(df: DataFrame, actual: str, probs=THRESHOLDS, bins: int = BINS, least: int = MIN_BIN_ROWS,
        hot_rows: int | None = 1_000_000) -> DataFrame:
    """Expected calibration error: bin errors weighted by bin rows over all rows."""
    n = df.filter(F.col(actual).isNotNull() & F.col("alpha").isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    per = calibration_bins(df, actual, probs, bins, least, hot_rows)
    one = per.agg(F.coalesce(F.sum(F.col("error") * F.col("n_samples")), F.lit(0.0)).alias("__e"))
    return one.select((F.col("__e") / n).alias("ece"), n.alias("n_samples"))


def coverage(df: DataFrame, actual: str, levels=LEVELS) -> DataFrame:
    """Share of outcomes inside each central interval.

    An outcome is inside exactly when its PIT lies between the tail probabilities, so no quantile is needed.
    """
    rows = with_pit(df.filter(F.col(actual).isNotNull() & F.col("alpha").isNotNull()), actual)
    pit = F.col("pit")
    one = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(
            *[
                F.struct(
                    F.lit(level).alias("expected"),
                    F.avg(pit.between((1 - level) / 2, 1 - (1 - level) / 2).cast("double")).alias("actual"),
                )
                for level in levels
            ]
        ).alias("c"),
    )
    out = one.select("n", F.inline("c"))
    err = F.abs(F.col("actual") - F.col("expected"))
    return out.withColumns({"error": err, "is_valid": err < 0.03})


def sharpness(df: DataFrame, levels=LEVELS) -> DataFrame:
    """Mean width of each central interval."""
    rows = df.filter(F.col("alpha").isNotNull())
    names = {}
    for i, level in enumerate(levels):
        names[f"__l{i}"], names[f"__u{i}"] = (1 - level) / 2, 1 - (1 - level) / 2
    wide = quantiles(rows.select("alpha", "beta"), names)
    one = wide.agg(
        F.array(
            *[
                F.struct(
                    F.lit(level).alias("level"), F.avg(F.col(f"__u{i}") - F.col(f"__l{i}")).alias("mean_width")
                )
                for i, level in enumerate(levels)
            ]
        ).alias("s")
    )
    return one.select(F.inline("s"))


def pit_histogram(df: DataFrame, actual: str, bins: int = 10) -> DataFrame:
    """Share of the PIT values per bin; the last bin holds 1."""
    rows = with_pit(df.filter(F.col(actual).isNotNull() & F.col("alpha").isNotNull()), actual)
    b = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pit").alias("pit_sum"), F.sum(F.col("pit") * F.col("pit")).alias("pit_sq")
    )


def pit_diagnosis(df: DataFrame, actual: str) -> DataFrame:
    """Mean and deviation of the PIT, weight of its edges and middle, and what that says."""
    h = pit_histogram(df, actual)
    share = F.sum("n")
    one = h.agg(
        share.alias("n"),
        (F.sum("pit_sum") / share).alias("pit_mean"),
        (F.sum("pit_sq") / share).alias("__sq"),
        (F.sum(F.when(F.col("bin").isin(0, 9), F.col("n")).otherwise(0)) / share).alias("edge_share"),
        (F.sum(F.when(F.col("bin").isin(4, 5), F.col("n")).otherwise(0)) / share).alias("middle_share"),
    )
    edge, mid, mean = F.col("edge_share"), F.col("middle_share"), F.col("pit_mean")
    issue = (
        F.when(edge > EDGE_FACTOR * mid, "OVERCONFIDENT")
        .when(mid > EDGE_FACTOR * edge, "UNDERCONFIDENT")
        .when(mean < LOW_PIT, "NEGATIVE_BIAS")
        .when(mean > HIGH_PIT, "POSITIVE_BIAS")
        .otherwise("NONE")
    )
    spread = F.sqrt(F.greatest(F.col("__sq") - mean * mean, F.lit(0.0)))
    return one.withColumns({"pit_std": spread, "issue": issue}).drop("__sq")


def brier(df: DataFrame, actual: str, probs=THRESHOLDS, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Mean over the thresholds of the mean squared error of P(X > threshold)."""
    rows = _per_threshold(df, actual, probs, hot_rows)
    gap = F.col("p") - (F.col("y") > F.col("threshold")).cast("double")
    per = rows.groupBy("threshold_no").agg(F.avg(gap * gap).alias("b"))
    return per.agg(F.avg("b").alias("brier"))
