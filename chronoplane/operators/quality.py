"""Data-quality checks. Each one is a single aggregate over the table that returns findings as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple
from chronoplane.operators.relational import first_per_group

# Shares of missing values (percent) that warn and that fail; largest plausible magnitude;
# share of not-played rows that warns.
MISSING_WARN, MISSING_ERROR, MAGNITUDE, ZERO_SHARE_WARN = 10.0, 50.0, 1e6, 0.05


def check_grain(df: DataFrame, grain) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*as_tuple(grain)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """Per column: missing values, their share in percent and a level."""
    columns = list(as_tuple(columns) or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = one.unpivot(["__rows"], columns, "column", "n_null")
    pct = F.col("n_null") * 100.0 / F.nullif(F.col("__rows"), F.lit(0))
    level = F.when(pct > MISSING_ERROR, "ERROR").when(pct > MISSING_WARN, "WARN").otherwise("INFO")
    return long.select("column", "n_null", pct.alias("pct_null"), level.alias("level"))


def check_range(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: minimum, maximum and whether both are inside the limits."""
    one = df.agg(
        F.struct(
            *[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in limits]
        ).alias("m")
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m.{c}.lo").alias("min_value"),
                F.col(f"m.{c}.hi").alias("max_value"),
                F.coalesce((F.col(f"m.{c}.lo") >= lo) & (F.col(f"m.{c}.hi") <= hi), F.lit(True)).alias("in_range"),
            )
            for c, (lo, hi) in limits.items()
        ]
    )
    return one.select(F.inline(rows))


def check_first_rows(df: DataFrame, keys: Keys, features) -> DataFrame:
    """Per feature: first rows of an entity whose value is neither NULL nor 0 (there is no past to use)."""
    features = list(as_tuple(features))
    first = first_per_group(df.select(*keys.grain, *features), keys)
    one = first.agg(
        F.count(F.lit(1)).alias("n_entities"),
        *[F.count_if(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0).alias(c) for c in features],
    )
    return one.unpivot(["n_entities"], features, "feature", "n_leaking")


def check_distribution(df: DataFrame, columns, magnitude: float = MAGNITUDE) -> DataFrame:
    """Per column: infinite values, values beyond the magnitude, and whether it is constant."""
    columns = list(as_tuple(columns))
    inf = float("inf")
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.count_if(F.abs(x) == inf).alias("n_infinite"),
                F.count_if((F.abs(x) > magnitude) & (F.abs(x) != inf)).alias("n_huge"),
                (F.count(x) > 0).alias("has"),
                (F.min(x) == F.max(x)).alias("same"),
            ).alias(c)
        )
    one = df.agg(F.struct(*aggs).alias("m"))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m.{c}.n_infinite").alias("n_infinite"),
                F.col(f"m.{c}.n_huge").alias("n_huge"),
                F.coalesce(F.col(f"m.{c}.same") & F.col(f"m.{c}.has"), F.lit(True)).alias("is_constant"),
            )
            for c in columns
        ]
    )
    return one.select(F.inline(rows))


def check_feature_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Aggregate rules (boolean aggregate columns by name) that do not hold; NULL counts as holding."""
    one = df.agg(F.struct(*[rule.alias(name) for name, rule in rules.items()]).alias("r"))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"r.`{name}`"), F.lit(True)).alias("holds"))
            for name in rules
        ]
    )
    return one.select(F.inline(rows))


def is_binary(c: str) -> Column:
    return F.bool_and(F.col(c).isin(0, 1))


def is_between(c: str, low: float, high: float) -> Column:
    return (F.min(c) >= low) & (F.max(c) <= high)


def mean_between(c: str, low: float, high: float) -> Column:
    return (F.avg(c) > low) & (F.avg(c) < high)


def check_values(df: DataFrame, non_negative=(), at_most: dict[str, float] | None = None, fractions=(),
                 parts=(), total: str | None = None, key=(), played: str | None = None) -> DataFrame:
    """Counts of impossible values as rows (check, n): negatives, beyond a limit, shares outside 0..1,
    parts that do not add up, repeated keys and rows with nothing played."""
    checks: dict[str, Column] = {}
    for c in as_tuple(non_negative):
        checks[f"negative:{c}"] = F.count_if(F.col(c) < 0)
    for c, limit in (at_most or {}).items():
        checks[f"above:{c}"] = F.count_if(F.col(c) > limit)
    for c in as_tuple(fractions):
        checks[f"not_fraction:{c}"] = F.count_if((F.col(c) < 0) | (F.col(c) > 1))
    if total:
        added = reduce(lambda a, b: a + b, [F.col(p) for p in as_tuple(parts)])
        checks[f"sum_mismatch:{total}"] = F.count_if(F.abs(added - F.col(total)) > 1e-9)
    if played:
        checks[f"zero:{played}"] = F.count_if(F.col(played) == 0)
    one = df.agg(F.map_from_arrays(F.array(*[F.lit(n) for n in checks]), F.array(*checks.values())).alias("m"))
    out = one.select(F.explode("m").alias("check", "n"))
    key = as_tuple(key)
    if key:
        extra = check_grain(df, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
        out = out.unionByName(extra.select(F.lit("duplicate:" + ",".join(key)).alias("check"), "n"))
    return out


def quality_report(df: DataFrame, grain, target: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """All findings of a table as rows (check, column, value, level)."""
    columns = [c for c in df.columns if c not in as_tuple(grain)]
    missing = null_profile(df, columns).select(
        F.lit("missing_pct").alias("check"), "column", F.col("pct_null").alias("value"), "level"
    )
    dup = check_grain(df, grain).agg(F.count(F.lit(1)).cast("double").alias("value"))
    duplicates = dup.select(
        F.lit("duplicate_keys").alias("check"),
        F.lit(",".join(as_tuple(grain))).alias("column"),
        "value",
        F.when(F.col("value") > 0, "ERROR").otherwise("INFO").alias("level"),
    )
    ranges = check_range(df, limits).select(
        F.lit("range").alias("check"),
        "column",
        F.col("in_range").cast("double").alias("value"),
        F.when(F.col("in_range"), "INFO").otherwise("WARN").alias("level"),
    )
    x = F.col(target).cast("double")
    stats = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ).unpivot([], ["rows", "mean", "std", "min", "max"], "stat", "value")
    target_rows = stats.select(
        F.concat(F.lit("target_"), F.col("stat")).alias("check"),
        F.lit(target).alias("column"),
        "value",
        F.lit("INFO").alias("level"),
    )
    return reduce(lambda a, b: a.unionByName(b), [missing, duplicates, ranges, target_rows])
