"""Values seen against what their category (position, segment) has shown so far.

A category is one of a few, so its history is always long: moments run over ranges of the whole order, counts over
the blocks that `on_timeline` cuts long histories into.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplane.keys import Keys, as_tuple
from chronoplane.operators.ranges import RANGE, in_ranges, with_ranges
from chronoplane.operators.timeline import join_same, on_timeline

# Score weights and thresholds of the category rule, thresholds of the elite flag.
CENTER_SCORE, FORWARD_SCORE, GUARD_SCORE = 3.0, 1.0, 2.0
CATEGORIES = ("Guard", "Wing", "Forward", "Center")
ELITE = {
    "Guard": (20, 7, 5),
    "Wing": (18, 5, 6),
    "Forward": (18, 4, 8),
    "Center": (16, 3, 10),
}


def running_moments(df: DataFrame, keys: Keys, values) -> DataFrame:
    """Count, mean and sample deviation of all earlier rows: `<value>_prior_n/_mean/_std`.

    The whole table is cut into ranges of (entity, order), so a category of any size spans as many tasks as its share of
    the rows. Inside a range the moments run over its own rows; those of the ranges before are merged from one row per
    entity and range. Squares are always taken around a mean of the same entity, which keeps them small where the mean
    is far above the deviation. Rows equal in the whole order come in any order; a NULL entity is one of its own.
    """
    values, by = as_tuple(values), list(keys.entity)
    number = {v: F.col(v).cast("double") for v in values}
    rows = in_ranges(df, [*[F.col(c) for c in by], *keys.order])
    per = _moments_before(rows, by, number)
    inside = Window.partitionBy(*by, RANGE).orderBy(*keys.order).rowsBetween(Window.unboundedPreceding, -1)
    own = {}
    for v, x in number.items():
        own |= {f"__{m}_{v}": c for m, c in _moments(x, lambda c: c.over(inside)).items()}
    out = with_ranges(rows.withColumns(own), per, by)
    cols = {}
    for v in values:
        # `m` of this range, `b` of the ranges before.
        m, b = ({k: F.col(f"__{side}{k}_{v}") for k in MOMENTS} for side in ("", "b"))
        n1, n2 = (F.coalesce(s["n"], F.lit(0)) for s in (b, m))
        s1, s2, q1, q2 = (F.coalesce(s[k], F.lit(0.0)) for k in ("s", "q") for s in (b, m))
        n, low, high = n1 + n2, F.least(b["low"], m["low"]), F.greatest(b["high"], m["high"])
        apart = s2 / n2 - s1 / n1
        between = F.when((n1 > 0) & (n2 > 0), apart * apart * n1 * n2 / n).otherwise(F.lit(0.0))
        # Means of equal values differ by rounding, their deviation is an exact zero.
        level = (low == high) & (F.abs(low) < F.lit(float("inf")))
        cols[f"{v}_prior_n"] = n
        cols[f"{v}_prior_mean"] = F.when(n > 0, (s1 + s2) / n)
        cols[f"{v}_prior_std"] = F.when(n > 1, F.when(level, F.lit(0.0)).otherwise(F.sqrt((q1 + q2 + between) / (n - 1))))
    helpers = [f"__{side}{k}_{v}" for v in values for side in ("", "b") for k in MOMENTS]
    return out.withColumns(cols).drop(*helpers, RANGE)


MOMENTS = ("n", "s", "q", "low", "high")


def _moments(x: Column, over: Callable[[Column], Column] = lambda c: c) -> dict[str, Column]:
    """Aggregates of MOMENTS: count, sum, sum of squares around the mean, smallest and largest value."""
    n, s, var, low, high = map(over, (F.count(x), F.sum(x), F.var_pop(x), F.min(x), F.max(x)))
    return dict(zip(MOMENTS, (n, s, var * n, low, high)))


def _moments_before(rows: DataFrame, by: list[str], number: dict[str, Column]) -> DataFrame:
    """`by`, RANGE and `__b<moment>_<value>`: the moments of all ranges before a range, within each entity.

    The squares between the means of ranges are taken around the mean of the entity's first range.
    """
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*by, RANGE).agg(*[c.alias(f"__{m}_{v}") for v, x in number.items() for m, c in _moments(x).items()])
    for v in number:
        mean = F.col(f"__s_{v}") / F.nullif(F.col(f"__n_{v}"), F.lit(0))
        per = per.withColumn(f"__c_{v}", F.coalesce(F.first(mean, True).over(earlier), mean))
    for v in number:
        n, s, q, low, high = (F.col(f"__{m}_{v}") for m in MOMENTS)
        off = F.when(n > 0, s / n - F.col(f"__c_{v}"))
        total, shift, wide = (F.sum(c).over(earlier) for c in (n, n * off, n * off * off))
        between = wide - shift * shift / total
        per = per.withColumns({
            f"__bn_{v}": total,
            f"__bs_{v}": F.sum(s).over(earlier),
            f"__bq_{v}": F.sum(q).over(earlier) + F.when(between > wide * 1e-13, between).otherwise(F.lit(0.0)),
            f"__blow_{v}": F.min(low).over(earlier),
            f"__bhigh_{v}": F.max(high).over(earlier),
        })
    return per.select(*by, RANGE, *[f"__b{m}_{v}" for v in number for m in MOMENTS])


def group_z(df: DataFrame, keys: Keys, category: str, values) -> DataFrame:
    """Entity's previous value against the category's earlier rows: `<value>_z` and `<value>_diff`."""
    values = as_tuple(values)
    lagged = on_timeline(
        df, keys, lambda t: t.look_back(1, {f"__p_{v}": (lambda w, v=v: F.lag(v).over(w)) for v in values})
    )
    by_category = keys.with_(entity=(category,), event=(*keys.entity, *keys.event))
    out = running_moments(lagged, by_category, values)
    cols = {}
    for v in values:
        mean, std, prev = F.col(f"{v}_prior_mean"), F.col(f"{v}_prior_std"), F.col(f"__p_{v}")
        cols[f"{v}_z"] = (prev - mean) / F.nullif(std, F.lit(0.0))
        cols[f"{v}_diff"] = prev - mean
    helpers = [f"{v}_prior_{m}" for v in values for m in ("n", "mean", "std")]
    return out.withColumns(cols).drop(*helpers, *[f"__p_{v}" for v in values])


def expanding_percentile(df: DataFrame, keys: Keys, category: str, value: str,
                         name: str = "percentile", empty: float = 50.0) -> DataFrame:
    """Share (0 to 100) of the category's earlier values strictly below the row's value.

    Rows are cut into ranges twice, by time and by value; of equal values the latest comes first, so a row that is
    before another in both orders is earlier and truly smaller. Those of the same time range are counted inside it,
    those of the same value range and an earlier time range inside that, all others by a table of how many rows a time
    and a value range share: a range each, and that table of ranges by ranges, is all that a task holds. A category with NULL
    as its name has no percentile: its rows get `empty`, as do rows without a value or without earlier ones.
    """
    grain = [c for c in keys.grain if c != category]
    order = [F.col(keys.time), *[F.col(c) for c in (*keys.entity, *keys.event)]]
    slim = df.filter(F.col(value).isNotNull() & F.col(category).isNotNull())
    slim = slim.select(F.col(category).alias("__cat"), F.col(value).alias("__value"), *grain)
    by_time = in_ranges(slim, [F.col("__cat"), *order]).withColumnRenamed(RANGE, "__t")
    place = F.row_number().over(Window.partitionBy("__cat", "__t").orderBy(*order))
    upward = [F.col("__value"), *[c.desc() for c in order]]
    by_value = in_ranges(by_time.withColumn("__k", place), [F.col("__cat"), *upward]).withColumnRenamed(RANGE, "__v")
    height = F.row_number().over(Window.partitionBy("__cat", "__v").orderBy(*upward))
    rows = by_value.withColumn("__m", height).drop("__value").withColumn("__below", F.lit(0).cast("long"))

    def with_below(block, counts):
        below = pa.array(block["__below"].to_numpy() + counts, pa.int64())
        return block.set_column(block.schema.get_field_index("__below"), "__below", below)

    def inside_time(block):
        k, v, m = (block[c].to_numpy() for c in ("__k", "__v", "__m"))
        return with_below(block, earlier_and_smaller(k, (v, m)))

    def inside_value(block):
        # Rows of one time range are counted there: the highest comes first, so none is before another in both orders.
        t, m = (block[c].to_numpy() for c in ("__t", "__m"))
        at = np.empty(len(t), np.int64)
        at[np.lexsort((-m, t))] = np.arange(len(t))
        return with_below(block, earlier_and_smaller(at, (m,)))

    def of_ranges(cells):
        t, ts = np.unique(cells["__t"].to_numpy(), return_inverse=True)
        v, vs = np.unique(cells["__v"].to_numpy(), return_inverse=True)
        table = np.zeros((len(t) + 1, len(v) + 1), np.int64)
        np.add.at(table, (ts + 1, vs + 1), cells["__n"].to_numpy())
        table = table.cumsum(0).cumsum(1)
        return cells.append_column("__both", pa.array(table[ts, vs])).append_column("__before", pa.array(table[ts, -1]))

    cells = rows.groupBy("__cat", "__t", "__v").agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.groupBy("__cat").applyInArrow(of_ranges, f"{_ddl(cells)}, __both long, __before long")
    cells = cells.drop("__n")
    counted = rows.groupBy("__cat", "__t").applyInArrow(inside_time, _ddl(rows)).groupBy("__cat", "__v").applyInArrow(inside_value, _ddl(rows))
    below = counted.join(cells, ["__cat", "__t", "__v"]).withColumn(category, F.col("__cat")).select(
        *keys.grain,
        (F.col("__below") + F.col("__both")).alias("__below"),
        (F.col("__before") + F.col("__k") - 1).alias("__seen"),
    )
    out = join_same(df, below, keys.grain, "left")
    share = F.col("__below") / F.nullif(F.col("__seen"), F.lit(0)) * 100
    return out.withColumn(name, F.coalesce(share, F.lit(empty))).drop("__below", "__seen")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def earlier_and_smaller(at: np.ndarray, by: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each entry the number of entries earlier in `at` and smaller by the columns `by`, neither with ties.

    The rank by `by` is read bit by bit: earlier entries that agree above a bit, and lack it where the entry has it, are
    one part of the smaller ones. A stable sort by the upper bits and a running count give them: n log n, no pairs.
    """
    n = len(at)
    rank = np.empty(n, np.int64)
    rank[np.lexsort(by[::-1])] = np.arange(n)
    time = np.argsort(at, kind="stable")
    rank, found = rank[time], np.zeros(n, np.int64)
    for bit in range(max(0, n - 1).bit_length()):
        upper = rank >> (bit + 1)
        order = np.argsort(upper, kind="stable")
        has, group = (rank[order] >> bit) & 1, upper[order]
        lacking = np.cumsum(1 - has)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        start = np.repeat(lacking[first] - (1 - has[first]), np.diff(np.append(first, n)))
        found[order] += np.where(has == 1, lacking - start, 0)
    out = np.empty(n, np.int64)
    out[time] = found
    return out


def category_of(big: Column, guard: Column) -> Column:
    return (
        F.when(big > CENTER_SCORE, "Center")
        .when(big > FORWARD_SCORE, "Forward")
        .when(guard > GUARD_SCORE, "Guard")
        .otherwise("Wing")
    )


def _scores(reb: Column, ast: Column, three: Column, shots: Column) -> tuple[Column, Column]:
    rate = F.coalesce(three / F.nullif(shots, F.lit(0.0)), F.lit(0.0))
    # Weights of the two composite scores.
    guard = ast * 0.5 + rate * 10 - reb * 0.3
    big = reb * 0.8 - ast * 0.3 - rate * 5
    return big, guard


def entity_profile(df: DataFrame, keys: Keys, rebounds: str, assists: str, threes: str, shots: str,
                   as_of: bool = True, name: str = "position") -> DataFrame:
    """Category of the entity from its average profile.

    `as_of=True` averages only earlier rows, so the category may be used as a feature; `as_of=False`
    averages the whole history, which looks ahead.
    """
    stats = (rebounds, assists, threes, shots)
    if as_of:
        out = running_moments(df, keys, stats)
        big, guard = _scores(*[F.col(f"{s}_prior_mean") for s in stats])
        helpers = [f"{s}_prior_{m}" for s in stats for m in ("n", "mean", "std")]
        return out.withColumn(name, category_of(big, guard)).drop(*helpers)
    means = df.groupBy(*keys.entity).agg(*[F.avg(s).alias(f"__m_{s}") for s in stats])
    big, guard = _scores(*[F.col(f"__m_{s}") for s in stats])
    profile = means.select(*keys.entity, category_of(big, guard).alias(name))
    return join_same(df, profile, keys.entity, "left").withColumn(name, F.coalesce(name, F.lit("Wing")))


def one_hot(df: DataFrame, column: str, values=CATEGORIES, prefix: str = "is_") -> DataFrame:
    """0/1 column per value."""
    hit = {f"{prefix}{v.lower()}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values}
    return df.withColumns(hit)


def elite_flag(df: DataFrame, category: str, points: str, assists: str, rebounds: str, thresholds=ELITE,
               default: str = "Wing", name: str = "is_elite") -> DataFrame:
    """1 where points reach the category's bar and assists or rebounds reach theirs."""
    def bar(i: int) -> Column:
        first, *rest = [(c, t[i]) for c, t in thresholds.items()]
        case = F.when(F.col(category) == first[0], F.lit(first[1]))
        for c, v in rest:
            case = case.when(F.col(category) == c, F.lit(v))
        return case.otherwise(F.lit(thresholds[default][i]))

    hit = (F.col(points) >= bar(0)) & ((F.col(assists) >= bar(1)) | (F.col(rebounds) >= bar(2)))
    return df.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int"))
