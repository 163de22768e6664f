"""Windows over entity histories that do not break when one history is huge.

A plain window hands a whole history to one task. That is right for almost all entities and wrong for the
few that hold a large share of the table. Every temporal operator therefore describes its columns once, as
steps on a `Timeline`, and `on_timeline` runs the steps twice:

* histories of at most `hot_rows` rows: one exchange on the entity, ordinary windows;
* longer histories: rows are numbered exactly (row counts per time slice, a prefix sum over the few slices,
  a row number inside each slice; a table that is one history as a whole by ranges of its order) and cut into blocks of `hot_rows` rows. Bounded frames get the last rows
  of the block before as read-only copies; running aggregates add what all blocks before sum up to.

Both give the same values. The list of long histories has at most (rows / hot_rows) entries: one million keys
for 10^12 rows and the default limit. That bounds its broadcast; a larger limit bounds it further. It must be a
broadcast, because a shuffled join would first send a long history to one task. Where the list is empty,
adaptive execution drops the second plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoplane.keys import Keys, day_number, require_columns
from chronoplane.operators.ranges import numbered

INDEX, BLOCK, TO, SLICE, OFFSET, TOTAL = "__k", "__blk", "__to", "__slice", "__off", "__total"
MIN_SLICE = -(2**62)
# A slice is 1 / 4096 of the step from a number to its double; subnormal numbers start 1075 such steps below 1.
SLICES_PER_OCTAVE, SMALLEST_LOG2 = 4096, 1076

_FOLDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """A running aggregate: fold is sum, count, max or min; `prior` leaves the current row out."""

    fold: str
    value: Column
    prior: bool = True


def same(left: DataFrame, right: DataFrame, cols) -> Column:
    """NULL-safe equality on equally named columns."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols], F.lit(True))


def join_same(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns where NULL equals NULL; keeps the left copy of the keys."""
    cols = list(cols)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in cols])


def slice_number(df: DataFrame, keys: Keys) -> Column:
    """Monotone integer that cuts a history into short pieces.

    Times are cut into `slice_seconds`; numbers into equal steps of their logarithm, so that values of a narrow
    range fall into many slices too, without knowing their minimum or maximum. NaN is the largest number.
    """
    col, kind = F.col(keys.time), df.schema[keys.time].dataType
    while isinstance(kind, T.StructType):
        # Structs are ordered by their first field.
        col, kind = col[kind[0].name], kind[0].dataType
    if isinstance(kind, T.StringType):
        # The first seven bytes as a number follow the byte order of the text.
        code = F.rpad(F.substring(F.hex(F.encode(col, "UTF-8")), 1, 14), 14, "0")
        number = F.conv(code, 16, 10).cast("long")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(col).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.hour(col) * 3600 + F.minute(col) * 60 + F.floor(F.second(col))
        per_day = max(1, 86_400 // keys.slice_seconds)
        number = day_number(col).cast("long") * per_day + F.least(
            F.floor(seconds / keys.slice_seconds), F.lit(per_day - 1)
        )
    elif isinstance(kind, T.NumericType):
        x = col.cast("double")
        size = F.floor((F.log2(F.abs(x)) + SMALLEST_LOG2) * SLICES_PER_OCTAVE)
        number = F.when(F.isnan(x), F.lit(2**61)).when(F.abs(x) == float("inf"), F.signum(x).cast("long") * 2**60)
        number = number.when(x == 0, F.lit(0)).otherwise((F.signum(x) * size).cast("long"))
    else:
        raise TypeError(f"cannot order a history by {kind.simpleString()}")
    return F.coalesce(number, F.lit(MIN_SLICE)).cast("long")


def dealt(df: DataFrame, parts: int | None, cols) -> DataFrame:
    """The rows dealt by `cols` into `parts` parts; None leaves it to the windows, which take the shuffle partitions."""
    return df.repartition(parts, *cols) if parts and cols else df


def number_rows(df: DataFrame, keys: Keys, index: str = INDEX, total: str | None = None, parts: int | None = None) -> DataFrame:
    """Exact 0-based position of every row in its history, with no task holding a history.

    Without an entity the whole table is numbered by ranges of its order. Else groups are (entity, time slice); only their
    row counts are put in order per entity.
    """
    if not keys.entity:
        return numbered(df, keys.order, index, total)
    rows = df.withColumn(SLICE, slice_number(df, keys))
    part = [*keys.entity, SLICE]
    per_entity = Window.partitionBy(*keys.entity)
    counts = (
        rows.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__cnt"))
        .withColumn(
            OFFSET,
            F.coalesce(
                F.sum("__cnt").over(per_entity.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    if total:
        counts = counts.withColumn(total, F.sum("__cnt").over(per_entity))
    rows = join_same(rows, counts.drop("__cnt"), part)
    in_slice = Window.partitionBy(*part).orderBy(*keys.order)
    return dealt(rows, parts, part).withColumn(index, (F.col(OFFSET) + F.row_number().over(in_slice) - 1).cast("long")).drop(
        SLICE, OFFSET
    )


@dataclass(frozen=True)
class Timeline:
    """One history per partition, in order; what `on_timeline` passes to the steps."""

    df: DataFrame
    keys: Keys
    block_rows: int | None = None
    parts: int | None = None

    @property
    def blocked(self) -> bool:
        return self.block_rows is not None

    @property
    def order(self) -> list[Column]:
        return [F.col(INDEX)] if self.blocked else self.keys.order

    @property
    def _part(self) -> list[str]:
        return [*self.keys.entity, BLOCK] if self.blocked else list(self.keys.entity)

    def _window(self, extra=()) -> WindowSpec:
        part = [*self._part, *extra]
        spec = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
        return spec.orderBy(*self.order)

    def columns(self, **cols: Column) -> "Timeline":
        return replace(self, df=self.df.withColumns(cols)) if cols else self

    def drop(self, *cols: str) -> "Timeline":
        return replace(self, df=self.df.drop(*cols))

    def position(self, name: str, total: str | None = None) -> "Timeline":
        """0-based number of the row in its history; `total` names a column with the length of the history."""
        if self.blocked:
            return self.columns(**{name: F.col(INDEX), **({total: F.col(TOTAL)} if total else {})})
        cols = {name: (F.row_number().over(self._window()) - 1).cast("long")}
        if total:
            whole = Window.partitionBy(*self._part) if self._part else Window.partitionBy(F.lit(0))
            cols[total] = F.count(F.lit(1)).over(whole)
        return self.columns(**cols)

    def look_back(self, rows: int, cols: dict[str, Callable[[WindowSpec], Column]]) -> "Timeline":
        """Columns over frames that reach at most `rows` rows back and never ahead."""
        return self.look_back_with(rows, _all_looks([Look(rows, cols)], self))

    def look_back_with(self, rows: int, add: Callable[[DataFrame, list[str]], DataFrame]) -> "Timeline":
        """`add(df, part)` for columns that need more than one window; `part` are the partition columns.

        In a cut history the rows of a block are preceded by copies of the last `rows` rows before it.
        """
        if not self.blocked:
            return replace(self, df=add(self.df, self._part))
        size = self.block_rows
        if rows > size:
            raise ValueError(f"look-back of {rows} rows exceeds the block of {size}")
        tail = (F.col(INDEX) % size) >= (size - rows)
        copies = F.when(tail, F.array(F.col(BLOCK), F.col(BLOCK) + 1)).otherwise(F.array(F.col(BLOCK)))
        spread = self.df.withColumn(TO, F.explode(copies))
        wide = add(dealt(spread, self.parts, [*self.keys.entity, TO]), [*self.keys.entity, TO])
        own = wide.filter(F.col(TO) == F.col(BLOCK)).drop(BLOCK).withColumnRenamed(TO, BLOCK)
        return replace(self, df=own)

    def running(self, cols: dict[str, Running], by=()) -> "Timeline":
        """Aggregates from the start of the history (or of the current `by` group) up to the row."""
        return self.running_by({(by,) if isinstance(by, str) else tuple(by): cols})

    def running_by(self, groups: dict[tuple[str, ...], dict[str, Running]]) -> "Timeline":
        """Running aggregates for several `by` groups at once; a cut history is read once per group more."""
        local = self.df
        for by, cols in groups.items():
            local = local.withColumns(
                {
                    n: _FOLDS[r.fold](r.value).over(
                        self._window(by).rowsBetween(Window.unboundedPreceding, -1 if r.prior else 0)
                    )
                    for n, r in cols.items()
                }
            )
        if self.blocked:
            for by, cols in groups.items():
                local = self._add_carry(local, cols, by)
        return replace(self, df=local)

    def _add_carry(self, local: DataFrame, cols: dict[str, Running], by) -> DataFrame:
        """Add to the aggregates inside the block what the blocks before sum up to."""
        part = [*self.keys.entity, *by]
        sums = self.df.groupBy(*part, BLOCK).agg(
            *[_FOLDS[r.fold](r.value).alias(f"__c_{n}") for n, r in cols.items()]
        )
        before = (
            (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0)))
            .orderBy(BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = sums.select(
            *part,
            BLOCK,
            *[
                _FOLDS["sum" if r.fold == "count" else r.fold](F.col(f"__c_{n}")).over(before).alias(f"__c_{n}")
                for n, r in cols.items()
            ],
        )
        joined = join_same(local, carry, [*part, BLOCK], "left")
        merged = {n: _merge(r.fold, F.col(n), F.col(f"__c_{n}")) for n, r in cols.items()}
        return joined.withColumns(merged).drop(*[f"__c_{n}" for n in cols])

    def whole(self, cols: dict[str, Running]) -> "Timeline":
        """Aggregates over the whole history on every row of it."""
        part = list(self.keys.entity)
        if not self.blocked:
            w = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
            return self.columns(**{n: _FOLDS[r.fold](r.value).over(w) for n, r in cols.items()})
        sums = self.df.groupBy(*(part or [F.lit(0).alias("__one")])).agg(
            *[_FOLDS[r.fold](r.value).alias(n) for n, r in cols.items()]
        )
        if part:
            return replace(self, df=join_same(self.df, sums, part))
        one = sums.select(F.struct(*cols).alias("s")).scalar()
        return self.columns(**{n: one.getField(n) for n in cols})


def _merge(fold: str, own: Column, before: Column) -> Column:
    if fold in ("max", "min"):
        return F.greatest(own, before) if fold == "max" else F.least(own, before)
    both = F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
    return both if fold == "count" else F.when(own.isNotNull() | before.isNotNull(), both)


def on_timeline(
    df: DataFrame,
    keys: Keys,
    steps: Callable[[Timeline], Timeline],
    reach: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """Run `steps` over every history of `df`; `reach` is the longest look-back, in rows, that they use.

    parts: into how many parts rows are dealt, where their number is known (`parts_for`); else the shuffle partitions.
    """
    require_columns(df, [*keys.entity, keys.time, *keys.event])
    limit = keys.hot_rows
    if limit is None:
        return steps(Timeline(dealt(df, parts, keys.entity), keys)).df
    entity = list(keys.entity)
    size = max(limit, reach)
    if not entity:
        # The whole table is one history, so its size is what decides: number and cut it always.
        return _blocked(df, keys, steps, size, parts)
    long_ones = F.broadcast(
        df.groupBy(*entity).agg(F.count(F.lit(1)).alias("__cnt")).filter(F.col("__cnt") > limit).drop("__cnt")
    )
    flagged = long_ones.select(*[F.col(c).alias(f"__h_{c}") for c in entity])
    is_long = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__h_{c}")) for c in entity])
    short = steps(Timeline(dealt(df.join(F.broadcast(flagged), is_long, "left_anti"), parts, entity), keys)).df
    cut = _blocked(df.join(F.broadcast(flagged), is_long, "left_semi"), keys, steps, size, parts)
    return short.unionByName(cut.select(*short.columns))


POSITION = "__pos"


@dataclass(frozen=True)
class Look:
    """Ask for columns over frames that reach at most `rows` rows back."""

    rows: int
    cols: dict[str, Callable[[WindowSpec], Column]]


@dataclass(frozen=True)
class LookWith:
    """Ask for columns that `add(df, part)` makes, with windows of its own."""

    rows: int
    add: Callable[[DataFrame, list[str]], DataFrame]


@dataclass(frozen=True)
class Run:
    """Ask for running aggregates."""

    cols: dict[str, Running]
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cols:
    """Ask for plain columns and drop helpers."""

    cols: dict[str, Column]
    drop: tuple[str, ...] = ()


def compose(*families: Callable[[], Iterator]) -> Callable[[Timeline], Timeline]:
    """Steps that run several feature families side by side.

    A family is a generator of requests (`Look`, `LookWith`, `Run`, `Cols`). Requests of the same kind are
    answered together, so all families share one exchange and sort, and a cut history is copied and carried
    once per round instead of once per family. `POSITION` holds the row's place in its history meanwhile.
    """

    def steps(t: Timeline) -> Timeline:
        t = t.position(POSITION)
        live = [family() for family in families]
        asked = [next(g, None) for g in live]

        def advance(kinds) -> list:
            taken = []
            for i, request in enumerate(asked):
                if isinstance(request, kinds):
                    taken.append(request)
                    asked[i] = next(live[i], None)
            return taken

        while any(request is not None for request in asked):
            if plain := advance(Cols):
                for request in plain:
                    t = t.columns(**request.cols).drop(*request.drop)
            elif looks := advance((Look, LookWith)):
                t = t.look_back_with(max(q.rows for q in looks), _all_looks(looks, t))
            else:
                by_group: dict[tuple[str, ...], dict[str, Running]] = {}
                for request in advance(Run):
                    by_group.setdefault(tuple(request.by), {}).update(request.cols)
                t = t.running_by(by_group)
        return t.drop(POSITION)

    return steps


def _all_looks(looks, t: Timeline) -> Callable[[DataFrame, list[str]], DataFrame]:
    order = t.order

    def add(df: DataFrame, part: list[str]) -> DataFrame:
        spec = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
        frames = {n: f for q in looks if isinstance(q, Look) for n, f in q.cols.items()}
        if frames:
            df = df.withColumns({n: f(spec.orderBy(*order)) for n, f in frames.items()})
        for q in looks:
            if isinstance(q, LookWith):
                df = q.add(df, part)
        return df

    return add


def _blocked(df: DataFrame, keys: Keys, steps, size: int, parts: int | None = None) -> DataFrame:
    numbered = number_rows(df, keys, total=TOTAL, parts=parts).withColumn(BLOCK, F.floor(F.col(INDEX) / size).cast("long"))
    return steps(Timeline(numbered, keys, size, parts)).df.drop(INDEX, BLOCK, TOTAL)
