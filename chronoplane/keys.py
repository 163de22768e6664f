"""How an operator finds its entity, its order and its size limits in a table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_tuple(cols) -> tuple[str, ...]:
    if cols is None:
        return ()
    return (cols,) if isinstance(cols, str) else tuple(cols)


@dataclass(frozen=True)
class Keys:
    """Names the columns every temporal operator needs.

    entity     columns whose rows form one history (may be empty: the whole table is one history)
    time       column that orders a history; date, timestamp, timestamp_ntz or a number
    event      tie-break columns that make the order total
    season     optional column at whose change season-wise running values restart
    hot_rows   a history longer than this is cut into blocks of this many rows, so that no task ever
               has to hold one whole history; None switches the check off
    slice_seconds
               width of the time slices in which a long history is numbered before it is cut
    """

    entity: tuple[str, ...]
    time: str
    event: tuple[str, ...]
    season: str | None = None
    hot_rows: int | None = 1_000_000
    slice_seconds: int = 86_400

    def __post_init__(self):
        object.__setattr__(self, "entity", as_tuple(self.entity))
        object.__setattr__(self, "event", as_tuple(self.event))

    @property
    def order(self) -> list[Column]:
        return [F.col(self.time), *[F.col(c) for c in self.event]]

    @property
    def grain(self) -> list[str]:
        """Entity, event and time: the columns that identify one row."""
        return list(dict.fromkeys([*self.entity, *self.event, self.time]))

    def with_(self, **changes) -> "Keys":
        return replace(self, **changes)


def day_number(col: Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp; the unit of every day-range frame."""
    return F.unix_date(F.to_date(col))


def in_days(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Rows with start <= day < end. Compares the column itself, so the filter reaches the scan."""
    kind = df.schema[time].dataType
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(str(start)).cast(kind))
    if end is not None:
        df = df.filter(F.col(time) < F.lit(str(end)).cast(kind))
    return df


def require_columns(df: DataFrame, cols) -> None:
    """Fail early, without a job, when a needed column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def require_rows(df: DataFrame, name: str = "input") -> DataFrame:
    """Fail when the table is empty. Runs a one-row job."""
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    return df
