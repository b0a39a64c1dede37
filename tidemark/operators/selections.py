"""Row selections: one description, one boolean column, used to extract rows and to retain the others."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Everything:
    """All rows."""


@dataclass(frozen=True)
class Between:
    """Rows in [lower, upper): text bounds of time columns or integers."""

    column: str
    lower: str | int
    upper: str | int


@dataclass(frozen=True)
class Remainder:
    """Null and all values outside [start, end)."""

    column: str
    start: int
    end: int


Selection = Everything | Between | Remainder


def predicate(selection: Selection, df: DataFrame) -> Column:
    """The condition of a selection; bounds take the type of the column, so they reach the scan."""
    if isinstance(selection, Everything):
        return F.lit(True)
    c = F.col(selection.column)
    kind = df.schema[selection.column].dataType
    if isinstance(selection, Between):
        return (c >= F.lit(selection.lower).cast(kind)) & (c < F.lit(selection.upper).cast(kind))
    return c.isNull() | (c < F.lit(selection.start).cast(kind)) | (c >= F.lit(selection.end).cast(kind))


def select_rows(df: DataFrame, selection: Selection) -> DataFrame:
    return df if isinstance(selection, Everything) else df.filter(predicate(selection, df))


def retain(df: DataFrame, affected: Iterable[Selection]) -> DataFrame:
    """Rows in none of the selections. A null condition means not affected, so null rows stay unless selected."""
    hit = reduce(lambda a, b: a | b, (predicate(s, df) for s in affected), F.lit(False))
    return df.filter(~F.coalesce(hit, F.lit(False)))
