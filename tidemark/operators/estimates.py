"""Counts of filtered rows from sketches, kept for each partition and combination of access units."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 400
ERROR = 0.007  # of a sketch's rows, for one bound, with 99 % confidence at this K
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)
REAL = (T.FloatType, T.DoubleType)
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def number(c: Column, kind: T.DataType) -> Column:
    """A value of a sketched type as a number that keeps its order: times as microseconds, dates as days."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("double" if isinstance(kind, REAL) else "long")


def sketch(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each combination of ``keys``: ``rows`` and, for each column, a quantile sketch (numbers, times) or a sketch of its different values, and its nulls.

    Groups of at most ``K`` rows are held exactly. Partial sketches are merged after a map-side combine.
    """
    parts = [F.count("*").alias("rows")]
    for name in columns:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, REAL):
            kept = F.kll_sketch_agg_double(number(F.when(~F.isnan(c), c), kind), F.lit(K))
        elif isinstance(kind, WHOLE):
            kept = F.kll_sketch_agg_bigint(number(c, kind), F.lit(K))
        else:
            kept = F.hll_sketch_agg(c.cast("string"))
        real = c.isNotNull() & ~F.isnan(c) if isinstance(kind, REAL) else c.isNotNull()
        parts += [kept.alias(f"sketch_{name}"), F.count_if(real).alias(f"held_{name}")]
    return df.groupBy(*keys).agg(*parts)


def usable(where: Sequence, kinds: Mapping[str, T.DataType], keys: Sequence[str]) -> bool:
    """Whether the sketches of columns ``kinds``, or the keys, can tell of every condition."""
    for spec in where:
        if not isinstance(spec, (tuple, list)) or len(spec) != 3:
            return False
        name, op, _ = spec
        if name in keys:
            continue
        if name not in kinds or op not in ("eq", "in", *(("gt", "gte", "lt", "lte") if isinstance(kinds[name], (*WHOLE, *REAL)) else ())):
            return False
    return True


def _share(name: str, kind: T.DataType, specs: Sequence) -> Column:
    """Share of a sketch's rows that meet all conditions on one column; of a column that is only counted, those that are not null."""
    kept, held, rows = F.col(f"sketch_{name}"), F.col(f"held_{name}").cast("double"), F.col("rows")
    if not isinstance(kind, (*WHOLE, *REAL)):
        return held / rows
    real = isinstance(kind, REAL)
    rank = F.kll_sketch_get_rank_double if real else F.kll_sketch_get_rank_bigint
    value = lambda v: number(F.lit(v).cast(kind), kind)
    least = F.lit(math.ulp(0.0)) if real else F.lit(1)
    to = lambda v: F.coalesce(rank(kept, value(v)), F.lit(0.0))  # noqa: E731  share of values up to v
    under = lambda v: to_under(rank, kept, value(v), least, real)
    low, high, points = F.lit(0.0), F.lit(1.0), []
    for _, op, v in specs:
        if op in ("gt", "gte"):
            low = F.greatest(low, to(v) if op == "gt" else under(v))
        elif op in ("lt", "lte"):
            high = F.least(high, to(v) if op == "lte" else under(v))
        else:
            points.append(reduce(lambda a, b: a + b, (to(x) - under(x) for x in (dict.fromkeys(v) if op == "in" else [v]))))
    share = F.greatest(F.lit(0.0), high - low)
    for p in points:
        share = F.least(share, p)
    return F.when(held > 0, share * held / rows).otherwise(0.0)


def to_under(rank, kept: Column, v: Column, least: Column, real: bool) -> Column:
    """Share of values below v: up to the number before it."""
    before = v - F.greatest(F.abs(v) * 2.0**-53, least) if real else v - least
    return F.coalesce(rank(kept, before), F.lit(0.0))


def sure(where: Sequence, kinds: Mapping[str, T.DataType]) -> Column:
    """Whether a sketch's share is its rows' true one: conditions on at most one sketched column, a number or time, of which it holds every value."""
    names = list({spec[0] for spec in where if spec[0] in kinds})
    if not names:
        return F.lit(True)
    if len(names) > 1 or not isinstance(kinds[names[0]], (*WHOLE, *REAL)):
        return F.lit(False)
    return F.col(f"held_{names[0]}") <= K


def estimate(sketches: DataFrame, where: Sequence, kinds: Mapping[str, T.DataType], keyed: Column | None = None) -> DataFrame:
    """One row ``total``: rows of all sketches that meet the conditions, columns taken as independent within a sketch.

    ``keyed`` holds the conditions on keys, which are met exactly. With one column in the
    conditions the error is at most 2 * ``ERROR`` of the sketches' rows. Other than numbers and
    times, values are taken as equally frequent: their number is that of all visible sketches merged.
    """
    by: dict[str, list] = {}
    for spec in where:
        if spec[0] in kinds:
            by.setdefault(spec[0], []).append(spec)
    if keyed is not None:
        sketches = sketches.filter(keyed)
    share = reduce(lambda a, b: a * b, (_share(name, kinds[name], specs) for name, specs in by.items()), F.lit(1.0))
    total = F.sum(F.col("rows") * share)
    for name, specs in by.items():
        if not isinstance(kinds[name], (*WHOLE, *REAL)):
            values = min((len(set(v)) if op == "in" else 1) for _, op, v in specs)
            different = F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{name}"))
            total = total * F.least(F.lit(1.0), values / F.greatest(different, F.lit(1)))
    return sketches.agg(F.coalesce(F.round(total), F.lit(0)).cast("long").alias("total"))
