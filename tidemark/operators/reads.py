"""Secured reads: filters, columns, order, pages and counts, applied after row security."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Unit
from tidemark.operators.estimates import estimate, sure, usable
from tidemark.operators.security import check_role, in_scope, secure
from tidemark.sources.store import Store

ROW_CAP = 1000


def condition(df: DataFrame, spec) -> Column:
    """A filter as a column: (column, operator, value), a list (all of them), {"or": [...]}, {"and": [...]} or {"not": ...}.

    Operators: eq neq gt gte lt lte like in is. Literals take the column's type; nulls follow SQL.
    """
    if isinstance(spec, Mapping):
        [(kind, rest)] = spec.items()
        if kind == "not":
            return ~condition(df, rest)
        parts = [condition(df, r) for r in rest]
        if kind not in ("or", "and") or not parts:
            raise ValueError(f"unknown filter {kind!r}")
        return reduce((lambda a, b: a | b) if kind == "or" else (lambda a, b: a & b), parts)
    if isinstance(spec, list):
        return reduce(lambda a, b: a & b, (condition(df, s) for s in spec), F.lit(True))
    name, op, value = spec
    c, kind = df[name], df.schema[name].dataType
    cast = lambda v: F.lit(v).cast(kind)
    if op == "like":
        return c.like(value.replace("*", "%"))
    if op == "in":
        return c.isin(*[cast(v) for v in value])
    if op == "is":
        return c.isNull() if value is None else c.eqNullSafe(F.lit(value))
    table = {"eq": c == cast(value), "neq": c != cast(value), "gt": c > cast(value), "gte": c >= cast(value), "lt": c < cast(value), "lte": c <= cast(value)} if op in ("eq", "neq", "gt", "gte", "lt", "lte") else {}
    if op not in table:
        raise ValueError(f"unknown operator {op!r}")
    return table[op]


@dataclass(frozen=True)
class Query:
    """One read. Order is a list of (column, "asc" or "desc"): nulls last upwards, first downwards.

    ``after`` holds the order columns' values of the last row of the page before: the page goes on
    behind it without counting off what came before. The order should tell all rows apart,
    since rows equal to it in all order columns are passed over.
    """

    where: Sequence = ()
    select: Sequence[str] = ()
    order: Sequence[tuple[str, str]] = ()
    limit: int | None = None
    offset: int = 0
    after: Sequence = ()
    cap: int | None = field(default=ROW_CAP)  # None: no cap

    def filtered(self, df: DataFrame) -> DataFrame:
        return df.filter(condition(df, list(self.where))) if self.where else df

    def behind(self, df: DataFrame) -> Column:
        """Rows behind ``after`` in the order. The first column's bound stands alone too, so that it reaches the scan."""
        if len(self.after) != len(self.order):
            raise ValueError("after needs a value for each column of the order")
        out, same, first = F.lit(False), F.lit(True), None
        for (name, way), v in zip(self.order, self.after):
            c, v = df[name], F.lit(v).cast(df.schema[name].dataType)
            if way == "desc":  # nulls come first
                later, from_here = F.when(v.isNull(), c.isNotNull()).otherwise(c < v), v.isNull() | (c <= v)
            else:
                later, from_here = v.isNotNull() & (c.isNull() | (c > v)), c.isNull() | (c >= v)
            first = from_here if first is None else first
            out = out | (same & F.coalesce(later, F.lit(False)))
            same = same & c.eqNullSafe(v)
        return first & out

    def spans(self) -> list:
        """Conditions that rule partitions out: the filter's, and where the order leads through the first column, ``after``'s."""
        where = list(self.where)
        if self.after and self.after[0] is not None:
            name, way = self.order[0]
            where.append((name, "lte" if way == "desc" else "gte", self.after[0]))
        return where

    def page(self, df: DataFrame) -> DataFrame:
        """Filter, order, skip, limit (never above the cap) and pick columns."""
        out = self.filtered(df)
        if self.after:
            out = out.filter(self.behind(df))
        if self.order:
            out = out.orderBy(*[F.col(c).desc_nulls_first() if way == "desc" else F.col(c).asc_nulls_last() for c, way in self.order])
        if self.offset:
            out = out.offset(self.offset)
        bounds = [n for n in (self.limit, self.cap) if n is not None]
        if bounds:
            out = out.limit(min(bounds))
        return out.select(*self.select) if self.select else out

    def exact_count(self, df: DataFrame) -> DataFrame:
        """One row ``total``: all rows of the filter, whatever the page."""
        return self.filtered(df).agg(F.count("*").alias("total"))

    def estimated_count(self, df: DataFrame, visible_rows: int, sample: float = 0.01, seed: int = 7) -> tuple[int, bool]:
        """(rows, exact) without sketches: counted up to the cap, above it ``visible_rows``, the rows of ``df`` without the filter, scaled by a sample."""
        few, exact = self.counted(df)
        if exact:
            return few, True
        part = df.sample(sample, seed)
        seen, hit = part.agg(F.count("*"), F.count_if(condition(df, list(self.where)))).first()
        return max(few, round(visible_rows * hit / max(1, seen))), False

    def counted(self, df: DataFrame) -> tuple[int, bool]:
        """(rows, True) if they are no more than the cap, else (cap + 1, False)."""
        cap = ROW_CAP if self.cap is None else self.cap
        few = self.filtered(df).limit(cap + 1).count()
        return few, few <= cap


class SecureReader:
    """Reads of one requester: every table comes through row security first."""

    def __init__(self, store: Store, grants: DataFrame, claims: Mapping):
        self.store, self.grants, self.claims = store, grants, claims

    def table(self, schema: str | None, table: str, where: Sequence = ()) -> DataFrame:
        """The visible rows; the schema may be left out when only one is published. ``where`` spares partitions, see :meth:`Store.read`."""
        check_role(self.claims)
        schema = self.named(schema)
        now = self.store.current(schema, table)
        df = self.store.read(schema, table, where)
        units = now["policy"]["units"]
        return secure(df, schema, None if units is None else [Unit(**u) for u in units], now["policy"]["claim"], self.grants, self.claims)

    def named(self, schema: str | None) -> str:
        """The schema, or the only one that is published."""
        if schema is None:
            names = {s for s, _ in self.store.tables()}
            if len(names) != 1:
                raise ValueError("name a schema")
            schema = names.pop()
        return schema

    def read(self, schema: str | None, table: str, query: Query) -> DataFrame:
        return query.page(self.table(schema, table, query.spans()))

    def count(self, schema: str | None, table: str, query: Query, exact: bool = True, sharp: bool = False) -> DataFrame:
        """One row (total, exact): the visible rows of the filter, whatever the page.

        With ``exact`` False more rows than the cap are estimated from the sketches of the visible
        units' rows, so hidden rows are in no number; where the table has no sketches of the
        filter's columns, rows are counted all the same. ``sharp``: sketches tell only of the
        combinations of units that they hold exactly, rows of the others are counted, so the
        total is the true one at any size.
        """
        schema = self.named(schema)
        visible, certain = self.table(schema, table, query.where), F.lit(True).alias("exact")
        if not exact:
            few, known = query.counted(visible)
            if known:
                return self.store.spark.createDataFrame([(few, True)], "total long, exact boolean")
            found = self.estimated(schema, table, query, sharp)
            if found is not None:
                return found.select(F.greatest("total", F.lit(few)).alias("total"), F.lit(False).alias("exact"))
        return query.exact_count(visible).select("total", certain)

    def estimated(self, schema: str, table: str, query: Query, sharp: bool = False) -> DataFrame | None:
        """The estimate alone, see :meth:`count`; None if the sketches can't tell of a condition."""
        now = self.store.current(schema, table)
        columns = T.StructType.fromJson(now["columns"])
        kinds = {c: columns[c].dataType for c in now.get("estimate") or ()}
        units = now["policy"]["units"]
        keys = list(dict.fromkeys(u["column"] for u in units or ()))
        kinds = {c: k for c, k in kinds.items() if c not in keys}
        if not usable(query.where, kinds, keys):
            return None
        sketches = self.store.sketches(schema, table, query.where)
        if sketches is None:
            return None
        seen = secure(sketches, schema, None if units is None else [Unit(**u) for u in units], now["policy"]["claim"], self.grants, self.claims)
        keyed = [s for s in query.where if s[0] in keys]
        if not sharp:
            return estimate(seen, query.where, kinds, condition(seen, keyed) if keyed else None)
        unsure = seen.groupBy(*keys).agg(F.bool_and(sure(query.where, kinds)).alias("__sure")).filter("NOT __sure")
        unsure = unsure.select(*[F.col(k).alias(f"__{k}") for k in keys])
        told = lambda df: reduce(lambda a, b: a & b, (df[k].eqNullSafe(unsure[f"__{k}"]) for k in keys), F.lit(True))
        held = seen.join(unsure, told(seen), "left_anti")
        rows = query.filtered(self.table(schema, table, query.where))
        rest = rows.join(unsure, told(rows), "left_semi").agg(F.count("*").alias("total"))
        return estimate(held, query.where, kinds, condition(held, keyed) if keyed else None).unionByName(rest).agg(F.sum("total").alias("total"))


def catalog(spark: SparkSession, store: Store, claims: Mapping | None = None) -> DataFrame:
    """schema, table, column, type and protected of all published tables, those in scope if claims are given."""
    rows = []
    for schema, table in store.tables():
        if claims is None or in_scope(claims, schema):
            now = store.current(schema, table)
            rows += [(schema, table, f["name"], f["type"] if isinstance(f["type"], str) else f["type"]["type"], now["policy"]["units"] is not None) for f in now["columns"]["fields"]]
    return spark.createDataFrame(rows, "schema string, table string, column string, type string, protected boolean")


def namespaces(spark: SparkSession, store: Store, claims: Mapping | None = None) -> DataFrame:
    """schema and how many tables it publishes, for every namespace, an empty one too; those in scope if claims are given."""
    held = Counter(schema for schema, _ in store.tables())
    rows = [(s, held[s]) for s in store.schemas() if claims is None or in_scope(claims, s)]
    return spark.createDataFrame(rows, "schema string, tables long")
