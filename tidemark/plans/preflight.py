"""What is wrong with a configuration, told by its text, its sources' schemas and their rows before anything is written."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import RangeLayout, Table, TimeLayout, read_config
from tidemark.plans.sync import source

FOUND = "schema string, table string, problem string, blocks boolean, rows long"
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


def columns_wanted(table: Table) -> dict[str, str]:
    """What each column that the table's configuration names is for; the first use counts."""
    uses = [("layout", (table.layout.column,) if table.layout else ()), ("rls", tuple(u.column for u in table.rls or ()))]
    uses += [(use, getattr(table, use)) for use in ("order", "index", "estimate", "split")]
    wanted: dict[str, str] = {}
    for use, names in uses:
        for name in names:
            wanted.setdefault(name, use)
    return wanted


def unfit(table: Table, schema: T.StructType) -> list[str]:
    """Problems that the source's schema alone tells; the table can't be synced with any of them."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out = [f"{use}: no column {name}" for name, use in columns_wanted(table).items() if name not in kinds]
    layout = table.layout
    if isinstance(layout, TimeLayout) and not isinstance(kinds.get(layout.column, T.DateType()), TIMES):
        out.append(f"layout: {layout.column} is no time but {kinds[layout.column].simpleString()}")
    if isinstance(layout, RangeLayout) and not isinstance(kinds.get(layout.column, T.LongType()), T.IntegralType):
        out.append(f"layout: {layout.column} is no integer but {kinds[layout.column].simpleString()}")
    return out


def measures(table: Table, schema: T.StructType) -> list[tuple[str, bool, Column]]:
    """(problem, whether it blocks, how many rows have it) of what only the rows tell."""
    out, layout = [], table.layout
    if layout is not None:
        c = F.col(layout.column)
        if isinstance(layout, RangeLayout):
            out.append(("rows in the remainder", False, F.count_if(c.isNull() | (c < layout.start) | (c >= layout.end))))
        else:
            out.append(("rows without a time", False, F.count_if(c.isNull())))
            if isinstance(schema[layout.column].dataType, T.StringType):
                out.append(("texts that are no time", True, F.count_if(c.isNotNull() & F.try_to_timestamp(c).isNull())))
    if table.rls is not None:
        hidden = reduce(lambda a, b: a & b, (F.col(u.column).isNull() for u in table.rls), F.lit(True))
        out.append(("rows without a unit, for admins only", False, F.count_if(hidden)))
    if table.split:
        out.append(("rows with a null in the split key", False, F.count_if(reduce(lambda a, b: a | b, (F.col(s).isNull() for s in table.split)))))
    return out


def preflight(spark: SparkSession, text: str, sources: Mapping[str, DataFrame | str] | None = None) -> DataFrame:
    """Every problem of a configuration in JSON: schema, table, problem, blocks, rows.

    ``blocks`` are those with which the table would fail to sync: entries that contradict
    themselves, columns that the source lacks or that don't fit the layout, sources that
    can't be opened. What the rows tell (times that are null, values outside the ranges, rows
    that only admins would see) is counted in one aggregate a table, which reads the named columns
    alone; ``rows`` is null for what needs no count. A sound table gives no row.
    """
    config, bad = read_config(text)
    told = [(schema, table, problem, True, None) for schema, table, problem in bad]
    counted = []
    for table in config.tables():
        try:
            df = source(spark, table, sources or {})
            schema = df.schema
        except Exception as e:  # noqa: BLE001  whatever keeps a source shut is told, and the other tables go on
            told.append((table.schema, table.name, f"source: {str(e).splitlines()[0][:200]}", True, None))
            continue
        wrong = unfit(table, schema)
        told += [(table.schema, table.name, problem, True, None) for problem in wrong]
        found = [] if wrong else measures(table, schema)
        if found:
            one = df.agg(F.array(*[F.struct(F.lit(p).alias("problem"), F.lit(b).alias("blocks"), n.alias("rows")) for p, b, n in found]).alias("found"))
            counted.append(one.select(F.lit(table.schema).alias("schema"), F.lit(table.name).alias("table"), F.inline("found")).filter("rows > 0"))
    return reduce(DataFrame.unionByName, counted, spark.createDataFrame(told, FOUND))
