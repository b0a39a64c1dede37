"""Change detection: signatures, the diff of manifests, plans and merged intervals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import Table
from tidemark.functions.expressions import epoch_ms
from tidemark.operators.partitions import fingerprint

KEY = ["schema", "table", "partition_id"]


def table_signature(table: Table, df: DataFrame) -> str:
    """Changes with the configuration, the layout and the source's columns."""
    return hashlib.sha256(f"{table.canonical()}|{df.schema.json()}".encode()).hexdigest()


def full_signature(table: Table, df: DataFrame, signature_mode: str = "content") -> str:
    """Signature of a table that is replaced whole: what was modified, and the configuration."""
    return df.agg(F.concat_ws(":", modified(df, signature_mode), F.lit(table_signature(table, df)))).first()[0]


def modified(df: DataFrame, signature_mode: str = "content") -> Column:
    """An aggregate that changes when the rows do, or in mode ``mtime`` when their files do."""
    return fingerprint(df.schema) if signature_mode == "content" else epoch_ms(F.max("_metadata.file_modification_time"))


def changed_tables(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Tables (schema, table, signature) whose stored signature differs or is missing."""
    old = stored.select("schema", "table", F.col("signature").alias("old"))
    return current.join(old, ["schema", "table"], "left").filter(~F.col("signature").eqNullSafe(F.col("old"))).drop("old")


def partition_diff(current: DataFrame, stored: DataFrame, rebuild: bool = False) -> DataFrame:
    """schema, table, partition_id and status (new, changed, removed, unchanged) of every partition on either side.

    A partition is unchanged only if signature and bounds agree; ``rebuild`` makes all
    current ones changed, as on a first sync or after the table's signature changed.
    """
    parts = ["signature", "kind", "column", "lower", "upper"]
    cur = current.select(*KEY, F.struct(*parts).alias("now"))
    old = stored.select(*KEY, F.struct(*parts).alias("was"))
    status = (
        F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "new")
        .when(F.lit(rebuild) | ~F.col("now").eqNullSafe(F.col("was")), "changed").otherwise("unchanged")
    )
    return cur.join(old, KEY, "full_outer").select(*KEY, status.alias("status"))


def removed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored partitions that the table has no more."""
    return stored.join(current.select(*KEY), KEY, "left_anti")


def affected(diff: DataFrame) -> DataFrame:
    """Partitions whose old rows must go."""
    return diff.filter(F.col("status").isin("new", "changed", "removed"))


def table_plans(diff: DataFrame) -> DataFrame:
    """One row for each table with something to do: counts by status."""
    return diff.groupBy("schema", "table").agg(*_counts()).filter("new + changed + removed > 0")


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "removed", "unchanged")]


def check_plan(diff: DataFrame, current: DataFrame, full: list[tuple[str, str]], known: list[tuple[str, str]]) -> list[Row]:
    """The rows of :func:`table_plans` for every table of ``diff``, unchanged ones too, by one aggregate.

    Raises ValueError on a plan that contradicts itself: work on partitions that the tables
    don't have now, removal of those they have, tables planned whole and by partition, and
    tables that are not configured.
    """
    sides = diff.select(*KEY, "status", F.lit(False).alias("here")).unionByName(current.select(*KEY, F.lit(None).cast("string").alias("status"), F.lit(True).alias("here")))
    both = sides.groupBy(*KEY).agg(F.max("status").alias("status"), F.bool_or("here").alias("here"))
    wrong = F.count_if(F.coalesce((F.col("status") == "removed") == F.col("here"), F.lit(True)))
    plans = both.groupBy("schema", "table").agg(*_counts(), wrong.alias("wrong")).collect()  # configured tables only
    if any(p.wrong for p in plans):
        raise ValueError("the plan and the current partitions disagree")
    tables = {(p.schema, p.table) for p in plans}
    if tables & set(full):
        raise ValueError("a table is planned both whole and by partition")
    if (tables | set(full)) - set(known):
        raise ValueError("the plan names an unknown table")
    return plans


def merged_intervals(parts: DataFrame) -> DataFrame:
    """Adjacent [lower, upper) ranges of partitions merged to few: schema, table, lower, upper, n."""
    w = Window.partitionBy("schema", "table").orderBy(F.col("lower").try_cast("long"), "lower")
    start = F.coalesce((F.lag("upper").over(w) != F.col("lower")).cast("int"), F.lit(1))
    groups = parts.withColumn("__start", start).withColumn("__rank", F.row_number().over(w)).withColumn("__island", F.sum("__start").over(w))
    ends = (F.min_by("lower", "__rank").alias("lower"), F.max_by("upper", "__rank").alias("upper"), F.count("*").alias("n"))
    return groups.groupBy("schema", "table", "__island").agg(*ends).drop("__island")
