"""A whole run: detect changes, extract what changed, publish table by table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Config, Table, TimeLayout
from tidemark.functions.expressions import struct_columns, structs_to_json
from tidemark.operators.changes import KEY, check_plan, full_signature, merged_intervals, modified, partition_diff, table_plans, table_signature
from tidemark.operators.partitions import (
    FILES, base_id, content, content_of, content_of_files, current_manifest, file_entries, fold, inventory, inventory_of_files, moved_files, partition_id, piece_of, pieces_in, signed, slot,
    split_fingerprint, with_bounds,
)
from tidemark.operators.selections import Between, Remainder, predicate
from tidemark.sources.store import MANIFEST, PID, ROWS, Store

RESULT = "schema string, table string, status string, version long, new long, changed long, removed long, error string"


def source(spark: SparkSession, table: Table, sources: Mapping[str, DataFrame | str]) -> DataFrame:
    """The source of a table: a given frame, or a Parquet path or table name."""
    given = sources.get(table.source, table.source)
    if isinstance(given, DataFrame):
        return given
    return spark.read.parquet(given) if "/" in given else spark.table(given)


def plain_files(spark: SparkSession, table: Table, sources: Mapping[str, DataFrame | str]) -> bool:
    """Whether a source is files as they are: a path, or a table of files that is no view. Only then do unchanged files mean unchanged rows."""
    given = sources.get(table.source, table.source)
    if isinstance(given, DataFrame):
        return False
    if "/" in given:
        return True
    try:
        spark.table(given).select("_metadata.file_path")
        return spark.catalog.getTable(given).tableType in ("MANAGED", "EXTERNAL")
    except AnalysisException:
        return False


def entries_by_file(store: Store, table: Table, df: DataFrame, signature: str) -> tuple[DataFrame, bool]:
    """(content and rows by file and partition, whether no file moved since the last sync): only new and rewritten files are opened.

    A file is known by its path, size and time of writing.
    """
    known = store.files(table.schema, table.name, signature)
    if known is None:
        return file_entries(df, table.layout, split=table.split), False
    new, gone = moved_files(df, known)
    kept = known.filter(~F.col("file").isin(gone)) if gone else known
    return kept.unionByName(file_entries(df, table.layout, new, table.split)) if new else kept, not new and not gone


def pieces(table: Table, df: DataFrame, entries: DataFrame | None, signature_mode: str, stored: DataFrame | None) -> DataFrame:
    """The inventory of a table's partitions, or of their pieces where it splits them (by content only: file times can't tell pieces)."""
    if entries is not None:
        found = inventory_of_files(entries)
        return fold(found, stored) if table.split else found
    if table.split and signature_mode == "content":
        return fold(inventory(df, table.layout, signature_mode, table.split), stored)
    return inventory(df, table.layout, signature_mode)


def policy(table: Table, claim: str | None) -> dict:
    return {"claim": claim, "units": None if table.rls is None else [asdict(u) for u in table.rls]}


def extract(df: DataFrame, table: Table, todo: DataFrame) -> DataFrame:
    """Rows of the partitions ``todo``, with their ``__pid`` and its ``__rows``: one scan, pruned by merged intervals, then by id."""
    rest = F.lit("remainder")
    spans = merged_intervals(todo.filter(F.col("kind") != rest)).select("lower", "upper")
    spans = spans.unionByName(todo.filter(F.col("kind") == rest).select(rest.alias("lower"), rest.alias("upper"))).collect()  # a few, merged
    instants = isinstance(df.schema[table.layout.column].dataType, T.TimestampType)  # their bounds are by the clock of UTC
    cast = (lambda text: f"{text}Z" if instants else text) if isinstance(table.layout, TimeLayout) else int
    picks = [Between(table.layout.column, cast(r.lower), cast(r.upper)) if r.lower != "remainder" else Remainder(table.layout.column, table.layout.start, table.layout.end) for r in spans]
    rows = df.filter(reduce(lambda a, b: a | b, (predicate(p, df) for p in picks), F.lit(False))).withColumn(PID, partition_id(table.layout, df.schema))
    if table.split:
        pid = F.col("partition_id")
        cuts = todo.select(base_id(pid).alias(PID), pieces_in(pid).alias("__n")).distinct()
        rows = rows.join(cuts, PID).withColumn(PID, piece_of(F.col(PID), slot(table.split, df.schema), F.col("__n"))).drop("__n")
    return rows.join(todo.select(F.col("partition_id").alias(PID), F.col("rows").alias(ROWS)), PID)


def holding(df: DataFrame, entries: DataFrame, todo: DataFrame) -> DataFrame:
    """The rows of the files that hold rows of the partitions ``todo``; the names of no other files come to the driver, which has listed all."""
    base = base_id(F.col("partition_id")).alias("pid")
    files = entries.select("file", base).join(todo.select(base).distinct(), "pid", "left_semi").select("file").distinct().collect()
    return df.filter(F.col("_metadata.file_path").isin([r.file for r in files]))


class WrongWrite(RuntimeError):
    """What was written is not what was planned, so it is not published."""


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows that are counted and fingerprinted while they are written."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), content(T.StructType([f for f in df.schema.fields if f.name not in (PID, ROWS)])).alias("content")), seen


def check_written(seen: Observation, rows: int | None, content_sum, written: Callable[[], DataFrame], structs: bool) -> None:
    """Raise :class:`WrongWrite` unless the planned rows were written: by what was seen at the write, in doubt by reading back.

    Lost tasks that ran again may be seen twice, so a difference alone proves nothing. Columns
    turned to JSON can be counted only; None is not compared.
    """
    same = lambda n, c: (rows is None or n == rows) and (content_sum is None or (c or 0) == content_sum)
    if same(seen.get["rows"], seen.get["content"]):
        return
    df = written()
    n, c = df.agg(F.count("*"), content(df.schema)).first()
    if not (n == rows if structs else same(n, c)):
        raise WrongWrite(f"{n} rows were written where {rows} were planned, or their content differs")


def sync_table(store: Store, table: Table, df: DataFrame, claim: str | None = None, signature_mode: str = "content", files: bool = False) -> dict:
    """Bring one table up to date. Unaffected partitions keep their files; with no change nothing is written.

    With ``files`` the source is files as they are (see :func:`plain_files`), and only new and
    rewritten ones are read to find what changed; if none moved, no column is read at all. What
    is written is held against the inventory before it is published.
    """
    schema, name, run = table.schema, table.name, uuid.uuid4().hex
    now = store.current(schema, name)
    version = now["version"] if now else 0
    done = {"schema": schema, "table": name, "new": 0, "changed": 0, "removed": 0, "error": None}
    signature, noted, entries = table_signature(table, df), {}, None
    if files and signature_mode == "content":
        entries, still = entries_by_file(store, table, df, signature)
        if still:
            return done | {"status": "unchanged", "version": version}
        noted = {"files": store.write_files(entries, schema, name), "files_for": signature}
        entries = store.spark.read.schema(FILES).parquet(noted["files"])

    def unchanged() -> dict:
        if "files" in noted:
            store.note_files(schema, name, **{"files": noted["files"], "signature": signature})
        return done | {"status": "unchanged", "version": version}

    structs = bool(struct_columns(df))
    units = list(dict.fromkeys(u.column for u in table.rls or ()))
    if table.estimate:
        noted["estimate"] = list(table.estimate)
    if table.layout is None:
        whole = full_signature(table, df, signature_mode) if entries is None else f"{content_of_files(entries)}:{signature}"
        if now and now["signature"] == whole:
            return unchanged()
        out, seen = observed(df)
        out = structs_to_json(out)
        path = store.write_whole(out, schema, name, run, table.order, table.index)
        if signature_mode == "content":
            check_written(seen, *split_fingerprint(whole.split(":")[0]), lambda: store.read_paths(out.schema, [path]), structs)
        if table.estimate:
            store.write_sketches(schema, name, run, path, out.schema, units, table.estimate, parted=False)
        row = [(schema, name, "", whole, "all", None, None, None, None, path)]
        version = store.publish(store.spark.createDataFrame(row, MANIFEST), schema, name, out.schema, whole, policy(table, claim), version, **noted)
        return done | {"status": "replaced", "version": version, "changed": 1}
    rebuild = now is None or now["signature"] != signature
    stored = store.manifest(schema, name, version)
    found, current = current_manifest(pieces(table, df, entries, signature_mode, None if rebuild else stored), table, signature)
    held = [found]
    try:
        diff = partition_diff(current, stored, rebuild)  # of the held inventory and a manifest, a row for each partition
        plans = check_plan(diff, current, [], [(schema, name)])
        counts = {k: plans[0][k] if plans else 0 for k in ("new", "changed", "removed")}
        if not any(counts.values()) and not rebuild:
            return unchanged()
        out = structs_to_json(df)
        fresh = store.spark.createDataFrame([], MANIFEST)
        if counts["new"] or counts["changed"]:
            todo = current.join(diff.filter("status IN ('new', 'changed')").select(*KEY), KEY, "left_semi").persist()
            held.append(todo)
            rows, seen = observed(extract(df if entries is None else holding(df, entries, todo), table, todo))
            path = store.write_partitions(structs_to_json(rows), schema, name, run, table.order, table.index)
            planned = found.join(todo.select("partition_id"), "partition_id", "left_semi")
            sums = planned.agg(F.sum("rows"), F.sum(content_of("modified")) if signature_mode == "content" else F.lit(None)).first()
            check_written(seen, *sums, lambda: store.spark.read.schema(out.schema).parquet(path).drop(PID), structs)
            if table.estimate:
                store.write_sketches(schema, name, run, path, out.schema, units, table.estimate, parted=True)
            fresh = todo.withColumn("path", F.concat(F.lit(f"{path}/{PID}="), F.col("partition_id")))
        kept = stored.join(diff.filter("status = 'unchanged'").select(*KEY), KEY, "left_semi")
        version = store.publish(kept.unionByName(fresh), schema, name, out.schema, signature, policy(table, claim), version, **noted)
        return done | counts | {"status": "rebuilt" if rebuild else "refreshed", "version": version}
    finally:
        for df in held:
            df.unpersist()


def plan(spark: SparkSession, config: Config, root: str, sources: Mapping[str, DataFrame | str] | None = None, signature_mode: str = "content") -> DataFrame:
    """What :func:`sync` would do, as one table and without writing: schema, table, whole, rebuild, new, changed, removed, unchanged.

    A row for every configured table with something to do; tables that are replaced whole
    count as one changed partition, partitioned ones by partition.
    """
    store, parts = Store(spark, root), []
    for table in config.tables():
        df, now = source(spark, table, sources or {}), store.current(table.schema, table.name)
        signature, entries = table_signature(table, df), None
        if signature_mode == "content" and plain_files(spark, table, sources or {}):
            entries, still = entries_by_file(store, table, df, signature)
            if still:
                continue
        names = (F.lit(table.schema).alias("schema"), F.lit(table.name).alias("table"))
        if table.layout is None:
            found = df.agg(modified(df, signature_mode).alias("m")) if entries is None else spark.createDataFrame([(content_of_files(entries),)], "m string")
            row = found.filter(~F.concat_ws(":", "m", F.lit(signature)).eqNullSafe(F.lit(now["signature"] if now else None)))
            counts = {"new": 0, "changed": 1, "removed": 0, "unchanged": 0}
            parts.append(row.select(*names, F.lit(True).alias("whole"), F.lit(now is None).alias("rebuild"), *[F.lit(n).cast("long").alias(c) for c, n in counts.items()]))
            continue
        rebuild = now is None or now["signature"] != signature
        stored = store.manifest(table.schema, table.name)
        found = pieces(table, df, entries, signature_mode, None if rebuild else stored)
        current = signed(with_bounds(found, table.layout), table, signature)
        plans = table_plans(partition_diff(current, stored, rebuild))
        parts.append(plans.select(*names, F.lit(False).alias("whole"), F.lit(rebuild).alias("rebuild"), "new", "changed", "removed", "unchanged"))
    if not parts:
        return spark.createDataFrame([], "schema string, table string, whole boolean, rebuild boolean, new long, changed long, removed long, unchanged long")
    return reduce(DataFrame.unionByName, parts)


def sync(
    spark: SparkSession, config: Config, root: str, sources: Mapping[str, DataFrame | str] | None = None, signature_mode: str = "content", workers: int = 8
) -> DataFrame:
    """Sync every configured table, ``workers`` at a time; one that fails keeps its old snapshot and the others still publish.

    Each table's jobs go to a scheduler pool of its own, so with spark.scheduler.mode=FAIR small
    tables don't wait behind a large one. ``sources`` gives frames or paths by name. One row for each table, in the
    configuration's order.
    """
    store = Store(spark, root)

    def one(table: Table, claim: str | None) -> dict:
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"{table.schema}.{table.name}")
        try:
            files = plain_files(spark, table, sources or {})
            return sync_table(store, table, source(spark, table, sources or {}), claim, signature_mode, files)
        except Exception as e:  # noqa: BLE001  the result names it, and other tables go on
            return {"schema": table.schema, "table": table.name, "status": "failed", "error": str(e)[:2000]}
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    for schema in config.schemas:
        store.create_schema(schema)
    todo = [(table, entry.claim) for entry in config.schemas.values() for table in entry.tables]
    with ThreadPoolExecutor(max(1, min(workers, len(todo)))) as pool:
        results = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), *x) for x in todo]]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in results], RESULT)
