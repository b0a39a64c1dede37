"""Partition ids of rows, bounds of ids, and the inventory of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.config import FORMATS, RangeLayout, Table, TimeLayout
from tidemark.functions.expressions import digest, epoch_ms, row_hash

REMAINDER = "__NULL__"
UNPARTITIONED = "__UNPARTITIONED__"


def on_utc(c: Column, kind: T.DataType | None) -> Column:
    """A time as a time without zone: instants by the clock of UTC, whatever the session's zone; others as they stand."""
    if not isinstance(kind, T.TimestampType):
        return c.cast("timestamp_ntz")
    seconds = (F.unix_micros(c).cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def partition_id(layout: TimeLayout | RangeLayout, schema: T.StructType | None = None) -> Column:
    """Id of the partition of a row; null for a null time.

    Instants (a timestamp column of ``schema``) are dealt by the clock of UTC. Times are cut out
    of their text, since Spark's formatting would move local times that the session's zone skips.
    """
    c = F.col(layout.column)
    if isinstance(layout, TimeLayout):
        known = schema is not None and layout.column in schema.names
        text = on_utc(c, schema[layout.column].dataType if known else None).cast("string")
        return F.substring(F.translate(text, "-: ", ""), 1, len(FORMATS[layout.granularity]))
    low = F.expr(f"{layout.start} + ((`{layout.column}` - {layout.start}) div {layout.interval}) * {layout.interval}")
    return F.when(c.isNull() | (c < layout.start) | (c >= layout.end), F.lit(REMAINDER)).otherwise(low.cast("string"))


SLOTS = 1024
LEAF = 1_000_000
PIECE = r"^(.*)-(\d+)\.(\d+)$"


def slot(split: Sequence[str], schema: T.StructType) -> Column:
    """One of ``SLOTS`` slots of a row, by the hash of its split columns."""
    return F.pmod(row_hash(T.StructType([schema[c] for c in split])), F.lit(SLOTS))


def piece_of(pid: Column, slot: Column, pieces: Column) -> Column:
    """Id of a piece of a partition that is cut in so many: ``<partition>-<piece>.<pieces>``, the partition's own where it is whole."""
    return F.when(pieces == 1, pid).otherwise(F.concat(pid, F.lit("-"), F.pmod(slot, pieces).cast("string"), F.lit("."), pieces.cast("string")))


def base_id(pid: Column) -> Column:
    """The partition that an id or the id of a piece names."""
    return F.regexp_replace(pid, PIECE, "$1")


def pieces_in(pid: Column) -> Column:
    """How many pieces the partition of an id is cut in."""
    return F.coalesce(F.regexp_extract(pid, PIECE, 3).try_cast("long"), F.lit(1))


def fold(cells: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The inventory of pieces from that of slots: sums of a hash tree, slots below pieces below partitions.

    A partition is cut in as many pieces, a power of 2, as it has millions of rows. The number
    that ``stored`` has stays while pieces hold between a quarter and twice of that, so a change
    of a few rows changes a few pieces.
    """
    pid = F.col("partition_id")
    cells = cells.select(base_id(pid).alias("__base"), F.regexp_extract(pid, PIECE, 2).cast("long").alias("__slot"), content_of("modified").alias("__content"), "rows")
    sizes = cells.groupBy("__base").agg(F.sum("rows").alias("__total"))
    wanted = F.least(F.lit(SLOTS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("__total") / LEAF, F.lit(1.0))))).cast("long"))
    if stored is None:
        sizes = sizes.select("__base", wanted.alias("__n"))
    else:
        old = stored.groupBy(base_id(pid).alias("__base")).agg(F.max(pieces_in(pid)).alias("__old"))
        fits = (F.col("__total") <= 2 * LEAF * F.col("__old")) & ((F.col("__old") == 1) | (4 * F.col("__total") >= LEAF * F.col("__old")))
        sizes = sizes.join(old, "__base", "left").select("__base", F.when(fits, F.col("__old")).otherwise(wanted).alias("__n"))
    cut = cells.join(sizes, "__base").withColumn("partition_id", piece_of(F.col("__base"), F.col("__slot"), F.col("__n")))
    return cut.groupBy("partition_id").agg(joined(F.sum("__content"), F.sum("rows")).alias("modified"), F.sum("rows").alias("rows"))


def with_bounds(inventory: DataFrame, layout: TimeLayout | RangeLayout) -> DataFrame:
    """Add kind, column, lower and upper (texts, times by the clock of UTC) to rows with a partition_id; pieces have those of their partition."""
    pid = base_id(F.col("partition_id"))
    if isinstance(layout, TimeLayout):
        parts = [F.substring(pid, at, n) for at, n in ((1, 4), (5, 2), (7, 2), (9, 2))]
        month, day, hour = (F.when(F.length(p) > 0, p).otherwise(d) for p, d in zip(parts[1:], ("01", "01", "00")))
        low = F.concat(parts[0], F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, F.lit(":00:00")).try_cast("timestamp_ntz")
        low = F.when(F.length(pid) == len(FORMATS[layout.granularity]), low)
        df = inventory.withColumn("__low", low).withColumn("__high", F.expr(f"__low + INTERVAL 1 {layout.granularity}"))
        return df.withColumns({"kind": F.lit("time"), "column": F.lit(layout.column), "lower": F.col("__low").cast("string"), "upper": F.col("__high").cast("string")}).drop("__low", "__high")
    low = pid.try_cast("long")
    high = F.least(low + layout.interval, F.lit(layout.end))
    rest = pid == REMAINDER
    return inventory.withColumns({
        "kind": F.when(rest, "remainder").otherwise("range"),
        "column": F.lit(layout.column),
        "lower": F.when(rest, F.lit(layout.start)).otherwise(low).cast("string"),
        "upper": F.when(rest, F.lit(layout.end)).otherwise(high).cast("string"),
    })


def violations(inventory: DataFrame, layout: TimeLayout | RangeLayout) -> DataFrame:
    """Rows of an inventory (partition_id, lower, modified) that no refresh may use, with the reason."""
    pid = base_id(F.col("partition_id"))
    if isinstance(layout, TimeLayout):
        bad = F.when(F.col("lower").isNull(), "not an id of the granularity").when(F.length(pid) != len(FORMATS[layout.granularity]), "not an id of the granularity")
    else:
        low = pid.try_cast("long")
        bad = F.when((pid != REMAINDER) & low.isNull(), "not an integer").when((low < layout.start) | (low >= layout.end), "outside the range").when(F.pmod(low - layout.start, F.lit(layout.interval)) != 0, "not aligned")
    reason = F.when(pid.isNull() | (pid == ""), "no id").when(pid == UNPARTITIONED, "unpartitioned rows").otherwise(F.when(F.col("modified").isNull(), "no modification time").otherwise(bad))
    return inventory.withColumn("reason", reason).filter("reason IS NOT NULL")


def content(schema: T.StructType) -> Column:
    """Sum of the hashes of rows of a schema: like rows in any order give the same, copies don't cancel, and sums of parts add up."""
    return F.sum(row_hash(schema).cast("decimal(20,0)"))


def joined(content: Column, rows: Column) -> Column:
    return F.concat_ws("-", content.cast("string"), rows.cast("string"))


def fingerprint(schema: T.StructType) -> Column:
    """The content of rows of a schema with their number."""
    return joined(content(schema), F.count("*"))


def content_of(fingerprint: str) -> Column:
    """The content in a column of fingerprints."""
    return F.regexp_extract(fingerprint, r"^(.*)-\d+$", 1).try_cast("decimal(38,0)")


def split_fingerprint(text: str) -> tuple[int, int | None]:
    """(rows, content) of a fingerprint; no content where there are no rows."""
    content, _, rows = text.rpartition("-")
    return int(rows), int(content) if content else None


def cell_id(layout: TimeLayout | RangeLayout, schema: T.StructType, split: Sequence[str] = ()) -> Column:
    """Id of the partition of a row, or of its slot in it where partitions are split."""
    pid = partition_id(layout, schema)
    return piece_of(pid, slot(split, schema), F.lit(SLOTS)) if split else pid


def inventory(df: DataFrame, layout: TimeLayout | RangeLayout, signature_mode: str = "content", split: Sequence[str] = ()) -> DataFrame:
    """partition_id, rows and modified of each partition: one partial aggregate over the source.

    ``modified`` is the fingerprint of the content (reads all columns), or in mode ``mtime``
    the newest modification time of the files that hold rows of the partition (reads one
    column, but a file rewritten for one partition marks all others in it as changed).
    """
    modified = epoch_ms(F.max("_metadata.file_modification_time")) if signature_mode == "mtime" else fingerprint(df.schema)
    if isinstance(layout, TimeLayout):
        df = df.filter(F.col(layout.column).isNotNull())
    return df.groupBy(cell_id(layout, df.schema, split).alias("partition_id")).agg(modified.alias("modified"), F.count("*").alias("rows"))


FILE = {"file": "file_path", "size": "file_size", "written": "file_modification_time"}
FILES = "file string, size long, written timestamp, partition_id string, content decimal(38,0), rows long"


def file_states(df: DataFrame) -> DataFrame:
    """file, size and written of the files that hold rows of a plain scan; reads no data column."""
    return df.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in FILE.items()]).distinct()


def moved_files(df: DataFrame, known: DataFrame) -> tuple[list[str], list[str]]:
    """(new or rewritten, gone or rewritten) files of a scan against known entries: only those that differ come to the driver."""
    now, was = file_states(df).withColumn("now", F.lit(True)), known.select(*FILE).distinct().withColumn("was", F.lit(True))
    differ = now.join(was, [F.expr("true") & now[c].eqNullSafe(was[c]) for c in FILE], "full_outer").filter(now["now"].isNull() | was["was"].isNull())
    rows = differ.select(now["file"].alias("now"), was["file"].alias("was")).collect()
    return [r.now for r in rows if r.now is not None], [r.was for r in rows if r.was is not None]


def file_entries(df: DataFrame, layout: TimeLayout | RangeLayout | None, files: list[str] | None = None, split: Sequence[str] = ()) -> DataFrame:
    """Content and rows by file and partition (null for null times, empty without a layout), of all files of a scan or of those named; others are not opened."""
    if files is not None:
        df = df.filter(F.col("_metadata.file_path").isin(files))
    pid = cell_id(layout, df.schema, split) if layout is not None else F.lit("")
    keys = [F.col(f"_metadata.{m}").alias(c) for c, m in FILE.items()]
    found = df.groupBy(*keys, pid.alias("partition_id")).agg(content(df.schema).cast("decimal(38,0)").alias("content"), F.count("*").alias("rows"))
    return found.select(*[f.split()[0] for f in FILES.split(", ")])


def content_of_files(entries: DataFrame) -> str:
    """The fingerprint that a scan of all files would give."""
    return entries.agg(joined(F.sum("content"), F.coalesce(F.sum("rows"), F.lit(0)))).first()[0]


def inventory_of_files(entries: DataFrame) -> DataFrame:
    """The inventory that a scan of all files would give, from their entries."""
    found = entries.filter("partition_id IS NOT NULL").groupBy("partition_id").agg(F.sum("content").alias("c"), F.sum("rows").alias("rows"))
    return found.select("partition_id", joined(F.col("c"), F.col("rows")).alias("modified"), "rows")


def last_partitions(found: DataFrame, n: int, *tables: str) -> DataFrame:
    """The n largest ids, of each table if columns name one."""
    if not tables:
        return found.orderBy(F.desc("partition_id")).limit(n)
    rank = F.row_number().over(Window.partitionBy(*tables).orderBy(F.desc("partition_id")))
    return found.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def in_order(found: DataFrame) -> DataFrame:
    """Ids as numbers upwards, the remainder last."""
    return found.orderBy(base_id(F.col("partition_id")).try_cast("long").asc_nulls_last(), "partition_id")


def signed(found: DataFrame, table: Table, table_signature: str) -> DataFrame:
    """An inventory with bounds as the partitions of a table: id, signature, kind, column, bounds and rows."""
    if table.last is not None:
        kept = last_partitions(found.select(base_id(F.col("partition_id")).alias("partition_id")).distinct(), table.last)
        found = found.withColumn("__base", base_id(F.col("partition_id"))).join(kept.select(F.col("partition_id").alias("__base")), "__base", "left_semi") if table.split else last_partitions(found, table.last)
    return found.select(
        F.lit(table.schema).alias("schema"), F.lit(table.name).alias("table"), "partition_id",
        digest(F.col("partition_id"), F.col("modified"), F.lit(table_signature)).alias("signature"), "kind", "column", "lower", "upper", "rows",
    )


def current_manifest(found: DataFrame, table: Table, table_signature: str) -> tuple[DataFrame, DataFrame]:
    """(inventory with bounds, the partitions a table has now) of an inventory. Raises ValueError on unusable ones.

    The inventory, a row for each partition, is held so that the source is scanned once; the
    caller releases it.
    """
    found = with_bounds(found, table.layout).persist()
    wrong = violations(found, table.layout).agg(F.slice(F.collect_list(F.struct("partition_id", "reason")), 1, 3)).first()[0]
    if wrong:
        found.unpersist()
        raise ValueError(f"{table.schema}.{table.name}: {[tuple(r) for r in wrong]}")
    return found, signed(found, table, table_signature)
