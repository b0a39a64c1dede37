"""The store: run-scoped Parquet, versioned manifests and one pointer file for each table.

Layout: ``<root>/<schema>/<table>/run=<id>/__pid=<partition>/``, ``.../manifest/v=<k>/`` and
``.../_CURRENT``, a small JSON file that names the version, its columns, signature and policy.
Replacing that file publishes rows, signatures and policy together. The version check before
it is no lock: one writer at a time for each table.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import row_hash
from tidemark.operators.estimates import sketch
from tidemark.operators.partitions import FILES, on_utc

MANIFEST = "schema string, table string, partition_id string, signature string, kind string, column string, lower string, upper string, rows long, path string"
PID = "__pid"
ROWS = "__rows"
LARGE = 5_000_000
CLOCK = "UTC"
ROW_GROUP = 16 << 20


def may_hold(columns: T.StructType, where: Sequence, clock: str | None = CLOCK) -> Column:
    """Whether a partition of a manifest may hold rows of a filter, by its bounds: all (column, operator, value) in ``where`` count, others rule nothing out.

    Bounds of instants are by the clock of UTC, and a filter's instants are held against them by
    the same one, so the session's zone decides only how a filter's text is read. Of a table
    published without that clock, instants rule nothing out.
    """
    out = F.lit(True)
    for spec in where:
        if not isinstance(spec, (tuple, list)) or len(spec) != 3 or spec[1] not in ("eq", "gt", "gte", "lt", "lte", "in") or spec[0] not in columns.names:
            continue
        name, op, value = spec
        kind = columns[name].dataType
        times = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if not times and not isinstance(kind, T.IntegralType) or clock != CLOCK and isinstance(kind, T.TimestampType):
            continue
        manifest, bound = ("time", "timestamp_ntz") if times else ("range", "long")
        low, high = (F.col(c).try_cast(bound) for c in ("lower", "upper"))
        inside = F.lit(False)
        for v in value if op == "in" else [value]:
            v = on_utc(F.lit(v).cast(kind), kind) if times else F.lit(v).cast(kind).cast(bound)
            after = high > v if op in ("eq", "gt", "gte", "in") else F.lit(True)
            before = low <= v if op in ("eq", "in", "lte") else low < v if op == "lt" else F.lit(True)
            inside = inside | F.coalesce(after & before, F.lit(True))
        out = out & (inside | (F.col("kind") != manifest) | (F.col("column") != name))
    return out


class StalePlan(RuntimeError):
    """The table was published by someone else since the plan was made."""


def scratch_root(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return "file://" + tempfile.mkdtemp(prefix="tidemark-store-")
    return f"{shared.rstrip('/')}/store-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


class Store:
    """Reads and publishes the tables below one root, through Spark's file systems only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def home(self, schema: str, table: str) -> str:
        return f"{self.root}/{schema}/{table}"

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def create_schema(self, schema: str) -> None:
        path, fs = self._path(f"{self.root}/{schema}")
        fs.mkdirs(path)

    def current(self, schema: str, table: str) -> dict | None:
        """What ``_CURRENT`` says, or None before the first publication."""
        path, fs = self._path(f"{self.home(schema, table)}/_CURRENT")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, schema: str, table: str, version: int | None = None) -> DataFrame:
        """The manifest of a version, by default the current one; empty before the first."""
        if version is None:
            now = self.current(schema, table)
            version = now["version"] if now else 0
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.home(schema, table)}/manifest/v={version}")

    def read(self, schema: str, table: str, where: Sequence = ()) -> DataFrame:
        """The published rows: only the paths that the manifest names, nothing is listed by pattern.

        Filters (column, operator, value) leave out the partitions whose bounds hold no such
        row; other rows of those that stay are not filtered.
        """
        now = self.current(schema, table)
        if now is None:
            raise ValueError(f"{schema}.{table} was never published")
        columns = T.StructType.fromJson(now["columns"])
        found = self.manifest(schema, table, now["version"]).filter(may_hold(columns, where, now.get("clock")))
        paths = [r.path for r in found.select("path").distinct().collect()]  # one for each partition
        return self.read_paths(columns, paths)

    def read_paths(self, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _parquet(self, df: DataFrame, index: Sequence[str]):
        """A writer that a point read on an indexed column is served well by: Bloom filters of it, and row groups of bounded size."""
        writer = df.write
        for name in index:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        return writer.option("parquet.block.size", ROW_GROUP) if index else writer

    def write_whole(self, df: DataFrame, schema: str, table: str, run: str, order: Sequence[str] = (), index: Sequence[str] = ()) -> str:
        """One whole table below a run of its own; ordered by range where the table asks for it."""
        path = f"{self.home(schema, table)}/run={run}/data"
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        self._parquet(df, index).parquet(path)
        return path

    def write_partitions(self, df: DataFrame, schema: str, table: str, run: str, order: Sequence[str] = (), index: Sequence[str] = ()) -> str:
        """Rows with ``__pid`` and ``__rows`` (those of the partition) in one job, a folder for each partition.

        Partitions go to a task each; those of over ``LARGE`` rows are dealt to as many tasks as
        they need by a salt, so a hot partition is no single task.
        """
        path = f"{self.home(schema, table)}/run={run}"
        own = T.StructType([f for f in df.schema.fields if f.name not in (PID, ROWS)])
        salt = F.when(F.col(ROWS) > LARGE, F.pmod(row_hash(own), F.ceil(F.col(ROWS) / LARGE))).otherwise(0)
        df = df.withColumn("__salt", salt).repartition(PID, "__salt").drop("__salt", ROWS)
        if order:
            df = df.sortWithinPartitions(PID, *order)
        self._parquet(df, index).partitionBy(PID).parquet(path)
        return path

    def files(self, schema: str, table: str, signature: str) -> DataFrame | None:
        """What is known of the source's files, if it was found under this signature of the table."""
        now = self.current(schema, table)
        if now is None or now.get("files_for") != signature:
            return None
        return self.spark.read.schema(FILES).parquet(now["files"])

    def write_files(self, entries: DataFrame, schema: str, table: str) -> str:
        path = f"{self.home(schema, table)}/files/{uuid.uuid4().hex}"
        entries.write.parquet(path)
        return path

    def note_files(self, schema: str, table: str, files: str, signature: str) -> None:
        """Name what is known of the source's files without a new version: their rows are what is served already."""
        now = self.current(schema, table) | {"files": files, "files_for": signature}
        self._replace(f"{self.home(schema, table)}/_CURRENT", json.dumps(now))

    def write_sketches(self, schema: str, table: str, run: str, path: str, columns: T.StructType, units: Sequence[str], sketched: Sequence[str], parted: bool) -> None:
        """Sketches of what a run has written, by partition and unit columns; reads those columns only."""
        kind = T.StructType([*columns.fields, T.StructField(PID, T.StringType())]) if parted else columns
        df = self.spark.read.schema(kind).parquet(path)
        df = df if parted else df.withColumn(PID, F.lit(""))
        own = sketch(df, [PID, *units], sketched).withColumn("__run", F.lit(run))
        own.write.parquet(f"{self.home(schema, table)}/sketches/run={run}/data")

    def sketches(self, schema: str, table: str, where: Sequence = ()) -> DataFrame | None:
        """The sketches of all published partitions that may hold rows of a filter; None if some have none."""
        now = self.current(schema, table)
        columns = T.StructType.fromJson(now["columns"])
        run = F.regexp_extract("path", "/run=([^/]+)/", 1)
        found = self.manifest(schema, table, now["version"]).filter(may_hold(columns, where, now.get("clock")))
        parts = found.select(F.col("partition_id").alias(PID), run.alias("__run"))
        paths = [f"{self.home(schema, table)}/sketches/run={r[0]}/data" for r in parts.select("__run").distinct().collect()]
        if not now.get("estimate") or not paths or not all(fs.exists(p) for p, fs in map(self._path, paths)):
            return None
        return self.spark.read.parquet(*paths).join(parts, [PID, "__run"], "left_semi")

    def publish(self, manifest: DataFrame, schema: str, table: str, columns: T.StructType, signature: str, policy: dict, expected: int, **noted) -> int:
        """Write the next manifest, then replace the pointer if it still is at ``expected``; ``noted`` goes into the pointer."""
        now = self.current(schema, table)
        if (now["version"] if now else 0) != expected:
            raise StalePlan(f"{schema}.{table} is at another version than {expected}")
        version = expected + 1
        manifest.select(*[f.split()[0] for f in MANIFEST.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{self.home(schema, table)}/manifest/v={version}")
        text = json.dumps({"version": version, "columns": columns.jsonValue(), "signature": signature, "policy": policy, "clock": CLOCK} | noted)
        self._replace(f"{self.home(schema, table)}/_CURRENT", text)
        return version

    def _replace(self, path: str, text: str) -> None:
        jvm = self.spark._jvm
        target, fs = self._path(path)
        new, _ = self._path(f"{path}.{jvm.java.util.UUID.randomUUID()}")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, target, options)

    def schemas(self) -> list[str]:
        """Every namespace that was created, with tables or without."""
        path, fs = self._path(f"{self.root}/*")
        return sorted(s.getPath().getName() for s in fs.globStatus(path) or [] if s.isDirectory())

    def tables(self) -> list[tuple[str, str]]:
        """(schema, table) of every published table."""
        found = []
        path, fs = self._path(f"{self.root}/*/*/_CURRENT")
        for status in fs.globStatus(path) or []:
            home = status.getPath().getParent()
            found.append((home.getParent().getName(), home.getName()))
        return sorted(found)

    def vacuum(self, schema: str, table: str, keep_versions: int = 2, grace_ms: int = 3_600_000) -> list[str]:
        """Delete runs that none of the last manifests names and that are older than the grace period."""
        now = self.current(schema, table)
        if now is None:
            return []
        used = set()
        for v in range(max(1, now["version"] - keep_versions + 1), now["version"] + 1):
            used |= {r.run for r in self.manifest(schema, table, v).select(F.regexp_extract("path", "run=([^/]+)", 1).alias("run")).distinct().collect()}
        gone = []
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - grace_ms
        path, fs = self._path(f"{self.home(schema, table)}/files/*")
        for status in fs.globStatus(path) or []:
            if status.getPath().getName() != now.get("files", "").rsplit("/", 1)[-1] and status.getModificationTime() <= limit:
                fs.delete(status.getPath(), True)
        path, fs = self._path(f"{self.home(schema, table)}/run=*")
        for status in fs.globStatus(path) or []:
            run = status.getPath().getName().split("=", 1)[1]
            if run not in used and status.getModificationTime() <= limit:
                fs.delete(status.getPath(), True)
                fs.delete(self._path(f"{self.home(schema, table)}/sketches/run={run}")[0], True)
                gone.append(run)
        return gone

    def to_jdbc(self, schema: str, table: str, url: str, target: str, properties: dict | None = None, tasks: int = 8, rename: str | None = None) -> None:
        """Copy a published table to a relational database: to a shadow table by up to ``tasks`` connections, which then takes the target's place in one transaction.

        Until then, and if anything fails, the target stays as it was. ``rename`` is the
        database's way to rename a table, by default that of most, or of the few by their URL; its
        DDL must be transactional.
        """
        rename = rename or ("RENAME TABLE {} TO {}" if url.split(":")[1] in ("derby", "db2", "mysql", "mariadb") else "ALTER TABLE {} RENAME TO {}")
        properties, shadow, old = properties or {}, f"{target}_tidemark_new", f"{target}_tidemark_old"
        self._sql(url, properties, [f"DROP TABLE {t}" for t in (shadow, old) if self._has(url, properties, t)])
        self.read(schema, table).write.mode("overwrite").option("numPartitions", tasks).jdbc(url, shadow, properties=properties)
        there = self._has(url, properties, target)
        self._sql(url, properties, [rename.format(target, old)] * there + [rename.format(shadow, target)] + [f"DROP TABLE {old}"] * there)

    def _has(self, url: str, properties: dict, table: str) -> bool:
        try:
            self._sql(url, properties, [f"SELECT 1 FROM {table} WHERE 1 = 0"])
        except Py4JJavaError as e:
            if "SQL" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _sql(self, url: str, properties: dict, statements: Sequence[str]) -> None:
        """Statements in one transaction."""
        jvm = self.spark._jvm
        given = jvm.java.util.Properties()
        for k, v in properties.items():
            given.setProperty(k, v)
        if "driver" in properties:
            jvm.java.lang.Class.forName(properties["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(url, given)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                connection.createStatement().execute(text)
            connection.commit()
        except Py4JJavaError:
            connection.rollback()
            raise
        finally:
            connection.close()
