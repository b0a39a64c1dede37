"""Maintenance of the grants table; there is no delete."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import merge_metadata

KEY = ["schema", "subject", "unit_type", "unit_id"]


WRITER = "policy_writer_"
BACKUP = "backup"


def writer_schema(claims: Mapping) -> str:
    """The schema whose grants a requester may write, from the role ``policy_writer_<schema>``; PermissionError for all others."""
    role = claims.get("role")
    if not isinstance(role, str) or not role.startswith(WRITER) or role == WRITER:
        raise PermissionError("only a schema's writer changes grants")
    return role[len(WRITER) :]


def check_writer(rows: DataFrame, schema: str) -> None:
    """A writer touches rows of its own schema only."""
    if rows.filter(~F.col("schema").eqNullSafe(F.lit(schema))).take(1):
        raise PermissionError(f"rows outside the schema {schema}")


def stamp(metadata: Column, created: Column | None, now: Column) -> Column:
    """Metadata with the server's times: both new on insert, created_at kept on update."""
    server = F.create_map(F.lit("created_at"), F.coalesce(created, now) if created is not None else now, F.lit("updated_at"), now)
    return merge_metadata(F.coalesce(metadata, F.create_map().cast("map<string,string>")), server)


def upsert(old: DataFrame, new: DataFrame, now: Column, writer_schema: str | None = None) -> DataFrame:
    """Merge rows on (schema, subject, unit_type, unit_id).

    Columns that ``new`` lacks keep their stored value, or the default on insert. Keys with
    a null never merge, so such rows are always inserted. Keys are unique in both tables.
    """
    if writer_schema is not None:
        check_writer(new, writer_schema)
    given = [c for c in ("is_admin", "is_enabled", "metadata") if c in new.columns]
    for c in ("unit_type", "unit_id"):
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast("string"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in [*KEY, *given]], F.lit(True).alias("is_new"))
    o = old.withColumn("is_old", F.lit(True))
    both = o.join(n, [F.col(c) == F.col(f"n_{c}") for c in KEY], "full_outer")
    inserted, updated = F.col("is_old").isNull(), F.col("is_new").isNotNull()

    def pick(c: str, default: Column) -> Column:
        stored = F.when(inserted, default).otherwise(F.col(c))
        return F.when(updated, F.coalesce(F.col(f"n_{c}"), stored)).otherwise(stored) if c in given else stored

    empty = F.create_map().cast("map<string,string>")
    meta = F.when(updated, stamp(pick("metadata", empty), F.when(~inserted, F.col("metadata")["created_at"]), now)).otherwise(F.col("metadata"))
    return both.select(*[F.coalesce(c, f"n_{c}").alias(c) for c in ("schema", "subject")], pick("is_admin", F.lit(False)).alias("is_admin"), pick("is_enabled", F.lit(True)).alias("is_enabled"),
                       *[F.when(inserted, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("unit_type", "unit_id")], meta.alias("metadata"))


def set_enabled(grants: DataFrame, where: Column, enabled: bool, now: Column, writer_schema: str | None = None) -> DataFrame:
    """Switch the rows of a filter on or off; a writer's filter reaches its own schema only."""
    hit = F.coalesce(where, F.lit(False))
    if writer_schema is not None:
        hit = hit & (F.col("schema") == writer_schema)
    return grants.withColumns({"is_enabled": F.when(hit, F.lit(enabled)).otherwise(F.col("is_enabled")), "metadata": F.when(hit, stamp(F.col("metadata"), F.col("metadata")["created_at"], now)).otherwise(F.col("metadata"))})


def restore_diff(live: DataFrame, restored: DataFrame) -> DataFrame:
    """Grants that a restored copy and the live table don't share: only_live, only_restored or differs.

    Flags and metadata are compared, the latter whatever the order of its keys. Null keys match each other.
    """
    parts = ["is_admin", "is_enabled", F.array_sort(F.map_entries("metadata")).alias("metadata")]
    a = live.select(*KEY, F.struct(*parts).alias("was")).distinct()
    b = restored.select(*[F.col(c).alias(f"r_{c}") for c in KEY], F.struct(*parts).alias("now")).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in KEY]
    both = a.join(b, on, "full_outer")
    status = F.when(F.col("was").isNull(), "only_restored").when(F.col("now").isNull(), "only_live").when(~F.col("was").eqNullSafe(F.col("now")), "differs")
    live_side = F.col("was").isNotNull()
    return both.withColumn("status", status).filter("status IS NOT NULL").select(*[F.when(live_side, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in KEY], "status")


def written(grants: DataFrame, claims: Mapping) -> DataFrame:
    """The grants a writer sees: those of its own schema."""
    return grants.filter(F.col("schema") == writer_schema(claims))


def export_csv(grants: DataFrame, prefix: str, date: str, claims: Mapping) -> str:
    """One dated CSV export of every grant, with a header and doubled quotes, for the role ``backup`` alone."""
    if claims.get("role") != BACKUP:
        raise PermissionError("only the role backup exports grants")
    path = f"{prefix.rstrip('/')}/{date}"
    grants.withColumn("metadata", F.to_json("metadata")).write.options(header=True, escape='"').csv(path)
    return path
