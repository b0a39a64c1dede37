"""Column expressions of the mirror and of secured reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holds_struct(kind: T.DataType) -> bool:
    """Whether a type is or contains a struct."""
    if isinstance(kind, T.ArrayType):
        return holds_struct(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_struct(kind.keyType) or holds_struct(kind.valueType)
    return isinstance(kind, T.StructType)


def struct_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if holds_struct(f.dataType)]


def structs_to_json(df: DataFrame) -> DataFrame:
    """Struct-bearing columns as JSON text in place, null fields kept; plain arrays stay."""
    found = struct_columns(df)
    return df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in found}) if found else df


def plain(value: Column, kind: T.DataType) -> Column:
    """A value as nested structs and arrays in which every null is told by a flag and every map is sorted by key.

    Hashes of Spark pass over nulls and refuse maps; the hash of this form sees where a null stands.
    """
    if isinstance(kind, T.ArrayType):
        return F.struct(value.isNull(), F.size(value), F.transform(value, lambda v: plain(v, kind.elementType)))
    if isinstance(kind, T.MapType):
        items = F.transform(F.map_entries(value), lambda e: F.struct(plain(e["key"], kind.keyType).alias("k"), plain(e["value"], kind.valueType).alias("v")))
        return F.struct(value.isNull(), F.size(value), F.array_sort(items))
    if isinstance(kind, T.StructType):
        return F.struct(value.isNull(), *[plain(value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.VariantType):
        value = F.to_json(value)
    return F.struct(value.isNull(), value)


def row_hash(schema: T.StructType) -> Column:
    """64-bit hash of all columns of a schema, with the places of their nulls and whatever the order of a map's entries."""
    simple = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    parts: list[Column] = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [plain(c, f.dataType)] if isinstance(f.dataType, simple) else [c.isNull(), c]
    return F.xxhash64(*parts)


def in_comma_list(value: Column | str, text: Column) -> Column:
    """Whether a comma list holds the value; blanks are not trimmed, null and missing lists hold nothing."""
    return F.coalesce(F.array_contains(F.split(text, ",", -1), value), F.lit(False))


def flatten_claims(claims: Column) -> Column:
    """A JSON object of claims as a map of texts: arrays joined by commas, JSON null left out."""
    parsed = F.from_json(claims, "map<string,string>")
    items = F.filter(F.map_entries(parsed), lambda e: e["value"].isNotNull())
    text = lambda v: F.when(v.startswith("["), F.coalesce(F.array_join(F.from_json(v, "array<string>"), ","), v)).otherwise(v)
    return F.map_from_entries(F.transform(items, lambda e: F.struct(e["key"].alias("key"), text(e["value"]).alias("value"))))


def merge_metadata(given: Column, server: Column) -> Column:
    """Both maps in one; where both have a key the server's value stands."""
    return F.map_concat(F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(server), k)), server)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts).cast("string")


def digest(*parts: Column) -> Column:
    """SHA-256 of texts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)
