"""Row security: which rows a requester, or every subject, may see."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Unit
from tidemark.functions.expressions import in_comma_list

GRANTS = "schema string, subject string, is_admin boolean, is_enabled boolean, unit_type string, unit_id string, metadata map<string,string>"


def claim_text(value) -> str | None:
    """A claim as text: lists joined by commas, outer quotes off strings, other values as JSON; None is missing."""
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return ",".join(claim_text(v) or "" for v in value)
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value).strip('"') if isinstance(value, str) else str(value)


def in_scope(claims: Mapping, schema: str) -> bool:
    """Whether the requester's schemas, a list or comma list without trimming, hold the schema."""
    text = claim_text(claims.get("schemas"))
    return text is not None and schema in text.split(",")


def check_role(claims: Mapping) -> None:
    if claims.get("role") != "user":
        raise PermissionError("only the role user reads tables")


def secure(df: DataFrame, schema: str, units: Sequence[Unit] | None, claim: str | None, grants: DataFrame, claims: Mapping) -> DataFrame:
    """The rows the requester may see; out of scope none, and no error.

    ``units`` None: the schema's scope is enough. Else an enabled grant of the subject must
    be an admin's or name one of the row's units. Each unit column is one equi left join
    with the subject's distinct ids, small sides that Spark broadcasts by their size, and the
    match flags are joined by OR, so no nested loop is planned.
    """
    check_role(claims)
    if not in_scope(claims, schema):
        return df.filter(F.lit(False))
    if units is None:
        return df
    if not claim:
        raise ValueError("a secured table needs a claim")
    subject = claim_text(claims.get(claim))
    if subject is None:
        return df.filter(F.lit(False))
    own = grants.filter((F.col("schema") == schema) & (F.col("subject") == subject) & F.col("is_enabled"))
    out, seen = df, own.agg(F.coalesce(F.bool_or("is_admin"), F.lit(False))).scalar()
    for i, unit in enumerate(units):
        ids = own.filter((F.col("unit_type") == unit.unit_type) & F.col("unit_id").isNotNull()).select(F.col("unit_id").alias(f"__id{i}")).distinct().withColumn(f"__hit{i}", F.lit(True))
        out = out.join(ids, F.col(unit.column).cast("string") == F.col(f"__id{i}"), "left")
        seen = seen | F.coalesce(F.col(f"__hit{i}"), F.lit(False))
    return out.filter(seen).select(*df.columns)


def audit(df: DataFrame, schema: str, units: Sequence[Unit], grants: DataFrame) -> DataFrame:
    """subject, is_admin and visible_rows of every subject with an enabled grant in the schema.

    Rows are counted by their combination of unit values first, so what meets the grants is
    those counts and not the table. Rows that several of a subject's units open count once, by
    inclusion and exclusion: for each set of units, the rows that all of its units open are
    added or taken off. Counts are summed by subject and the units still to be met after each
    join, so no pair of a subject and a whole combination is shuffled.
    """
    enabled = grants.filter((F.col("schema") == schema) & F.col("is_enabled") & F.col("subject").isNotNull())
    combos = df.groupBy(*dict.fromkeys(u.column for u in units)).agg(F.count("*").alias("rows"))
    held = enabled.filter("unit_id IS NOT NULL").select("subject", "unit_type", "unit_id").distinct()
    total = df.agg(F.count("*").alias("total")).withColumn("__one", F.lit(1))
    people = enabled.groupBy("subject").agg(F.bool_or("is_admin").alias("is_admin")).withColumn("__one", F.lit(1))
    terms = []
    for size in range(1, len(units) + 1):
        for chosen in combinations(range(len(units)), size):
            names = [f"u{i}" for i in chosen]
            term = combos.select(*[F.col(units[i].column).cast("string").alias(n) for i, n in zip(chosen, names)], "rows").dropna(subset=names)
            term = term.groupBy(*names).agg(F.sum("rows").alias("rows"))
            for at, (i, n) in enumerate(zip(chosen, names)):
                own = held.filter(F.col("unit_type") == units[i].unit_type).select("subject", F.col("unit_id").alias(n))
                term = term.join(own, ["subject", n] if at else [n]).groupBy("subject", *names[at + 1 :]).agg(F.sum("rows").alias("rows"))
            terms.append(term.select("subject", (F.col("rows") * (1 if size % 2 else -1)).alias("rows")))
    if not terms:
        terms = [people.select("subject", F.lit(0).cast("long").alias("rows"))]
    seen = reduce(DataFrame.unionByName, terms).groupBy("subject").agg(F.sum("rows").alias("n"))
    out = people.join(seen, "subject", "left").join(total, "__one")
    return out.select("subject", "is_admin", F.when(F.col("is_admin"), F.col("total")).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("visible_rows"))


def readable_grants(grants: DataFrame, claims: Mapping) -> DataFrame:
    """Grants of the schemas in the requester's claim."""
    text = claim_text(claims.get("schemas"))
    return grants.filter(in_comma_list(F.col("schema"), F.lit(text)))
