"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm._shared import keep

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
SALTS = 1024


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes that are no white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int, budget: int | None = None) -> DataFrame:
    """Add ``target`` to ``sources`` (source, source_size, weight).

    The budget (default: the sum of all sizes) is shared by weight. A source whose share
    passes ``max_epochs`` times its size is clamped there and what it cannot take is shared
    again among the others by weight, until none is above. The share per weight only rises,
    so each round is one aggregate with two numbers as its result; no source table reaches
    the driver. An empty table stays empty; when every source is clamped, all get their cap.
    """
    exact = T.DecimalType(19, 0)
    table = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    if budget is None:
        budget = table.agg(F.sum("source_size")).first()[0] or 0
    rest, weights = budget, table.agg(F.sum("weight")).first()[0] or 0
    while True:
        clamped = F.col("cap").cast(exact) * F.lit(weights).cast(exact) <= F.col("weight").cast(exact) * F.lit(rest).cast(exact)
        taken, free = table.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
        ).first()
        if (budget - taken, free) == (rest, weights):
            break
        rest, weights = budget - taken, free
        if not weights:
            return table.withColumn("target", F.col("cap").cast("double"))
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weights))
    return table.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(share))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 by code point, null last: counted inside ranges of the order, behind the counts of those before."""
    by = F.col("source").asc_nulls_last()
    many = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keep(sources.repartitionByRange(many, by).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range, so that one task may add them up
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return ranges.withColumn("inside", inside).join(before, "range").withColumn("place", F.col("before") + F.col("inside")).drop("range", "inside", "before")


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: id, source, size (words), source_size, target, whole
    (full repetitions), taken (words, repeats counted). Sources weigh ``weights`` in turn by
    code point, null last. A source with target t and size s repeats each document
    floor(t / s) times; the rest of the target is filled in a seeded order of documents, the
    one at the end of it being cut (a fractional repetition), so each source meets
    floor(target) words exactly. Empty or null texts have size 0 and are taken 0 times over.
    Rows with the same id and size are interchangeable; other columns are ignored.

    Order inside a source is by a digest, cut in ``BUCKETS`` ranges: sums of the ranges find
    the one range where the target ends, and only its rows (about 1/4096 of a source) are
    sorted, so a source with a third of all rows is never one task's work. Rows of that range
    that agree in id and size are sorted as counts of ``SALTS`` parts, and take their places
    part by part, so one id may hold any share of the rows.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = keep(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), digest.alias("draw"))
        .withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
        .withColumn("row", F.monotonically_increasing_id()),
        "mix-rows",
    )
    sums = keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-sums")
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(pattern, (F.col("place") % F.lit(len(weights)) + 1).cast("int")).cast("long")
    sources = keep(ranked(sums.groupBy("source").agg(F.sum("words").alias("source_size"))).select("source", "source_size", weight.alias("weight")), "mix-sources")
    filled = water_fill(sources, max_epochs)
    goal = F.floor(F.col("target"))
    filled = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    filled = filled.withColumn("more", (goal - F.col("whole") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("words").over(upto)).alias("b").join(filled.select(F.col("source").alias("s2"), "more"), F.col("source").eqNullSafe(F.col("s2")))
    ends = ends.filter(F.col("upto") > F.col("more")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = ends.select(F.col("source").alias("s3"), F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    filled = keep(
        filled.join(ends, F.col("source").eqNullSafe(F.col("s3")), "left")
        .select(F.col("source").alias("s"), "source_size", "target", "whole", "more", F.coalesce("end_bucket", F.lit(BUCKETS)).alias("end_bucket"), F.coalesce("before", F.lit(0)).alias("before")),
        "mix-targets",
    )
    joined = rows.join(filled, F.col("source").eqNullSafe(F.col("s")))
    sides = joined.filter("bucket <> end_bucket").withColumn("extra", F.when(F.col("bucket") < F.col("end_bucket"), F.col("size")).otherwise(F.lit(0)))
    edge = joined.filter("bucket = end_bucket").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    alike = ["source", "doc_id", "size", "salt"]
    running = Window.partitionBy("source").orderBy("draw", "doc_id", "size", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("n")
    groups = edge.groupBy("draw", "before", *alike).agg(F.count("*").alias("n")).withColumn("from", F.col("before") + F.sum(words).over(running) - words)
    groups = keep(groups.select(*[F.col(c).alias(f"__{c}") for c in alike], "from"), "mix-edge")
    turn = F.row_number().over(Window.partitionBy(*alike).orderBy("row")) - 1
    edge = edge.withColumn("turn", turn).join(groups, reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in alike)))
    edge = edge.withColumn("start", F.col("from") + F.col("turn") * F.col("size"))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("more") - F.col("start"))))
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")]
    return sides.select(*columns).unionByName(edge.select(*columns))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: whole repetitions as repeated rows, a fractional one as its first words.

    ``docs`` has doc_id, text, source and n_chars; all columns are returned, n_chars being
    set anew for a cut text. Rows that agree in id, source and size share what they take
    evenly, rounded up to a word.
    """
    taken = plan(docs, **options)
    per_row = taken.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("sum"), F.count("*").alias("rows"))
    left = docs.withColumn("__mix_size", word_count(F.col("text")))
    per_row = keep(per_row.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_n"), F.col("sum").alias("__mix_sum"), F.col("rows").alias("__mix_rows")), "mix-taken")
    match = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_size") == F.col("__mix_n"))
    joined = left.join(per_row, match)
    share = F.expr("(__mix_sum + __mix_rows - 1) div __mix_rows")
    joined = joined.withColumn("__mix_taken", share).withColumn("__mix_full", F.expr("if(__mix_size > 0, __mix_taken div __mix_size, 0)")).withColumn("__mix_part", F.expr("if(__mix_size > 0, __mix_taken % __mix_size, 0)"))
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("__mix_full").cast("int")), F.when(F.col("__mix_part") > 0, F.array("__mix_part")).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn("__mix_parts", parts).filter(F.size("__mix_parts") > 0).withColumn("__mix_copies", F.size("__mix_parts"))
    out = out.withColumn("__mix_at", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1))).withColumn("__mix_cut", F.get("__mix_parts", F.col("__mix_at")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.when(F.col("__mix_cut") == 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("__mix_cut"), F.lit(1)).cast("int")), " "))
    out = out.withColumn("text", cut).withColumn("n_chars", F.when(F.col("__mix_cut") == 0, F.col("n_chars")).otherwise(F.char_length("text")))
    return out.select(*docs.columns)


ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM r GROUP BY source),
w AS (SELECT source, source_size, source_size * 3 AS cap, (CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM s),
t AS (
  SELECT *, (sum(source_size) OVER ())::HUGEINT AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
         (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS free
  FROM w),
c AS (SELECT *, cap::HUGEINT * free <= weight::HUGEINT * (budget - before) AS clamped FROM t),
g AS (SELECT sum(CASE WHEN clamped THEN cap ELSE 0 END)::BIGINT AS fixed, sum(CASE WHEN clamped THEN 0 ELSE weight END)::BIGINT AS free FROM c),
f AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE weight::DOUBLE * (budget - fixed)::DOUBLE / g.free::DOUBLE END AS target
  FROM c, g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM f),
x AS (
  SELECT r.*, q.source_size, q.target, q.whole, floor(q.target)::BIGINT - q.whole * q.source_size AS more,
         sum(size) OVER (PARTITION BY r.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, more - start)))::BIGINT AS taken, source
FROM x
"""
