"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language, mixing, ngram_join, sharding
from tidemark.llm._shared import keep
from tidemark.llm.queries import held_out

SHARDS = 8
LEAST_SHARE = 0.5
MARKS = 1 << 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those of several languages of which none has half."""
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    one = (F.size("languages") == 1) | (F.col("score") >= LEAST_SHARE)
    return found.filter((F.col("lang_pred") != "und") & one).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of texts linked at 80 % of their five-word shingles."""
    rows = docs.withColumn("__class_id", F.struct("doc_id", F.md5("text").alias("digest")))
    found = ngram_join.join(rows, percent=80, k=5, id_col="__class_id").groupBy(F.col("doc_id").alias("__class_kept"))
    found = keep(found.agg(F.bool_or("kept").alias("any"), (F.count("*") > 1).alias("many")), "kept")
    sure, unsure = marked(rows, found.filter("many OR NOT any"))
    first = unsure.join(found.filter("any"), F.col("__class_id").eqNullSafe(F.col("__class_kept")), "left_semi")
    return sure.select(*docs.columns).unionByName(first.dropDuplicates(["__class_id"]).select(*docs.columns))


def marked(rows: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``__class_id`` is surely none of those in ``some`` (``__class_kept``), and the others.

    A bitmap of fixed size (``MARKS`` bits) of their hashes tells it where a row stands, so the
    texts of the first ones, by far the most, are not shuffled.
    """
    place = F.pmod(F.xxhash64("__class_kept"), F.lit(MARKS))
    marks = some.select(F.shiftright(place, 6).alias("__word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(__class_kept), 64) as int))").alias("bit"))
    marks = keep(marks.groupBy("__word").agg(F.bit_or("bit").alias("__bits")), "marks")  # MARKS / 64 rows at most
    named = rows.withColumn("__word", F.shiftright(F.pmod(F.xxhash64("__class_id"), F.lit(MARKS)), 6)).join(F.broadcast(marks), "__word", "left")
    hit = F.expr("coalesce(__bits & shiftleft(1L, cast(pmod(xxhash64(__class_id), 64) as int)), 0L) <> 0")
    return named.filter(~hit), named.filter(hit)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window like a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminate(docs, benchmark).filter(F.size("matches") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample the documents of each source to its target."""
    return mixing.apply(docs, weights=(5, 2, 1), max_epochs=3)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each row its shard and slot."""
    return sharding.shard(docs, shards=SHARDS)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"stage-{i}")
    return docs


ORACLE_SQL = None
