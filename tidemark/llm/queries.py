"""One registered query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, html, language, lines, mixing, ngram_join, phrases, repeats, sharding, vectors, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_table(spark, sf_dir, "documents"), length=400).drop("kept").withColumn("repeated", F.col("n_removed") > 0)


def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), percent=85, k=4).select("doc_id", "n_shingles", "component_id")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents"), every_block=True).select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.when(F.size("matches") > 0, F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")).alias("items"),
        F.array_max(F.transform("matches", lambda m: m["similarity"])).alias("similarity"),
    )


def linked_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(_table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "position", "parent_turn", "n_quotes", "n_linked", "body")


def held_out(doc_id: Column) -> Column:
    """The fold kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages hold no time of capture: one is made of the id, a second for each."""
    clock = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("page_id", F.lit(1_000_000_000)))
    found = warc.archive(_table(spark, sf_dir, "pages"), captured=clock)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "position", "capture")


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"), least=30, top=2000).drop("path_words")


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


QUERIES = {
    "op1_water_filling": mix,
    "op2_hash_ring": shards,
    "op3_prefix_free_parsing": repeated_strings,
    "op4_jaccard_join": jaccard_classes,
    "op5_tree_scoring": page_text,
    "op6_cover_tree": vector_classes,
    "op7_patience_alignment": line_dedup,
    "op8_simhash_windows": leaks,
    "op9_quotation_linking": linked_chat,
    "op10_language_mixture": languages,
    "op11_loser_tree_merge": archived,
    "op12_phrase_graph": collocations,
    "op13_block_whitening": whitened,
}

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i:i + 3], ' ')))
                                    WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda y: y <> 0)) > 0),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.c = p.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) k ON k.a = e.vec_id
"""

ORACLES = {
    "op1_water_filling": mixing.ORACLE,
    "op2_hash_ring": sharding.oracle(),
    "op3_prefix_free_parsing": repeats.ORACLE,
    "op4_jaccard_join": JACCARD_SQL,
    "op6_cover_tree": VECTOR_SQL,
    "op7_patience_alignment": lines.ORACLE,
    "op8_simhash_windows": decontamination.ORACLE,
    "op9_quotation_linking": chat.ORACLE,
    "op11_loser_tree_merge": warc.ORACLE,
    "op12_phrase_graph": phrases.ORACLE,
}
