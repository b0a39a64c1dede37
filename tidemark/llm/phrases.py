"""Phrases that stick together, counted on a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._bytes import chunks, prefix_sums, stretch
from tidemark.llm._shared import discard, keep, ready

ENDS = r"[.,;:!?\x0A-\x0D]"
BLANKS = r"[\x20\x09]+"
EDGE = 4
TOGETHER = 500_000
CUT = 16
ROUNDS = 12
BUCKET = 8 << 20
WAYS = 4096
CODEC = "zstd"
BLOCKS = "bucket long, lang string, size long, n long, grams binary, weights binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("weights", pa.binary())])


def words_of(langs: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(word, its language, number of its piece) of all words of texts, in order."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), ENDS)
    langs = langs.take(pc.list_parent_indices(pieces))
    words = pc.split_pattern_regex(pieces.flatten(), BLANKS)
    piece, words = pc.list_parent_indices(words), words.flatten()
    real = pc.not_equal(words, "")
    piece = piece.filter(real)
    return words.filter(real), langs.take(piece), piece.to_numpy(zero_copy_only=False)


def longest_grams(words: pa.Array, piece: np.ndarray, begin: int, end: int) -> pa.Array:
    """The gram that starts at each word from ``begin`` to before ``end``: ``EDGE`` words, fewer where the piece ends."""
    parts = [words.slice(begin, end - begin)]
    for k in range(1, EDGE):
        at = np.arange(begin + k, end + k)
        inside = at < len(piece)
        inside[inside] = piece[at[inside]] == piece[begin:end][inside]
        parts.append(words.take(pa.array(np.where(inside, at, 0), mask=~inside)))
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def summed(tables: list[pa.Table]) -> pa.Table:
    """Tables (lang, gram, w) as one of different grams, weights summed, language by language."""
    table = pa.concat_tables(tables).combine_chunks()
    if not table.num_rows:
        return table
    langs = table["lang"].combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy()
    by = np.argsort(code, kind="stable") if len(langs.dictionary) > 1 else None
    grams, weights = table["gram"].combine_chunks(), table["w"].to_numpy()
    if by is not None:
        grams, weights, code = grams.take(pa.array(by)), weights[by], code[by]
    starts = [*np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)]
    out = []
    for i, j in zip(starts, starts[1:]):
        found = grams.slice(i, j - i).dictionary_encode()
        sums = np.bincount(found.indices.to_numpy(), weights[i:j]).astype(np.int64)  # exact below 2^53
        out.append(pa.table({"lang": pa.repeat(langs.dictionary[int(code[i])], len(sums)), "gram": found.dictionary, "w": sums}))
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(out).combine_chunks()


def ends(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Where the first words of each gram end, or the gram if it has fewer."""
    blanks = np.flatnonzero(data == 32)
    at = np.searchsorted(blanks, offsets[:-1]) + words - 1
    return np.minimum(np.r_[blanks, np.full(words, len(data))][at], offsets[1:])


def heads(grams: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    """Hash of the first words of each gram, of all of it if it has fewer."""
    out = [np.zeros(0, dtype=np.uint64)]
    for _, data, offsets in chunks(grams):
        out.append(stretch(prefix_sums(data), offsets[:-1], ends(data, offsets, words)))
    return np.concatenate(out)


def cut(grams: pa.Array | pa.ChunkedArray, words: int) -> pa.ChunkedArray:
    """The first words of each gram."""
    out = []
    for _, data, offsets in chunks(grams):
        end = ends(data, offsets, words)
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[offsets[:-1]] += 1
        inside[end] -= 1
        lengths = np.r_[0, np.cumsum(end - offsets[:-1])]
        kept = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        out.append(pa.Array.from_buffers(pa.large_string(), len(end), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(kept)]))
    return pa.chunked_array(out, pa.large_string())


def pack(table: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
    """Grams (lang, gram, w) as compressed blocks, one for each bucket and language: a third of what rows would take in a shuffle."""
    if not table.num_rows:
        return pa.RecordBatch.from_pylist([], BLOCK_SCHEMA)
    langs = table["lang"].combine_chunks().dictionary_encode()
    key = bucket.astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()
    by = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0])
    lines = pc.binary_join_element_wise(table["gram"].combine_chunks().take(pa.array(by)).cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    offsets, data = np.frombuffer(lines.buffers()[1], dtype=np.int64)[: len(by) + 1], lines.buffers()[2]
    weights = table["w"].to_numpy()[by]
    rows = []
    for i, j in zip(starts, [*starts[1:], len(by)]):
        text = data.slice(offsets[i], offsets[j] - offsets[i])
        rows.append((int(bucket[by[i]]), langs.dictionary[int(langs.indices[int(by[i])].as_py())].as_py(), int(offsets[j] - offsets[i]), int(j - i), pa.compress(text, CODEC, asbytes=True), pa.compress(weights[i:j].tobytes(), CODEC, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)


def unpack(blocks: pa.Table | pa.RecordBatch) -> list[pa.Table]:
    """The grams (lang, gram, w) of each block."""
    out = []
    for lang, size, n, grams, weights in zip(*(blocks[c].to_pylist() for c in ("lang", "size", "n", "grams", "weights"))):
        text = pa.decompress(grams, size, CODEC)
        lines = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, size], dtype=np.int64)), text]), "\n").flatten().slice(0, n)
        out.append(pa.table({"lang": pa.repeat(pa.scalar(lang), n), "gram": lines, "w": np.frombuffer(pa.decompress(weights, 8 * n, CODEC), dtype=np.int64)}))
    return out


def edges_of_texts(ways: int):
    """A map over texts (lang, text): blocks of their edges (grams of ``EDGE`` words) and ends of pieces (shorter ones), summed over about ``TOGETHER`` words at a time, by a hash of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            words, langs, piece = words_of(batch.column("lang"), batch.column("text"))
            for begin in range(0, len(words), TOGETHER):
                end = min(begin + TOGETHER, len(words))
                grams = longest_grams(words, piece, begin, end).cast(pa.large_string())
                held.append(pa.table({"lang": langs.slice(begin, end - begin), "gram": grams, "w": np.ones(end - begin, dtype=np.int64)}))
                count += end - begin
                if count >= TOGETHER:
                    table, held, count = summed(held), [], 0
                    yield pack(table, heads(table["gram"], 3) % np.uint64(ways))
        if held:
            table = summed(held)
            yield pack(table, heads(table["gram"], 3) % np.uint64(ways))

    return run


def dealt(blocks: DataFrame, words: int, ways: int, parts: int) -> DataFrame:
    """Blocks of ``ways`` buckets dealt on to ``parts`` buckets at least, ``WAYS`` times as many in each round, so that blocks stay large."""
    while ways < parts:
        more, old = min(WAYS, -(-parts // ways)), ways

        def finer(batches: Iterator[pa.RecordBatch], more: int = more, old: int = old) -> Iterator[pa.RecordBatch]:
            held, count, now = [], 0, None

            def flush() -> Iterator[pa.RecordBatch]:
                if held:
                    table = summed(held)
                    yield pack(table, np.uint64(now) * np.uint64(more) + heads(table["gram"], words) // np.uint64(old) % np.uint64(more))

            for batch in batches:
                for i in range(batch.num_rows):
                    bucket = batch.column("bucket")[i].as_py()
                    if bucket != now or count >= TOGETHER:
                        yield from flush()
                        held, count, now = [], 0, bucket
                    held += unpack(batch.slice(i, 1))
                    count += held[-1].num_rows
            yield from flush()

        blocks = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(finer, BLOCKS)
        ways *= more
    return blocks


def nodes_of(least: int, ways: int):
    """A map over the blocks of a bucket and language, which hold all edges of their nodes: frequent edges and nodes, and blocks of the flows through nodes by their first two words.

    A node's flow is the sum of the edges that leave it and of the pieces that end with it.
    """

    def run(table: pa.Table) -> pa.Table:
        edges = summed(unpack(table))
        often = edges.filter(pc.greater_equal(edges["w"], least))
        often = often.filter(pc.match_substring_regex(often["gram"], "^[^ ]+ [^ ]+ [^ ]+ "))
        nodes = summed([pa.table({"lang": edges["lang"], "gram": cut(edges["gram"], 3), "w": edges["w"]})])
        del edges
        known = nodes.filter(pc.greater_equal(nodes["w"], least))
        often = pa.concat_tables([often, known.filter(pc.match_substring_regex(known["gram"], "^[^ ]+ [^ ]+ "))])
        pairs = summed([pa.table({"lang": nodes["lang"], "gram": cut(nodes["gram"], 2), "w": nodes["w"]})])
        del nodes
        blocks = pack(pairs, heads(pairs["gram"], 2) % np.uint64(ways))
        none = lambda n, t: pa.nulls(n, t)
        rows = [none(often.num_rows, f.type) if f.name != "lang" else often["lang"].combine_chunks() for f in BLOCK_SCHEMA]
        schema = pa.schema([*BLOCK_SCHEMA, ("phrase", pa.string()), ("w", pa.int64())])
        found = pa.table([*rows, often["gram"].cast(pa.string()), often["w"]], schema=schema)
        return pa.concat_tables([found, pa.table([*blocks.columns, none(blocks.num_rows, pa.string()), none(blocks.num_rows, pa.int64())], schema=schema)])

    return run


def pairs_of(least: int):
    """A map over the blocks of a bucket and language, which hold all flows of their pairs: frequent pairs, and the flows by first word."""

    def run(table: pa.Table) -> pa.Table:
        pairs = summed(unpack(table))
        real = pc.match_substring(pairs["gram"], " ")
        often = pairs.filter(pc.and_(pc.greater_equal(pairs["w"], least), real))
        single = summed([pa.table({"lang": pairs["lang"], "gram": cut(pairs["gram"], 1), "w": pairs["w"]})])
        words = pa.array([2] * often.num_rows + [1] * single.num_rows, pa.int32())
        both = pa.concat_tables([often, single])
        return pa.table([words, both["lang"], both["gram"].cast(pa.string()), both["w"]], names=["words", "lang", "phrase", "w"])

    return run


def phrase_counts(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to 4 words that occur ``least`` times, and (lang, n) of all words.

    Only the longest gram at each place is shuffled, to the bucket of its node (its first
    three words). Counts of shorter phrases are flows: what leaves a node, and the pieces that
    end there, summed to nodes of fewer words. Buckets grow in number with the texts, so that
    what one task holds doesn't.
    """
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // BUCKET))
    ways = min(parts, WAYS)
    edges = dealt(texts.mapInArrow(edges_of_texts(ways), BLOCKS), 3, ways, parts)
    ways = min(-(-parts // 4), WAYS)
    flows = keep(edges.groupBy("bucket", "lang").applyInArrow(nodes_of(least, ways), BLOCKS + ", phrase string, w long"), "flows")
    pairs = dealt(flows.filter("phrase IS NULL").drop("phrase", "w"), 2, ways, -(-parts // 4))
    short = keep(pairs.groupBy("bucket", "lang").applyInArrow(pairs_of(least), "words int, lang string, phrase string, w long"), "pairs")
    single = short.filter("words = 1").groupBy("lang", "phrase").agg(F.sum("w").alias("w"))
    found = flows.filter("phrase IS NOT NULL").select("lang", "phrase", "w").unionByName(short.filter("words = 2").drop("words")).unionByName(single.filter(F.col("w") >= least))
    counts = keep(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), F.col("w").alias("f")), "counts")
    totals = keep(short.filter("words = 1").groupBy("lang").agg(F.sum("w").alias("n")), "totals")
    discard(flows)
    discard(short)
    return counts, totals


def compact(edges: DataFrame) -> DataFrame:
    """(lang, words, w) of the unary paths of a graph of edges (lang, gram, w).

    Two edges are one path where a node has no other edge in or out and both weigh the same.
    The head of each path is found by pointer doubling. Paths are cut at edges that a hash
    picks, one of 16, so none gets long; edges of a cycle that no cut breaks stand alone.
    """
    ends = edges.select("lang", "gram", "w", F.substring_index("gram", " ", 3).alias("start"), F.substring_index("gram", " ", -3).alias("end"))
    leaving = ends.groupBy("lang", F.col("start").alias("node")).agg(F.count("*").alias("out"), F.min("gram").alias("gram"), F.min("w").alias("w"))
    coming = ends.groupBy("lang", F.col("end").alias("node")).agg(F.count("*").alias("in"), F.min("gram").alias("before"), F.min("w").alias("w"))
    joints = leaving.join(coming, ["lang", "node", "w"]).filter("out = 1 AND in = 1")
    joints = joints.filter(F.pmod(F.xxhash64("lang", "gram"), F.lit(CUT)) != 0).select("lang", "gram", "before")
    heads = edges.select("lang", "gram", "w").join(joints, ["lang", "gram"], "left")
    now = keep(heads.select("lang", "gram", "w", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("long").alias("d")), "heads")
    for _ in range(ROUNDS):
        above = now.select("lang", F.col("gram").alias("head"), F.col("head").alias("top"), F.col("d").alias("more")).filter("more > 0")
        joined = now.join(above, ["lang", "head"], "left")
        following = keep(joined.select("lang", "gram", "w", F.coalesce("top", "head").alias("head"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("more").isNotNull().alias("open")), "heads")
        discard(now)
        now = following
        if not now.filter("open").head(1):
            break
    alone = F.col("open")
    steps = now.select("lang", "w", F.when(alone, F.col("gram")).otherwise(F.col("head")).alias("head"), F.when(alone, 0).otherwise(F.col("d")).alias("d"), "gram")
    paths = steps.groupBy("lang", "head", "w").agg(F.array_sort(F.collect_list(F.struct("d", "gram"))).alias("steps"))
    added = F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: F.substring_index(s["gram"], " ", -1))
    out = keep(paths.select("lang", F.concat(F.split(F.col("steps")[0]["gram"], " "), added).alias("words"), "w"), "paths")
    discard(now)
    return out


def windows(words: Column, k: int) -> Column:
    """All different phrases of k words in a row."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))


def mine(docs: DataFrame, least: int = 30, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang", cover_percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and path_words of each language's ``top`` phrases of 2 to 4 words (None: all).

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?`` and line ends, and these into
    words at blanks and tabs. A phrase that occurs a >= ``least`` times is scored by the cut into
    parts of l and r occurrences that gives the least floor(2000000*a/(l+r)), the first one on a
    tie; one that lies in a longer such phrase with 100*f >= ``cover_percent``*a goes. ``path_words``
    tells phrases of four words how long the unary path is in which they lie (others null).

    Words are nodes' letters of a de Bruijn graph: :func:`phrase_counts` sums its edges and
    derives all shorter counts, :func:`compact` joins unary paths of frequent edges, from which
    the phrases of four words and what they cover are read. Nulls in text count as empty, in lang
    as ``und``; repeated rows count each time; other columns are not looked at. No words, no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    counts, totals = phrase_counts(texts, least)
    paths = compact(counts.filter(f"words = {EDGE}").select("lang", F.col("phrase").alias("gram"), F.col("f").alias("w")))
    by_path = paths.select("lang", F.explode(windows(F.col("words"), EDGE)).alias("phrase"), F.col("w").alias("a"), F.size("words").cast("long").alias("path_words"))
    shorter = counts.filter("words IN (2, 3)").select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("path_words"))
    over_three = paths.select("lang", F.explode(windows(F.col("words"), 3)).alias("phrase"), F.col("w").alias("longer"))
    three = counts.filter("words = 3").select("lang", F.split("phrase", " ").alias("words"), F.col("f").alias("longer"))
    over_two = three.select("lang", F.explode(windows(F.col("words"), 2)).alias("phrase"), "longer")  # what covers a pair by four words does so by three of them
    covers = over_three.unionByName(over_two).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(25,0)")
    free = by_path.unionByName(shorter).join(covers, ["lang", "phrase"], "left").filter(F.coalesce(100 * wide("longer") < cover_percent * wide("a"), F.lit(True))).drop("longer")
    free = keep(free, "free")
    words = F.split("phrase", " ")
    cuts = free.select("lang", "phrase", "a", "path_words", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "path_words", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(25,0)) div (CAST(l AS DECIMAL(25,0)) + CAST(r AS DECIMAL(25,0))) AS LONG)")
    scored = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "phrase", "a", "path_words").agg(F.min("cut").alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "path_words")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
c AS (
  SELECT lang, k, g, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
    FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
q AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM c WHERE f >= 30),
inner_parts AS (
  SELECT lang, f, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS g
  FROM q, (VALUES (2), (3)) AS t(s) WHERE k > s),
cover AS (SELECT lang, g, max(f) AS f FROM inner_parts GROUP BY ALL),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, k)) AS cut, w, k FROM q WHERE k >= 2),
s AS (
  SELECT x.lang, x.g, x.a, cut, l.f AS l, r.f AS r, (2000000 * x.a::HUGEINT // (l.f + r.f)::HUGEINT)::BIGINT AS score
  FROM cuts x JOIN q l ON l.lang = x.lang AND l.g = array_to_string(x.w[1:cut], ' ') JOIN q r ON r.lang = x.lang AND r.g = array_to_string(x.w[cut + 1:x.k], ' ')
  LEFT JOIN cover o ON o.lang = x.lang AND o.g = x.g WHERE o.f IS NULL OR 100 * o.f < 80 * x.a),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) <= 2000
"""
