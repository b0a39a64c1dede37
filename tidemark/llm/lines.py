"""Line dedup by pairwise alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import mix, powers
from tidemark.llm._shared import keep, ready

ROUNDS = 16


def rising(places: Sequence[int]) -> list[int]:
    """Indices of the longest rising chain, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, y in enumerate(places):
        at = bisect_left(tops, y)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            ends.append(k)
        else:
            tops[at], ends[at] = y, k
    chain = []
    k = ends[-1] if ends else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs (i, j), both rising, of like lines: equal ends, then the longest rising chain of lines unique on both sides, then between its links."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        count_a, count_b = Counter(a[i:m]), Counter(b[j:n])
        place = {b[y]: y for y in range(j, n) if count_b[b[y]] == 1}
        unique = [(x, place[a[x]]) for x in range(i, m) if count_a[a[x]] == 1 and a[x] in place]
        chain = [unique[k] for k in rising([y for _, y in unique])]
        x0, y0 = i, j
        for x, y in chain:
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        if chain:
            todo.append((x0, m, y0, n))
    return sorted(out)


def common_blocks(a: Sequence[int], b: Sequence[int], sizes: Sequence[int], least: int) -> list[int]:
    """Lines of b in runs aligned with consecutive lines of a that hold ``least`` characters or more."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for x, y in [*patience(a, b), (-9, -9)]:
        if (x, y) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in run) >= least:
                out += run
            run = []
        if y >= 0:
            run.append(y)
        last = (x, y)
    return out


def short_runs(hashes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first line, line after the last, hash) of the shortest runs of lines that hold ``least`` characters, from each line on and up to each line.

    ``offsets`` bounds the lines of each row. All lines of a longer run lie in such runs inside it.
    """
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lines = np.arange(len(sizes))
    row = np.searchsorted(offsets, lines, side="right") - 1
    end = np.maximum(np.searchsorted(before, before[:-1] + least), lines + 1)
    begin = np.minimum(np.searchsorted(before, before[1:] - least, side="right") - 1, lines)
    on, up = end <= offsets[row + 1], begin >= offsets[row]
    # what a line starts and another one ends counts once
    up[up] = np.where(on[begin[up]], end[begin[up]], -1) != lines[up] + 1
    row = np.concatenate([row[on], row[up]])
    begin, end = np.concatenate([lines[on], begin[up]]), np.concatenate([end[on], lines[up] + 1])
    forth, back = powers(len(sizes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes.view(np.uint64)) * forth[: len(sizes)], dtype=np.uint64)])
    return row, begin - offsets[row], end - offsets[row], mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def alike(own: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the lines of two texts, alike for like ones, from pairs of like lines (both by place, from 0 on)."""
    there = np.arange(int(ahead.max()) + 1)
    while True:
        here = np.full(int(own.max()) + 1, len(there))
        np.minimum.at(here, own, there[ahead])
        least = there.copy()
        np.minimum.at(least, ahead, here[own])
        if (least == there).all():
            return here, there
        there = least


def aligned(begins: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Lines of a text in the blocks that align with another text, from the runs that both share: (first line, line after the last, first line in the other).

    :func:`patience` aligns the lines of both texts that lie in shared runs (others are in no
    block): equal ends, the longest rising chain of lines unique on both sides, then between its
    links. A run whose lines meet lines in a row is aligned. What is left, blocks that stand twice
    or in another order, is aligned again; after ``ROUNDS`` diffs, or one that aligns no run, each
    run stands for itself.
    """
    order = np.lexsort((ends, begins))
    begins, ends, places = (x[order].astype(np.int64) for x in (begins, ends, places))
    sizes = ends - begins
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    step = np.arange(sizes.sum()) - np.repeat(heads, sizes)
    line, owner = np.repeat(begins, sizes) + step, np.repeat(np.arange(len(begins)), sizes)
    other, ahead = np.unique(np.repeat(places, sizes) + step, return_inverse=True)
    here, there = alike(line, ahead)
    gone = np.zeros(int(ends.max()), dtype=bool)
    left = np.ones(len(begins), dtype=bool)
    for _ in range(ROUNDS):
        own = np.unique(line[left[owner]])
        met = np.array(patience(there.tolist(), here[own].tolist()), dtype=np.int64).reshape(-1, 2)
        # how far a line lies from the one it meets: the same for all lines of an aligned run
        far = np.full(len(gone), np.iinfo(np.int64).max)
        far[own[met[:, 1]]] = other[met[:, 0]] - own[met[:, 1]]
        low, high = np.minimum.reduceat(far[line], heads), np.maximum.reduceat(far[line], heads)
        now = left & (low == high) & (high < np.iinfo(np.int64).max)
        gone[line[now[owner]]] = True
        left &= ~now
        if not now.any() or not left.any():
            break
    gone[line[left[owner]]] = True
    return np.flatnonzero(gone).astype(np.int32)


def aligned_blocks(texts: DataFrame, order: Column, least: int) -> DataFrame:
    """(key, gone): the lines of each text in blocks of ``least`` characters or more that align with an earlier text by ``order``.

    Texts meet where they share a short run of lines: each other text with a run is paired with
    the first one that has it, so pairs grow with lines, and every block that an earlier text has
    too is in a pair. A pair's shared runs are aligned by :func:`aligned`.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = batch.column("hashes"), batch.column("sizes")
            n = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            row, begin, end, run = short_runs(hashes.flatten().to_numpy(zero_copy_only=False), sizes.flatten().to_numpy(zero_copy_only=False), n, least)
            columns = [batch.column(i).take(pa.array(row)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(run.view(np.int64))], ["key", "first", "begin", "end", "run"])

    first = texts.schema["first"].dataType.simpleString()
    runs = texts.select("key", "first", "hashes", "sizes").mapInArrow(cut, f"key string, first {first}, begin int, end int, run long")
    runs = keep(runs, "line-runs")
    # written before the join, so that Spark may split the rows of a run that very many texts have
    leaders = runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("order"), "begin")).alias("leader")).filter("n > 1")
    leaders = keep(leaders.select("run", F.col("leader.order.key").alias("leader"), F.col("leader.begin").alias("place")), "run-leaders")
    pairs = runs.join(leaders, "run").filter("key <> leader").groupBy("leader", "key").agg(*[F.collect_list(c).alias(c) for c in ("begin", "end", "place")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [aligned(*(x.values.to_numpy(zero_copy_only=False) for x in row)) for row in zip(*(batch.column(c) for c in ("begin", "end", "place")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return pairs.drop("leader").mapInArrow(align, "key string, gone array<int>")


def trimmed(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def aligned_pairs(texts: DataFrame, order: Column, evidence: float, least: int) -> DataFrame:
    """(key, gone): the lines of each text in blocks that align with the first text of a line they share, of pairs with ``evidence``."""
    each = texts.select("key", "first", F.explode(F.arrays_zip("hashes", "sizes")).alias("l")).select("key", "first", F.col("l.hashes").alias("hash"), F.col("l.sizes").alias("size")).distinct()
    leaders = keep(each.groupBy("hash").agg(F.count("*").alias("texts"), F.min(order).alias("leader")).filter("texts > 1").select("hash", "texts", F.col("leader.key").alias("leader")), "line-leaders")
    pairs = each.join(leaders, "hash").filter("key <> leader").groupBy("leader", "key").agg(F.sum(F.col("size") / F.log2(F.col("texts") + 1.0)).alias("evidence"))
    pairs = pairs.filter(F.col("evidence") >= evidence).select("leader", "key")
    both = pairs.join(texts.select(F.col("key").alias("leader"), F.col("hashes").alias("ahead")), "leader").join(texts.select("key", "hashes", "sizes"), "key")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ahead, hashes, sizes = (batch.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([common_blocks(*x, least) for x in zip(ahead, hashes, sizes, strict=True)], pa.list_(pa.int32()))], ["key", "gone"]
            )

    return both.select("key", "ahead", "hashes", "sizes").mapInArrow(align, "key string, gone array<int>")


def dedup(docs: DataFrame, evidence: float = 16.0, block_chars: int = 50, id_col: str = "doc_id", text_col: str = "text", every_block: bool = False) -> DataFrame:
    """Delete from later documents the blocks of lines they share with earlier ones.

    A line is compared trimmed; blank ones never match. Of the texts that share a line the
    one with the smallest id is first; each other one is paired with it, so pairs grow with
    the lines and not with their square, however many texts share one. Shared lines count
    as characters / log2(1 + texts with the line), so rare lines carry a pair and common short
    ones don't; pairs with ``evidence`` or more are aligned by patience diff, and aligned
    blocks of ``block_chars`` characters or more are deleted from the later text.

    That leaves blocks whose lines lead to different texts, that many texts share, or that
    stand twice or in another order. With ``every_block`` texts meet by runs of lines in place of
    single ones, each with the first text that has it, and all blocks of ``block_chars`` characters
    or more that align there go: every run of lines that any earlier text has in a row too.

    Returns all columns of ``docs`` (those named like a new one are replaced) with the text
    that is left, n_lines and n_deleted (not blank ones). Among equal texts that of the
    smallest id stays and every other loses all its lines if they hold ``block_chars`` or
    more; rows with one id and text are one document. Null ids come last. Null text: null, 0, 0.
    """
    ready(docs.sparkSession)
    docs = docs.drop("n_lines", "n_deleted")
    rows = docs.withColumn("__key", F.md5(text_col))
    ids = keep(rows.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), "__key"), "line-ids")
    # as what is joined to all rows is written first, Spark may split those of a text with very many copies
    firsts = keep(ids.groupBy("__key").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "line-firsts")
    lines = F.filter(F.transform(F.split(text_col, "\n", -1), trimmed), lambda x: F.length(x) > 0)
    texts = rows.filter(F.col(text_col).isNotNull()).select("__key", F.col(id_col).alias("id"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), F.transform(lines, lambda x: F.length(x)).alias("sizes"))
    # one row for each text: that of its first id
    texts = texts.join(firsts, "__key").filter(F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["__key"])
    texts = keep(texts.select(F.col("__key").alias("key"), "first", "hashes", "sizes"), "line-texts")
    order = F.struct(F.col("first").isNull().alias("last"), "first", "key")
    gone = aligned_blocks(texts, order, block_chars) if every_block else aligned_pairs(texts, order, evidence, block_chars)
    gone = gone.filter("size(gone) > 0").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = firsts.join(gone.withColumnRenamed("key", "__key"), "__key", "left").filter("rows > 1 OR gone IS NOT NULL").withColumnRenamed("first", "__first")
    out = rows.join(keep(gone.select("__key", "__first", F.col("gone").alias("__gone"), F.lit(True).alias("__hit")), "line-gone"), "__key", "left")
    all_lines = F.split(text_col, "\n", -1)
    out = out.withColumn("__lines", all_lines)
    filled = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: trimmed(F.get("__lines", i)) != "")
    out = out.withColumn("__filled", F.when(F.col(text_col).isNotNull(), filled))
    chars = F.aggregate(F.transform("__filled", lambda i: F.length(trimmed(F.get("__lines", i)))), F.lit(0), lambda a, x: a + x)
    # the characters are counted in later copies only
    later = F.when(F.col("__hit") & ~F.col(id_col).eqNullSafe(F.col("__first")), chars >= block_chars)
    blank = F.array().cast("array<int>")
    deleted = F.when(F.coalesce(later, F.lit(False)), F.col("__filled")).otherwise(F.coalesce(F.transform("__gone", lambda k: F.get("__filled", k)), blank))
    out = out.withColumn("__deleted", deleted)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__deleted")), lambda i: F.get("__lines", i))
    out = out.withColumn("n_lines", F.coalesce(F.size("__filled"), F.lit(0)).cast("long")).withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_deleted", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("__deleted")).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("n_deleted") == 0, F.col(text_col)).when(F.col(text_col).isNotNull(), F.array_join(left, "\n")))
    return out.select(*docs.columns, "n_lines", "n_deleted")


ORACLE = r"""
WITH t AS (SELECT text, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text),
l AS (SELECT text, first, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS f FROM t),
s AS (SELECT text, first, f, list_transform(f, lambda x: length(x)) AS z FROM l),
c AS (SELECT text, first, f, list_transform(range(0, len(f) + 1), lambda k: coalesce(list_sum(z[1:k]), 0)) AS cs, unnest(range(1, len(f) + 1)) AS i FROM s),
r AS (
  SELECT text, first, f, i AS b, list_min(list_filter(range(i, len(f) + 1), lambda j: cs[j + 1] - cs[i] >= 50)) AS e FROM c
  UNION SELECT text, first, f, list_max(list_filter(range(1, i + 1), lambda j: cs[i + 1] - cs[j] >= 50)), i FROM c),
h AS (SELECT text, first, b, e, array_to_string(f[b:e], chr(10)) AS run FROM r WHERE b IS NOT NULL AND e IS NOT NULL),
k AS (SELECT *, first_value(text) OVER (PARTITION BY run ORDER BY first NULLS LAST, md5(text)) AS leader FROM h),
g AS (SELECT text, list(DISTINCT p) AS gone FROM (SELECT text, unnest(range(b, e + 1)) AS p FROM k WHERE leader <> text) GROUP BY text),
o AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ol, t.first, g.gone FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN g ON g.text = d.text),
f AS (SELECT *, list_filter(range(1, len(ol) + 1), lambda i: trim(ol[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS fi FROM o),
x AS (
  SELECT *, CASE WHEN doc_id IS DISTINCT FROM first AND coalesce(list_sum(list_transform(fi, lambda i: length(trim(ol[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13))))), 0) >= 50 THEN fi
                 ELSE list_transform(coalesce(gone, []), lambda p: fi[p]) END AS del FROM f)
SELECT doc_id, coalesce(len(fi), 0)::BIGINT AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE len(del) END::BIGINT AS n_deleted,
       sha256(CASE WHEN text IS NULL OR len(del) = 0 THEN text
                   ELSE array_to_string(list_transform(list_filter(range(1, len(ol) + 1), lambda i: NOT list_contains(del, i)), lambda i: ol[i]), chr(10)) END) AS kept_sha256
FROM x
"""
