"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._bytes import chunks, sequences, shingles, short, words
from tidemark.llm._shared import ready

SHINGLE = 5
BITS = 64
TILE = 1024


def fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each stretch [start, end) of shingles: bit b is the majority of their bits b."""
    ones = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
    np.cumsum((hashes[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1), axis=0, out=ones[1:])
    set_ = (ones[ends] - ones[starts]) * 2 > (ends - starts)[:, None]
    return (set_.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks of bits: two fingerprints within the radius agree in one whole block."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, shingle hashes, shingle weights (bytes of their words) and the bounds of each text's words."""
    hashes, starts, ends, bounds = words(data, offsets)
    sums = np.r_[0, np.cumsum(ends - starts)]
    return hashes, shingles(hashes, SHINGLE), sums[SHINGLE:] - sums[:-SHINGLE], bounds


class Block:
    """A block of benchmark items (item_id, item), ordered by them, as it is broadcast.

    A Python worker indexes it once, for all tasks that it runs.
    """

    def __init__(self, rows: pa.Table, radius: int):
        self.rows, self.radius, self.made = rows, radius, None

    def index(self) -> Items:
        if self.made is None:
            self.made = Items(self.rows, self.radius)
        return self.made


class Items:
    """Index of a block of benchmark items: shingles, weights and fingerprints by number of words.

    Items are known by a number in the order of their ids, which may be of any type.
    """

    def __init__(self, rows: pa.Table, radius: int):
        self.radius = radius
        self.shifts, self.masks = (np.array(x, dtype=np.uint64) for x in zip(*blocks(radius), strict=True))
        self.ids: list = []
        whole: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.bags: list[tuple[int, Counter, dict[int, int], int]] = []
        by_size: dict[int, list[int]] = defaultdict(list)
        prints: list[int] = []
        for item_id, text in zip(rows.column("item_id").to_pylist(), rows.column("item").to_pylist(), strict=True):
            if not self.ids or self.ids[-1] != item_id:
                self.ids.append(item_id)
            item = len(self.ids) - 1
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            hashes, sh, weight, _ = parts(raw, np.array([0, len(raw)]))
            if not len(hashes):
                continue
            if len(hashes) < SHINGLE:
                whole[len(hashes)][int(short(hashes))].append(item)
                continue
            bag = Counter(sh.tolist())
            weights = dict(zip(sh.tolist(), weight.tolist(), strict=True))
            by_size[len(hashes)].append(len(self.bags))
            self.bags.append((item, bag, weights, sum(weights[s] * n for s, n in bag.items())))
            prints.append(int(fingerprints(sh, np.array([0]), np.array([len(sh)]))[0]))
        # hashes in order, and the items of each
        self.whole = {size: (np.array(sorted(table), dtype=np.uint64), [table[h] for h in sorted(table)]) for size, table in whole.items()}
        self.known = np.unique(np.array([s for _, bag, _, _ in self.bags for s in bag], dtype=np.uint64))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.sizes = {}
        for size, at in by_size.items():
            own = np.array([prints[i] for i in at], dtype=np.uint64)
            values = (own[None] >> self.shifts[:, None]) & self.masks[:, None]
            order = np.argsort(values, axis=1, kind="stable")
            # where the items of each value of each block begin in the order of the block
            bounds = np.stack([np.searchsorted(v[o], np.arange(int(self.masks.max()) + 2, dtype=np.uint64)) for v, o in zip(values, order, strict=True)])
            self.sizes[size] = (min(self.bags[i][3] for i in at), np.array(at), own, order, bounds)

    def near(self, size: int, prints: np.ndarray) -> dict[int, set[int]]:
        """For each place in ``prints`` with any, the items of this size whose fingerprint is within the radius."""
        _, at, own, order, bounds = self.sizes[size]
        found: dict[int, set[int]] = {}
        block = np.arange(len(self.shifts))
        for begin in range(0, len(prints), TILE):
            tile = prints[begin : begin + TILE]
            value = ((tile[:, None] >> self.shifts) & self.masks).astype(np.int64)
            low = bounds[block, value].ravel()
            n = bounds[block, value + 1].ravel() - low
            probe = np.repeat(np.arange(len(n)), n)
            item = order[probe % len(block), np.arange(len(probe)) - np.repeat(np.cumsum(n) - n - low, n)]
            window = probe // len(block)
            hit = np.flatnonzero(np.bitwise_count(tile[window] ^ own[item]) <= self.radius)
            for w, i in zip((window[hit] + begin).tolist(), at[item[hit]].tolist(), strict=True):
                found.setdefault(w, set()).add(i)
        return found

    def hits(self, sh: np.ndarray) -> np.ndarray:
        """Which shingles are in some item."""
        out = self.filter[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, sh[at]), len(self.known) - 1)
            out[at] = self.known[place] == sh[at]
        return out

    def search(self, hashes: np.ndarray, sh: np.ndarray, weight: np.ndarray, hit: np.ndarray, percent: int) -> list[tuple]:
        """(item_id, similarity, first word) of the best window of each item found in one text."""
        best: dict[int, tuple[float, int]] = {}
        for size, (known, items) in self.whole.items():
            found = sequences(hashes, size)
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            at = np.flatnonzero(known[place] == found)
            for k, first in zip(*(x.tolist() for x in np.unique(place[at], return_index=True)), strict=True):
                for item in items[k]:
                    best[item] = min(best.get(item, (1.0, len(hashes))), (1.0, int(at[first])))
        if hit.any():
            shared = np.r_[0, np.cumsum(np.where(hit, weight, 0))]
            for size, (least, *_) in self.sizes.items():
                # a similarity of p % needs shared shingles of p % of the item's weight; windows are cut to short texts
                span = min(size - SHINGLE + 1, len(sh))
                starts = np.arange(len(sh) - span + 1)
                starts = starts[(shared[starts + span] - shared[starts]) * 100 >= percent * least]
                if not len(starts):
                    continue
                # windows that lie apart are hashed apart, without what is between them
                cuts = np.flatnonzero(np.diff(starts) > span) + 1
                prints = [fingerprints(sh[s[0] : s[-1] + span], s - s[0], s - s[0] + span) for s in np.split(starts, cuts)]
                for at, near in ((int(starts[w]), items) for w, items in sorted(self.near(size, np.concatenate(prints)).items())):
                    window = Counter(sh[at : at + span].tolist())
                    weights = dict(zip(sh[at : at + span].tolist(), weight[at : at + span].tolist(), strict=True))
                    total = sum(weights[s] * n for s, n in window.items())
                    for i in near:
                        item, bag, _, own = self.bags[i]
                        common = sum(weights[s] * min(n, bag[s]) for s, n in window.items() if s in bag)
                        if common * 100 >= percent * (total + own - common) and common / (total + own - common) > best.get(item, (0, 0))[0]:
                            best[item] = (common / (total + own - common), at)
        return [(self.ids[k], s, at) for k, (s, at) in sorted(best.items())]


def merged(old: list[dict] | None, new: list[tuple]) -> list[dict]:
    """Matches of the blocks so far and of one more: the better one of an id that is in both."""
    best = {m["item_id"]: m for m in old or ()}
    for item_id, similarity, at in new:
        if item_id not in best or similarity > best[item_id]["similarity"]:
            best[item_id] = {"item_id": item_id, "similarity": similarity, "first_word": at}
    return list(best.values())


def contaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = 20, block_bytes: int = 32_000_000,
                text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Add ``matches``: item_id, similarity and first word of the best window for each item found in a text.

    Windows of as many words as an item has slide over the whole text by one word; a text
    that is shorter is one window. A window's SimHash is looked up among those of the items
    of its size in radius + 1 blocks of bits, which finds every one within ``radius``; a pair
    so found counts if the weighted Jaccard similarity of their five-word shingles (with
    repeats, weighed by the bytes of their words) is ``percent`` or more. Windows that hold
    too little weight of benchmark shingles for that are passed over before hashing. Items
    with fewer than five words match as a whole sequence; empty or null items and texts
    match nothing. Words are split at white space, A-Z in lower case. Item ids may be of any
    type that Spark can sort; equal ones are one item with several texts, null is one of them.

    The benchmark is taken in blocks of at most about ``block_bytes`` of text, one pass over
    the documents for each, so its size doesn't bind memory. Other columns pass through, one
    named ``matches`` is replaced.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.drop("matches")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item"))
    match = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(match))])
    position = docs.columns.index(text_col)
    out = docs.withColumn("matches", F.array().cast(T.ArrayType(match)))
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(n)) == block) if n > 1 else items
        table = rows.orderBy(F.col("item_id").asc_nulls_last(), F.col("item").asc_nulls_first()).toArrow()  # block_bytes at most, about
        shared = spark.sparkContext.broadcast(Block(table, radius))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value.index()
            for batch in batches:
                found = []
                for _, data, offsets in chunks(batch.column(position)):
                    hashes, sh, weight, bounds = parts(data, offsets)
                    hit = index.hits(sh) if len(index.known) else np.zeros(len(sh), dtype=bool)
                    seen = np.r_[0, np.cumsum(hit)]
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        e = max(a, b - SHINGLE + 1)
                        found.append(index.search(hashes[a:b], sh[a:e], weight[a:e], hit[a:e], percent) if index.whole or e > a and seen[e] > seen[a] else [])
                held = batch.column(batch.num_columns - 1)
                new = [merged(o, f) for o, f in zip(held.to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, held.type)], schema.names)

        out = out.mapInArrow(scan, schema)
    return out


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS d FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS k FROM benchmark),
ds AS (SELECT d, unnest(range(0, len(w) - 4)) AS p, w FROM dw WHERE len(w) >= 5),
dx AS (SELECT d, p, array_to_string(w[p + 1 : p + 5], ' ') AS s, list_sum(list_transform(w[p + 1 : p + 5], lambda x: strlen(x)))::BIGINT AS g FROM ds),
dc AS (SELECT d, p, s, g, sum(g) OVER (PARTITION BY d ORDER BY p)::BIGINT AS upto FROM dx),
ix AS (
  SELECT k, array_to_string(w[p + 1 : p + 5], ' ') AS s, list_sum(list_transform(w[p + 1 : p + 5], lambda x: strlen(x)))::BIGINT AS g
  FROM (SELECT k, w, unnest(range(0, len(w) - 4)) AS p FROM iw WHERE len(w) >= 5)),
ib AS (SELECT k, s, any_value(g) AS g, count(*) AS n FROM ix GROUP BY k, s),
io AS (SELECT k, sum(g * n)::BIGINT AS own FROM ib GROUP BY k),
h AS (SELECT dc.d, ib.k, dc.p, ib.s, ib.g, ib.n, least(len(iw.w) - 4, len(dw.w) - 4) AS span, greatest(len(dw.w) - len(iw.w), 0) AS last
      FROM dc JOIN ib ON ib.s = dc.s JOIN iw ON iw.k = ib.k JOIN dw ON dw.d = dc.d),
e AS (SELECT d, k, s, g, n, span, unnest(range(greatest(p - span + 1, 0), least(p, last) + 1)) AS st FROM h),
c AS (SELECT d, k, st, span, s, g * least(count(*), n) AS c FROM e GROUP BY d, k, st, span, s, g, n),
v AS (SELECT d, k, st, span, sum(c)::BIGINT AS common FROM c GROUP BY d, k, st, span),
y AS (
  SELECT v.d, v.k, common, (b.upto - b0.upto + b0.g)::BIGINT + io.own - common AS total
  FROM v JOIN io ON io.k = v.k JOIN dc b ON b.d = v.d AND b.p = v.st + v.span - 1 JOIN dc b0 ON b0.d = v.d AND b0.p = v.st),
m AS (
  SELECT d, k, max(common / total) AS similarity FROM y WHERE common * 100 >= 80 * total GROUP BY d, k
  UNION ALL
  SELECT d, k, 1.0 FROM dw, iw WHERE len(iw.w) BETWEEN 1 AND 4 AND len(list_filter(range(1, len(dw.w) - len(iw.w) + 2), lambda i: dw.w[i : i + len(iw.w) - 1] = iw.w)) > 0),
z AS (SELECT d, item_id, max(similarity) AS similarity FROM m JOIN iw USING (k) GROUP BY d, item_id)
SELECT dw.doc_id, count(z.d) > 0 AS contaminated, string_agg(z.item_id::VARCHAR, ',' ORDER BY z.item_id) AS items, max(z.similarity) AS similarity
FROM dw LEFT JOIN z ON z.d = dw.d GROUP BY dw.d, dw.doc_id
"""
