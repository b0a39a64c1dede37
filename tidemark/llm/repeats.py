"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import chunks, mix, prefix_sums, stretch
from tidemark.llm._shared import keep, ready

GRAM = 128
PLACE_BITS = 24
PIECE = 512
SORTED = 1 << 19


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by running minima of blocks from both ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    after = np.minimum.accumulate(grid, axis=1).ravel()
    before = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, place of the trigger after the first start, trigger key, context) of the phrases of texts laid end to end.

    The trigger of a string of ``length`` bytes is its 128-byte piece with the least rolling
    hash, the first one on a tie: a like string has it at the same place. The starts that
    share a trigger are a phrase; its context is all bytes of their strings and the place of
    the trigger in them. A row's starts are counted from its own beginning.
    """
    gram = min(GRAM, max(1, length // 3))
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    keys = stretch(sums, at, at + gram)
    places = np.uint64((1 << PLACE_BITS) - 1)
    rows, firsts, lasts, triggers = [], [], [], []
    piece = 1 << (PLACE_BITS - 1)
    for begin in range(0, len(data) - length + 1, piece):
        part = keys[begin : begin + piece + length - gram]
        least = sliding_least((part & ~places) | np.arange(len(part), dtype=np.uint64), length - gram + 1)[:piece]
        trigger = (least & places).astype(np.int64) + begin
        start = np.arange(begin, begin + len(trigger))
        row = np.searchsorted(offsets, start, side="right") - 1
        valid = start + length <= offsets[row + 1]
        start, trigger, row = start[valid], trigger[valid], row[valid]
        if len(start):
            head = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])])
            rows.append(row[head])
            firsts.append(start[head])
            lasts.append(start[np.r_[head[1:], len(start)] - 1])
            triggers.append(trigger[head])
    if not rows:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    row, first, last, trigger = (np.concatenate(x) for x in (rows, firsts, lasts, triggers))
    context = mix(stretch(sums, first, last + length) + (trigger - first).astype(np.uint64))
    return row, first - offsets[row], last - offsets[row], trigger - first, keys[trigger], context


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places in the suffix array of ``data`` of the suffixes at ``starts``, compared over ``length`` bytes: equal ones agree so far.

    By prefix doubling: suffixes are sorted by their first 8 bytes, then those still alike by
    the ranks of what follows, at twice the distance each time; the last step overlaps.
    """
    padded = np.zeros(len(data) + length + 8, dtype=np.uint64)
    padded[: len(data)] = data
    width = min(8, length)
    word = np.zeros(len(data) + length, dtype=np.uint64)
    for j in range(width):
        word |= padded[j : j + len(word)] << np.uint64(56 - 8 * j)
    order = np.argsort(word)
    head = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
    rank = np.zeros(len(word) + length, dtype=np.int64)
    sizes = np.diff(np.r_[head, len(order)])
    rank[order] = np.repeat(head, sizes)
    alike = order[np.repeat(sizes, sizes) > 1]
    while width < length and len(alike):
        step = min(width, length - width)
        if 2 * (width + step) >= length:  # the last two steps look at the starts alone and at what the last one adds to them
            wanted = np.zeros(len(word), dtype=bool)
            wanted[starts] = True
            wanted[starts + length - width - step] = True
            alike = alike[wanted[alike]]
        pair = rank[alike] << 32 | rank[alike + step]
        by = np.argsort(pair)
        pair, alike = pair[by], alike[by]
        now = pair >> 32
        group = np.r_[True, now[1:] != now[:-1]]
        part = np.r_[True, pair[1:] != pair[:-1]]
        at = np.arange(len(by))
        first = np.maximum.accumulate(np.where(group, at, 0))
        begin = np.maximum.accumulate(np.where(part, at, 0))
        rank[alike] = now + begin - first
        sizes = np.diff(np.r_[np.flatnonzero(part), len(by)])
        alike = alike[np.repeat(sizes, sizes) > 1]
        width += step
    return rank[starts]


def order_windows(contexts: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its strings of ``length`` bytes start elsewhere too.

    The suffixes of the dictionary entries at hand are sorted by bytes; those with a neighbour
    that agrees in ``length`` bytes, or of an entry with copies, occur again.
    """
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    starts = np.concatenate([np.arange(e - len(c), e - length + 1) for c, e in zip(contexts, ends.tolist(), strict=True)])
    owner = np.repeat(np.arange(len(contexts)), [len(c) - length + 1 for c in contexts])
    ranks = suffix_ranks(data, starts, length)
    order = np.argsort(ranks, kind="stable")
    like = ranks[order][1:] == ranks[order][:-1]
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:][like]] = True
    again[order[:-1][like]] = True
    again |= copies[owner] > 1
    return np.split(again, np.flatnonzero(np.diff(owner)) + 1)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without its spans, the bytes removed and the number of maximal runs."""
    left, at, removed, n = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or n == 0:
            left.append(text[at:start])
            removed += end - start
            n += 1
            at = end
        elif end > at:
            removed += end - at
            at = end
    left.append(text[at:])
    return b"".join(left), removed, n


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts elsewhere.

    Returns one row per input row: id, n_bytes, n_removed, n_spans, kept (the bytes left,
    which may cut a character) and kept_sha256. Texts are UTF-8 bytes, null and empty ones
    give zeros. Strings are judged on the input and never cross rows; rows with one id and
    text are separate and repeat each other. Other columns are ignored.

    Prefix-free parsing at scale: rolling-hash triggers cut all texts in phrases, alike in
    like strings; each reaches over every string whose trigger it holds, so strings lie in one
    phrase. The dictionary counts each distinct phrase; the parse is the table of their
    occurrences. A suffix of the corpus has a neighbour that agrees in ``length`` bytes if its
    phrase occurs twice in the parse, or if it has one in the suffix array of the dictionary;
    the order of longer suffixes, which the parse would give, plays no part. Phrases with one
    trigger are put in one piece of the dictionary, whose suffixes are sorted by bytes. A piece
    of over ``PIECE`` phrases is cut by longer triggers, half of its starts each time, with the
    bytes that all strings of the half share, until every piece is small; so no task holds
    more than a few of these, however many texts share a passage. Only which phrases are the
    same rests on 64-bit hashes.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    named = F.coalesce(F.concat(F.octet_length(F.col("doc_id").cast("string")).cast("string"), F.lit(":"), F.col("doc_id").cast("string")), F.lit("-"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(named, F.lit(":"), F.col("text")))))  # the id's length keeps ids with a colon apart

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                row, start, last, place, trigger, context = phrases(data, offsets, length)
                if len(row):
                    keys = batch.column(0).take(pa.array(row + first))
                    numbers = [pa.array(x.astype(np.int32)) for x in (start, last, place)]
                    yield pa.RecordBatch.from_arrays([keys, *numbers, pa.array(trigger.view(np.int64)), pa.array(context.view(np.int64))], ["key", "start", "last", "place", "trigger", "context"])

    # aggregates are written before they are joined to the rows they come from, so that Spark may split the hot keys of the join
    table = keep(rows.select("key", "text").mapInArrow(parse, "key binary, start int, last int, place int, trigger long, context long"), "parse")
    entries = table.groupBy("trigger").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).filter("n > 1")
    entries = keep(entries.select("trigger", (F.col("low") == F.col("high")).alias("alike")), "entries")
    again = keep(table.join(entries, "trigger"), "again")
    whole = again.filter("alike").select("key", F.col("start").alias("begin"), (F.col("last") + length).alias("end"))
    mixed = again.filter("NOT alike")
    words = keep(
        mixed.groupBy("trigger", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "last", "place")).alias("o"))
        .select("trigger", "context", "copies", "o.key", "o.start", "o.last", "o.place"), "dictionary",
    )
    copied = keep(words.filter("copies > 1").select("trigger", "context"), "copied")
    several = mixed.join(copied, ["trigger", "context"], "left_semi")
    several = several.select("key", F.col("start").alias("begin"), (F.col("last") + length).alias("end"))
    size = keep(words.groupBy("trigger").agg(F.count("*").alias("contexts")), "sizes")
    asked = words.join(size, "trigger").groupBy("key").agg(F.collect_list(F.struct("trigger", "copies", "start", "last", "place", "contexts")).alias("asked"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for key, text, asked in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                for a in asked.as_py():
                    out.append((key.as_py(), a["trigger"], a["copies"], a["start"], a["place"], a["contexts"], raw[a["start"] : a["last"] + length]))
                    held += len(out[-1][-1])
                if held > 4_000_000:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    found = rows.select("key", "text").join(asked, "key").select("key", "text", "asked").mapInArrow(take, "key binary, trigger long, copies long, start int, place int, contexts long, bytes binary")
    found = keep(found, "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size > SORTED and row[1] != last:  # whole entries only
                    yield from _spans(held, length)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[1]
        yield from _spans(held, length)

    pieces, spans = _pieces(found, length)
    sorted_ = pieces.select("key", "trigger", "copies", "start", "bytes").repartition("trigger").sortWithinPartitions("trigger")
    spans = spans.unionByName(sorted_.mapInArrow(compare, "key binary, begin int, end int"))
    gone = whole.unionByName(several).unionByName(spans)
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = rows.join(gone, "key", "left").select("doc_id", "text", "spans")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                left, removed, n = cut(raw, [(s["begin"], s["end"]) for s in spans.as_py() or ()])
                for to, x in zip(columns, (len(raw), removed, n, left, hashlib.sha256(left).hexdigest()), strict=True):
                    to.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(finish, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "trigger", "copies", "start", "place", "contexts", "bytes"])


def _pieces(found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(phrases in pieces of at most ``PIECE``, spans of strings found to repeat on the way).

    ``found`` has the distinct phrases (key, trigger, copies, start, place, contexts, bytes). Those
    of a larger piece are cut in two by the distance of the trigger from a string's start; all
    strings of a half share a longer stretch of bytes, whose hash is its trigger.
    """

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, copies, start, place, low, high, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                nearest = place - (len(raw) - length)
                for lo, hi in ((low, (low + high) // 2), ((low + high) // 2, high)):
                    a, b = min(hi - 1, place), max(lo, nearest)  # the farthest and the nearest start from the trigger
                    if b <= a:
                        part, shared = raw[place - a : place - b + length], raw[place - lo if place >= lo else 0 : place - hi + 1 + length]
                        names = [int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=lo.to_bytes(4, "big") + n.to_bytes(4, "big")).digest(), "big", signed=True) for x, n in ((shared, hi), (part, a))]
                        out.append((key, copies, start + place - a, a, lo, hi, part, *names))
            if out:
                types = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "copies", "start", "place", "low", "high", "bytes", "trigger", "context"])

    columns = ("key", "trigger", "copies", "start", "bytes")
    small = found.filter(F.col("contexts") <= PIECE).select(*columns)
    none = found.filter("false").select("key", F.col("start").alias("begin"), F.col("start").alias("end"))
    large = found.filter(F.col("contexts") > PIECE).select("key", "copies", "start", "place", F.lit(0).alias("low"), F.lit(length).alias("high"), "bytes")
    while large.take(1):
        halves = keep(large.mapInArrow(halve, "key binary, copies long, start int, place int, low int, high int, bytes binary, trigger long, context long"), "halves")
        same = halves.groupBy("trigger", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("one"))
        same = keep(same, "same")
        sizes = keep(same.groupBy("trigger").agg(F.count("*").alias("contexts")), "sizes")
        halves = keep(halves.join(same, ["trigger", "context"]).join(sizes, "trigger"), "counted")
        none = none.unionByName(halves.filter("n > 1 AND copies = 1").select("key", F.col("start").alias("begin"), (F.col("start") + F.length("bytes")).alias("end")))
        first = halves.filter((F.col("n") == 1) | (F.col("one") == F.struct("key", "start"))).withColumn("copies", F.greatest("copies", "n"))
        small = small.unionByName(first.filter(F.col("contexts").between(2, PIECE)).select(*columns))
        large = first.filter(F.col("contexts") > PIECE).select("key", "copies", "start", "place", "low", "high", "bytes")
    return small, none


def _spans(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated strings of whole dictionary entries; those with copies are known already."""
    if not rows:
        return
    keys, begins, ends = [], [], []
    for (key, _, copies, start, _), again in zip(rows, order_windows([r[4] for r in rows], np.array([r[2] for r in rows]), length), strict=True):
        if copies == 1:
            for a, b in zip(*runs(again), strict=True):
                keys.append(key)
                begins.append(start + int(a))
                ends.append(start + int(b) + length)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["key", "begin", "end"])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT id, doc_id, h, (length(h) // 2)::BIGINT AS n_bytes FROM d),
w AS (SELECT id, i, hash(substr(h, 2 * i + 1, 800)) AS x FROM (SELECT id, h, unnest(range(0, n_bytes - 399)) AS i FROM n WHERE n_bytes >= 400)),
r AS (SELECT id, i FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
s AS (SELECT id, i, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS first FROM r),
g AS (SELECT id, i, sum(first) OVER (PARTITION BY id ORDER BY i) AS g FROM s),
p AS (SELECT id, g, min(i) AS b, max(i) + 400 AS e FROM g GROUP BY id, g),
c AS (SELECT id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM p GROUP BY id)
SELECT n.doc_id, n.n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN c.id IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(bs) + 1),
         lambda k: substr(h, 2 * coalesce(CASE WHEN k > 0 THEN es[k] END, 0) + 1, 2 * (coalesce(bs[k + 1], n_bytes) - coalesce(CASE WHEN k > 0 THEN es[k] END, 0)))), '') END)) AS kept_sha256,
       coalesce(c.n_removed, 0) > 0 AS repeated
FROM n LEFT JOIN c ON c.id = n.id
"""
