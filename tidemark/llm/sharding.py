"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._shared import keep

CELLS = 20


def position(key: str) -> int:
    """Place of a key on the ring: the first 60 bits of its MD5."""
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def ring(shards: int, vnodes: int) -> tuple[list[int], list[list[int]]]:
    """Sorted places of the virtual nodes, and for each the distinct shards met clockwise from it."""
    nodes = sorted((position(f"shard {s} node {v}"), s) for s in range(shards) for v in range(vnodes))
    owners = [s for _, s in nodes]
    met: list[list[int]] = [[] for _ in nodes]
    after: list[int] = []
    for i in reversed(range(2 * len(nodes))):
        s = owners[i % len(nodes)]
        after = [s, *[x for x in after if x != s]]
        if i < len(nodes):
            met[i] = after
    return [p for p, _ in nodes], met


def arc_of(place: Column, places: list[int]) -> Column:
    """Index of the first virtual node at or after a place, past the last one that of the first: a binary search by column functions."""
    nodes = F.split(F.lit(",".join(map(str, places))), ",").cast("array<long>")  # one literal once it is folded
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(places).bit_length()))])
    before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(nodes, n + step - 1) < place, n + step).otherwise(n))
    return F.pmod(before, F.lit(len(places)))


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """Most rows of each shard: a load factor of 1 deals floor or ceil of the mean, one above leaves slack."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load_factor * rows / shards)] * shards


def deal(loads: list[int], met: list[list[int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot) of every arc of the ring.

    In round r each arc offers what it still holds to the r-th shard clockwise; a shard takes
    offers in ring order until it is full. A full shard stays full, so an arc never has to ask twice.
    """
    left, used, pieces = [[0, n] for n in loads], [0] * len(caps), []
    for r in range(len(caps)):
        for arc, (start, n) in enumerate(left):
            if n and (take := min(n, caps[s := met[arc][r]] - used[s])) > 0:
                pieces.append((arc, start, start + take, s, used[s]))
                used[s] += take
                left[arc] = [start + take, n - take]
    return pieces


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 256, load_factor: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every row a shard and a gapless slot in it.

    A row's key is its id and the CRC of its text; the key's place on the ring falls in the
    arc before a virtual node, whose shard takes the row unless it holds its capacity, when
    the row goes on clockwise. Only the number of rows in each arc (shards x vnodes numbers,
    fixed by the parameters) reaches the driver, which returns the pieces of each arc. Rows
    are ranked inside one of 2 to the power of ``CELLS`` cells of the ring, cells inside their
    arc; slots follow from rank and piece. ``docs`` is read twice, nothing of it is copied,
    and columns that the caller doesn't use move nowhere. Null ids and
    texts count as empty; repeated rows are dealt like others and are interchangeable; an
    empty table gives no rows. Returns all columns of ``docs`` (those named like a new one
    are replaced) with size, text_crc32, shard and slot.
    """
    spark = docs.sparkSession
    places, met = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop("size", "text_crc32", "shard", "slot").withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))
    rows = rows.withColumn("__place", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("__arc", arc_of(F.col("__place"), places)).withColumn("__cell", F.shiftright("__place", 60 - CELLS))
    cells = keep(rows.groupBy("__arc", "__cell").agg(F.count("*").alias("n")), "shard-cells")
    loads = [0] * len(places)
    for r in cells.groupBy("__arc").agg(F.sum("n")).collect():  # at most shards x vnodes rows
        loads[r[0]] = r[1]
    pieces = deal(loads, met, capacities(sum(loads), shards, load_factor))
    table = spark.createDataFrame(pieces, "__piece_arc int, __from long, __to long, shard int, __slot long")
    before = F.sum("n").over(Window.partitionBy("__arc").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("__arc").alias("__a"), F.col("__cell").alias("__c"), F.coalesce(before, F.lit(0)).alias("__before"))
    order = Window.partitionBy("__arc", "__cell").orderBy("__place", F.col(id_col), "size")
    ranked = rows.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.join(cells, (F.col("__arc") == F.col("__a")) & (F.col("__cell") == F.col("__c"))).withColumn("__rank", F.col("__rank") + F.col("__before"))
    hit = (F.col("__arc") == F.col("__piece_arc")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    placed = ranked.join(F.broadcast(table), hit)  # at most shards pieces for each of the fixed number of arcs
    return placed.withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__from")).select(*rows.drop("__place", "__arc", "__cell").columns, "shard", "slot")


ROUND = """
o{r} AS (
  SELECT l.arc, l.start, l.n, m.shard, c.cap - coalesce(u.used, 0) AS free, coalesce(u.used, 0) AS used,
         coalesce(sum(l.n) OVER (PARTITION BY m.shard ORDER BY l.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM l{r} l JOIN met m ON m.arc = l.arc AND m.r = {r} JOIN caps c ON c.shard = m.shard LEFT JOIN u{r} u ON u.shard = m.shard),
t{r} AS (SELECT arc, shard, start, greatest(0, least(n, free - before))::BIGINT AS take, (used + least(before, free))::BIGINT AS slot, n FROM o{r}),
l{s} AS (SELECT arc, start + take AS start, n - take AS n FROM t{r}),
u{s} AS (SELECT shard, sum(take)::BIGINT AS used FROM ({all}) GROUP BY shard),"""


def oracle(shards: int = 8, vnodes: int = 256) -> str:
    """SQL for the law of rows: the ring, then a round of offers for each shard as window sums; CRC-32 by table."""
    rounds = "".join(ROUND.format(r=r, s=r + 1, all=" UNION ALL ".join(f"SELECT shard, take FROM t{k}" for k in range(r + 1))) for r in range(shards))
    pieces = " UNION ALL ".join(f"SELECT arc, shard, start, take, slot FROM t{r} WHERE take > 0" for r in range(shards))
    return f"""
WITH node AS (
  SELECT ('0x' || substr(md5('shard ' || s || ' node ' || v), 1, 15))::BIGINT AS pos, s::INTEGER AS shard FROM range({shards}) a(s), range({vnodes}) b(v)),
ring AS (SELECT row_number() OVER (ORDER BY pos, shard) - 1 AS arc, pos, shard FROM node),
met AS (
  SELECT a.arc, b.shard, row_number() OVER (PARTITION BY a.arc ORDER BY min((b.arc - a.arc + {shards * vnodes}) % {shards * vnodes})) - 1 AS r FROM ring a, ring b GROUP BY a.arc, b.shard),
tab AS (
  SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM range(256) t(k))),
k AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM k, tab),
p AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15))::BIGINT AS place FROM c),
q AS (SELECT p.*, coalesce(ring.arc, 0) AS arc FROM p ASOF LEFT JOIN ring ON p.place <= ring.pos),
z AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY place, doc_id, size) - 1 AS rank FROM q),
caps AS (SELECT s::INTEGER AS shard, n // {shards} + CASE WHEN s < n % {shards} THEN 1 ELSE 0 END AS cap FROM range({shards}) a(s), (SELECT count(*) AS n FROM k)),
u0 AS (SELECT NULL::INTEGER AS shard, 0::BIGINT AS used WHERE false),
l0 AS (SELECT arc, 0::BIGINT AS start, count(*) AS n FROM z GROUP BY arc),{rounds}
pieces AS ({pieces})
SELECT z.doc_id, z.size, z.text_crc32, 'rows' AS law, pieces.shard, (pieces.slot + z.rank - pieces.start)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM z JOIN pieces ON z.arc = pieces.arc AND z.rank >= pieces.start AND z.rank < pieces.start + pieces.take
"""
