"""N-gram Jaccard join in the metric space of shingle sets."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import chunks, mix, shingles, short, words
from tidemark.llm._graph import components
from tidemark.llm._shared import discard, keep, ready

SKETCH = 1 << 22
SKETCH_BLOCK = 1 << 17
PARITY = 1024
MARKS = 1 << 24
DIRECT = 64
PIVOTS = 16
ROUNDS = 2
LEVELS = 5
HEAD = 16


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for a whole text of fewer than k words, none without words."""
    for _, data, offsets in chunks(column):
        hashes, _, _, bounds = words(data, offsets)
        sh = shingles(hashes, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(sh[a : b - k + 1])
            elif b > a:
                yield np.array([short(hashes[a:b])], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def frequency_classes(docs: DataFrame, k: int) -> np.ndarray:
    """Class of each slot of a fixed-size count of all shingles: 0 for those near the middle, then by powers of two of what is above it.

    Near is what the spread of the slots, not their mean, allows: with more input a slot holds
    more shingles that meet by chance, and ever more frequent ones would pass for rare.
    Only the order in which a set lists its shingles depends on it, so collisions, and the
    255 at which a task stops counting a slot, cost time and never a link.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.uint32)
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for s in [*shingle_sets(batch.column(0), k), None]:
                if s is not None:
                    held.append((s & np.uint64(SKETCH - 1)).astype(np.int64))
                    size += len(s)
                if held and (s is None or size > 1 << 20):
                    slot, n = np.unique(np.concatenate(held), return_counts=True)
                    total[slot] += n.astype(np.uint32)
                    held, size = [], 0
        clipped = np.minimum(total, 255).astype(np.uint8)
        at = [i for i in range(0, SKETCH, SKETCH_BLOCK) if clipped[i : i + SKETCH_BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // SKETCH_BLOCK for i in at], pa.int32()), pa.array([clipped[i : i + SKETCH_BLOCK].tobytes() for i in at], pa.binary())], ["block", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, dtype=np.int64)
        for n in table.column("n"):
            total += np.frombuffer(n.as_py(), dtype=np.uint8 if len(n.as_py()) == SKETCH_BLOCK else np.uint32)
        sums = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "n": pa.array([sums], pa.binary())})

    summed = docs.select("text").mapInArrow(count, "block int, n binary").withColumn("part", F.spark_partition_id())
    for _ in range(2):  # in steps, so that no group holds the counts of all tasks: 64 at most, in the last step a 4096th of them
        summed = summed.withColumn("part", F.shiftright("part", 6)).groupBy("block", "part").applyInArrow(add, "block int, part int, n binary")
    blocks = summed.groupBy("block").applyInArrow(add, "block int, part int, n binary").select("block", "n").collect()  # SKETCH numbers
    counts = np.zeros(SKETCH)
    for block, n in blocks:
        counts[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(n, dtype=np.uint32)
    middle, upper = np.quantile(counts, (0.5, 0.84))
    limit = 8 + min(counts.mean(), 3 * (upper - middle))
    above = counts - middle
    return np.where(above > limit, np.floor(np.log2(np.maximum(above, 1) / limit)) + 1, 0).astype(np.uint8)


def identity(s: np.ndarray) -> int | None:
    """64-bit name of a set, none for the empty one."""
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None


def parity(s: np.ndarray, width: int = PARITY) -> np.ndarray:
    """Bit b: whether an odd number of shingles hash to b. Sets that differ in m shingles differ in m bits at most."""
    bits = np.bincount((s >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide(s: np.ndarray) -> bytes:
    """Parity bits in proportion to the set, 1 to 2 for each shingle: an eighth of a byte or two where a hash takes four bytes."""
    return parity(s, min(max(1 << len(s).bit_length(), PARITY), 1 << 24)).tobytes()


def far_apart(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """Whether wide parity bits rule a link out; the wider one is folded to the width of the other."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) > (na + nb) * (100 - percent)


def sets(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, name (of the text), n, node (the set's identity), prefix (with a shingle more for each level), parity bits and, of large sets, wide ones of every row of ``docs`` (doc_id, text)."""
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, k))  # SKETCH bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = classes.value
        for batch in batches:
            n, node, prefix, bits, more = [], [], [], [], []
            for s in shingle_sets(batch.column(2), k):
                kind = order[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                first = s[np.argsort(kind, kind="stable")] if len(s) and kind.any() else s
                n.append(len(s))
                node.append(identity(s))
                prefix.append(first[: len(s) - (percent * len(s) + 99) // 100 + LEVELS if len(s) else 0].view(np.int64))
                bits.append(parity(s))
                more.append(wide(s) if len(s) >= PARITY else None)  # else they are the others
            columns = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "name", "n", "node", "prefix", "bits", "wide"])

    return docs.select("doc_id", F.xxhash64("text").alias("name"), "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name long, n long, node long, prefix array<long>, bits array<long>, wide binary")


def whole_sets(docs: DataFrame, k: int, need: DataFrame) -> DataFrame:
    """node and all hashes (sorted, as bytes) of the sets of the texts in ``need`` (name), spread by node.

    The texts are read again; a bitmap of fixed size (``MARKS`` bits) of their names lets few
    others pass, and a task makes the set of equal texts once. Held on the executors' disks; a
    lost part is made again from the texts.
    """
    spark = docs.sparkSession
    words = need.select(F.shiftright(F.pmod(F.col("name"), F.lit(MARKS)), 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(name, 64) as int))").alias("bit"))
    mask = np.zeros(MARKS // 64, dtype=np.uint64)
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # MARKS / 64 rows at most, in one job
    mask[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    marks = spark.sparkContext.broadcast(mask)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, seen = marks.value, np.zeros(0, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            names, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            hit = (named[(names % MARKS) >> 6] >> (names % 64).astype(np.uint64)) & np.uint64(1) > 0
            hit[hit] = ~np.isin(names[hit], seen)
            seen = np.concatenate([seen, names[hit]])
            for s in shingle_sets(batch.column(1).take(pa.array(at[hit])), k):
                if len(s):
                    out.append((identity(s), s.tobytes()))
                    held += 8 * len(s)
                if held > 1 << 21:
                    yield _set_batch(out)
                    out, held = [], 0
            if out:
                yield _set_batch(out)

    found = docs.select(F.xxhash64("text").alias("name"), "text").mapInArrow(scan, "node long, hashes binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "node").dropDuplicates(["node"]).persist(StorageLevel.DISK_ONLY)


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    node, hashes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(hashes, pa.binary())], ["node", "hashes"])


def common(a: bytes, b: bytes) -> int:
    """Size of the intersection of two sets of hashes, each sorted and without repeats."""
    both = np.concatenate([np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that wide parity bits leave; these move in place of whole sets, above all those of long texts."""
    one, two = (reps.filter("wide IS NOT NULL").select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"x{c}")) for c in "ab")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            kept = [x is None or y is None or not far_apart(x, y, na, nb, percent) for x, y, na, nb in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.select("a", "b").join(one, "a", "left").join(two, "b", "left").select("a", "b", "xa", "xb", "na", "nb")
    return both.mapInArrow(narrow, "a long, b long")


class WholeSets:
    """Whole sets (:func:`whole_sets`) of the nodes that pairs to be compared have, each fetched once."""

    def __init__(self, docs: DataFrame, k: int, reps: DataFrame) -> None:
        self.docs, self.k, self.names = docs, k, reps.select("node", "name")
        self.parts: list[DataFrame] = []
        self.nodes: list[DataFrame] = []

    def of(self, pairs: DataFrame) -> DataFrame:
        """node, hashes: those of all pairs (a, b) so far; texts are read again only if a set is missing."""
        need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        for known in self.nodes:
            need = need.join(known, "node", "left_anti")
        need = keep(self.names.join(need, "node", "left_semi"), "need")
        if not self.parts or need.take(1):
            self.parts.append(whole_sets(self.docs, self.k, need.select("name")))
            self.nodes.append(need.select("node"))
        return reduce(DataFrame.unionByName, self.parts)

    def release(self) -> None:
        for part in self.parts:
            part.unpersist()


def links(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b), by whole 64-bit hashes."""
    one, two = (held.select(F.col("node").alias(c), F.col("hashes").alias(f"x{c}")) for c in "ab")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = p.as_py(), q.as_py()
                shared = common(p, q)
                kept.append(100 * shared >= percent * ((len(p) + len(q)) // 8 - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    return both.select("a", "b", "xa", "xb").mapInArrow(measure, "a long, b long")


def may_link(na: Column, nb: Column, xa: Column, xb: Column, percent: int) -> Column:
    """What sizes and parity bits leave: a link's sets differ in (100 - p) / (100 + p) of their sizes at most."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart(xa, xb) * (100 + percent) <= (na + nb) * (100 - percent))


def apart(xa: Column, xb: Column) -> Column:
    """Parity bits that differ; spelled out word by word, which Spark compiles, as it does not for a lambda."""
    return reduce(operator.add, (F.bit_count(xa.getItem(i).bitwiseXOR(xb.getItem(i))) for i in range(PARITY // 64)))


def least_common(n: Column, percent: int) -> Column:
    """What a set of n shingles shares with every set linked to it: percent % of it, rounded up."""
    return F.floor((n * percent + 99) / 100).cast("int")


def lean(n: Column, i: Column, percent: int, depth: int) -> Column:
    """Whether the smaller one of two linked sets may have the last of their first ``depth`` common shingles at place i."""
    return (depth - 1 + n - i) * (100 + percent) >= n * 2 * percent


def may_meet(na: Column, nb: Column, ia: Column, ib: Column, percent: int, depth: int) -> Column:
    """Whether a link may have the last of its first ``depth`` common shingles at these places of the two sets in the common order.

    All else that the sets share lies behind, so the shorter rest bounds the intersection. A link
    passes at its first common shingles; at others the same pair need not be found again.
    """
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & ((depth - 1 + F.least(na - ia, nb - ib)) * (100 + percent) >= (na + nb) * percent)


def band(n: Column, percent: int) -> Column:
    """Sizes that a link allows lie in the same or in neighbouring bands: rings around the empty set."""
    return F.floor(F.log(n.cast("double")) / math.log(100.01 / percent))


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are not in one class yet, with their classes (ca, cb)."""
    one, two = (parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    named = pairs.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    return named.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")


def grow(parts: DataFrame, found: DataFrame) -> DataFrame:
    """Classes (node, component) after the links (a, b): classes that these join are joined, the others stay."""
    joined = components(between(found, parts).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if not joined.take(1):
        return parts
    moved = parts.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return keep(moved.unionByName(joined.join(parts.select("node"), "node", "left_anti")), "classes")


def regions(reps: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), node, n, i (its place), members: every region whose members may link, with all that its window reaches."""
    first = F.posexplode(F.slice("prefix", F.lit(1), F.col("n") - least_common(F.col("n"), percent) + 1)).alias("i", "key")
    places = reps.select(first, "node", "n")
    may = F.count_if(lean(F.col("n"), F.col("i"), percent, 1))
    shared = keep(places.groupBy("key").agg(F.count("*").alias("members"), may.alias("leans")).filter("members > 1 AND leans > 0").select("key", "members"), "shared")
    return keep(places.join(shared, "key"), "regions")


def classed(members: DataFrame, parts: DataFrame, percent: int, depth: int) -> DataFrame:
    """``members`` (key, node, n, i, bits, head) of the regions that hold more than one class, with class, top (the largest class), others (members outside it), leans and members."""
    now = members.join(parts, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    may = F.count_if(lean(F.col("n"), F.col("i"), percent, depth))
    counts = now.groupBy("key", "class").agg(F.count("*").alias("n_class"), may.alias("leans"))
    state = counts.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n_class").alias("members"), F.sum("leans").alias("leans"), F.max(F.struct("n_class", "class")).alias("t"))
    state = state.filter("classes > 1 AND leans > 0").select("key", "members", "leans", F.col("t.class").alias("top"), (F.col("members") - F.col("t.n_class")).alias("others"))
    return keep(now.join(keep(state, "state"), "key"), "open")


def meet(one: DataFrame, two: DataFrame, percent: int, depth: int, ordered: bool = False) -> DataFrame:
    """(a, b): sets of different classes that meet in a region, ``one`` with ``two``, and pass the windows of size, place and parity bits.

    Sets that share a shingle of their ``head``, regions before this one, meet there and not
    here. If ``ordered``, both are all members, and the smaller set comes from ``one`` alone.
    """
    columns = ("node", "n", "i", "bits", "head", "class")
    left = one.select("key", *columns).withColumn("band", band(F.col("n"), percent))
    right = two.select("key", *[F.col(c).alias(f"{c}2") for c in columns]).withColumn("band", F.explode(F.array(*[band(F.col("n2"), percent) + x for x in (-1, 0, 1)])))
    window = (F.col("class") != F.col("class2")) & may_meet(F.col("n"), F.col("n2"), F.col("i"), F.col("i2"), percent, depth)
    if ordered:
        window &= F.struct("n", "node") < F.struct("n2", "node2")
        left = left.filter(lean(F.col("n"), F.col("i"), percent, depth))
    window &= may_link(F.col("n"), F.col("n2"), F.col("bits"), F.col("bits2"), percent) & ~F.arrays_overlap("head", "head2")
    found = left.join(right, ["key", "band"]).filter(window)
    return found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def split(rest: DataFrame, reps: DataFrame, percent: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions cut at the next common shingle: (members of the new ones, members of those where that doesn't pay, pairs that share no further shingle).

    Counts decide it region by region, before any row moves: a group of texts that are alike in
    all shingles would only be repeated once for each, and is better joined as it is.
    """
    n, i = F.col("n"), F.col("i")
    reach = F.greatest(n - least_common(n, percent) + depth - i, F.lit(0))  # places i + 1 to n - least + depth

    def longer(members: DataFrame) -> DataFrame:
        more = members.select("key", "node", "n", "class", "i").join(reps.select("node", "prefix"), "node")
        more = more.select("key", "node", "n", "class", i.alias("before"), F.posexplode(F.slice("prefix", i + 2, reach)).alias("at", "token"))
        return more.withColumn("i", F.col("before") + 1 + F.col("at")).drop("at", "before")

    may = F.count_if(lean(F.col("n"), F.col("i"), percent, depth + 1))
    counts = longer(rest).groupBy("key", "token").agg(F.count("*").alias("n_new"), may.alias("l_new"), F.min("class").alias("low"), F.max("class").alias("high"))
    counts = keep(counts.filter("n_new > 1 AND l_new > 0 AND low <> high").select("key", "token", "n_new", "l_new"), "tokens")
    then = counts.groupBy("key").agg(F.sum(F.col("n_new") * F.col("l_new") + F.col("n_new")).alias("then"))
    now = rest.select("key", "members", "leans").distinct()
    pays = F.coalesce("then", F.lit(0)) * 2 < F.col("members") * F.col("leans")
    chosen = keep(now.join(then, "key", "left").select("key", pays.alias("pays")), "chosen")
    both = rest.join(chosen, "key")
    cut = both.filter("pays")
    # what moves with every further shingle is narrow; the rest joins those that are left
    found = longer(cut).join(counts.select("key", "token"), ["key", "token"]).select("key", "token", "node", F.col("i").alias("place"))
    found = found.join(cut.select("key", "node", "n", "i", "bits", "head"), ["key", "node"]).join(reps.select("node", "prefix"), "node")
    passed = F.slice("prefix", i + 2, F.least(F.col("place") - i - 1, F.lit(HEAD)))
    deeper = found.select(F.xxhash64("key", "token").alias("key"), "node", "n", F.col("place").alias("i"), "bits", F.concat("head", passed).alias("head"))
    whole = cut.filter(n == depth)  # the one set that is the path itself
    return keep(deeper, "deeper"), both.filter("NOT pays"), meet(whole, cut, percent, depth)


def join(docs: DataFrame, percent: int = 85, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose shingle sets are linked at a Jaccard similarity of ``percent`` % or more.

    Returns one row per input row: id, n_shingles, component_id (smallest id reached by links),
    kept (the first row of its class by id). Two texts link exactly when 100 * intersection >=
    percent * union. Rows with one set are one node; null, empty and wordless texts have an
    empty set and stay alone; null ids come last and name a class only if it has no other.
    Other columns are ignored. Sets are held and compared as 64-bit hashes.

    The method, in the metric d = 1 - Jaccard with e = 1 - percent / 100:

    1. The first pivots are the one-shingle sets {s}, at a distance of 1 - 1/n from sets of n
       shingles that hold s and of 1 from all others: with documents as first pivots nearly
       all distances are 1, every document would lie on every border, and windows would
       replicate the whole table. A set's home is the region of its first shingle in one
       common order, rare ones first, and its window of width e reaches the regions of its
       first n - ceil(percent n / 100) + 1 shingles: two sets within e share one of them.
    2. In a region, pairs must pass further windows before whole sets are fetched and compared
       exactly: of size (the distance from the empty set), of place (where the region's
       shingle stands in both sets) and of parity bits, a map of the sets to 1024 bits that
       never makes distances larger. Regions of at most ``DIRECT`` members are joined so,
       nearest candidates first: pairs that these bring into one class are not compared.
    3. In larger regions the members outside the largest class meet the others if they are at
       most ``DIRECT``; otherwise up to ``PIVOTS`` of them do, documents as pivots, for
       ``ROUNDS`` rounds. Classes grow by the links found, pivots that met their region
       leave it, and a region of one class is done: thousands of near copies cost a few
       pivots' pairs.
    4. What is larger still is cut again by the pivots {s, t}: at the next common shingle, with
       the windows of step 1, and so on from step 3, ``deepest`` levels down. A region is cut
       only if the parts have less than half of its pairs by their counts; one of texts that
       share nearly all shingles, yet in many classes, is joined as it is, under all windows.

    Each step is partial aggregates and joins on keys; sets are fetched for pairs alone.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = keep(sets(docs, percent, k).withColumn("row", F.monotonically_increasing_id()), "sets")
    full = made.filter("node IS NOT NULL")
    first = full.groupBy("node").agg(F.min("row").alias("row"))
    reps = keep(full.join(first.select("row"), "row").select("node", "name", F.col("n").cast("int").alias("n"), "prefix", "bits", "wide"), "reps")
    table = keep(made.select("doc_id", "n", "node", "row"), "rows")
    discard(made)
    found = regions(reps, percent)
    small = found.filter(F.col("members") <= DIRECT)
    one, two = (small.select("key", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("i").alias(f"i{c}")) for c in "ab")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    one = one.filter(lean(F.col("na"), F.col("ia"), percent, 1))
    pairs = one.join(two, "key").filter(ordered & may_meet(F.col("na"), F.col("nb"), F.col("ia"), F.col("ib"), percent, 1)).select("a", "b").distinct()
    left, right = (reps.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & may_link(F.col("na"), F.col("nb"), F.col("xa"), F.col("xb"), percent))
    near = keep(both.select("a", pairs["b"], apart(F.col("xa"), F.col("xb")).alias("apart")), "near")
    near = keep(near.join(likely(near, reps, percent), ["a", "b"]), "close")
    large = found.filter(F.col("members") > DIRECT)
    # of the shared shingles before a region's the first ones, rare and common ones alike
    shared = found.join(large.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "key"))).alias("shared"))
    head = F.slice(F.transform(F.filter("shared", lambda x: x["i"] < F.col("i")), lambda x: x["key"]), 1, HEAD).alias("head")
    members = keep(large.join(reps.select("node", "bits"), "node").join(shared, "node").select("key", "node", "n", "i", "bits", head), "large")
    discard(found)
    sets_of = WholeSets(docs, k, reps)
    held = sets_of.of(near)
    # the nearest candidate of each set first: what comes into one class so needs no second look
    nearest = near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("p")).select("p.a", "b")
    parts = keep(components(links(nearest, held, percent)), "classes")
    parts = grow(parts, links(between(near.select("a", "b"), parts), held, percent))

    def compared(met: DataFrame) -> DataFrame:
        close = keep(likely(met, reps, percent), "close")
        return grow(parts, links(close, sets_of.of(close), percent)) if close.take(1) else parts

    for depth in range(1, deepest(percent) + 1) if members.take(1) else ():
        past = [members]
        for turn in range(ROUNDS + 1):
            now = classed(members, parts, percent, depth)
            for done in past:  # all that the rows so far were made of
                discard(done)
            past = [now]
            if turn == ROUNDS or not now.take(1):
                break
            few, outside = F.col("others") <= DIRECT, F.col("class") != F.col("top")
            slot = F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(PIVOTS))
            own = F.struct("node", "n", "i", "bits", "head", "class").alias("own")
            picks = now.filter(outside & ~few).groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), own)).alias("p"))
            picks = keep(picks.select("key", "p.own.*"), "picks")
            met = meet(now, now.filter(outside & few).select(*picks.columns).unionByName(picks), percent, depth)
            parts = compared(met)
            members = now.filter(~few).join(picks.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "n", "i", "bits", "head")
            past = [now, picks]
        if not now.take(1):
            break
        rest = now
        if depth == deepest(percent):
            parts = compared(meet(rest, rest, percent, depth, ordered=True))
            break
        members, level, through = split(rest, reps, percent, depth)
        parts = compared(meet(level, level, percent, depth, ordered=True).unionByName(through))
        discard(rest)
    sets_of.release()
    discard(reps)
    out = table.select("doc_id", "n", "node", "row").join(parts, "node", "left")
    # an empty set is a class of its own, named by its row
    out = out.withColumn("class", F.when(F.col("node").isNull(), F.struct(F.lit(True).alias("alone"), F.col("row").alias("name"))).otherwise(F.struct(F.lit(False).alias("alone"), F.coalesce("component", "node").alias("name"))))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    names = keep(out.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first")), "names")
    out = out.join(names, "class")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("first.row")).alias("kept"))


def deepest(percent: int) -> int:
    """Levels of cuts: at a depth under 2 p / (100 - p), sets with no further common shingle link only if one is the path itself."""
    return max(1, min(LEVELS, math.ceil(2 * percent / (100 - percent)) - 1)) if percent < 100 else 1
