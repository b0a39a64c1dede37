"""Embedding near-dedup by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._graph import components
from tidemark.llm._shared import keep, passing, ready

LEAF = 128
SLACK = 1e-6
SAMPLE = 1024
DENSE = 4
SHARE = 8
PIECE = 8192
LEVELS = 12


def spread(dot: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors by their products."""
    return np.sqrt(np.maximum(0, 2 - 2 * dot))


def reach(cosine: float) -> float:
    """Distance within which vectors link, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK


def net(x: np.ndarray, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (places in ``points``) more than ``radius`` apart that cover all points, and each point's centre and distance.

    The first point is a centre; 64 points not covered yet are looked at together.
    """
    owner, distance = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    left, centres = np.arange(len(points)), np.zeros(0, dtype=np.int64)
    while len(left):
        some = x[points[left[:64]]]
        near = spread(some @ some.T) <= radius
        chosen: list[int] = []
        for i in range(len(some)):
            if not near[i, chosen].any():
                chosen.append(i)
        d = spread(x[points[left]] @ some[chosen].T)
        d[chosen, np.arange(len(chosen))] = 0.0
        closest = d.argmin(axis=1)
        apart = d[np.arange(len(left)), closest]
        covered = apart <= radius
        owner[left[covered]], distance[left[covered]] = closest[covered] + len(centres), apart[covered]
        centres, left = np.r_[centres, left[chosen]], left[~covered]
    return centres, owner, distance


class Tree:
    """A node of a cover tree: children's centres are more than half its radius apart and cover it within that half.

    A node's centre is a centre among its children too, so levels are nested. ``points`` of a
    node are its rows, ``radius`` covers them from its centre exactly. Nodes of few rows, or so
    narrow that all their rows link, have no children.
    """

    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: int, radius: float, narrow: float):
        self.points, self.centre, self.radius, self.children = points, centre, radius, []
        if len(points) <= LEAF or radius <= max(narrow, SLACK):
            return
        points = np.r_[centre, points[points != centre]]
        centres, owner, distance = net(x, points, radius / 2)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
        for c, rows in zip(centres, np.split(order, ends[:-1]), strict=True):
            self.children.append(Tree(x, points[rows], int(points[c]), float(distance[rows].max()), narrow))


def grow(x: np.ndarray, cosine: float) -> Tree:
    return Tree(x, np.arange(len(x)), 0, float(spread(x @ x[0]).max()), reach(cosine) / 2)


def dual(a: Tree, b: Tree, xa: np.ndarray, xb: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of a, j of b) of pairs at the cosine or above; nodes farther apart than their radii and the limit are passed over.

    Children of two nodes meet in products of their centres; what is left of leaves is compared
    in blocks of rows, a block with the leaves that any of its own are near.
    """
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        ps, qs = p.children or [p], q.children or [q]
        centres, wide = xb[[d.centre for d in qs]], np.array([d.radius for d in qs]) + reach(cosine)
        flat = np.array([not d.children for d in qs])
        start = 0
        while start < len(ps):
            end, rows = start + 1, len(ps[start].points)
            while end < len(ps) and end - start < 1024 and rows + len(ps[end].points) <= 1024:
                rows += len(ps[end].points)
                end += 1
            some, start = ps[start:end], end
            near = spread(xa[[c.centre for c in some]] @ centres.T) <= np.array([c.radius for c in some])[:, None] + wide
            low = np.array([not c.children for c in some])
            todo += [(some[i], qs[j]) for i, j in zip(*np.nonzero(near & ~(low[:, None] & flat)), strict=True)]
            met = np.flatnonzero((near[low] & flat).any(axis=0))
            if not len(met):
                continue
            one, two = (np.concatenate(v) for v in ([c.points for c in some if not c.children], [qs[j].points for j in met]))
            for s in range(0, len(one), 1024):
                for t in range(0, len(two), 1024):
                    i, j = np.nonzero(xa[one[s : s + 1024]] @ xb[two[t : t + 1024]].T >= cosine)
                    if len(i):
                        yield one[s + i], two[t + j]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of linked rows: smallest label by hooking and jumping."""
    while True:
        li, lj = label[i], label[j]
        differ = li != lj
        if not differ.any():
            return
        i, j = i[differ], j[differ]
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        np.minimum.at(label, high, low)
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def links(left: pd.DataFrame, right: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """(node, n, root) of the rows of one pair of cells: vectors linked to each, copies counted, and the least row reached by them."""
    xa = np.stack(left["unit"].to_numpy())
    if right is None:
        nodes, copies, xb, shift = left["node"].to_numpy(), left["copies"].to_numpy(), xa, 0
    else:
        xb, shift = np.stack(right["unit"].to_numpy()), len(left)
        nodes, copies = (np.r_[left[c].to_numpy(), right[c].to_numpy()] for c in ("node", "copies"))
    count, label = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    tree = grow(xa, cosine)
    for i, j in dual(tree, tree if right is None else grow(xb, cosine), xa, xb, cosine):
        if right is None:
            i, j = i[i != j], j[i != j]
            np.add.at(count, i, copies[j])
        else:
            np.add.at(count, i, copies[j + shift])
            np.add.at(count, j + shift, copies[i])
        _merge(label, i, j + shift)
    hit = count > 0
    return pd.DataFrame({"node": nodes[hit], "n": count[hit], "root": nodes[label[hit]]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, cell_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of vectors with one label whose cosine is ``cosine`` or more, exactly and in double precision.

    Equal vectors are one row with a count. The rows of a label are the root of a cover tree,
    whose upper levels Spark grows. Of each node above ``cell_rows`` a sample of ``SAMPLE`` rows,
    by hash, gives centres more than half the node's radius apart; those with ``DENSE`` sampled
    rows about them become children, which take all rows within that half, so radii halve level
    by level. Rows that no centre covers are a node that is sampled again, known to lie more
    than half the radius from each of its siblings. The traversal goes down the same levels, a pair of nodes at
    a time: from the root's pair with itself, children of a pair that their covering radii
    cannot rule out go on. What has no dense parts of an eighth of it together, or is so narrow that all of it links, is cut
    by hash into pieces of ``cell_rows``. Pairs of cells left at the bottom are dealt to tasks
    by their rows, which grow the lower levels and traverse them together; no task holds more
    than a few pairs. The sample decides the shape of the tree and no link.

    Returns one row per input row: id, n_links, component_id, kept. Rows with a null label,
    null, empty, zero or non-finite vectors link with nothing, nor do vectors of other
    lengths. Equal ids are separate rows; a null id never names a component, and if a
    component has no other, component_id and kept are null. Other columns are ignored.
    """
    ready(vectors.sparkSession)
    x = F.col("unit")
    table = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("unit"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    largest = F.array_max(F.transform(x, F.abs))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("unit") > 0) & finite & (largest > 0), F.lit(False))
    table = table.withColumn("unit", F.when(good, _divided(x, largest)))
    table = table.withColumn("unit", _divided(x, norm)).withColumn("row", F.monotonically_increasing_id())
    table = table.withColumn("group", F.when(x.isNotNull(), F.concat_ws(":", F.col("label").cast("string"), F.size("unit"))))
    table = keep(table.select("vec_id", "row", "unit", "group", F.xxhash64("unit").alias("one"), F.hash("unit").alias("two")), "vectors")
    same = ["group", "one", "two"]
    firsts = table.filter("unit IS NOT NULL").groupBy(*same).agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    firsts = keep(firsts, "vector-copies")
    rows = table.select("row", "unit", "group").join(firsts.select(F.col("node").alias("row"), "copies"), "row").withColumnRenamed("row", "node")
    with passing(vectors.sparkSession):
        cells, levels, pieces = _cells(rows, cell_rows, cosine)
        found = keep(_joined(cells, _descend(rows, levels, pieces, cosine), cosine, cell_rows), "links", stay=True)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    firsts = firsts.join(counts, "node", "left").join(parts, "node", "left")
    firsts = keep(firsts.select(*same, F.coalesce("component", "node").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    out = table.select("vec_id", "row", *same).join(firsts, same, "left").withColumn("c", F.coalesce("c", "row"))
    names = keep(out.groupBy("c").agg(F.min("vec_id").alias("component_id")), "vector-names")
    out = out.join(names, "c")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _divided(x: Column, by: Column) -> Column:
    """Each component divided; ``by`` is bound to a variable of its own, or it would be worked out again for every component."""
    return F.transform(F.array(by), lambda d: F.transform(x, lambda v: v / d)).getItem(0)


def _table(columns: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


VECTOR = pa.list_(pa.float64())
CENTRES = pa.schema([("cell", pa.string()), ("pick", pa.int32()), ("centre", VECTOR)])
PLACED = pa.schema([("node", pa.int64()), ("unit", VECTOR), ("copies", pa.int64()), ("parent", pa.string()), ("pick", pa.int32()), ("distance", pa.float64())])
PAIRS = pa.schema([("a", pa.string()), ("b", pa.string())])


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _centres(table: pa.Table) -> pa.Table:
    """Dense centres of one cell's sample; the cell's own centre, where it has one, comes first.

    None if they cover less than a ``SHARE``-th: cutting these off would leave most pairs and cost a level.
    """
    own = table["own"][0].as_py()
    x = _rows(table["unit"])
    x = x if own is None else np.r_[np.array(own)[None], x]
    centres, owner, _ = net(x, np.arange(len(x)), table["radius"][0].as_py() / 2)
    sizes = np.bincount(owner, minlength=len(centres))
    dense = centres[sizes >= DENSE]
    if sizes[sizes >= DENSE].sum() * SHARE < len(x):
        dense = dense[:0]
    return _table({"cell": [table["cell"][0].as_py()] * len(dense), "pick": np.arange(len(dense)), "centre": list(x[dense])}, CENTRES)


def _placed(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Rows of one part of a cell with the nearest centre within half its radius, if there is one."""
    if not len(rows):
        return PLACED.empty_table()
    d = spread(_rows(rows["unit"]) @ _rows(centres["centre"]).T)
    closest = d.argmin(axis=1)
    apart = d[np.arange(len(d)), closest]
    far = apart > rows["radius"][0].as_py() / 2
    return pa.table([rows["node"], rows["unit"].cast(VECTOR), rows["copies"], rows["cell"], pa.array(centres["pick"].to_numpy()[closest], pa.int32(), mask=far), pa.array(apart, pa.float64(), mask=far)], schema=PLACED)


def _cells(rows: DataFrame, cell_rows: int, cosine: float, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Rows (node, unit, copies) with their ``cell``; the levels of the tree above (parent, cell, centre, radius, gap); pieces (parent, cell) of what is cut by hash.

    ``gap`` of the rows that no centre covers is what they lie from each of their siblings' centres at least.
    """
    now = rows.select("node", "unit", "copies", F.col("group").alias("cell"))
    none, zero = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    # unit vectors are within 2 of each other
    bounds = now.select("cell").distinct().select("cell", none.alias("own"), F.lit(2.0).alias("radius"))
    grown: list[DataFrame] = []
    for level in range(levels):
        # of new cells only: what had no dense part is not tried again
        large = now.groupBy("cell").count().filter(F.col("count") > cell_rows)
        large = keep(large.join(bounds, "cell").filter(F.col("radius") > reach(cosine) / 2), "large-cells")
        if not large.take(1):
            break
        cut = now.join(large, "cell")
        sample = cut.filter(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 40)) / float(1 << 40) * F.col("count") < SAMPLE)
        centres = keep(sample.select("cell", "unit", "own", "radius").groupBy("cell").applyInArrow(_centres, "cell string, pick int, centre array<double>"), "centres")
        if not centres.take(1):
            break
        dense = keep(large.join(centres.select("cell").distinct(), "cell"), "dense-cells")
        parts = F.ceil(F.col("count") / PIECE)
        one = now.join(dense, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(-1)), parts)).select("cell", "part", "node", "unit", "copies", "radius")
        two = centres.join(dense.select("cell", parts.alias("parts")), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "pick", "centre")
        placed = one.groupBy("cell", "part").cogroup(two.groupBy("cell", "part")).applyInArrow(_placed, "node long, unit array<double>, copies long, parent string, pick int, distance double")
        placed = placed.withColumn("cell", F.concat_ws("/", "parent", F.coalesce(F.col("pick").cast("string"), F.lit("rest"))))
        placed = keep(placed, f"placed-{level}")
        radius = placed.groupBy("parent", "cell", "pick").agg(F.max("distance").alias("covered"))
        radius = radius.join(centres.withColumnRenamed("cell", "parent"), ["parent", "pick"], "left").join(dense.withColumnRenamed("cell", "parent"), "parent")
        rest = F.col("pick").isNull()
        # what is left keeps its parent's bounds
        level_bounds = radius.select("parent", "cell", F.when(rest, F.col("own")).otherwise(F.col("centre")).alias("centre"), F.when(rest, F.col("radius")).otherwise(F.col("covered")).alias("radius"), F.when(rest, F.col("radius") / 2).alias("gap"))
        grown.append(keep(level_bounds, "bounds"))
        bounds = grown[-1].select("cell", F.col("centre").alias("own"), "radius")
        now = now.join(dense.select("cell"), "cell", "left_anti").select("node", "unit", "copies", "cell").unionByName(placed.select("node", "unit", "copies", "cell"))
    large = keep(now.groupBy("cell").count().filter(F.col("count") > cell_rows), "large-cells")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / cell_rows))
    cut = now.join(large, "cell", "left").select("node", "unit", "copies", F.when(F.col("count").isNotNull(), F.col("cell")).alias("parent"), F.concat_ws("#", "cell", salt.cast("string")).alias("cell"))
    cut = keep(cut, "cells")
    return cut.select("node", "unit", "copies", "cell"), grown, cut.filter("parent IS NOT NULL").select("parent", "cell").distinct()


def _descend(rows: DataFrame, levels: list[DataFrame], pieces: DataFrame, cosine: float) -> DataFrame:
    """Pairs of cells (a <= b) that the triangle inequality leaves at every level from the root down."""
    limit = reach(cosine)

    def meet(table: pa.Table) -> pa.Table:
        a, b, side = table["a"][0].as_py(), table["b"][0].as_py(), table["side"].to_numpy()
        cells, centres, radii, gaps = (table[c].to_pylist() for c in ("cell", "centre", "radius", "gap"))
        one = np.flatnonzero(side == 0)
        two = one if a == b else np.flatnonzero(side == 1)
        known = np.array([c is not None for c in centres])
        width = next((len(c) for c in centres if c is not None), 1)
        x = np.array([c if c is not None else [0.0] * width for c in centres])
        r = np.array([v if v is not None else np.inf for v in radii])
        near = spread(x[one] @ x[two].T) <= r[one][:, None] + r[two] + limit
        near |= ~(known[one][:, None] & known[two])
        if a == b:
            gap = np.array([v if v is not None else -np.inf for v in gaps])[one]
            off = ~np.eye(len(one), dtype=bool)
            near &= ~(off & (gap[:, None] > r[one] + limit)) & ~(off & (gap > r[one][:, None] + limit))
            near = np.triu(near)
        i, j = np.nonzero(near)
        both = [sorted((cells[one[p]], cells[two[q]])) for p, q in zip(i, j, strict=True)]
        return _table({"a": [p for p, _ in both], "b": [q for _, q in both]}, PAIRS)

    none, zero = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    now = rows.select(F.col("group").alias("cell")).distinct().select("cell", none.alias("centre"), zero.alias("radius"))
    pairs = now.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for level in levels:
        cut = level.select(F.col("parent").alias("cell")).distinct()
        whole = now.join(cut, "cell", "left_anti")
        kids = level.unionByName(whole.select(F.col("cell").alias("parent"), "cell", "centre", "radius", zero.alias("gap")))
        marked = pairs.join(cut.select(F.col("cell").alias("a"), F.lit(1).alias("cut_a")), "a", "left").join(cut.select(F.col("cell").alias("b"), F.lit(1).alias("cut_b")), "b", "left")
        marked = keep(marked.select("a", "b", F.expr("cut_a IS NOT NULL OR cut_b IS NOT NULL").alias("open")), "marked-pairs")
        opened, named = marked.filter("open").select("a", "b"), ("a", "b", "side", "cell", "centre", "radius", "gap")
        left = opened.join(kids.withColumnRenamed("parent", "a"), "a").withColumn("side", F.lit(0)).select(*named)
        right = opened.filter("a <> b").join(kids.withColumnRenamed("parent", "b"), "b").withColumn("side", F.lit(1)).select(*named)
        met = left.unionByName(right).groupBy("a", "b").applyInArrow(meet, "a string, b string")
        pairs = keep(marked.filter("NOT open").select("a", "b").unionByName(met), "cell-pairs")
        now = keep(kids.select("cell", "centre", "radius"), "frontier")
    one, two = (pieces.select(F.col("parent").alias(c), F.col("cell").alias(f"k{c}")) for c in "ab")
    both = pairs.join(one, "a", "left").join(two, "b", "left").withColumns({"ka": F.coalesce("ka", "a"), "kb": F.coalesce("kb", "b")})
    both = both.filter("a <> b OR ka <= kb")
    return keep(both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")), "cell-pairs")


def _joined(cells: DataFrame, pairs: DataFrame, cosine: float, cell_rows: int) -> DataFrame:
    """Links of every pair of cells; pairs share tasks by hash, so that each task has about two cells' rows."""
    sizes = cells.groupBy("cell").count()
    rows = pairs.select(F.col("a").alias("cell")).unionByName(pairs.filter("a <> b").select(F.col("b").alias("cell"))).join(sizes, "cell").agg(F.sum("count")).first()[0]
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("a", "b"), F.lit(max(1, (rows or 0) // (2 * cell_rows)))))
    columns = ("task", "a", "b", "side", "node", "unit", "copies")
    left = cells.withColumnRenamed("cell", "a").join(pairs, "a").withColumn("side", F.lit(0))
    right = cells.withColumnRenamed("cell", "b").join(pairs.filter("a <> b"), "b").withColumn("side", F.lit(1))
    both = left.select(*columns).unionByName(right.select(*columns))

    def work(table: pa.Table) -> pa.Table:
        done = []
        for (a, b), frame in table.to_pandas().groupby(["a", "b"], sort=False):
            second = None if a == b else frame[frame["side"] == 1]
            done.append(links(frame[frame["side"] == 0], second, cosine))
        return pa.Table.from_pandas(pd.concat(done), preserve_index=False).cast(pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return both.groupBy("task").applyInArrow(work, "node long, n long, root long")
