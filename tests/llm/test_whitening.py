"""Whitening against numpy, and its edge cases."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def check(frame, vectors, k):
    """The rows of ``frame`` are those of numpy for ``vectors`` {id: entries}."""
    ids = sorted(vectors)
    x = np.array([[int(np.floor(float(np.float32(c)) * 64)) + 1_000_000 for c in vectors[i]] for i in ids], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    e, a = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    order = order[e[order] > e.max() * whitening.NO_VARIANCE]
    want = (x * n - s).astype(float) / n @ a[:, order] / np.sqrt(e[order])
    got = frame.toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(ids) * len(order) and set(got.n) == {n}
    found = got.whitened.to_numpy().reshape(len(ids), -1)
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-8
    assert list(got.deviation.astype(int)) == [d for d in ((x * n - s) ** 2).sum(axis=1) for _ in order]
    assert np.abs(got.explained.to_numpy().reshape(len(ids), -1) - e[order] / e.sum()).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-6


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries.QUERIES["op13_block_whitening"](spark, SF), {r.vec_id: r.embedding for r in rows}, 16)


def test_many_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 35)  # blocks of 7 rows
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 5)) * [3, 2, 1, 0.5, 0.3]
    vectors = {i: base[i % 40 if i < 60 else 0].astype(np.float32).tolist() for i in range(120)}  # half are copies of one
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA).repartition(5)
    check(whitening.whiten(df, components=4), vectors, 4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [1.0, 2.0], 2: [2.0, -1.0], 3: [0.5, 0.25], 4: [1.0, 2.0]}
    bad = [(5, None, 1), (6, [], 1), (7, [1.0, None], None), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1e30, 0.0], 1), (11, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good.items()] + bad, SCHEMA).withColumns({"n": F.lit("mine"), "index": F.lit(3), "x": F.lit("x"), "row": F.lit(0)})
    check(whitening.whiten(df), good, 16)
    twice = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [2.0, 0.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], SCHEMA)
    out = whitening.whiten(twice).collect()
    assert sorted((r.vec_id is None, r.component, r.n) for r in out) == [(False, 1, 2)] * 2 + [(True, 1, 2)] * 2
    assert {round(abs(r.whitened), 9) for r in out} == {1.0} and {r.deviation for r in out} == {64**2 + 128**2}


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for df in (same, same.filter("vec_id < 0"), same.withColumn("embedding", F.lit(None).cast("array<float>"))):
        out = whitening.whiten(df)
        assert out.columns == columns and out.count() == 0
    flat = spark.createDataFrame([(i, [float(i), 1.0, float(i)], 1) for i in range(9)], SCHEMA)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    huge = spark.createDataFrame([(1, [float(1 << 45)], 1), (2, [0.0], 1)], SCHEMA)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
