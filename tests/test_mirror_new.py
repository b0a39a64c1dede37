"""The mirror engine: zones, files, checks at the write, estimates, index, pages by key, parallel syncs, the relational swap."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config, RangeLayout, Schema, Table, TimeLayout, Unit
from tidemark.operators import estimates, partitions, security
from tidemark.operators.reads import Query, SecureReader
from tidemark.plans import catalogue
from tidemark.plans import sync as syncs
from tidemark.plans.sync import plan, sync
from tidemark.sources import store as stores
from tidemark.sources.store import Store

USER = {"role": "user", "schemas": "shop", "sub": "ana"}
GRANTS = [("shop", "ana", False, True, "school", "1", None), ("shop", "bob", True, True, None, None, None), ("shop", "eve", False, True, "school", "2", None)]


def zone(spark, name):
    """A session of another time zone."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", name)
    other.conf.set("spark.sql.shuffle.partitions", "4")
    return other


def half_hours(spark, n=200, begin=1_710_000_000):
    """Instants around the hour that clocks skip in Los Angeles (2024-03-10 10:00 in UTC)."""
    return spark.range(n).select("id", F.timestamp_seconds(begin + F.col("id") * 1800).alias("at"))


@pytest.mark.parametrize("granularity", ["HOUR", "DAY"])
def test_bounds_hold_in_every_zone(spark, tmp_path, granularity):
    zones = ("UTC", "America/Los_Angeles", "Asia/Kolkata")
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("at", granularity)),))})
    for writer in zones[:2]:
        root = f"file://{tmp_path}/{writer.replace('/', '-')}"
        there = zone(spark, writer)
        assert sync(there, config, root, {"t": half_hours(there)}).first().status == "rebuilt"
        ids = {r.partition_id for r in Store(spark, root).manifest("shop", "t").collect()}
        assert min(ids) == {"HOUR": "2024030916", "DAY": "20240309"}[granularity]
        for reader in zones:
            here = zone(spark, reader)
            rows = half_hours(here)
            assert sync(here, config, root, {"t": rows}).first().status == "unchanged"
            read = SecureReader(Store(here, root), here.createDataFrame(GRANTS, security.GRANTS), USER)
            for where in ([("at", "lt", "2024-03-10 11:00:00Z"), ("at", "gte", "2024-03-10 09:15:00Z")], [("at", "gt", "2024-03-10 01:45:00"), ("at", "lte", "2024-03-10 05:00:00")], [("at", "eq", "2024-03-10 03:00:00")]):
                got = {r.id for r in read.read("shop", "t", Query(where=where)).collect()}
                assert got == {r.id for r in Query(where=where).page(rows).collect()}, (writer, reader, where)


def test_local_times_that_a_zone_skips_stay(spark, tmp_path):
    there = zone(spark, "America/Los_Angeles")
    rows = there.createDataFrame([(1, "2024-03-10 02:30:00"), (2, "2024-03-10 03:30:00"), (3, "2024-03-10 01:30:00")], "id long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("t", "HOUR")),))})
    sync(there, config, f"file://{tmp_path}", {"t": rows})
    store = Store(there, f"file://{tmp_path}")
    assert {r.partition_id: r.lower for r in store.manifest("shop", "t").collect()}["2024031002"] == "2024-03-10 02:00:00"
    assert [r.id for r in store.read("shop", "t", [("t", "eq", "2024-03-10 02:30:00")]).collect()] == [1]


def test_tables_without_a_clock_are_not_pruned_by_instants(spark, tmp_path):
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("at", "DAY")),))})
    sync(spark, config, f"file://{tmp_path}", {"t": half_hours(spark, 100)})
    store = Store(spark, f"file://{tmp_path}")
    columns = store.read("shop", "t").schema
    kept = lambda clock: store.manifest("shop", "t").filter(stores.may_hold(columns, [("at", "lt", "2024-03-10 00:00:00Z")], clock)).count()
    assert kept("UTC") == 1 and kept(None) == 3


# files -------------------------------------------------------------------------

DAYS = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY")), Table("w", "w")))})


def days(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long").withColumn("day", F.when(F.col("id") % 7 != 6, F.timestamp_seconds(1_704_067_200 + (F.col("id") % 5) * 86400).cast("timestamp_ntz")))


def opened(monkeypatch):
    """The lists of files that syncs opened for their content; None stands for all."""
    seen = []
    real = partitions.file_entries
    monkeypatch.setattr(syncs, "file_entries", lambda df, layout, files=None, split=(): seen.append(files) or real(df, layout, files, split))
    return seen


def test_only_new_files_are_opened(spark, tmp_path, monkeypatch):
    seen, root, src = opened(monkeypatch), f"file://{tmp_path}/store", f"{tmp_path}/src x%20"
    given = {"t": src, "w": src}
    statuses = lambda: [r.status for r in sync(spark, DAYS, root, given).collect()]
    for k in range(3):
        days(spark, range(k * 20, k * 20 + 20)).coalesce(1).write.mode("append").parquet(src)
    assert statuses() == ["rebuilt", "replaced"] and seen == [None, None]
    assert statuses() == ["unchanged", "unchanged"] and len(seen) == 2 and plan(spark, DAYS, root, given).count() == 0
    days(spark, [100]).coalesce(1).write.mode("append").parquet(src)
    assert {(r.table, r.changed) for r in plan(spark, DAYS, root, given).collect()} == {("t", 1), ("w", 1)}
    assert statuses() == ["refreshed", "replaced"] and [len(f) for f in seen[2:]] == [1] * 4
    store = Store(spark, root)
    fresh = f"file://{tmp_path}/fresh"
    sync(spark, DAYS, fresh, {n: spark.read.parquet(src) for n in given})  # by a scan of all columns
    for name in given:
        assert sorted(store.read("shop", name).collect()) == sorted(Store(spark, fresh).read("shop", name).collect())
        assert sorted((r.partition_id, r.signature) for r in store.manifest("shop", name).collect()) == sorted((r.partition_id, r.signature) for r in Store(spark, fresh).manifest("shop", name).collect())
    rows = spark.read.parquet(src).collect()
    spark.createDataFrame(rows, "id long, day timestamp_ntz").repartition(2).write.parquet(f"{src}2")
    given |= {"t": f"{src}2", "w": f"{src}2"}  # the same rows in other files
    before = store.current("shop", "t")
    assert statuses() == ["unchanged", "unchanged"] and store.current("shop", "t")["version"] == before["version"] and store.current("shop", "t")["files"] != before["files"]
    count = len(seen)
    assert statuses() == ["unchanged", "unchanged"] and len(seen) == count
    store.vacuum("shop", "t", keep_versions=1, grace_ms=0)
    assert statuses() == ["unchanged", "unchanged"] and len(seen) == count


def test_a_refresh_reads_the_files_that_hold_its_partitions(spark, tmp_path, monkeypatch):
    root, src, read = f"file://{tmp_path}/store", f"{tmp_path}/src", []
    for d in range(5):
        days(spark, range(100)).filter(F.col("id") % 5 == d).coalesce(1).write.mode("append").parquet(src)
    config, real = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY")),))}), syncs.holding
    monkeypatch.setattr(syncs, "holding", lambda *a: read.append((df := real(*a)).select("_metadata.file_path").distinct().count()) or df)
    sync(spark, config, root, {"t": src})
    days(spark, [502]).coalesce(1).write.mode("append").parquet(src)
    assert sync(spark, config, root, {"t": src}).first().changed == 1 and read == [5, 2]
    assert sorted(r.id for r in Store(spark, root).read("shop", "t").collect()) == sorted(r.id for r in spark.read.parquet(src).filter("day IS NOT NULL").collect())


def test_unmoved_files_are_found_without_a_data_column(spark, tmp_path):
    src = f"{tmp_path}/src"
    days(spark, range(50)).write.parquet(src)
    text = partitions.file_states(spark.read.parquet(src))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in text


def test_frames_and_views_are_scanned(spark, tmp_path, monkeypatch):
    seen, root, src = opened(monkeypatch), f"file://{tmp_path}/store", f"{tmp_path}/src"
    days(spark, range(20)).write.parquet(src)
    spark.read.parquet(src).createOrReplaceTempView("some_days")
    config = Config({"shop": Schema((Table("t", "some_days", TimeLayout("day", "DAY")),))})
    assert sync(spark, config, root).first().status == "rebuilt"
    spark.read.parquet(src).filter("id > 3").createOrReplaceTempView("some_days")  # like files, other rows
    assert sync(spark, config, root).first().status == "refreshed" and not seen
    assert Store(spark, root).read("shop", "t").filter("id <= 3").count() == 0
    spark.catalog.dropTempView("some_days")


# what was written is what was planned --------------------------------------------


@pytest.mark.parametrize("table", [Table("t", "t", TimeLayout("day", "DAY")), Table("t", "t")])
@pytest.mark.parametrize("tamper", [lambda df: df.filter("id <> 7"), lambda df: df.withColumn("id", F.col("id") + (F.col("id") == 7).cast("long"))])
def test_a_tampered_write_is_not_published(spark, tmp_path, monkeypatch, table, tamper):
    config, root = Config({"shop": Schema((table,))}), f"file://{tmp_path}"
    assert sync(spark, config, root, {"t": days(spark, range(12))}).first().status in ("rebuilt", "replaced")
    real = syncs.observed
    monkeypatch.setattr(syncs, "observed", lambda df: real(tamper(df)))
    result = sync(spark, config, root, {"t": days(spark, range(30))}).first()
    assert result.status == "failed" and "were written" in result.error
    assert Store(spark, root).read("shop", "t").agg(F.max("id")).first()[0] == 11
    monkeypatch.setattr(syncs, "observed", real)
    assert sync(spark, config, root, {"t": days(spark, range(30))}).first().status in ("refreshed", "replaced")


def test_doubtful_counts_are_read_back(spark, tmp_path, monkeypatch):
    """Tasks that ran twice are seen twice; the files decide."""

    class Twice:
        get = {"rows": 24, "content": 5}

    monkeypatch.setattr(syncs, "observed", lambda df: (df, Twice()))
    for name, extra in (("plain", F.lit(1)), ("struct", F.struct(F.lit(1).alias("x")))):
        df = days(spark, range(12)).withColumn("extra", extra)
        for layout in (TimeLayout("day", "DAY"), None):
            config = Config({"shop": Schema((Table("t", "t", layout),))})
            assert sync(spark, config, f"file://{tmp_path}/{name}{layout is None}", {"t": df}).first().status in ("rebuilt", "replaced")


# pieces of partitions ---------------------------------------------------------------


@pytest.mark.parametrize("by_file", [False, True])
def test_one_row_rewrites_one_piece(spark, tmp_path, monkeypatch, by_file):
    monkeypatch.setattr(partitions, "LEAF", 100)
    table = Table("t", "t", RangeLayout("k", 0, 20, 10), split=("id",))
    config, root, turn = Config({"shop": Schema((table,))}), f"file://{tmp_path}/s", iter(range(99))
    store = Store(spark, root)

    def run(df):
        if by_file:
            df.repartition(3).write.parquet(path := f"{tmp_path}/{next(turn)}")
        return sync(spark, config, root, {"t": path if by_file else df}).first()

    def paths():
        return {r.partition_id: r.path for r in store.manifest("shop", "t").collect()}

    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.lit(3)).when(F.col("id") % 20 > 0, F.lit(15)).alias("k"), F.lit("v").alias("v"))
    assert run(df).status == "rebuilt"
    before = paths()
    assert len([p for p in before if p.startswith("0-")]) == 32 and len([p for p in before if p.startswith("10-")]) == 2 and len([p for p in before if p.startswith("__NULL__-")]) == 2
    assert run(df).status == "unchanged"
    changed = df.withColumn("v", F.when(F.col("id") == 1234, "w").otherwise("v"))
    assert (r := run(changed)).status == "refreshed" and (r.new, r.changed, r.removed) == (0, 1, 0)
    after = paths()
    assert [p for p in after if after[p] != before[p]] == [next(p for p in after if after[p] != before[p])] and set(after) == set(before)
    assert sorted(store.read("shop", "t").collect()) == sorted(changed.collect())
    more = changed.union(spark.range(3000, 3040).select("id", F.lit(3), F.lit("v")))
    assert run(more).status == "refreshed" and set(paths()) == set(before)  # a little more leaves the cut
    far = changed.filter("k = 3 AND id < 400 OR k = 15")
    assert run(far).removed > 30 and len([p for p in paths() if p.startswith("0-")]) == 4  # much less cuts anew
    assert sorted(store.read("shop", "t", [("k", "eq", 15)]).filter("k = 15").collect()) == sorted(far.filter("k = 15").collect())
    assert sorted(store.read("shop", "t").collect()) == sorted(far.collect())
    assert by_file or plan(spark, config, root, {"t": far}).count() == 0


def test_newest_partitions_of_split_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(partitions, "LEAF", 5)
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY"), last=2, split=("id",)),))})
    sync(spark, config, f"file://{tmp_path}", {"t": days(spark, range(200))})
    got = Store(spark, f"file://{tmp_path}").read("shop", "t")
    assert {r.id % 5 for r in got.collect()} == {3, 4} and got.count() == days(spark, range(200)).filter("day IS NOT NULL AND id % 5 >= 3").count()
    with pytest.raises(ValueError):
        Table("t", "t", split=("id",))


# estimates -------------------------------------------------------------------------


def pupils(spark, n=40_000):
    return spark.range(0, n, 1, 4).select(
        "id", (F.col("id") % 100).alias("school"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("grade"), (F.rand(5) * F.rand(6) * 100).alias("score"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("name"), F.col("id") % 50)).alias("name"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).alias("at"),
    )


def test_sharp_estimates_are_true_at_any_size(spark, tmp_path):
    """Units of 300 and of 3,000 rows, and one without a name: sketches hold the small ones, rows of the others are counted."""
    table = Table("p", "p", rls=(Unit("school", "school"),), estimate=("grade", "name"))
    rows = spark.range(7000).selectExpr("id", "CASE WHEN id < 300 THEN 'a' WHEN id < 3300 THEN 'b' WHEN id < 6300 THEN 'c' END AS school", "sqrt(id * 37 % 7001) AS grade", "concat('n', id % 5) AS name")
    config, root = Config({"shop": Schema((table,), claim="sub")}), f"file://{tmp_path}"
    assert [r.status for r in sync(spark, config, root, {"p": rows}).collect()] == ["replaced"]
    grants = spark.createDataFrame([("shop", "all", True, True, None, None, {}), *(("shop", "one", False, True, "school", u, {}) for u in "ab")], security.GRANTS)
    for subject in ("all", "one"):
        reader = SecureReader(Store(spark, root), grants, {"role": "user", "schemas": ["shop"], "sub": subject})
        for where in ([("grade", "gt", 20.5), ("grade", "lte", 61.0)], [("grade", "lt", 33.3), ("name", "eq", "n2")], [("school", "eq", "b"), ("grade", "gte", 50.0)], [("school", "in", ["a", "b"])]):
            got = reader.count("shop", "p", Query(where=where, cap=0), exact=False, sharp=True).first()
            assert (got.total, got.exact) == (reader.count("shop", "p", Query(where=where)).first().total, False), (subject, where)


def test_large_units_are_counted_like_the_sql(spark, tmp_path):
    """Some 120,000 customers: more in a unit than its sketch holds."""
    few = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").filter("c_nationkey IS NOT NULL")
    n = 2 + 120_000 // max(1, few.count())
    few.crossJoin(spark.range(n)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * 1_000_000).withColumn("c_acctbal", F.col("c_acctbal") + F.col("id") * 0.37).drop("id").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    got = catalogue.secured_estimate(spark, str(tmp_path)).first()
    reader = catalogue._reader(spark, str(tmp_path), catalogue.USER | {"sub": "s2"}, "customer")
    want = reader.table("shop", "customer").filter("c_acctbal > 2000 AND c_acctbal <= 7000").count()
    assert (got.total, got.exact) == (want, False) and want > 400


def test_estimates_count_visible_rows_only(spark, tmp_path):
    df = pupils(spark).persist()
    table = Table("p", "p", TimeLayout("at", "DAY"), rls=(Unit("school", "school"),), estimate=("grade", "score", "name", "at"))
    sync(spark, Config({"shop": Schema((table,), claim="sub")}), f"file://{tmp_path}", {"p": df})
    grants = spark.createDataFrame(GRANTS, security.GRANTS)
    filters = [
        [("grade", "lt", 300)], [("grade", "gte", 100), ("grade", "lte", 899)], [("score", "gt", 25.5)], [("score", "lt", "3")], [("at", "gte", "2024-01-05 12:00:00"), ("at", "lt", "2024-01-20")],
        [("school", "eq", 1), ("grade", "gt", 500)], [], [("grade", "eq", 5)], [("grade", "in", [5, 6, 7, 7])], [("grade", "gt", 2000)], [("school", "in", [1, 2, 3])],
    ]
    for subject, visible in (("ana", 400), ("bob", 40_000), ("zoe", 0)):
        reader = SecureReader(Store(spark, f"file://{tmp_path}"), grants, USER | {"sub": subject})
        for where in filters if visible else filters[:2]:
            query = Query(where=where, cap=0)
            real = reader.count("shop", "p", query).first()
            got = reader.count("shop", "p", query, exact=False).first()
            assert real.exact and abs(got.total - real.total) <= 2 * estimates.ERROR * visible + 1 and got.total <= visible, (subject, where, got, real)
            assert got.exact == (real.total == 0)
        few = reader.count("shop", "p", Query(where=[("grade", "lt", 300)], cap=40_001), exact=False).first()
        assert few.exact and few.total == reader.count("shop", "p", Query(where=[("grade", "lt", 300)])).first().total
    reader = SecureReader(Store(spark, f"file://{tmp_path}"), grants, USER | {"sub": "bob"})
    named = reader.count("shop", "p", Query(where=[("name", "eq", "name7")], cap=10), exact=False).first()
    assert not named.exact and 0.5 < named.total / df.filter("name = 'name7'").count() < 2
    for where in ([("name", "like", "name1*")], [{"not": ("grade", "lt", 5)}], [("id", "lt", 10_000)], [("grade", "is", None)]):  # no sketch tells: counted
        assert reader.count("shop", "p", Query(where=where, cap=10), exact=False).first() == reader.count("shop", "p", Query(where=where)).first()
    df.unpersist()


def test_sketches_follow_refreshes(spark, tmp_path):
    table = Table("p", "p", RangeLayout("school", 0, 100, 50), rls=(Unit("school", "school"),), estimate=("grade",))
    config, root = Config({"shop": Schema((table, Table("w", "w", estimate=("grade",))), claim="sub")}), f"file://{tmp_path}"
    df = pupils(spark, 5000)
    grants = spark.createDataFrame(GRANTS, security.GRANTS)
    for given in (df, df.filter("school < 50 OR id < 2500"), df.filter("school >= 50")):
        sync(spark, config, root, {"p": given, "w": given})
        reader = SecureReader(Store(spark, root), grants, USER | {"sub": "bob"})
        for name in ("p", "w"):
            assert reader.count("shop", name, Query(cap=5), exact=False).first().total == given.count()
    store = Store(spark, root)
    store.vacuum("shop", "p", keep_versions=1, grace_ms=0)
    assert SecureReader(store, grants, USER | {"sub": "bob"}).count(None, "p", Query(cap=5), exact=False).first().total == df.filter("school >= 50").count()


# index -------------------------------------------------------------------------------


def scanned(df):
    """Rows that the scans of a frame gave on, as measured."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            plans.append(p.executedPlan())
        if "Scan" in p.nodeName():
            total += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


def test_point_reads_open_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "ROW_GROUP", 1 << 20)
    df = spark.range(400_000).select((F.xxhash64("id")).alias("key"), F.col("id").alias("v")).coalesce(2)
    key = df.filter("v = 123456").first().key
    read = {}
    for name, index in (("with", ("key",)), ("without", ())):
        config = Config({"shop": Schema((Table("t", "t", index=index),))})
        sync(spark, config, f"file://{tmp_path}/{name}", {"t": df})
        found = SecureReader(Store(spark, f"file://{tmp_path}/{name}"), spark.createDataFrame(GRANTS, security.GRANTS), USER).read("shop", "t", Query(where=[("key", "eq", key)]))
        assert [r.v for r in found.collect()] == [123456]
        read[name] = scanned(found)
    assert read["with"] * 4 < read["without"], read


# the audit --------------------------------------------------------------------------------


@pytest.mark.parametrize("units", [("a",), ("a", "b"), ("a", "b", "c"), ("a", "a"), ()])
def test_audit_of_many_units_against_reads(spark, units):
    rng = random.Random(len(units))
    df = spark.createDataFrame([(i, rng.choice([None, *range(8)]), rng.choice([None, *"xyz"]), rng.randrange(4)) for i in range(600)], "id long, a int, b string, c int")
    rows = []
    for s in range(25):
        for _ in range(rng.randrange(0, 6)):
            kind = rng.choice(["a", "b", "c", "other"])
            rows.append(("shop", f"s{s}", rng.random() < 0.03, rng.random() < 0.85, kind, rng.choice("xyz") if kind == "b" else str(rng.randrange(8)) if rng.random() < 0.9 else None, None))
    grants = spark.createDataFrame(rows + rows[:10], security.GRANTS)
    own = tuple(Unit(u, u) for u in units)
    table = df.collect()
    want = {}
    for subject in {r[1] for r in rows if r[3]}:
        mine = [r for r in rows if r[1] == subject and r[3]]
        admin, held = any(r[2] for r in mine), {(r[4], r[5]) for r in mine}
        want[subject] = (admin, len(table) if admin else sum(any((u, str(r[u])) in held and r[u] is not None for u in units) for r in table))
    found = security.audit(df, "shop", own, grants)
    assert {r.subject: (r.is_admin, r.visible_rows) for r in found.collect()} == want


def test_audit_shuffles_no_pair_of_subject_and_combination(spark):
    """Nothing is grouped by the subject and all units at once."""
    df = spark.range(100).select("id", F.col("id").alias("a"), F.col("id").alias("b"))
    text = security.audit(df, "shop", (Unit("a", "a"), Unit("b", "b")), spark.createDataFrame(GRANTS, security.GRANTS))._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in text.splitlines() if "Aggregate [subject" in line]
    assert keys and not any("u0" in k.split("]")[0] and "u1" in k.split("]")[0] for k in keys)


# pages by key ---------------------------------------------------------------------------


@pytest.mark.parametrize("order", [(("a", "asc"), ("id", "asc")), (("a", "desc"), ("id", "asc")), (("a", "desc"), ("b", "asc"), ("id", "desc"))])
def test_pages_by_key_are_pages_by_offset(spark, order):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(60)], "id long, a int, b string")
    want = [tuple(r) for r in Query(order=order).page(df).collect()]
    got, after = [], ()
    while page := Query(order=order, after=after, limit=7).page(df).collect():
        got += [tuple(r) for r in page]
        after = tuple(page[-1][c] for c, _ in order)
    assert got == want
    with pytest.raises(ValueError):
        Query(order=order, after=(1,)).page(df)


def test_pages_by_key_open_few_partitions(spark, tmp_path):
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY")),))})
    sync(spark, config, f"file://{tmp_path}", {"t": days(spark, range(50))})
    reader = SecureReader(Store(spark, f"file://{tmp_path}"), spark.createDataFrame(GRANTS, security.GRANTS), USER)
    page = reader.read("shop", "t", Query(order=(("day", "asc"), ("id", "asc")), after=("2024-01-05 00:00:00", 4)))
    assert len({f.rsplit("/", 2)[1] for f in page.inputFiles()}) == 1 and {r.id % 5 for r in page.collect()} == {4} and 4 not in {r.id for r in page.collect()}


# syncs side by side -----------------------------------------------------------------------


def test_tables_are_synced_side_by_side(spark, tmp_path, monkeypatch):
    real, now, most = syncs.sync_table, [], []

    def slow(store, table, *more):
        now.append(table.name)
        most.append(len(now))
        time.sleep(1.5)
        now.remove(table.name)
        if table.name == "t2":
            raise RuntimeError("lost")
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == f"shop.{table.name}"
        return real(store, table, *more)

    monkeypatch.setattr(syncs, "sync_table", slow)
    config = Config({"shop": Schema(tuple(Table(f"t{i}", f"t{i}") for i in range(4)))})
    given = {f"t{i}": spark.range(i + 1) for i in range(4)}
    result = sync(spark, config, f"file://{tmp_path}", given, workers=3).collect()
    assert [(r.table, r.status) for r in result] == [("t0", "replaced"), ("t1", "replaced"), ("t2", "failed"), ("t3", "replaced")]
    assert max(most) == 3 and threading.active_count() < 50
    assert [Store(spark, f"file://{tmp_path}").read("shop", f"t{i}").count() for i in (0, 1, 3)] == [1, 2, 4]
    assert sync(spark, Config(), f"file://{tmp_path}/none").count() == 0


# the relational swap ------------------------------------------------------------------------


def test_a_failed_copy_leaves_the_old_table(spark, tmp_path):
    url, driver = f"jdbc:derby:memory:swap{tmp_path.name};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    config, root = Config({"shop": Schema((Table("t", "t"),))}), f"file://{tmp_path}"
    store = Store(spark, root)
    rows = lambda: sorted(r[0] for r in spark.read.jdbc(url, "ids", properties=driver).collect())
    copy = lambda **how: store.to_jdbc("shop", "t", url, "ids", driver, rename="RENAME TABLE {} TO {}", **how)
    for n in (3, 5):
        sync(spark, config, root, {"t": spark.range(n)})
        copy()
        assert rows() == list(range(n))
    sync(spark, config, root, {"t": spark.range(9).withColumn("bad", F.array(F.lit(1)))})  # a type the database lacks
    with pytest.raises(Exception):
        copy()
    assert rows() == list(range(5))
    sync(spark, config, root, {"t": spark.range(7)})
    with pytest.raises(Exception):
        store.to_jdbc("shop", "t", url, "ids", driver, rename="RENAME NOTHING {} {}")  # fails in the swap
    assert rows() == list(range(5))
    copy(tasks=2)
    assert rows() == list(range(7))


@pytest.mark.parametrize("layout", [None, TimeLayout("day", "DAY")])
def test_empty_sources_and_odd_columns_are_written(spark, tmp_path, layout):
    """What is observed at the write comes back also where nothing is written."""
    config = Config({"shop": Schema((Table("t", "t", layout),))})
    kind = "id long, day timestamp_ntz, a array<struct<x:int>>, `odd name` string, rows int, content string"
    none = spark.createDataFrame([], kind)
    for k, df in enumerate((none, spark.createDataFrame([(1, None, None, "x", 1, "c")], kind), none.union(none).filter("id > 1"))):
        root = f"file://{tmp_path}/{k}"
        assert sync(spark, config, root, {"t": df}).first().status in ("replaced", "rebuilt")
        assert Store(spark, root).read("shop", "t").count() == (0 if layout else df.count())
        df.write.parquet(f"{tmp_path}/src{k}")
        assert sync(spark, config, f"{root}-files", {"t": f"{tmp_path}/src{k}"}).first().status in ("replaced", "rebuilt")
        assert sync(spark, config, f"{root}-files", {"t": f"{tmp_path}/src{k}"}).first().status == "unchanged"
