"""The mirror engine on tiny tables: rules, edge cases and invariants."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Config, RangeLayout, Schema, Table, TimeLayout, Unit
from tidemark.functions.expressions import flatten_claims, in_comma_list, struct_columns, structs_to_json
from tidemark.operators import changes, grants, partitions, security, selections
from tidemark.operators.reads import Query, SecureReader, catalog, condition
from tidemark.plans.sync import plan, sync
from tidemark.ship import ship
from tidemark.sources.store import StalePlan, Store


def days(spark, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, day string").withColumn("day", F.col("day").cast("timestamp_ntz"))


EVENTS = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY")),))})
USER = {"role": "user", "schemas": "shop,lab", "sub": "ana"}


@pytest.mark.parametrize(
    ("granularity", "pid", "lower", "upper"),
    [
        ("HOUR", "2025010123", "2025-01-01 23:00:00", "2025-01-02 00:00:00"), ("DAY", "20240228", "2024-02-28 00:00:00", "2024-02-29 00:00:00"),
        ("MONTH", "202512", "2025-12-01 00:00:00", "2026-01-01 00:00:00"), ("YEAR", "2025", "2025-01-01 00:00:00", "2026-01-01 00:00:00"),
    ],
)
def test_time_bounds(spark, granularity, pid, lower, upper):
    row = partitions.with_bounds(spark.createDataFrame([(pid,)], "partition_id string"), TimeLayout("d", granularity)).first()
    assert (row.lower, row.upper, row.kind) == (lower, upper, "time")


def test_unusable_ids_are_named(spark):
    layout = TimeLayout("d", "DAY")
    rows = [("20250230", "1"), ("bad", "1"), ("2025", "1"), ("20250101", "1"), ("20250102", None), ("__UNPARTITIONED__", "1"), (None, "1")]
    found = partitions.violations(partitions.with_bounds(spark.createDataFrame(rows, "partition_id string, modified string"), layout), layout)
    assert {r.partition_id for r in found.collect()} == {"20250230", "bad", "2025", "20250102", "__UNPARTITIONED__", None}
    layout = RangeLayout("k", 0, 25, 10)
    rows = [("0", "1"), ("20", "1"), ("5", "1"), ("30", "1"), ("x", "1"), ("__NULL__", "1")]
    found = partitions.violations(spark.createDataFrame(rows, "partition_id string, modified string"), layout)
    assert {r.partition_id for r in found.collect()} == {"5", "30", "x"}


def test_range_buckets(spark):
    layout = RangeLayout("k", 0, 25, 10)
    df = spark.createDataFrame([(k,) for k in (None, -1, 0, 9, 10, 24, 25)], "k long").withColumn("partition_id", partitions.partition_id(layout))
    assert [r.partition_id for r in df.collect()] == ["__NULL__", "__NULL__", "0", "0", "10", "20", "__NULL__"]
    bounds = {r.partition_id: (r.kind, r.lower, r.upper) for r in partitions.with_bounds(df.select("partition_id").distinct(), layout).collect()}
    assert bounds["20"] == ("range", "20", "25") and bounds["__NULL__"] == ("remainder", "0", "25")
    assert [r.partition_id for r in partitions.in_order(df.select("partition_id").distinct()).collect()] == ["0", "10", "20", "__NULL__"]


@pytest.mark.parametrize(
    "bad",
    [
        lambda: TimeLayout("_PARTITIONTIME", "DAY"), lambda: TimeLayout("d", "WEEK"), lambda: RangeLayout("k", 0, 10, 0), lambda: RangeLayout("k", 5, 5, 1),
        lambda: Table("t", "t", RangeLayout("k", 0, 10, 5), last=2), lambda: Table("a b", "t"), lambda: Config({"s": Schema((Table("t", "t", rls=()),))}),
        lambda: Config({"s": Schema((Table("t", "t"), Table("t", "u")))}), lambda: Config({"bad name": Schema()}),
    ],
)
def test_bad_configuration(bad):
    with pytest.raises(ValueError):
        bad()


def test_selections_and_nulls(spark):
    df = spark.createDataFrame([(k,) for k in (None, 1, 5, 10, 99)], "k long")
    rest, span = selections.Remainder("k", 5, 50), selections.Between("k", 5, 10)
    assert {r.k for r in selections.select_rows(df, rest).collect()} == {None, 1, 99}
    assert {r.k for r in selections.select_rows(df, span).collect()} == {5}
    assert {r.k for r in selections.retain(df, [span]).collect()} == {None, 1, 10, 99}
    assert selections.retain(df, [rest, span]).count() == 1 and selections.retain(df, []).count() == 5
    assert selections.select_rows(df, selections.Everything()).count() == 5 and selections.retain(df, [selections.Everything()]).count() == 0


def test_fingerprint_sees_copies(spark):
    one, two = (spark.createDataFrame([(1, "a")] * n, "k long, v string").select("k", "v") for n in (1, 3))
    one, two = (df.agg(partitions.fingerprint(df.schema)).first()[0] for df in (one, two))
    assert one != two


def test_diff_and_plan(spark):
    def manifest(rows):
        return spark.createDataFrame([("s", "t", p, sig, "range", "k", p, str(int(p) + 10)) for p, sig in rows], "schema string, table string, partition_id string, signature string, kind string, column string, lower string, upper string")

    current, stored = manifest([("0", "a"), ("10", "b2"), ("30", "c")]), manifest([("0", "a"), ("10", "b"), ("20", "d")])
    got = {r.partition_id: r.status for r in changes.partition_diff(current, stored).collect()}
    assert got == {"0": "unchanged", "10": "changed", "30": "new", "20": "removed"}
    assert {r.status for r in changes.partition_diff(current, current, rebuild=True).collect()} == {"changed"}
    assert changes.table_plans(changes.partition_diff(current, current)).count() == 0
    assert [r.partition_id for r in changes.removed(current, stored).collect()] == ["20"]
    assert [(r.lower, r.upper, r.n) for r in changes.merged_intervals(current).orderBy("n").collect()] == [("30", "40", 1), ("0", "20", 2)]
    diff = changes.partition_diff(current, stored)
    changes.check_plan(diff, current, [], [("s", "t")])
    for full, known in (([("s", "t")], [("s", "t")]), ([], []), ([("s", "x")], [("s", "t")])):
        with pytest.raises(ValueError):
            changes.check_plan(diff, current, full, known)
    with pytest.raises(ValueError):
        changes.check_plan(changes.partition_diff(current, stored), stored, [], [("s", "t")])


def test_structs_become_json(spark):
    df = spark.createDataFrame([(1, (None, "x"), [(2,)], [1, 2])], "id long, s struct<a:int,b:string>, l array<struct<c:int>>, p array<int>")
    assert struct_columns(df) == ["s", "l"]
    row = structs_to_json(df).first()
    assert row.s == '{"a":null,"b":"x"}' and row.l == '[{"c":2}]' and row.p == [1, 2] and structs_to_json(df).columns == df.columns


def test_sync_life_of_a_table(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = Store(spark, root)

    def run(df):
        return sync(spark, EVENTS, root, {"t": df}).first()

    first = days(spark, "2024-01-01", "2024-01-02 05:00:00", "2024-01-03", None)
    assert (r := run(first)).status == "rebuilt" and r.new == 3 and r.version == 1
    assert {x.id for x in store.read("shop", "t").collect()} == {0, 1, 2}
    before = {r.partition_id: r.path for r in store.manifest("shop", "t").collect()}
    assert run(first).status == "unchanged" and store.current("shop", "t")["version"] == 1
    then = first.filter("id <> 2").withColumn("day", F.when(F.col("id") == 1, F.lit("2024-01-02 06:00:00").cast("timestamp_ntz")).otherwise(F.col("day")))
    assert (r := run(then)).status == "refreshed" and (r.new, r.changed, r.removed) == (0, 1, 1)
    after = {r.partition_id: r.path for r in store.manifest("shop", "t").collect()}
    assert after["20240101"] == before["20240101"] and after["20240102"] != before["20240102"] and "20240103" not in after
    fresh = f"file://{tmp_path}/other"
    sync(spark, EVENTS, fresh, {"t": then})
    assert sorted(store.read("shop", "t").collect()) == sorted(Store(spark, fresh).read("shop", "t").collect())
    assert run(then.filter("id = 0")).removed == 1 and store.read("shop", "t").count() == 1
    assert run(then.filter("false")).removed == 1 and store.read("shop", "t").count() == 0 and store.read("shop", "t").columns == ["id", "day"]
    assert run(then.withColumn("more", F.lit(1))).status == "rebuilt" and "more" in store.read("shop", "t").columns
    assert len(store.vacuum("shop", "t", keep_versions=1, grace_ms=0)) == 2 and store.read("shop", "t").count() == 2


def test_failed_tables_keep_their_snapshot(spark, tmp_path):
    config = Config({"shop": Schema((Table("bad", "bad", TimeLayout("nope", "DAY")), Table("good", "good"))), "empty": Schema()})
    result = {r.table: r.status for r in sync(spark, config, f"file://{tmp_path}", {"bad": spark.range(2), "good": spark.range(3)}).collect()}
    assert result == {"bad": "failed", "good": "replaced"} and (tmp_path / "empty").is_dir()
    store = Store(spark, f"file://{tmp_path}")
    assert store.read("shop", "good").count() == 3 and store.tables() == [("shop", "good")]
    with pytest.raises(StalePlan):
        store.publish(store.manifest("shop", "good"), "shop", "good", T.StructType(), "x", {}, expected=0)
    with pytest.raises(ValueError):
        store.read("shop", "bad")


def test_remainder_and_hot_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.store.LARGE", 3)
    config = Config({"shop": Schema((Table("t", "t", RangeLayout("k", 0, 20, 10)),))})
    df = spark.createDataFrame([(k, i) for i, k in enumerate([None, None, -5, 99, 1, 2, 3, 4, 5, 15])], "k long, i long")
    sync(spark, config, f"file://{tmp_path}", {"t": df})
    assert sorted(r.i for r in Store(spark, f"file://{tmp_path}").read("shop", "t").collect()) == list(range(10))
    less = df.filter("k IS NOT NULL OR i > 100")
    assert sync(spark, config, f"file://{tmp_path}", {"t": less}).first().changed == 1
    assert Store(spark, f"file://{tmp_path}").read("shop", "t").count() == 8


def test_mtime_signatures(spark, tmp_path):
    days(spark, "2024-01-01", "2024-01-02").write.parquet(str(tmp_path / "src"))
    config = Config({"shop": Schema((Table("t", str(tmp_path / "src"), TimeLayout("day", "DAY")), Table("whole", str(tmp_path / "src"))))})
    for want in ({"rebuilt", "replaced"}, {"unchanged"}):
        assert {r.status for r in sync(spark, config, f"file://{tmp_path}/s", signature_mode="mtime").collect()} == want


GRANTS = [
    ("shop", "ana", False, True, "school", "1", None), ("shop", "ana", False, True, "class", "b", None), ("shop", "bob", True, True, None, None, None),
    ("shop", "eve", True, False, None, None, None), ("lab", "ana", True, True, None, None, None), ("shop", "bob", True, True, None, None, None),
]
UNITS = (Unit("school", "school"), Unit("class", "room"))


def students(spark):
    return spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, None, None)], "id long, school long, room string")


def seen(spark, units=UNITS, schema="shop", claim="sub", **claims):
    g = spark.createDataFrame(GRANTS, security.GRANTS)
    return {r.id for r in security.secure(students(spark), schema, units, claim, g, USER | claims).collect()}


def test_row_security(spark):
    assert seen(spark) == {1, 2} and seen(spark, sub="bob") == {1, 2, 3, 4} and seen(spark, sub="eve") == set() and seen(spark, sub="zoe") == set()
    assert seen(spark, sub=None) == set() and seen(spark, schemas="lab") == set() and seen(spark, schemas=None) == set() and seen(spark, schemas=[" shop"]) == set()
    assert seen(spark, units=None) == {1, 2, 3, 4} and seen(spark, units=()) == set() and seen(spark, units=(), sub="bob") == {1, 2, 3, 4}
    for role in (None, "writer"):
        with pytest.raises(PermissionError):
            seen(spark, role=role)
    with pytest.raises(ValueError):
        seen(spark, claim=None)


def test_audit_agrees_with_reads(spark):
    g = spark.createDataFrame(GRANTS, security.GRANTS)
    got = {r.subject: r.visible_rows for r in security.audit(students(spark), "shop", UNITS, g).collect()}
    assert got == {s: len(seen(spark, sub=s)) for s in ("ana", "bob")}
    assert {r.subject for r in security.readable_grants(g, USER | {"schemas": "lab"}).collect()} == {"ana"}


def test_secured_plan_has_no_nested_loop(spark):
    g = spark.createDataFrame(GRANTS, security.GRANTS)
    df = security.secure(students(spark), "shop", UNITS, "sub", g, USER)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_claims(spark):
    raw = json.dumps({"sub": "ana", "schemas": ["a", "b"], "n": 12, "on": True, "none": None})
    row = spark.createDataFrame([(raw,)], "c string").select(flatten_claims(F.col("c"))).first()[0]
    assert row == {"sub": "ana", "schemas": "a,b", "n": "12", "on": "true"}
    assert security.claim_text(["a", "b"]) == "a,b" and security.claim_text('"x"') == "x" and security.claim_text(True) == "true" and security.claim_text(None) is None
    df = spark.createDataFrame([("a,b",), ("a, b",), (None,)], "t string")
    assert [r[0] for r in df.select(in_comma_list(F.lit("b"), F.col("t"))).collect()] == [True, False, False]


def test_grants_maintenance(spark, tmp_path):
    g = spark.createDataFrame(GRANTS[:3], security.GRANTS).withColumn("metadata", F.create_map(F.lit("created_at"), F.lit("t0"), F.lit("by"), F.lit("me")))
    new = spark.createDataFrame([("shop", "ana", "school", "1", False), ("shop", "new", "school", "9", True), ("shop", "bob", None, None, True)], "schema string, subject string, unit_type string, unit_id string, is_enabled boolean")
    out = {(r.subject, r.unit_type, r.unit_id, r.is_admin): r for r in grants.upsert(g, new, F.lit("t1"), "shop").collect()}
    assert len(out) == 5
    changed = out[("ana", "school", "1", False)]
    assert not changed.is_enabled and changed.metadata == {"created_at": "t0", "updated_at": "t1", "by": "me"}
    assert out[("new", "school", "9", False)].metadata == {"created_at": "t1", "updated_at": "t1"} and out[("ana", "class", "b", False)].metadata["created_at"] == "t0"
    assert ("bob", None, None, True) in out and ("bob", None, None, False) in out
    with pytest.raises(PermissionError):
        grants.upsert(g, new, F.lit("t1"), "lab")
    off = grants.set_enabled(g, F.col("unit_type") == "class", False, F.lit("t2"), "shop")
    assert [r.subject for r in off.filter("NOT is_enabled").collect()] == ["ana"] and grants.set_enabled(g, F.lit(True), False, F.lit("t2"), "lab").filter("NOT is_enabled").count() == 0
    assert {(r.subject, r.status) for r in grants.restore_diff(g, off.filter("subject <> 'bob'")).collect()} == {("ana", "differs"), ("bob", "only_live")}
    path = grants.export_csv(g, f"file://{tmp_path}", "2024-06-01", {"role": "backup"})
    assert spark.read.option("header", True).csv(path).count() == 3


def test_filters(spark):
    df = spark.createDataFrame([(1, "ab", True), (2, "b", None), (None, None, False)], "k long, s string, b boolean")
    pick = lambda spec: sorted(r.k or 0 for r in df.filter(condition(df, spec)).collect())
    assert pick(("k", "eq", "1")) == [1] and pick(("k", "neq", 1)) == [2] and pick([("k", "gte", 1), ("k", "lt", 2)]) == [1]
    assert pick(("s", "like", "*b")) == [1, 2] and pick(("s", "in", ["b", "x"])) == [2] and pick(("b", "is", None)) == [2] and pick(("b", "is", False)) == [0]
    assert pick({"or": [("k", "eq", 2), ("b", "is", True)]}) == [1, 2] and pick({"not": ("k", "gt", 1)}) == [1] and pick([]) == [0, 1, 2]
    for bad in (("k", "between", 1), {"xor": [("k", "eq", 1)]}):
        with pytest.raises(ValueError):
            condition(df, bad)


def test_pages_counts_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "k long")
    order = lambda way, **more: [r.k for r in Query(order=(("k", way),), **more).page(df).collect()]
    assert order("asc") == [1, 2, 3, None] and order("desc") == [None, 3, 2, 1] and order("asc", limit=2, offset=1) == [2, 3] and order("asc", cap=1, limit=9) == [1]
    assert Query(where=[("k", "gt", 1)], limit=1).exact_count(df).first().total == 2
    assert Query(cap=10).estimated_count(df, 4) == (4, True)
    many = spark.range(5000)
    rows, exact = Query(where=[("id", "lt", 2500)], cap=100).estimated_count(many, 5000, sample=0.5)
    assert not exact and 2200 < rows < 2800
    config = Config({"shop": Schema((Table("st", "st", rls=UNITS, order=("id",)),), claim="sub")})
    sync(spark, config, f"file://{tmp_path}", {"st": students(spark)})
    store = Store(spark, f"file://{tmp_path}")
    reader = SecureReader(store, spark.createDataFrame(GRANTS, security.GRANTS), USER)
    assert [r.id for r in reader.read(None, "st", Query(select=("id",), order=(("id", "desc"),))).collect()] == [2, 1]
    assert {(r.column, r.type, r.protected) for r in catalog(spark, store, USER).collect()} == {("id", "long", True), ("school", "long", True), ("room", "string", True)}
    assert catalog(spark, store, USER | {"schemas": "x"}).count() == 0


def test_last_partitions_of_many_tables(spark):
    df = spark.createDataFrame([("a", p) for p in ("1", "2", "3")] + [("b", "9")], "table string, partition_id string")
    assert sorted(tuple(r) for r in partitions.last_partitions(df, 2, "table").collect()) == [("a", "2"), ("a", "3"), ("b", "9")]


def test_fingerprint_sees_moved_nulls_and_maps(spark):
    """A value that moves to a null beside it changes the signature, at any depth; the order of a map's entries does not."""
    kind = "a int, b int, c string, s struct<x:int,y:int>, l array<int>, m map<string,array<map<string,int>>>"

    def seen(*row):
        df = spark.createDataFrame([row], kind)
        return df.agg(partitions.fingerprint(df.schema)).first()[0]

    base = (1, None, "x", (1, None), [1, None, 2], {"k": [{"p": 1, "q": 2}], "n": None})
    assert seen(*base) == seen(*base[:5], {"n": None, "k": [{"q": 2, "p": 1}]})
    others = [(None, 1, *base[2:]), (*base[:3], (None, 1), *base[4:]), (*base[:4], [1, 2, None], base[5]), (*base[:4], [None, 1, 2], base[5]), (*base[:3], None, *base[4:]), (*base[:5], {"k": None, "n": [{"p": 1, "q": 2}]}), (*base[:5], None)]
    assert len({seen(*base), *(seen(*o) for o in others)}) == 8


def test_moved_nulls_and_maps_are_synced(spark, tmp_path):
    whole = Config({"shop": Schema((Table("t", "t"),))})
    rows = [(1, None, "x", {"k": 1}), (2, "a", None, None)]
    kind = "id int, a string, b string, m map<string,int>"
    first = spark.createDataFrame(rows, kind)
    root = f"file://{tmp_path}"
    assert sync(spark, whole, root, {"t": first}).first().status == "replaced" and sync(spark, whole, root, {"t": first}).first().status == "unchanged"
    then = spark.createDataFrame([(1, "x", None, {"k": 1}), rows[1]], kind)
    assert sync(spark, whole, root, {"t": then}).first().status == "replaced"
    assert {(r.id, r.a) for r in Store(spark, root).read("shop", "t").collect()} == {(1, "x"), (2, "a")}


def test_reads_open_partitions_within_bounds_only(spark, tmp_path):
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY")), Table("r", "r", RangeLayout("k", 0, 30, 10))))})
    days_ = days(spark, "2024-01-01", "2024-01-02 05:00:00", "2024-01-03")
    ints = spark.createDataFrame([(None,), (-1,), (5,), (15,), (25,), (99,)], "k long")
    sync(spark, config, f"file://{tmp_path}", {"t": days_, "r": ints})
    store = Store(spark, f"file://{tmp_path}")
    opened = lambda table, *where: len({f.rsplit("/", 2)[1] for f in store.read("shop", table, where).inputFiles()})
    assert opened("t") == 3 and opened("t", ("day", "gte", "2024-01-02 06:00:00")) == 2 and opened("t", ("day", "lt", "2024-01-02")) == 1
    assert opened("t", ("day", "in", ["2024-01-01", "2024-01-03 07:00:00"])) == 2 and opened("t", ("day", "eq", "2024-01-03"), ("id", "eq", 7)) == 1
    assert opened("t", ("id", "eq", 1)) == 3 and opened("t", {"or": [("day", "lt", "2024-01-02")]}) == 3 and opened("t", ("day", "neq", "2024-01-02")) == 3
    assert opened("r") == 4 and opened("r", ("k", "eq", "5")) == 2 and opened("r", ("k", "gt", 20)) == 2 and opened("r", ("k", "lte", 10), ("k", "gte", 5)) == 3
    reader = SecureReader(store, spark.createDataFrame(GRANTS, security.GRANTS), USER)
    assert [r.k for r in reader.read("shop", "r", Query(where=[("k", "eq", 99)])).collect()] == [99]
    assert [r.id for r in reader.read("shop", "t", Query(where=[("day", "eq", "2024-01-02 05:00:00")])).collect()] == [1]


def jobs(spark, f):
    """Spark jobs that a call runs."""
    group = f"jobs-{id(f)}"
    spark.sparkContext.setJobGroup(group, "")
    f()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_unchanged_sync_is_few_jobs_and_holds_nothing(spark, tmp_path):
    root, df = f"file://{tmp_path}/s", days(spark, "2024-01-01", "2024-01-02", "2024-01-03")
    sync(spark, EVENTS, root, {"t": df})
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert jobs(spark, lambda: sync(spark, EVENTS, root, {"t": df})) <= 8
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_plan_of_all_tables(spark, tmp_path):
    config = Config({"shop": Schema((Table("t", "t", TimeLayout("day", "DAY")), Table("w", "w"))), "none": Schema()})
    given = {"t": days(spark, "2024-01-01", "2024-01-02"), "w": spark.range(3)}
    root = f"file://{tmp_path}"
    rows = {r.table: r for r in plan(spark, config, root, given).collect()}
    assert (rows["t"].rebuild, rows["t"].new) == (True, 2) and (rows["w"].whole, rows["w"].changed) == (True, 1)
    sync(spark, config, root, given)
    assert plan(spark, config, root, given).count() == 0 and plan(spark, Config(), root).count() == 0
    row = plan(spark, config, root, given | {"t": days(spark, "2024-01-01", "2024-01-05")}).first()
    assert (row.table, row.new, row.changed, row.removed, row.unchanged) == ("t", 1, 0, 1, 1)


def test_roles_of_grants(spark, tmp_path):
    g = spark.createDataFrame(GRANTS, security.GRANTS)
    assert grants.writer_schema({"role": "policy_writer_shop"}) == "shop" and grants.written(g, {"role": "policy_writer_lab"}).count() == 1
    for role in (None, "user", "backup", "policy_writer_"):
        with pytest.raises(PermissionError):
            grants.writer_schema({"role": role})
    with pytest.raises(PermissionError):
        grants.export_csv(g, f"file://{tmp_path}", "x", {"role": "user"})
    meta = g.withColumn("metadata", F.create_map(F.lit("by"), F.lit("a"), F.lit("of"), F.lit("b")))
    other = g.withColumn("metadata", F.create_map(F.lit("of"), F.lit("b"), F.lit("by"), F.lit("a")))
    assert grants.restore_diff(meta, other).count() == 0
    assert {r.status for r in grants.restore_diff(meta, other.withColumn("metadata", F.create_map(F.lit("by"), F.lit("c")))).collect()} == {"differs"}


def test_jdbc_copy(spark, tmp_path):
    sync(spark, Config({"shop": Schema((Table("st", "st"),))}), f"file://{tmp_path}", {"st": students(spark)})
    url, driver = f"jdbc:derby:memory:mirror{tmp_path.name};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    Store(spark, f"file://{tmp_path}").to_jdbc("shop", "st", url, "students", driver)
    assert sorted(tuple(r) for r in spark.read.jdbc(url, "students", properties=driver).collect()) == sorted(tuple(r) for r in students(spark).collect())


def test_package_is_shipped_once(spark):
    ship(spark)
    ship(spark)
    assert sum("tidemark.zip" in f for f in spark.sparkContext.listFiles) == 1
