"""Configurations in JSON, and what is wrong with them."""

import json

import pytest

from tidemark.config import Config, RangeLayout, Schema, Table, TimeLayout, Unit, read_config
from tidemark.operators.reads import namespaces
from tidemark.plans.preflight import columns_wanted, preflight
from tidemark.plans.sync import sync
from tidemark.sources.store import Store

GOOD = {"name": "t", "source": "t", "layout": {"column": "day", "granularity": "DAY"}, "last": 3, "rls": [{"unit_type": "u", "column": "k"}], "order": ["k", "day"], "split": ["k"]}


def test_json_becomes_the_same_configuration():
    ranged = {"name": "r", "source": "x/r", "layout": {"column": "k", "start": 0, "end": 10, "interval": 5}}
    got, bad = read_config(json.dumps({"shop": {"claim": "sub", "tables": [GOOD, ranged]}, "bare": {}}))
    tables = (Table("t", "t", TimeLayout("day", "DAY"), 3, (Unit("u", "k"),), ("k", "day"), split=("k",)), Table("r", "x/r", RangeLayout("k", 0, 10, 5)))
    assert got == Config({"shop": Schema(tables, "sub"), "bare": Schema()}) and not bad
    assert [t.canonical() for t in got.tables()] == [t.canonical() for t in Config({"shop": Schema(tables, "sub")}).tables()]


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"layout": None}, "last keeps"), ({"last": 0}, "last keeps"), ({"layout": {"column": "k", "start": 0, "end": 9, "interval": 3}}, "last keeps"),
        ({"layout": {"column": "day", "granularity": "WEEK"}}, "granularity"), ({"layout": {"column": "_PARTITIONTIME", "granularity": "DAY"}}, "real column"),
        ({"last": None, "layout": {"column": "k", "start": 0, "end": 9, "interval": 0}}, "positive interval"), ({"last": None, "layout": {"column": "k", "start": 9}}, "missing"),
        ({"name": "a b"}, "bad table name"), ({"colour": "red"}, "colour"), ({"rls": [{"unit": "u"}]}, "unit"), ({"last": None, "layout": None}, "only partitions"),
    ],
)
def test_bad_entries_spoil_no_other(change, problem):
    got, bad = read_config(json.dumps({"s": {"claim": "sub", "tables": [GOOD | change, GOOD | {"name": "ok"}]}}))
    assert [t.name for t in got.tables()] == ["ok"]
    assert len(bad) == 1 and bad[0][:2] == ("s", (GOOD | change)["name"]) and problem in bad[0][2]


def test_names_and_claims():
    got, bad = read_config(json.dumps({"s": {"tables": [GOOD, {"name": "t", "source": "t"}, {"name": "t", "source": "u"}]}, "a-b": {"tables": [GOOD]}}))
    assert [(t.schema, t.name, t.source) for t in got.tables()] == [("s", "t", "t")]
    assert [(s, t) for s, t, _ in bad] == [("s", "t"), ("s", "t"), ("a-b", None)]


def test_rows_are_counted_and_sound_tables_say_nothing(spark):
    df = spark.sql("SELECT CAST(k AS INT) AS k, IF(k % 3 = 0, NULL, DATE'2024-01-01') AS day, IF(k = 5, NULL, 'x') AS u, IF(k = 1, 'soon', '2024-02-03') AS text FROM range(10) AS r(k)")
    layout = {"column": "day", "granularity": "DAY"}
    entries = [
        {"name": "days", "source": "t", "layout": layout, "rls": [{"unit_type": "u", "column": "u"}]}, {"name": "texts", "source": "t", "layout": layout | {"column": "text"}},
        {"name": "ranges", "source": "t", "layout": {"column": "k", "start": 2, "end": 8, "interval": 2}, "split": ["u"]}, {"name": "sound", "source": "t", "order": ["k"]},
        {"name": "lost", "source": "nowhere"}, {"name": "odd", "source": "t", "layout": layout | {"column": "k"}, "index": ["k", "gone"]},
    ]
    rows = preflight(spark, json.dumps({"s": {"claim": "sub", "tables": entries}}), {"t": df}).collect()
    got = {(r.table, r.problem): (r.blocks, r.rows) for r in rows if r.table != "lost"}
    assert got == {
        ("days", "rows without a time"): (False, 4), ("days", "rows without a unit, for admins only"): (False, 1), ("texts", "texts that are no time"): (True, 1), ("ranges", "rows in the remainder"): (False, 4),
        ("ranges", "rows with a null in the split key"): (False, 1), ("odd", "index: no column gone"): (True, None), ("odd", "layout: k is no time but int"): (True, None),
    }
    assert [r.blocks for r in rows if r.table == "lost"] == [True]


def test_a_blocked_table_fails_and_a_passed_one_syncs(spark, tmp_path):
    """What blocks by the schema is what a sync reports as failed, and nothing else."""
    df = spark.range(8).selectExpr("id AS k", "DATE'2024-01-01' AS day")
    text = json.dumps({"s": {"tables": [{"name": "a", "source": "t", "layout": {"column": "gone", "granularity": "DAY"}}, {"name": "b", "source": "t", "order": ["nope"]}, {"name": "c", "source": "t", "order": ["k"]}]}, "bare": {}})
    blocked = {r.table for r in preflight(spark, text, {"t": df}).filter("blocks").collect()}
    done = {r.table: r.status for r in sync(spark, read_config(text)[0], str(tmp_path), {"t": df}).collect()}
    assert blocked == {t for t, status in done.items() if status == "failed"} == {"a", "b"}
    assert [tuple(r) for r in namespaces(spark, Store(spark, str(tmp_path))).collect()] == [("bare", 0), ("s", 1)]


def test_only_named_columns_are_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).selectExpr("id AS k", "'a' AS note", "DATE'2024-01-01' AS day").write.parquet(path)
    found = preflight(spark, json.dumps({"s": {"tables": [{"name": "t", "source": path, "layout": {"column": "day", "granularity": "DAY"}}]}}))
    plan = found._jdf.queryExecution().toString()
    assert "ReadSchema: struct<day:date>" in plan and found.count() == 0
    assert list(columns_wanted(read_config(json.dumps({"s": {"claim": "c", "tables": [GOOD]}}))[0].tables()[0])) == ["day", "k"]
