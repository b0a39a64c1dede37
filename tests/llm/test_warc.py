"""Archives against brute force, the merge, and edge cases."""

import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

PAGES = "page_id long, url string, html string"
LONG = "<p>the same text over and over, in all of a hundred bytes and more than that, to be a revisit of one page</p>"


def expected(rows):
    """(payload_bytes, payload_digest, record_type, refers_to) of unique page ids."""
    digest = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows}
    size = {i: len((h or "").encode()) for i, _, h in rows}
    first = {}
    for i in sorted(digest):
        first.setdefault(digest[i], i)
    again = {i: size[i] >= 100 and first[digest[i]] != i for i in digest}
    return {i: (size[i], digest[i], "revisit" if again[i] else "response", first[digest[i]] if again[i] else None) for i in digest}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 20])
def test_loser_tree_merges_sorted_runs(k):
    rng = random.Random(k)
    runs = [sorted(str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(k)]
    got = list(warc.loser_tree(runs))
    assert got == sorted(((i, j) for i, r in enumerate(runs) for j in range(len(r))), key=lambda x: (runs[x[0]][x[1]], x))


def test_archives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE", 23)
    monkeypatch.setattr(warc, "STEP", 2)
    rng = random.Random(1)
    texts = [LONG, LONG + "ü", "short", None, "", f"WARC/1.1\r\nWARC-Type: response\r\n\r\n{LONG}\r\n\r\nWARC/1.1\r\n", "\r\n\r\n" * 40]
    urls = ["http://hot.example.org/a"] * 5 + ["https://www.Example.com:443/b?z=1&a=2#x", "http://example.com:8080", "http://[bad/", "not a url", None, "http://é.example/ü?q", "http://a.b/c d\ne"]
    rows = [(i, rng.choice(urls), rng.choice([*texts, f"<p>{i}</p>" * 30])) for i in range(400)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5).withColumns({"row": F.lit("mine"), "digest": F.lit(1), "capture": F.lit(2), "size": F.lit("x")})
    out = warc.archive(pages, captured=F.timestamp_seconds(F.lit(1_700_000_000) - F.col("page_id"))).collect()
    want = expected(rows)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out} == want and len(out) == 400
    out.sort(key=lambda r: r.position)
    assert [r.position for r in out] == list(range(400)) and len({r.archive for r in out}) > 4
    assert [(r.urlkey, r.timestamp) for r in out] == sorted((r.urlkey, r.timestamp) for r in out)
    seen = defaultdict(int)
    for r in out:
        seen[r.urlkey] += 1
        assert r.capture == seen[r.urlkey] and (r.uri is None) == (r.urlkey == "")
    assert max(seen.values()) > 3 * warc.RANGE  # the hot URL's history is cut and goes on
    assert {"com,example,www)/b?a=2&z=1", "com,example:8080)/", "http://[bad/", "not%20a%20url", "b,a)/c%20d%20e"} <= set(seen)
    by_file = defaultdict(list)
    for r in out:
        by_file[r.archive].append(r.offset)
    for name, offsets in by_file.items():  # each offset is that of a record
        data = gzip.decompress(Path(name.removeprefix("file:")).read_bytes())
        assert sorted(offsets) == [r["offset"] for r in warc.parse(data, name)] and len(data) < 60_000


def test_odd_pages(spark):
    rows = [(None, "http://a.b/1", LONG), (None, None, LONG), (7, "http://a.b/1", LONG), (7, "http://a.b/1", LONG), (9, None, None), (9, None, None), (8, "http://a.b/1", "x" * 300_000)]
    out = [r for r in warc.archive(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out), key=str) == sorted(
        [(None, "revisit", 7, len(LONG)), (None, "revisit", 7, len(LONG)), (7, "response", None, len(LONG)), (7, "revisit", 7, len(LONG)), (9, "response", None, 0), (9, "response", None, 0), (8, "response", None, 300_000)], key=str
    )
    text_ids = spark.createDataFrame([("a b\r\nc", "http://x.y/", LONG), ("ü:%", "http://x.y/", LONG), ("", "http://x.y/", LONG)], "page_id string, url string, html string")
    out = {r.page_id: r.refers_to for r in warc.archive(text_ids).collect()}
    assert out == {"a b\r\nc": "", "ü:%": "", "": None}
    empty = warc.archive(spark.createDataFrame([], PAGES))
    assert empty.count() == 0 and empty.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_times_are_utc_in_any_zone(spark):
    page = spark.createDataFrame([(1, "http://a.b/", LONG)], PAGES)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        [row] = warc.archive(page, captured=F.timestamp_seconds(F.lit(0))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.timestamp == "19700101000000"


def test_damage_is_named(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "http://a.b/", LONG), (2, "http://a.b/", LONG + "!")], PAGES).coalesce(1), f"file://{tmp_path}/w")
    data = gzip.decompress(next(f for f in (tmp_path / "w").glob("*.gz") if len(f.read_bytes()) > 50).read_bytes())
    assert len(list(warc.parse(data, "f"))) >= 1
    for bad, said in ((data.replace(b"the same", b"the sane"), "damaged"), (data[:-3], "is cut"), (b"x" + data, "no record at 0")):
        with pytest.raises(ValueError, match=said):
            list(warc.parse(bad, "f"))
