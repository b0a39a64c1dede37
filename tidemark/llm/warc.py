"""WARC archives of pages, and one index of them in the order of URL and time."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import discard, keep, ready, shared_dir

# fixed values of the format
VERSION = "WARC/1.1"
CRLF = "\r\n"
BETWEEN = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BEGIN = 946_684_800  # 2000-01-01, where no time is known

LEAST = 100
FILE_BYTES = 32 << 20
RANGE = 100_000
STEP = 1024
SAMPLES = 200_000
RUNS = "run string, at long, urlkey string, timestamp string, uri string, record_type string, page string, refers string, payload_bytes long, payload_digest string, offset long"


def _date(seconds: Column) -> Column:
    """Epoch seconds as an ISO time in UTC, whatever the session's zone."""
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(seconds, F.lit(BEGIN)).cast("decimal(18,6)"))
    return F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _urn(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(" ", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record(kind: str, payload: Column, extra: Sequence[Column], own: Column) -> Column:
    """Text of a record from the columns id, uri, seconds, size and digest, without the blank lines after it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(BETWEEN))
    block = F.concat(http, payload)
    return F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}"), _line("WARC-Record-ID", own), _line("WARC-Date", _date(F.col("seconds"))), _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), _line("Page-Id", F.url_encode(F.col("id").cast("string"))), *extra,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None) -> None:
    """Write a record for each page as gzipped WARC files below ``path``.

    Of pages with equal payloads of at least 100 bytes the one with the smallest id (nulls
    last; on ties by url and time) is a response, the others are revisits without the payload
    that refer to it; smaller payloads are all responses. A null text is an empty payload.
    ``captured`` is the time of capture, 2000-01-01 where null. Blanks and control characters of
    a URL become ``%20``; a null URL or id has no header. Texts are shuffled once, after copies
    met in the tasks that read them; what decides on revisits is a narrow table.
    """
    ready(pages.sparkSession)
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    seconds = F.unix_seconds(captured) if captured is not None else F.lit(None).cast("long")
    of = pages.select(F.col(f"`{id_col}`").alias("id"), F.regexp_replace(f"`{url_col}`", r"[\x00-\x20\x7f]+", "%20").alias("uri"), seconds.alias("seconds"), html.alias("html"))
    of = of.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    meta = ["id", "uri", "seconds"]
    narrow = keep(of.select(*meta, "size", "digest", F.monotonically_increasing_id().alias("row")), "captures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), *meta, "row"))
    copied = keep(narrow.filter(F.col("size") >= LEAST).groupBy("digest").agg(first.alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "copied")
    own = _urn(F.col("digest"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    met = copied.select("digest", "first", _urn(F.col("digest"), F.coalesce(F.col("first.id").cast("string"), F.lit(""))).alias("target"))
    again = narrow.filter(F.col("size") >= LEAST).join(met, "digest").filter("row <> first.row")
    refers = [
        F.lit(f"WARC-Profile: {PROFILE}{CRLF}"), _line("WARC-Refers-To", F.col("target")), _line("WARC-Refers-To-Target-URI", F.col("first.uri")),
        _line("WARC-Refers-To-Date", _date(F.col("first.seconds"))), _line("Refers-To-Page-Id", F.url_encode(F.col("first.id").cast("string"))),
    ]
    revisits = again.select(_record("revisit", F.lit(""), refers, _urn(F.col("digest"), F.lit("again"), F.col("row").cast("string"))).alias("value"))
    whole = of.filter(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.min(F.struct(F.col("id").isNull().alias("none"), *meta)).alias("first"), F.first("html").alias("html"))
    whole = whole.select("digest", "size", "html", *[F.col(f"first.{c}").alias(c) for c in meta])
    small = of.filter(F.col("size") < LEAST)
    responses = whole.select(_record("response", F.col("html"), [], own).alias("value")).unionByName(
        small.select(_record("response", F.col("html"), [], _urn(F.col("digest"), F.lit("small"), F.monotonically_increasing_id().cast("string"))).alias("value")))
    mean = narrow.agg(F.avg("size")).first()[0] or 0
    rows = max(1, int(FILE_BYTES // (mean + 1000)))  # a reader takes a file at once
    responses.unionByName(revisits).write.option("lineSep", BETWEEN).option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)
    discard(narrow)
    discard(copied)


def url_key(uri: str) -> str:
    """A URL in the order of its host's labels from the right: ``com,example)/path?a&b``; no scheme, user, default port or fragment, parameters sorted."""
    try:
        parts = urlsplit(uri)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return uri
    if not host:
        return uri
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def headers(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split(CRLF)[1:])


def parse(data: bytes, name: str) -> Iterator[dict]:
    """The records of one archive, by their lengths; a damaged one raises ValueError with its place."""
    at, gap = 0, BETWEEN.encode()
    while at < len(data):
        end = data.find(gap, at)
        if end < 0 or not data.startswith(f"{VERSION}{CRLF}".encode(), at):
            raise ValueError(f"{name}: no record at {at}")
        head = headers(data[at:end])
        stop = end + 4 + int(head["Content-Length"])
        block = data[end + 4 : stop]
        if data[stop : stop + 4] != gap:
            raise ValueError(f"{name}: the record at {at} is cut")
        split = block.index(gap)
        size, digest = int(headers(block[:split])["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response" and (len(block) - split - 4 != size or hashlib.sha256(block[split + 4 :]).hexdigest() != digest):
            raise ValueError(f"{name}: the payload of the record at {at} is damaged")
        page, refers = (None if head.get(k) is None else unquote_plus(head[k]) for k in ("Page-Id", "Refers-To-Page-Id"))
        uri = head.get("WARC-Target-URI")
        yield {
            "urlkey": url_key(uri) if uri else "", "timestamp": "".join(c for c in head["WARC-Date"] if c.isdigit()), "uri": uri, "record_type": head["WARC-Type"],
            "page": page, "refers": refers, "payload_bytes": size, "payload_digest": digest, "offset": at,
        }
        at = stop + 4


def order(urlkey: str, timestamp: str, page: str | None) -> str:
    """What captures are ordered by, as one text."""
    return f"{urlkey}\0{timestamp}\0{page or ''}"


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``: each archive is a run, sorted by URL key, time and page, ``at`` is the place in it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("run", pa.string()), ("at", pa.int64()), *((c, pa.int64() if c in ("payload_bytes", "offset") else pa.string()) for c in COLUMNS)])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                name = name.as_py()
                found = sorted(parse(gzip.decompress(content.as_buffer()), name), key=lambda r: order(r["urlkey"], r["timestamp"], r["page"]))
                for i in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist([r | {"run": name, "at": i + k} for k, r in enumerate(found[i : i + 10_000])], schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(read, RUNS)


COLUMNS = [f.split()[0] for f in RUNS.split(", ")][2:]


def loser_tree(runs: Sequence[Sequence[str]]) -> Iterator[tuple[int, int]]:
    """(run, place) of all keys of sorted runs, upwards; equal keys by run.

    A tournament: each inner node holds the run that lost there, the root's winner is next,
    and only the path from its leaf up is played again.
    """
    k, at = len(runs), [0] * len(runs)

    def beats(a: int, b: int) -> bool:
        """Whether run a's next key comes before b's; -1 and runs at their end lose."""
        if a < 0 or at[a] >= len(runs[a]):
            return False
        if b < 0 or at[b] >= len(runs[b]):
            return True
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or x == y and a < b

    losers = [-1] * k
    won = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = won[1] if k > 1 else 0 if k else -1
    while winner >= 0 and at[winner] < len(runs[winner]):
        yield winner, at[winner]
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def merge(table: pa.Table) -> pa.Table:
    """The runs' pieces of one range merged: rows in order, with ``place`` in the range and ``capture``, the number among the range's captures of the URL."""
    table = table.sort_by([("run", "ascending"), ("at", "ascending")])
    keys = [order(*x) for x in zip(*(table[c].to_pylist() for c in ("urlkey", "timestamp", "page")))]
    names = table["run"].to_pylist()
    starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
    pieces = [keys[a:b] for a, b in zip(starts, starts[1:])]
    out = table.take(pa.array([starts[run] + i for run, i in loser_tree(pieces)], pa.int64()))
    capture, before = [], None
    for url in out["urlkey"].to_pylist():
        capture.append(capture[-1] + 1 if url == before else 1)
        before = url
    return out.append_column("place", pa.array(range(len(capture)), pa.int64())).append_column("capture", pa.array(capture, pa.int64()))


def merged(captures: DataFrame) -> DataFrame:
    """All runs as one: each capture with ``position``, its place in the order of all, and ``capture``, its number among those of its URL.

    Keys taken at even steps from every run cut the order into ranges of about 100,000
    captures, each of which merges its pieces of all runs by a loser tree in a task of its own;
    keys reach down to the page, so the history of a hot URL is cut too. A row for each range
    comes to the driver and says where the range begins and what it continues.
    """
    spark = captures.sparkSession
    captures = keep(captures, "runs")
    total = captures.count()
    step = max(1, min(STEP, RANGE // 16), -(-total // SAMPLES))
    taken = captures.filter(F.pmod(F.col("at") + F.xxhash64("run"), F.lit(step)) == 0).select("urlkey", "timestamp", "page").collect()
    sample, ranges = sorted(order(*r) for r in taken), -(-total // RANGE)
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    own = "range int, " + RUNS

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("urlkey", "timestamp", "page")))
            number = pa.array([bisect_right(cuts, order(*k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([number, *batch.columns], ["range", *batch.schema.names])

    out = keep(captures.mapInArrow(ranged, own).groupBy("range").applyInArrow(merge, own + ", place long, capture long"), "merged")
    discard(captures)
    ends = out.groupBy("range").agg(F.count("*").alias("n"), F.min_by("urlkey", "place").alias("first"), F.max_by("urlkey", "place").alias("last"), F.max_by("capture", "place").alias("run")).orderBy("range").collect()
    rows, start, before, carry = [], 0, None, 0
    for r in ends:
        carried = carry if r["first"] == before else 0
        rows.append((r["range"], start, r["first"], carried))
        start, before, carry = start + r["n"], r["last"], r["run"] + (carried if r["first"] == r["last"] else 0)
    table = spark.createDataFrame(rows, "range int, start long, first string, carried long")
    joined = out.join(F.broadcast(table), "range")
    capture = F.col("capture") + F.when(F.col("urlkey") == F.col("first"), F.col("carried")).otherwise(0)
    return joined.select(*COLUMNS, F.col("run").alias("archive"), (F.col("start") + F.col("place")).alias("position"), capture.alias("capture"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives below ``path``, in order: see :func:`runs` and :func:`merged`. Every payload is read and held against its digest."""
    ready(spark)
    return merged(runs(spark, path))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None, path: str | None = None) -> DataFrame:
    """Write pages as WARC, read the archives back and return their index.

    One row for each page: the id (its type kept), payload_bytes, payload_digest, record_type,
    refers_to, uri, urlkey, timestamp, archive, offset, position and capture. Equal rows are captures of
    their own. Files go below ``path``, a new folder in the shared one by default. No pages give
    no files and no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, id_col, url_col, html_col, captured)
    kind = pages.schema[id_col].dataType
    found = read(spark, path)
    return found.select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"),
        *[c for c in ("uri", "urlkey", "timestamp", "archive", "offset", "position", "capture") if c != id_col],
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
u AS (
  SELECT page_id, coalesce(url, '') AS url, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)(\?[^#]+)?', ['s', 'h', 'p', 'q']) AS x FROM pages),
k AS (
  SELECT page_id, array_to_string(list_reverse(string_split(lower(x.h), '.')), ',') || ')' || CASE WHEN x.p = '' THEN '/' ELSE x.p END
    || CASE WHEN x.q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(x.q[2:], '&')), '&') END AS urlkey FROM u)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, urlkey,
  row_number() OVER (ORDER BY urlkey, page_id) - 1 AS position, row_number() OVER (PARTITION BY urlkey ORDER BY page_id) AS capture
FROM p LEFT JOIN f USING (d) JOIN k USING (page_id)
"""
