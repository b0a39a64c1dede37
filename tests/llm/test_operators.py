"""Operators against brute force on small tables, and their edge cases."""

import datetime
import decimal
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, html, language, lines, mixing, ngram_join, queries, repeats, sharding, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and clashing names."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words.upper(), None, None, None), (3, None, "en", "b", 0), (4, "", "de", "b", 0),
        (5, " \t\n ", None, "a", 3), (None, words, "en", "a", 1), (None, None, None, None, None), (6, "one two", "en", "c", 7), (7, "one two", "en", "c", 7), (8, "x" * 5000, "en", "a", 9),
        (9, ("long line " * 30 + "\n") * 20, "en", "a", 9),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("mine"), "matches": F.lit(1), "n_lines": F.lit("x"), "score": F.lit("s"), "shard": F.lit("z")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, df = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(df.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted((plain(r[c] for c in want.columns) for r in df.collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)


# 1 ---------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    rows = mixing.plan(documents(spark)).collect()
    taken, targets = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(taken[s] == int(t) for s, t in targets.items())
    assert sorted(rows) == sorted(mixing.plan(documents(spark).repartition(3)).collect())


def test_water_fill_shares_again_until_feasible(spark):
    table = spark.createDataFrame([("a", 10, 5), ("b", 100, 2), ("c", 1000, 1)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(table, 3).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0}


def test_mix_edge_cases(spark):
    rows = mixing.plan(odd(spark)).collect()
    assert len(rows) == 12 and all(r.taken == 0 for r in rows if not r.size)
    assert mixing.plan(empty(spark)).count() == 0
    assert mixing.plan(spark.createDataFrame([(1, None, None, None, None)], DOCS)).first().taken == 0
    out = mixing.apply(odd(spark))
    assert out.columns == odd(spark).columns
    assert 0 <= sum(len(WORD.findall(r.text)) for r in out.collect()) - sum(r.taken for r in rows) <= 3


def test_one_id_may_hold_most_rows(spark):
    """Rows of one id, and null ids, fill the range where targets end: each source still meets its target to the word."""
    rows = [(7, "one two three", None, s, None) for s in ("a", "b", None) for _ in range(150)]
    rows += [(None, "x y", None, "a", None)] * 90 + [(i, "w " * (i % 9), None, "c", None) for i in range(60)]
    got = mixing.plan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9)
        assert all(r.whole * r.size <= r.taken <= (r.whole + 1) * r.size for r in mine)


def test_sources_are_ranked_by_code_point(spark):
    names = [f"s{i}" for i in range(40)] + ["", "Z", "é", "😀", None]
    got = {r.source: r.place for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    assert got == {n: i for i, n in enumerate([*sorted((n for n in names if n is not None), key=lambda n: n.encode()), None])}


# 2 ---------------------------------------------------------------------------


def test_shards_follow_the_ring(spark):
    rows = sharding.shard(documents(spark), shards=8, vnodes=16).collect()
    places, met = sharding.ring(8, 16)
    caps = sharding.capacities(len(rows), 8, 1.0)
    where = {}
    held = []
    for r in rows:
        assert r.size == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode())
        p = sharding.position(f"{r.doc_id}:{r.text_crc32}")
        held.append((int(np.searchsorted(places, p)) % len(places), p, r.doc_id))
    used = [0] * 8
    waiting = sorted(held)
    for turn in range(8):  # one key after the other, in ring order
        rest = []
        for arc, p, d in waiting:
            s = met[arc][turn]
            if used[s] < caps[s]:
                where[d] = s
                used[s] += 1
            else:
                rest.append((arc, p, d))
        waiting = rest
    assert not waiting and {r.doc_id: r.shard for r in rows} == where
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_move_little(spark):
    """With slack about one key of nine goes to the ninth shard, and few others move; a plain hash would move eight of nine."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    before, after = ({r.doc_id: r.shard for r in sharding.shard(docs, shards=n, load_factor=1.25).select("doc_id", "shard").collect()} for n in (8, 9))
    moved = sum(before[k] != after[k] for k in before) / len(before)
    new = sum(s == 8 for s in after.values()) / len(after)
    assert new > 0.05 and moved < new + 0.08, (new, moved)


@pytest.mark.parametrize("vnodes", [1, 16, 37])
def test_arcs_are_found_without_python(spark, vnodes):
    """Each place falls in the arc up to the next node; no worker is started to tell, whose memory would come on top of the executor's."""
    places, _ = sharding.ring(8, vnodes)
    asked = sorted({0, 2**60 - 1, *places, *(p - 1 for p in places), *(p + 1 for p in places)})
    found = spark.createDataFrame([(p,) for p in asked], "p long").select("p", sharding.arc_of(F.col("p"), places)).collect()
    assert {p: a for p, a in found} == {p: int(np.searchsorted(places, p)) % len(places) for p in asked}
    plan = sharding.shard(documents(spark), shards=8, vnodes=vnodes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shard_edge_cases(spark):
    rows = sharding.shard(odd(spark), shards=3).collect()
    assert len(rows) == 12 and Counter(r.shard for r in rows) == {0: 4, 1: 4, 2: 4}
    assert [r.size for r in rows if r.text is None] == [1, 1]
    assert sharding.shard(empty(spark)).count() == 0


# 3 ---------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        first, _ = repeats.runs(gone)
        left = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), len(first), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_repeats_against_brute_force(spark, length):
    rows = sorted(r for r in documents(spark).select("doc_id", "text").collect() if len(r.text) < 6000)
    extra = [(10_000, "ab" * 700), (10_001, rows[0].text + rows[1].text[:500] + rows[0].text), (10_002, "y" * 399), (10_003, "z" * 401)]
    rows = [(r.doc_id, r.text) for r in rows] + extra
    got = sorted(repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=length).drop("kept").collect())
    want = brute_repeats([t.encode() for _, t in rows], length)
    assert [tuple(g)[1:] for g in got] == want


def test_suffix_ranks_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(2)
    for length in (3, 8, 20, 100, 400):
        data = rng.integers(97, 99, 1500).astype(np.uint8)
        data[700:1300] = data[100:700]
        starts = np.arange(len(data) - length + 1)
        strings = [data[i : i + length].tobytes() for i in starts]
        ranks = repeats.suffix_ranks(data, starts, length)
        order = np.argsort(ranks, kind="stable")
        assert [strings[i] for i in order] == sorted(strings)
        assert [ranks[i] == ranks[j] for i, j in zip(order[1:], order, strict=False)] == [strings[i] == strings[j] for i, j in zip(order[1:], order, strict=False)]


def test_large_pieces_are_cut_whole(spark, monkeypatch):
    """A passage in many texts, in full, in part and in copies, with pieces of two phrases."""
    monkeypatch.setattr(repeats, "PIECE", 2)
    rng = np.random.default_rng(4)
    passage = "".join(map(chr, rng.integers(97, 123, 700)))
    rows = []
    for i in range(30):
        a, b = sorted(rng.choice(700, 2, replace=False).tolist()) if i % 3 else (0, 700)
        pre, post = ("".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(0, 300, 2))
        rows.append((i, pre + passage[a:b] + post))
    rows += [(100, rows[3][1]), (101, rows[4][1]), (102, passage[100:400] + passage[50:500])]
    for length in (400, 90):
        got = sorted(repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=length).drop("kept").collect())
        assert [tuple(g)[1:] for g in got] == brute_repeats([t.encode() for _, t in rows], length)


def test_repeats_hot_entries_and_edges(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 2)
    core = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500))
    rows = [(i, f"{i * 7919 % 1000:04d}" * (i + 1) + core + f"{i * 104729 % 1000:04d}" * i) for i in range(12)]
    got = sorted(repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=100).drop("kept").collect())
    assert [tuple(g)[1:] for g in got] == brute_repeats([t.encode() for _, t in rows], 100)
    monkeypatch.undo()
    rows = repeats.dedup(odd(spark)).collect()
    assert len(rows) == 12 and {r.n_bytes for r in rows if r.doc_id in (3, 4)} == {0}
    assert repeats.dedup(empty(spark)).count() == 0


# 4 ---------------------------------------------------------------------------


def brute_classes(rows, k, percent):
    def shingled(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {d: shingled(t) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(d, len(sets[d]), find(d)) for d in ids]


def test_jaccard_classes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "DIRECT", 4)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "ROUNDS", 2)
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 10_000, 120)]
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    for i in range(60):  # near copies around the threshold
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"edit{i}_{at}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, "a b"), (20_001, "A  B"), (20_002, "a"), (20_003, ""), (20_004, None), (20_005, " \n")]
    for k, percent in ((4, 85), (5, 80), (2, 50)):
        got = sorted(tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, k=k).collect())
        assert got == brute_classes(rows, k, percent)


def test_like_upper_halves_of_hashes_make_no_link(spark):
    text = " ".join(f"v{i}" for i in range(400_000))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    upper = ngram_join.shingles(ngram_join.words(data, np.array([0, len(data)]))[0], 1) >> np.uint64(32)
    order = np.argsort(upper, kind="stable")
    x, y = [(int(i), int(j)) for i, j in zip(order[:-1], order[1:], strict=True) if upper[i] == upper[j]][-1]
    shared = " ".join(f"common{i}" for i in range(17))
    rows = [(1, f"{shared} v{x}"), (2, f"{shared} v{y}"), (4, f"{shared.replace('common', 'other')} v{x}"), (5, f"{shared.replace('common', 'other')} v{y} more")]
    for percent in (90, 94):
        got = sorted(tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, k=1).collect())
        assert got == brute_classes(rows, 1, percent)
    assert ngram_join.common(np.array([5, 9], np.uint64).tobytes(), b"") == 0


def test_regions_are_cut_level_by_level(spark, monkeypatch):
    """Words of a pool in every text: regions too large at the first shingle, cut at the next ones, with links across."""
    monkeypatch.setattr(ngram_join, "DIRECT", 3)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    cuts = []
    whole = ngram_join.split
    monkeypatch.setattr(ngram_join, "split", lambda rest, reps, percent, depth: cuts.append((depth, (out := whole(rest, reps, percent, depth))[0].count())) or out)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        words = [f"p{x}" for x in rng.choice(120, 12, replace=False)]
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join([*words, f"more{i}"])))
    rows += [(2000 + i, " ".join([*(f"c{x}" for x in range(9)), f"own{i}"])) for i in range(40)] + [(3000, " ".join(f"c{x}" for x in range(9)))]
    got = sorted(tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, k=1).collect())
    assert got == brute_classes(rows, 1, 85)
    assert [d for d, n in cuts if n] and len({c for _, _, c in got}) < len(rows) - 79


def test_unlinked_texts_of_one_region_cost_in_proportion(spark, monkeypatch):
    """Texts at a similarity of 80 % (a few by chance above), all in one region: what is compared grows as the texts do."""
    compared = []
    whole = ngram_join.links
    monkeypatch.setattr(ngram_join, "links", lambda pairs, held, percent: compared.append(pairs.count()) or whole(pairs, held, percent))
    seen = {}
    for size in (750, 1500, 3000):
        compared.clear()
        rng = np.random.default_rng(size)
        rows = [(i, " ".join([*(f"core{x}" for x in range(80)), *(f"pool{x}" for x in rng.choice(size * 5, 10, replace=False))])) for i in range(size)]
        got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, k=1)
        assert got.select("component_id").distinct().count() >= 0.99 * size
        seen[size] = sum(compared)
    assert seen[3000] <= 6 * max(seen[750], 200)


def test_frequent_shingles_stand_last_however_full_the_count_is(spark, monkeypatch):
    """A phrase of 55 texts where a slot of the count holds 60 other shingles: frequent, though a slot's count is not doubled."""
    monkeypatch.setattr(ngram_join, "SKETCH", 1 << 12)
    monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 1 << 12)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["in", "every", "one", "here", *(f"v{x}" for x in rng.integers(0, 10**9, 4468))])) for i in range(55)]
    classes = ngram_join.frequency_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    slot = int(next(ngram_join.shingle_sets(pa.array(["in every one here"]), 4))[0]) & (1 << 12) - 1
    assert classes[slot] > 0 and (classes == 0).mean() > 0.95


def test_sets_are_fetched_for_compared_pairs_alone(spark, monkeypatch):
    """60 texts meet in the region of one shingle; all but two pairs of near copies are ruled out before whole sets are fetched."""
    monkeypatch.setattr(ngram_join, "DIRECT", 4)
    monkeypatch.setattr(ngram_join, "frequency_classes", lambda docs, k: np.zeros(ngram_join.SKETCH, dtype=np.uint8))
    fetched = []
    whole = ngram_join.whole_sets
    monkeypatch.setattr(ngram_join, "whole_sets", lambda docs, k, need: fetched.append(need.count()) or whole(docs, k, need))
    met = min((f"c{i}" for i in range(5000)), key=lambda w: int(next(ngram_join.shingle_sets(pa.array([w]), 1))[0]))
    rows = [(i, " ".join([met, *(f"t{i}w{x}" for x in range(39))])) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} more") for i in (0, 1)]
    got = sorted(tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, k=1).collect())
    assert got == brute_classes(rows, 1, 85) and len({c for _, _, c in got}) == 60
    assert 4 <= sum(fetched) <= 8


def test_pipeline_keeps_one_of_each_class_and_drops_linked_ones_only(spark):
    import corpus_pipeline as pipeline

    rows = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    classes = brute_classes(rows, 5, 80)
    got = sorted(tuple(r)[:3] for r in ngram_join.join(documents(spark), percent=80, k=5).collect())
    assert got == classes
    kept = {r.doc_id for r in pipeline.one_of_each_class(spark, documents(spark), SF).collect()}
    assert kept == {c for _, _, c in classes} and len(kept) < len(rows)


def test_pipeline_shuffles_no_text_that_is_surely_kept(spark, monkeypatch):
    import corpus_pipeline as pipeline

    parted = []
    whole = pipeline.marked
    monkeypatch.setattr(pipeline, "marked", lambda rows, some: parted.append(whole(rows, some)) or parted[-1])
    rows = [(i, " ".join(f"t{i}w{x}" for x in range(60))) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(5)]  # linked, not kept
    rows += [rows[7], rows[7], (400, ""), (400, ""), (401, None), (None, "a b"), (None, "a b"), (None, None), (None, None), (402, "a B")]
    got = pipeline.one_of_each_class(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    named = [((d, t and hashlib.md5(t.encode()).hexdigest() if t else t), t) for d, t in rows]
    kept = ngram_join.join(spark.createDataFrame(named, "doc_id struct<doc_id: long, digest: string>, text string"), percent=80, k=5).filter("kept")
    kept = {tuple(r.doc_id) for r in kept.collect()}
    want = {(d, t) for (name, t), (d, _) in zip(named, rows, strict=True) if name in kept}
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) == 304
    (sure, unsure), = parted
    assert unsure.count() <= 16 and sure.count() >= len(rows) - 16
    assert "hashpartitioning" not in sure._jdf.queryExecution().toString()


def test_jaccard_edge_cases(spark):
    rows = ngram_join.join(odd(spark)).collect()
    assert len(rows) == 12
    assert sum(r.kept for r in rows if r.n_shingles == 57) == 1 and {r.component_id for r in rows if r.n_shingles == 57} == {1}
    assert ngram_join.join(empty(spark)).count() == 0


# 5 ---------------------------------------------------------------------------


def test_article_is_found():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies, many, many.</div><div id=wrap><div class="sidebar"><p>Side text, long enough to be a paragraph, surely.</p></div>
    <article><h1>Head &amp; line</h1><p>First&nbsp;paragraph   with, commas, and\n text &eacute;&#233;.<br><p>Second <b>bold<p>Third, unclosed, paragraph goes on and on here.
    <div class="ad">Buy, now, this, thing, please, it, is, great.</div><form><p>Name, address, phone</p></form><!-- gone --><script>var x = "</p>";</script></article>
    <section class="comments"><p>A reader wrote, at length, that this is wrong, very wrong, indeed.</p></section></div><footer>&copy; foot</footer></body></html>"""
    assert html.main_text(page) == "Head & line\nFirst paragraph with, commas, and text éé.\nSecond bold\nThird, unclosed, paragraph goes on and on here."


PARAGRAPH = "<p>Paragraph {}, with a comma, or two, and enough length to count for the score of a text like this one, which goes on for a while.</p>"


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ('<body><div class="content has-sidebar">{}</div><div class="sidebar"><p>Side text, one of two, long enough to be a paragraph.</p></div></body>', 5),
        ('<body><nav><a href=/>x</a></nav><div class="share-your-story text social">{}</div></body>', 5),
        ('<body><p>A stray paragraph, of some length, beside the layout of the page.</p><div id=main class="layout right rail">{}</div></body>', 5),
        ('<body><form action=/><input value=x><div class=menu><a href=a>a</a></div><div>{}</div><select><option>no</select></form></body>', 5),
        ('<body><div class="site-header"><h2>Site name, and more words to it, and more</h2></div><div class="entry"><div class="entry-header"><h1>Title of it</h1></div>{}</div></body>', 6),
        ('<body><div class="page comments-open"><article>{}</article><section id="comments"><article class="comment"><p>First, I think, this is wrong, and long enough, really.</p></article></section></div></body>', 5),
        ("<body><article>{}</article><div class=comments>" + "".join(f"<p>Reader {i} says, at length, that this, of all things, is wrong, and goes on and on.</p>" for i in range(20)) + "</div></body>", 5),
        ("<body><main>{}<div class=newsletter><p>Sign up, now, for letters, that come, every day, to you, in the morning.</p></div></main></body>", 5),
    ],
)
def test_labels_lower_scores_and_wrappers_stay(page, lines):
    got = html.main_text(page.replace("{}", "".join(PARAGRAPH.format(i) for i in range(5)))).split("\n")
    assert sum(x.startswith("Paragraph") for x in got) == 5 and len(got) == lines, got


SIDE = '<div class="sidebar"><p>Side text, with a comma, long enough to be a paragraph, of one or two lines.</p></div>'
STEPS = ["Two eggs", "Some flour", "A pinch of salt", "Stir it well", "Heat the pan", "Butter it", "Pour it in", "Turn it once"]
POEM = ["One line", "and another", "short ones", "that go on", "to the end", "of the page"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div><h1>A recipe</h1><ul>{''.join(f'<li>{s}</li>' for s in STEPS)}</ul></div>{SIDE}</body>", ["A recipe", *STEPS]),
        (f"<body>{SIDE}<article><h1>A poem</h1>{''.join(f'<p>{s}</p>' for s in POEM)}</article></body>", ["A poem", *POEM]),
        ("<body><!--><article><p>{}</p></article><!-- x --></body>", ["{}"]),
        ("<body><!---><article><p>{}</p></article><!-- x --></body>", ["{}"]),
        ('<body><article><p>{}</p><img alt="6" pipe"><p>{}</p><img src=a/b.png alt=\'x>y\'></article></body>', ["{}", "{}"]),
        ("<body><main><header><h1>Title</h1><p>A lede.</p></header><p>{}</p></main></body>", ["Title", "A lede.", "{}"]),
        ('<body><article><p>{}</p><section id="discussion"><h3>Reader comments</h3><p>I think, at length, that this is wrong, and much more.</p></section></article></body>', ["{}"]),
        ('<body><div role="status"><p>{}</p></div></body>', ["{}"]),
        ('<body style="visibility:hidden"><div style="visibility: hidden"><p>{}</p></div></body>', ["{}"]),
        ("<body><script>x</script><noscript><p>{}</p></noscript><nav><a href=/>no</a></nav></body>", ["{}"]),
        ("<body><article><p>{}</p></article><noscript><p>{} but not this</p></noscript></body>", ["{}"]),
    ],
)
def test_pages_that_lost_their_article(page, want):
    text = "A text of the article, with commas, and long enough to be a paragraph of its own."
    assert html.main_text(page.replace("{}", text)).split("\n") == [w.replace("{}", text) for w in want]


def test_generated_pages_give_their_articles_block_by_block():
    """Pages of known articles among other parts, in many shapes: every block of the article, and none other."""
    import random

    rng = random.Random(11)
    words = "the quick river of stones went on over hills and many fields until night came to them all".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice([".", ", and so on.", "!"])
    found = held = right = 0
    for k in range(300):
        blocks = [f"Title {k} of it"] + [f"{k}-{i} " + sentence(rng.randrange(8, 60)) for i in range(rng.randrange(3, 12))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<p><b></b>{}</p>"]).format(b) for b in blocks[1:])
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post-body">{}</div>', "<div><div>{}</div></div>", '<div id="content" class="wide">{}</div>', '<section class="text">{}</section>'])
        extras = [
            f"<nav><ul>{''.join(f'<li><a href=/{i}>{sentence(2)}</a>' for i in range(6))}</ul></nav>", f"<footer><p>{sentence(20)}</p></footer>", f'<div class="sidebar"><h3>More</h3><p>{sentence(25)}</p></div>',
            f"<aside><p>{sentence(30)}</p></aside>", f'<div class="cookie-banner"><p>{sentence(20)}</p><button>Yes</button></div>', f'<div class="ad">{sentence(15)}</div>',
            f'<section class="comments">{"".join(f"<p>{sentence(25)}</p>" for _ in range(rng.randrange(1, 5)))}</section>', f"<form action=/><p>{sentence(12)}</p><input></form>", f"<header><p>{sentence(9)}</p></header>",
        ]
        rng.shuffle(extras)
        cut = rng.randrange(len(extras))
        page = f"<html><body>{''.join(extras[:cut])}{wrap.format(inner)}{''.join(extras[cut:])}</body></html>"
        got = html.main_text(page).split("\n")
        found, held, right = found + len(set(got) & set(blocks)), held + len(blocks), right + len(got)
    assert found / held >= 0.99 and found / right >= 0.99, (found, held, right)


def test_container_by_score_and_odd_pages(spark):
    body = "".join(f"<p>Paragraph {i}, with a comma, and enough length to count for the score.</p>" for i in range(4))
    page = f"<html><body><div class=menu><ul><li><a href=a>x</a></ul></div><div><div>{body}</div></div><div><a href=b>links only, many, of, them, all, links</a></div></body>"
    assert html.main_text(page).count("\n") == 3
    for broken in (None, "", "<", "text only", "<p", "<div><div", "</p></div>", "<p>a &am", "<!-- open", "<script>x", "<a " * 500, "<div>" * 3000 + "deep"):
        html.main_text(broken)
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got[2] == ("", 0) and got[None] == ("", 0) and got[1][1] == len(got[1][0])
    assert html.extract(pages.limit(0)).count() == 0


# 6 ---------------------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    x = np.concatenate([base[i % 6] + rng.normal(size=16) * 0.12 for i in range(900)]).reshape(900, 16).astype(np.float32)
    label = rng.integers(0, 3, 900)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(900)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [None] * 16, 1), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.0], 1), (None, rows[0][1], rows[0][2])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    root = np.arange(900)
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(900)])
        if (new == root).all():
            break
        root = new
    for size in (4096, 60):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(data, cell_rows=size).collect()}
        extra = near[0].astype(int) + (np.arange(900) == 0)  # the row without an id is a copy of row 0
        assert all(got[i] == (int(near[i].sum()) + int(extra[i]), root[i], root[i] == i) for i in range(900))
        assert all(got[i] == (0, i, True) for i in range(1000, 1007)) and got[1007] == (1, 1007, True) and got[1008] == (1, 1007, False)
    assert vectors.near_duplicates(data.limit(0)).count() == 0


def test_copies_of_vectors_and_cells_cut_by_hash(spark, monkeypatch):
    """Thousands of equal vectors are one row; rows that no distance can part are cut by hash."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, base.tolist(), 1) for i in range(3000)] + [(3000 + i, (base + rng.normal(size=8) * 1e-3).tolist(), 1) for i in range(200)] + [(4000, (-base).tolist(), 1)]
    held = []
    whole = vectors._cells
    monkeypatch.setattr(vectors, "_cells", lambda rows, *a: held.append(rows.count()) or whole(rows, *a, levels=2))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_rows=30).collect()}
    assert held == [202] and got == {**{i: (3199, 0, i == 0) for i in range(3200)}, 4000: (0, 4000, True)}


def test_few_pairs_of_cells_are_met(spark, monkeypatch):
    """Clusters far apart: pairs of cells grow with the cells and not with their square."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(64, 32))
    x = (centres[:, None] + rng.normal(size=(64, 40, 32)) * 0.02).reshape(-1, 32)
    met = []
    whole = vectors._descend
    monkeypatch.setattr(vectors, "_descend", lambda *a: met.append((out := whole(*a)).count()) or out)
    data = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicates(data, cell_rows=64)
    assert got.select("component_id").distinct().count() == 64 and got.filter("n_links <> 39").count() == 0
    assert met[0] < 64 * 40


def test_levels_halve_and_are_nested():
    rng = np.random.default_rng(11)
    x = np.concatenate([c + rng.normal(size=(300, 12)) * w for c, w in zip(rng.normal(size=(6, 12)), (0.01, 0.05, 0.1, 0.2, 0.4, 1.0), strict=True)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    todo, cut = [vectors.grow(x, 0.98)], 0
    while todo:
        node = todo.pop()
        assert abs(vectors.spread(x[node.points] @ x[node.centre]).max() - node.radius) < 1e-7
        if not node.children:
            assert len(node.points) <= vectors.LEAF or node.radius <= vectors.reach(0.98) / 2
            continue
        cut += 1
        centres = [c.centre for c in node.children]
        apart = vectors.spread(x[centres] @ x[centres].T) + 4 * np.eye(len(centres))
        assert apart.min() > node.radius / 2 and max(c.radius for c in node.children) <= node.radius / 2
        assert node.centre in centres and sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        todo += node.children
    assert cut > 3


def test_upper_levels_halve_beside_rows_without_structure(spark):
    """A hot group, small groups and rows far from all: radii halve, the rest keeps its gap, links are those of brute force."""
    rng = np.random.default_rng(13)
    hot = rng.normal(size=24)
    groups = [hot + rng.normal(size=(400, 24)) * 0.06, *[c + rng.normal(size=(40, 24)) * 0.3 for c in rng.normal(size=(5, 24))], rng.normal(size=(300, 24))]
    x = np.concatenate(groups)
    data = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(data, cell_rows=50).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(x))} and sum(got.values()) > 1000
    rows = spark.createDataFrame([(i, v.tolist(), 1, "1:24") for i, v in enumerate(x)], "node long, unit array<double>, copies long, group string")
    cells, levels, pieces = vectors._cells(rows, 50, 0.98)
    assert cells.groupBy("cell").count().agg({"count": "max"}).first()[0] < 200 and cells.count() == len(x) and len(levels) > 1
    radius = {"1:24": 2.0}
    for level in levels:
        for r in level.collect():
            assert r.radius <= radius[r.parent] / (1 if r.gap else 2) and r.gap in (None, radius[r.parent] / 2)
            radius[r.cell] = r.radius
    met = vectors._descend(rows, levels, pieces, 0.98)
    n = cells.select("cell").distinct().count()
    assert met.count() == met.distinct().count() < n * (n + 1) / 2


# 7 ---------------------------------------------------------------------------


def test_patience_keeps_order():
    assert lines.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert lines.patience([5, 1, 2, 6], [7, 1, 2, 8]) == [(1, 1), (2, 2)]
    a, b = [1, 2, 3, 4, 5, 6], [4, 5, 6, 1, 2, 3]
    got = lines.patience(a, b)
    assert len(got) == 3 and all(a[x] == b[y] for x, y in got) and got == sorted(got)
    assert lines.patience([], [1]) == []


def test_runs_align_in_chains():
    run = lambda *rows: lines.aligned(*(np.array(c) for c in zip(*rows))).tolist()
    assert run((0, 2, 5), (1, 3, 6), (4, 6, 9)) == [0, 1, 2, 4, 5]  # one chain
    assert run((0, 2, 5), (6, 8, 5)) == [0, 1, 6, 7]  # stands twice: the second chain
    assert run((0, 1, 9), (3, 4, 6), (5, 6, 3), (8, 9, 0)) == [0, 3, 5, 8]  # in another order
    many = [(2 * i, 2 * i + 1, 1000 - i) for i in range(100)]  # more chains than rounds
    assert run(*many) == [2 * i for i in range(100)]
    assert lines.rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4]) and lines.rising([]) == []


def test_runs_align_by_patience_diff_of_their_lines(monkeypatch):
    asked, diff = [], lines.patience
    monkeypatch.setattr(lines, "patience", lambda a, b: asked.append((a, b)) or diff(a, b))
    run = lambda *rows: lines.aligned(*(np.array(c) for c in zip(*rows))).tolist()
    # lines 0 to 2, 4 and 5 in order; 6 and 7 stand before them in the other text, and are aligned by a second diff
    assert run((0, 2, 5), (1, 3, 6), (4, 6, 9), (6, 8, 1)) == [0, 1, 2, 4, 5, 6, 7]
    assert asked == [([0, 1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6, 0, 1]), ([0, 1, 2, 3, 4, 5, 6], [0, 1])]
    asked.clear()
    # line 1 is like line 5 of the other text by one run, like line 9 by another: one name for all
    assert run((0, 2, 4), (1, 3, 9)) == [0, 1, 2]
    assert asked[0] == ([0, 1, 1, 3], [0, 1, 3])


def test_without_alignment_nothing_goes(spark, monkeypatch):
    docs = documents(spark)
    gone = lambda: lines.dedup(docs, every_block=True).agg(F.sum("n_deleted")).first()[0]
    copies = docs.filter("text IS NOT NULL").count() - docs.select("text").distinct().count()
    before = gone()
    monkeypatch.setattr(lines, "aligned", lambda begins, ends, places: np.zeros(0, dtype=np.int32))
    assert before > gone() and copies >= 0


def test_line_dedup(spark):
    one, two = (["%s line number %d of a text that is long enough" % (n, i) for i in range(8)] for n in ("first", "second"))
    rows = [(1, "\n".join(one)), (2, "\n".join([*two[:3], *one[2:6], *two[3:]])), (3, "\n".join(one)), (4, "short\nline"), (5, "short\nline"), (6, None), (7, ""), (None, "\n".join(one)), (1, "\n".join(one))]
    got = {(r.doc_id, r.n_deleted): r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, 0)] == "\n".join(one) and got[(2, 4)] == "\n".join(two) and got[(3, 8)] == "" and got[(None, 8)] == ""
    assert got[(5, 0)] == "short\nline" and got[(6, 0)] is None and got[(7, 0)] == ""
    assert lines.dedup(empty(spark)).count() == 0 and lines.dedup(odd(spark)).count() == 12


def test_line_pairs_against_brute_force(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").orderBy("doc_id").collect()]
    split = {d: [x.strip() for x in t.split("\n") if x.strip()] for d, t in rows}
    texts, first, gone = {}, {}, {d: set() for d, _ in rows}
    for d, t in rows:
        texts.setdefault(t, d)
    for d in sorted(texts.values()):
        for x in split[d]:
            first.setdefault(x, d)
    count = Counter(x for d in texts.values() for x in set(split[d]))
    for t, d in texts.items():
        shared = defaultdict(float)
        for x in set(split[d]):
            if first[x] != d:
                shared[first[x]] += len(x) / np.log2(count[x] + 1)
        for leader, evidence in shared.items():
            if evidence >= 16:
                gone[d] |= set(lines.common_blocks(split[leader], split[d], [len(x) for x in split[d]], 50))
    for d, t in rows:
        if texts[t] != d and sum(map(len, split[d])) >= 50:
            gone[d] = set(range(len(split[d])))
    got = {r.doc_id: r.n_deleted for r in lines.dedup(documents(spark)).collect()}
    assert got == {d: len(g) for d, g in gone.items()} and sum(got.values())


def test_every_shared_block_against_all_pairs(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").orderBy("doc_id").collect()]
    one, two = "a line of six and twenty c", "one more of six and twenty"
    # the lines of the block lead to texts 10,000 and 10,001, the block itself to 10,002
    rows += [(10_000, one), (10_001, two), (10_002, f"{one}\n{two}"), (10_003, f"own\n{one}\n \n  {two}\nown too")]
    split = {d: [x.strip() for x in t.split("\n") if x.strip()] for d, t in rows}
    texts, gone, aligned = {}, {d: set() for d, _ in rows}, {d: set() for d, _ in rows}
    for d, t in rows:
        texts.setdefault(t, d)
    order = sorted(texts.values())
    for n, d in enumerate(order):
        for a in (a for a in order[:n] if set(split[a]) & set(split[d])):
            ends = [[0] * (len(split[d]) + 1) for _ in range(len(split[a]) + 1)]
            for i, x in enumerate(split[a]):
                for j, y in enumerate(split[d]):
                    ends[i + 1][j + 1] = ends[i][j] + 1 if x == y else 0
            for i, line in enumerate(ends):
                for j, long in enumerate(line):
                    if sum(map(len, split[d][j - long : j])) >= 50:
                        gone[d] |= set(range(j - long, j))
            aligned[d] |= set(lines.common_blocks(split[a], split[d], [len(x) for x in split[d]], 50))
    assert all(aligned[d] <= gone[d] for d in order) and gone[10_003] == {1, 2}
    for d, t in rows:
        if texts[t] != d and sum(map(len, split[d])) >= 50:
            gone[d] = set(range(len(split[d])))
    got = {r.doc_id: (r.n_deleted, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), every_block=True).collect()}
    assert {d: n for d, (n, _) in got.items()} == {d: len(g) for d, g in gone.items()} and got[10_003] == (2, "own\n \nown too")
    assert lines.dedup(empty(spark), every_block=True).count() == 0 and lines.dedup(odd(spark), every_block=True).count() == 12


def test_line_query_deletes_blocks_with_split_leaders(spark, tmp_path):
    one, two = "a line of six and twenty c", "one more of six and twenty"
    rows = [(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"own\n{one}\n{two}\nown too")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_deleted for r in queries.line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 0, 3: 0, 4: 2}


def test_line_query_deletes_blocks_however_many_share_them(spark, tmp_path):
    short, long = "a line of three and fifty characters, ever and again.", "a line of a hundred characters, " * 3 + "once"
    rows = [(i, f"own line {i}\n{short}") for i in range(12)] + [(i, f"own line {i}\n{long}") for i in range(100, 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert (len(short), len(long)) == (53, 100)
    assert {r.doc_id: r.n_deleted for r in queries.line_dedup(spark, str(tmp_path)).collect()} == {i: int(i not in (0, 100)) for i, _ in rows}


def test_line_query_deletes_doubled_and_moved_passages(spark, tmp_path):
    passage = [f"passage line {i}, short" for i in range(4)]
    other = [f"another line {i}, short" for i in range(4)]
    rows = [(1, "\n".join(["top", *passage, "between", *other, "end"])), (2, "\n".join(["x", *passage, "y", *passage, "z"])), (3, "\n".join(["u", *other, "v", *passage, "w"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_deleted for r in queries.line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 8, 3: 8}


# 8 ---------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    words = WORD.findall(items[0][1])
    rows += [(10_000, "pre " * 9 + items[0][1].upper().replace("É", "é") + " post" * 9), (10_001, " ".join([*words[:9], "changed", *words[10:]])), (10_002, " ".join(words[3:-2])), (10_003, None), (10_004, "")]

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = {}
    for d, t in rows:
        w, hits = WORD.findall((t or "").translate(low)), set()
        for k, text in items:
            own = bag(v := WORD.findall(text.translate(low)))
            if not set(own) & set(bag(w)):
                continue
            for at in range(max(1, len(w) - len(v) + 1)):
                part = bag(w[at : at + len(v)])
                weigh = lambda c: sum(sum(len(x.encode()) for x in s) * n for s, n in c.items())
                if weigh(part & own) * 100 >= 80 * weigh(part | own) > 0:
                    hits.add(k)
        want[d] = hits
    data = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (32_000_000, 500):
        got = {r.doc_id: {m.item_id for m in r.matches} for r in decontamination.contaminate(data, benchmark, block_bytes=block).collect()}
        assert got == want
    assert want[10_000] and sum(map(bool, want.values())) > 2


def test_leak_edge_cases(spark):
    few = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    data = spark.createDataFrame([(1, "Two Words here"), (2, None), (3, "x alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    got = {r.doc_id: [m.item_id for m in r.matches] for r in decontamination.contaminate(data, few).collect()}
    assert got == {1: [1], 2: [], 3: [None]}
    assert decontamination.contaminate(data, few.limit(0)).filter("size(matches) > 0").count() == 0
    assert decontamination.contaminate(odd(spark), few).count() == 12 and decontamination.contaminate(empty(spark), few).count() == 0


def test_items_of_one_word_over_long_texts(spark):
    few = spark.createDataFrame([(1, "needle"), (2, "Pin"), (2, "pin"), (3, " \t")], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(60_000))
    data = spark.createDataFrame([(1, long + " Needle " + long), (2, long), (3, "pin"), (4, "needles pins")], "doc_id long, text string")
    got = {r.doc_id: [(m.item_id, m.first_word) for m in r.matches] for r in decontamination.contaminate(data, few).collect()}
    assert got == {1: [(1, 60_000)], 2: [], 3: [(2, 0)], 4: []}


def test_item_ids_of_any_type(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "pin", None, "needle in hay"]
    data = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta"), (2, "pin a Needle in hay pin"), (3, "none")], "doc_id long, text string")
    for kind, ids in (("string", ["b:1", "a", None, "b:1"]), ("date", [datetime.date(2024, 1, d) for d in (3, 2, 1, 3)]), ("decimal(20,2)", [decimal.Decimal(d) for d in (9, 5, 1, 9)])):
        few = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"item_id {kind}, text string")
        for block in (32_000_000, 30):
            found = decontamination.contaminate(data, few, block_bytes=block)
            assert found.schema["matches"].dataType.elementType["item_id"].dataType == few.schema["item_id"].dataType
            got = {r.doc_id: {(m.item_id, m.first_word) for m in r.matches} for r in found.collect()}
            assert got == {1: {(ids[0], 1)}, 2: {(ids[1], 0), (ids[0], 2)}, 3: set()}


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (3, 7, 20):
        cuts = decontamination.blocks(radius)
        assert sum(m.bit_length() for _, m in cuts) == 64
        for _ in range(200):
            a = int(rng.integers(0, 2**63))
            b = a
            for bit in rng.choice(64, radius, replace=False):
                b ^= 1 << int(bit)
            assert any((a >> s) & m == (b >> s) & m for s, m in cuts)


# 9 ---------------------------------------------------------------------------


def test_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "What is the answer?\nPlease tell."), (1, 1, "assistant", "It is 42."), (1, 2, "user", "Bob wrote:\n> >  what is THE answer?\n> It is 42.\n\nWhy?"),
        (1, 3, "assistant", "> Please tell.\nI told you."), (1, 4, "user", "> nobody said this\nHm."), (2, 0, "user", "It is 42."), (2, 1, "user", None), (None, 0, "user", "x"), (3, None, "user", "> x"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("mine"))).collect()}
    assert got[(1, 2)].parent_turn == 1 and got[(1, 2)].body == "Why?" and got[(1, 2)].n_linked == 2
    assert got[(1, 3)].parent_turn == 0 and got[(1, 3)].quoted and got[(1, 3)].body == "I told you."
    assert got[(1, 4)].parent_turn == 3 and not got[(1, 4)].quoted and got[(1, 4)].n_quotes == 1
    assert [t for _, t in sorted((r.position, r.turn) for r in got.values() if r.conv_id == 1)] == [0, 1, 3, 2, 4]
    assert got[(2, 0)].parent_turn is None and got[(2, 1)].body is None and got[(None, 0)].parent_turn is None
    made = {r.conv_id: r.messages for r in chat.to_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [m.content for m in made[1]] == ["What is the answer?\nPlease tell.", "It is 42.", "I told you.", "Why?", "Hm."]
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_are_ranked_by_blocks(spark):
    rows = [(1, i, "user", f"message {i}") for i in range(300)]
    got = sorted((r.turn, r.position) for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(i, i + 1) for i in range(300)]


def test_turns_that_are_missing_or_equal(spark):
    rows = [(1, 0, "user", "a"), (1, 5, "user", "b"), (1, 200, "user", "c"), (1, 200, "bot", "d"), (1, 200, "bot", "d"), (1, None, "user", "e"), (None, 3, "user", "f"), (None, 4, "user", "> f"), (2, -3, "user", "x"), (2, 7, None, None)]
    got = sorted((r.conv_id or 0, -99 if r.turn is None else r.turn, r.role or "", r.parent_turn, r.position) for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(0, 3, "user", None, 1), (0, 4, "user", None, 1), (1, -99, "user", None, 2), (1, 0, "user", None, 1), (1, 5, "user", 0, 3), (1, 200, "bot", 5, 4), (1, 200, "bot", 5, 4), (1, 200, "user", 5, 6), (2, -3, "user", None, 1), (2, 7, "", -3, 2)]


def test_chat_against_sql(spark, tmp_path):
    """Random threads with nested quotes, whole and in part, and the given table."""
    import duckdb

    rng = np.random.default_rng(6)
    said = ["yes", "The  answer is 42.", "why?\nbecause", "Ünder line", "a\n\n\n\nb", "", "> stray"]
    rows = []
    for c in range(40):
        texts = []
        for turn in np.unique(rng.integers(0, 200, 12)).tolist():
            parts = []
            if texts and rng.random() < 0.7:
                quote = texts[rng.integers(len(texts))].upper() if rng.random() < 0.3 else texts[rng.integers(len(texts))]
                parts += ["Ann wrote:"] * int(rng.integers(0, 2)) + ["> " + x for x in quote.split("\n")]
            parts.append(said[rng.integers(len(said))])
            texts.append("\n".join(parts))
            rows.append((c if c else None, turn if rng.random() < 0.97 else None, "user", texts[-1] if rng.random() < 0.97 else None))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, glob in ((SF, f"{SF}/conversations.parquet"), (str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{glob}'")
        want = con.sql(chat.ORACLE)
        df = queries.linked_chat(spark, folder)
        assert sorted(want.columns) == sorted(df.columns)
        rows = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=str)
        assert rows == sorted(want.fetchall(), key=str)
        assert folder == SF or sum(r[want.columns.index("n_linked")] for r in rows) > 50


# 10 --------------------------------------------------------------------------


def test_held_out_languages(spark):
    from tidemark.llm import queries

    got = queries.languages(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.filter("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n >= 0.97


def test_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 500")
    model = language.train(docs)
    one = {lang: docs.filter(F.col("lang") == lang).first().text[:500] for lang in ("en", "de", "fr")}
    rows = [(1, one["en"]), (2, one["de"] + " " + one["fr"]), (3, None), (4, "123 !?"), (5, ""), (6, "é")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()}
    assert got[1].lang_pred == "en" and len(got[1].languages) == 1
    assert {x.lang for x in got[2].languages} == {"de", "fr"} and 0.4 < got[2].score < 0.6
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[6].lang_pred in model.languages
    none = language.train(docs.filter("false"))
    assert language.identify(docs, none).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(odd(spark), model).count() == 12 and language.identify(empty(spark), model).count() == 0


def brute_mixture(probability, at, penalty):
    """Every set of languages, by EM in plain loops; the best penalised likelihood wins."""
    from itertools import combinations

    n = probability.shape[1]

    def fit(chosen):
        theta = [1 / len(chosen)] * len(chosen)
        for _ in range(60):
            sums = [0.0] * len(chosen)
            for s in at:
                whole = sum(t * probability[s, k] for t, k in zip(theta, chosen, strict=True))
                for j, k in enumerate(chosen):
                    sums[j] += theta[j] * probability[s, k] / whole
            theta = [x / len(at) for x in sums]
        return sum(np.log(sum(t * probability[s, k] for t, k in zip(theta, chosen, strict=True))) for s in at)

    sets = [c for r in range(1, n + 1) for c in combinations(range(n), r)]
    return max(sets, key=lambda c: fit(c) / 3 - penalty * np.log(len(at)) * len(c))


def test_language_sets_against_all_sets():
    rng = np.random.default_rng(8)
    probability = rng.dirichlet(np.full(40, 0.3), 4).T + 1e-6
    probability /= probability.sum(axis=0)
    for shares in ((1, 0, 0, 0), (0.5, 0.5, 0, 0), (0.1, 0, 0.9, 0), (0.4, 0.3, 0, 0.3), (0, 0, 0.02, 0.98)):
        at = np.concatenate([rng.choice(40, int(600 * s), p=probability[:, k]) for k, s in enumerate(shares)])
        got = {k for k, _ in language.infer(probability, at.astype(np.uint16), 5.0)}
        assert got == set(brute_mixture(probability, at, 5.0))


def test_many_languages_keep_all_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 500").select("doc_id", "text", "lang")
    few = language.train(docs)
    rare = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("q").alias("text"), F.concat(F.lit("zz"), "id").alias("lang"))  # teach no n-gram
    model = language.train(docs.unionByName(rare.withColumn("text", F.concat(F.lit("qxz"), F.col("lang")))))
    assert model.probability.shape == (language.SLOTS, len(few.languages) + 600)
    known = [model.languages.index(x) for x in few.languages]
    assert np.allclose(model.probability[:, known], few.probability, rtol=1e-6)
    got = language.identify(docs.limit(60), model)
    assert got.filter("lang = lang_pred").count() >= 57


def test_repeat_keys_are_unambiguous(spark):
    text = "0123456789" * 90
    rows = [("a", f"b:{text}", "x"), ("a:b", text, "x"), (None, "n", "x"), ("", "n", "x")]
    out = {r.doc_id: r for r in repeats.dedup(spark.createDataFrame(rows, "doc_id string, text string, lang string"), length=400).collect()}
    assert all(r.n_removed <= r.n_bytes for r in out.values()) and out["a:b"].n_bytes == 900 and out["a:b"].n_removed == 900 and out["a"].n_removed == 900


# pipeline ---------------------------------------------------------------------


def test_language_stage_keeps_short_clean_texts(spark):
    import corpus_pipeline as pipeline

    more = [(900_001, "ok", "en", "a", 2), (900_002, "Hola", "es", "a", 4), (900_003, "No", None, None, None), (900_004, "12", "en", "a", 2), (900_005, None, "en", "a", 0)]
    docs = documents(spark).unionByName(spark.createDataFrame(more, DOCS).select(*[F.col(f.name).cast(f.dataType) for f in documents(spark).schema.fields]))
    kept = {r.doc_id for r in pipeline.known_language(spark, docs, SF).collect()}
    assert {900_001, 900_002, 900_003} <= kept and not {900_004, 900_005} & kept
    assert {r.doc_id for r in documents(spark).filter("text rlike '[a-z]'").collect()} - kept == set()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    strange = odd(spark).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = documents(spark).union(strange.select(*documents(spark).columns))
    seen = docs
    for _, stage in pipeline.STAGES[:3]:
        after = stage(spark, seen, SF)
        rows = after.collect()
        assert after.columns == docs.columns and not Counter(rows) - Counter(seen.collect())
        seen = spark.createDataFrame(rows, docs.schema)
    rows = seen.select("doc_id", "text").collect()
    assert [c for _, _, c in brute_classes([(r.doc_id, r.text) for r in rows if r.doc_id is not None], 5, 80)] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    mixed = pipeline.mixed(spark, seen, SF)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    assert pipeline.sharded(spark, mixed, SF).count() == mixed.count()


def test_pipeline_with_clashing_columns(spark):
    """Columns named like those that stages work with: no stage fails, and the rows are those of the plain table."""
    import corpus_pipeline as pipeline

    docs = documents(spark).filter("n_chars < 3000")
    names = ["__id", "digest", "matches", "component_id", "kept", "n_shingles", "lang_pred", "languages", "name", "row", "size", "shard", "slot", "text_crc32"]
    more = docs.withColumns({n: F.lit("mine") for n in names})
    for _, stage in pipeline.STAGES:
        docs, more = (stage(spark, d, SF) for d in (docs, more))
        assert set(names) <= set(more.columns)
        ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in (docs, more)]
        assert ids[0] == ids[1] and ids[0]


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_wide_parity_never_rules_out_a_link():
    rng = np.random.default_rng(7)
    ruled_out = 0
    for n in (1, 5, 900, 3000, 20000):
        for shared in (0.0, 0.5, 0.9, 0.92, 0.95, 1.0):
            for grown in (1.0, 1.1, 1.7):
                base = rng.integers(0, 2**64, int(n * (grown + 1)) + 2, dtype=np.uint64)
                keep = max(int(n * shared), 0)
                a = np.unique(base[:n])
                b = np.unique(np.concatenate([base[:keep], base[n : n + max(int(n * grown) - keep, 1)]]))
                both = len(np.intersect1d(a, b))
                union = len(a) + len(b) - both
                far = ngram_join.far_apart(ngram_join.wide(a), ngram_join.wide(b), len(a), len(b), 85)
                assert not (far and 100 * both >= 85 * union)
                ruled_out += far
    assert ruled_out > 20
