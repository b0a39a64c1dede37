"""Phrases against brute force, the graph's paths, and edge cases."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        frequent = {g: c for g, c in f.items() if c >= least and len(g) > 1}
        found = []
        for g, a in frequent.items():
            if any(100 * c >= 80 * a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) for h, c in frequent.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r)[:8] for r in phrases.mine(df, **how).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["the", "Cat", "sat", "ON", "mat", "été", "naïve", "x-y", "\x01", "a", "b"]
    passage = "copied words that stay together in every single text of the set"
    rows = []
    for i in range(160):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(60))
        if i % 3 == 0:
            text += " " + passage
        if i % 4 == 0:
            text += " go go go go go go"
        rows.append((text, rng.choice(["en", "de", None, "a b\tc"])))
    df = spark.createDataFrame([(i, t, x, "s", 1) for i, (t, x) in enumerate(rows)], DOCS).repartition(3)
    for least, top in ((5, 40), (2, 2000)):
        assert mined(df, least=least, top=top) == brute(rows, least, top)
    monkeypatch.setattr(phrases, "TOGETHER", 97)
    monkeypatch.setattr(phrases, "BUCKET", 1000)  # dozens of buckets, dealt in several rounds
    monkeypatch.setattr(phrases, "WAYS", 4)
    assert mined(df, least=5, top=None) == brute(rows, 5, None)


def test_batches_cut_anywhere(spark):
    df = spark.createDataFrame([(i, "one two three four five. one two three six" if i % 2 else "one two, one two three", "en", "s", 1) for i in range(40)], DOCS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert mined(df, least=2) == brute([(r.text, r.lang) for r in df.collect()], 2, 2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paths_hold_each_edge_once(spark):
    words = [f"w{i}" for i in range(400)]
    edges = [("en", " ".join(words[i : i + 4]), 7) for i in range(397)]
    edges += [("en", "x y z x", 5), ("en", "y z x y", 5), ("en", "z x y z", 5), ("de", "q q q q", 9)]  # a cycle and a loop
    edges += [("fr", "a b c d", 4), ("fr", "b c d e", 3), ("fr", "b c d f", 1), ("es", "a b c d", 4), ("es", "b c d e", 3)]  # a fork, and weights that differ
    paths = phrases.compact(spark.createDataFrame(edges, "lang string, gram string, w long")).collect()
    back = [(p.lang, " ".join(p.words[i : i + 4]), p.w) for p in paths for i in range(len(p.words) - 3)]
    assert sorted(back) == sorted(edges)
    assert len([p for p in paths if p.lang == "en"]) < 80 and max(len(p.words) for p in paths) > 10
    assert all(len(p.words) == 4 for p in paths if p.lang in ("de", "fr", "es"))


def test_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " \t ", "en"), (4, ".,;", "de"), (5, "long " * 60000, "en"), (None, "Go on", None), (None, "go ON", "und"), (6, "solo", "fr")]
    df = spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows], DOCS).withColumns({"w": F.lit("mine"), "gram": F.lit(1), "phrase": F.lit("x"), "n": F.lit(2)})
    want = brute([(t, x) for _, t, x in rows], 2, 2000)
    assert mined(df, least=2) == want and any(r[0] == "und" and r[2] == "go on" for r in want)
    none = df.filter("doc_id < 0")
    assert phrases.mine(none).count() == 0 and phrases.mine(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words"]
