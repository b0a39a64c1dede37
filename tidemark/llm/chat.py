"""Chat formatting by quotation linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKS = r"^\s*((?:>\s?)+)"
TURNS_IN_BLOCK = 64


def normal(text: Column) -> Column:
    """Lower case, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """Add ``level`` by line, ``body`` (what is not quoted) and ``quotes`` (runs of lines of one level).

    The level of a line is the number of ``>`` marks it starts with. A line that ends in
    "wrote:" straight before a quote belongs to the quote and goes.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    df = messages.withColumn("__lines", lines)
    df = df.withColumn("__levels", F.transform("__lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))))
    df = df.withColumn("__plain", F.transform("__lines", lambda x: F.regexp_replace(x, MARKS, "")))
    at = F.sequence(F.lit(1), F.size("__lines"))
    heads = F.filter(at, lambda i: (i == 1) | (F.element_at("__levels", i) != F.element_at("__levels", F.greatest(i - 1, F.lit(1)))))
    df = df.withColumn("__heads", heads)
    ends = F.transform("__heads", lambda h, k: F.coalesce(F.get("__heads", k + 1), F.size("__lines") + 1))
    df = df.withColumn("__runs", F.zip_with("__heads", ends, lambda h, e: F.struct(F.element_at("__levels", h).alias("level"), F.slice("__plain", h, e - h).alias("lines"), h.alias("line"))))
    quotes = F.transform(F.filter("__runs", lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), r["line"].alias("line"), r["lines"].alias("lines")))
    body_at = F.filter(
        at,
        lambda i: (F.element_at("__levels", i) == 0)
        & ~(F.element_at("__lines", i).rlike(r"wrote:\s*$") & (F.coalesce(F.get("__levels", i), F.lit(0)) > 0)),
    )
    body = F.array_join(F.transform(body_at, lambda i: F.element_at("__lines", i)), "\n")
    df = df.withColumn("quotes", F.when(F.col("text").isNull(), F.array().cast("array<struct<level:int,line:int,lines:array<string>>>")).otherwise(quotes))
    df = df.withColumn("body", F.when(F.col("text").isNull(), None).otherwise(F.regexp_replace(F.regexp_replace(body, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")))
    return df.drop("__lines", "__levels", "__plain", "__heads", "__runs")


def latest_before(rows: DataFrame, keys: list[str], original: Column) -> DataFrame:
    """Add ``found`` to rows (keys, turn): the latest turn of an ``original`` row of the same keys before the row's own, or null.

    Turns are taken in blocks of ``TURNS_IN_BLOCK``: a window inside each, and one over the
    latest original of each block, so no task sorts all rows of a key.
    """
    rows = rows.withColumn("__block", F.floor(F.col("turn") / TURNS_IN_BLOCK)).withColumn("__original", F.when(original, F.col("turn")))
    last = rows.groupBy(*keys, "__block").agg(F.max("__original").alias("__last"))
    earlier = F.max("__last").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("__earlier", earlier).select(*[F.col(c).alias(f"__b_{c}") for c in [*keys, "__block"]], "__earlier")
    inside = Window.partitionBy(*keys, "__block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__inside", F.max("__original").over(inside))
    out = out.join(last, [F.col(c) == F.col(f"__b_{c}") for c in [*keys, "__block"]]).withColumn("found", F.coalesce("__inside", "__earlier"))
    return out.drop("__block", "__original", "__inside", "__earlier", *[f"__b_{c}" for c in [*keys, "__block"]])


def link(messages: DataFrame) -> DataFrame:
    """Join quoted passages to the messages they quote.

    ``messages`` has conv_id, turn, role and text. Returns its columns (those named like a
    new one are replaced) with body, n_quotes, n_linked, parent_turn, quoted (the parent was
    found by a quote) and position.

    A passage is looked up among the earlier messages of its conversation by the hash of its
    normalised text: as a whole body first, else line by line. The parent is the message that
    a level-1 quote names (whole bodies before lines, then the most letters, then the latest);
    deeper levels only count as linked. Without one, the parent is the turn before it that the
    conversation has, none for the first. Position orders a conversation by (parent_turn, turn),
    so every message stands after its parent and replies to one message stand together; it
    counts the rows before, so rows alike in turn, role and text share theirs. Null conv_id: no
    parent, and position 1; null turn: no parent, after the others. Equal (conv_id, turn) share
    their links. Blank passages never link. Links and positions come from windows over blocks
    of turns on narrow rows, so a long conversation isn't sorted in one task.
    """
    df = parse(messages.drop("body", "quotes", "n_quotes", "n_linked", "parent_turn", "quoted", "position"))

    def passages(lines: Column, level: Column, line: Column) -> Column:
        """The text of lines as a whole (kind 2), and each line (kind 1)."""
        item = lambda x, kind: F.struct(level.alias("level"), line.alias("line"), F.lit(kind).alias("kind"), x.alias("passage"))
        return F.concat(F.array(item(normal(F.array_join(lines, "\n")), 2)), F.transform(lines, lambda x: item(normal(x), 1)))

    none = F.lit(None).cast("int")
    own = F.when(F.col("body").isNotNull(), passages(F.split("body", "\n", -1), none, none))
    asked = F.flatten(F.transform("quotes", lambda q: passages(q["lines"], q["level"], q["line"])))
    said = df.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(F.filter(F.concat(F.coalesce(own, F.array().cast("array<struct<level:int,line:int,kind:int,passage:string>>")), asked), lambda x: x["passage"] != "")).alias("k"))
    said = said.select("conv_id", "turn", "k.level", "k.line", "k.kind", F.xxhash64("k.passage").alias("hash"), F.md5("k.passage").alias("md5"), F.when(F.col("k.level").isNotNull(), F.length("k.passage")).alias("letters")).distinct()
    # of all messages with the passage only the latest one before the quote counts: a sorted union instead of pairs
    hits = latest_before(said, ["conv_id", "hash", "md5", "kind"], F.col("level").isNull()).filter("level IS NOT NULL AND found IS NOT NULL")
    by_message = hits.groupBy("conv_id", "turn", "level", "line", "kind", "found").agg(F.sum("letters").alias("letters"))
    best = by_message.groupBy("conv_id", "turn", "level", "line").agg(F.max(F.struct("kind", "letters", "found")).alias("best"))
    per = best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("best"))).alias("best"))
    turns = df.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    turns = latest_before(turns, ["conv_id"], F.lit(True)).join(per, ["conv_id", "turn"], "left")
    turns = turns.select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), F.col("n_linked").alias("l_linked"), F.col("best.found").alias("l_parent"), F.col("found").alias("l_before"))
    out = df.join(turns, (F.col("conv_id") == F.col("l_conv")) & (F.col("turn") == F.col("l_turn")), "left")
    out = out.withColumn("n_quotes", F.size("quotes")).withColumn("n_linked", F.coalesce("l_linked", F.lit(0)).cast("long")).withColumn("quoted", F.col("l_parent").isNotNull())
    out = out.withColumn("parent_turn", F.coalesce("l_parent", "l_before")).drop("l_conv", "l_turn", "l_linked", "l_parent", "l_before", "quotes")
    return _positions(out)


def _positions(df: DataFrame) -> DataFrame:
    """Rank by (parent_turn, turn) in each conversation: counts of like rows, summed inside a block of turns, over the blocks of 64 parents, and over these."""
    df = df.withColumn("__digest", F.md5("text"))
    parents = F.coalesce(F.floor(F.col("parent_turn") / TURNS_IN_BLOCK), F.lit(-1)).cast("long").alias("__parents")
    own = ["conv_id", "parent_turn", "turn", "role", "__digest"]
    rows = df.filter("conv_id IS NOT NULL").groupBy(*own).agg(F.count("*").alias("n"))
    rows = rows.select("*", parents, F.floor(F.col("turn") / TURNS_IN_BLOCK).alias("__turns"))
    parent, turn = F.col("parent_turn").asc_nulls_first(), F.col("__turns").asc_nulls_last()
    upto = (Window.unboundedPreceding, -1)
    small = rows.groupBy("conv_id", "__parents", "parent_turn", "__turns").agg(F.sum("n").alias("n"))
    large = small.groupBy("conv_id", "__parents").agg(F.sum("n").alias("n"))
    large = large.select(F.col("conv_id").alias("a_conv"), F.col("__parents").alias("a_parents"), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("__parents").rowsBetween(*upto)), F.lit(0)).alias("a"))
    small = small.withColumn("b", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "__parents").orderBy(parent, turn).rowsBetween(*upto)), F.lit(0)))
    small = small.join(large, (F.col("conv_id") == F.col("a_conv")) & (F.col("__parents") == F.col("a_parents")))
    small = small.select(F.col("conv_id").alias("b_conv"), F.col("parent_turn").alias("b_parent"), F.col("__turns").alias("b_turns"), (F.col("a") + F.col("b")).alias("base"))
    inside = Window.partitionBy("conv_id", "parent_turn", "__turns").orderBy(F.col("turn").asc_nulls_last(), "role", "__digest").rowsBetween(*upto)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    match = (F.col("conv_id") == F.col("b_conv")) & F.col("parent_turn").eqNullSafe(F.col("b_parent")) & F.col("__turns").eqNullSafe(F.col("b_turns"))
    rows = rows.join(small, match).select(*[F.col(c).alias(f"p_{c}") for c in own], (F.col("base") + F.col("before") + 1).cast("long").alias("__position"))
    same = F.col("conv_id") == F.col("p_conv_id")
    for c in own[1:]:
        same &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    out = df.join(rows, same, "left").withColumn("position", F.coalesce("__position", F.lit(1)).cast("long"))
    return out.drop("__digest", "__position", *[f"p_{c}" for c in own])


def to_chat(messages: DataFrame) -> DataFrame:
    """One row per conversation: its messages (role, content) in reply order, empty ones left out.

    A conversation becomes one value, so its length is bounded by what a row may hold.
    """
    linked = link(messages).filter("body IS NOT NULL AND body <> ''")
    item = F.struct("position", "role", F.col("body").alias("content"))
    turns = F.transform(F.sort_array(F.collect_list(item)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return linked.groupBy("conv_id").agg(turns.alias("messages"))


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
v AS (
  SELECT *, list_transform(l, lambda x: length(regexp_replace(regexp_extract(x, '^\s*((?:>\s?)+)', 1), '[^>]', '', 'g'))) AS lv,
         list_transform(l, lambda x: regexp_replace(x, '^\s*((?:>\s?)+)', '')) AS pl, row_number() OVER () AS id FROM m),
h AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR lv[i] <> lv[i - 1]) AS heads FROM v),
b AS (
  SELECT *, CASE WHEN text IS NOT NULL THEN regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(range(1, len(l) + 1),
           lambda i: lv[i] = 0 AND NOT (regexp_matches(l[i], 'wrote:\s*$') AND coalesce(lv[i + 1], 0) > 0)), lambda i: l[i]), chr(10)), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') END AS body,
         CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(heads, lambda i: lv[i] > 0)) END::INTEGER AS n_quotes FROM h),
e AS (SELECT *, unnest(heads) AS hd FROM b),
q AS (
  SELECT conv_id, turn, lv[hd] AS level, hd AS line, pl[hd : coalesce(list_min(list_filter(heads, lambda i: i > hd)), len(l) + 1) - 1] AS ls
  FROM e WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL AND lv[hd] > 0),
o AS (
  SELECT DISTINCT conv_id, turn, 2 AS kind, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS p FROM b WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND body IS NOT NULL
  UNION SELECT conv_id, turn, 1, trim(regexp_replace(lower(unnest(string_split(body, chr(10)))), '\s+', ' ', 'g')) FROM b WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND body IS NOT NULL),
a AS (
  SELECT DISTINCT conv_id, turn, level, line, 2 AS kind, trim(regexp_replace(lower(array_to_string(ls, chr(10))), '\s+', ' ', 'g')) AS p FROM q
  UNION SELECT conv_id, turn, level, line, 1, trim(regexp_replace(lower(unnest(ls)), '\s+', ' ', 'g')) FROM q),
f AS (
  SELECT a.conv_id, a.turn, a.level, a.line, a.kind, a.p, max(o.turn) AS found
  FROM a JOIN o ON o.conv_id = a.conv_id AND o.kind = a.kind AND o.p = a.p AND o.turn < a.turn WHERE a.p <> '' GROUP BY ALL),
s AS (SELECT conv_id, turn, level, line, kind, found, sum(length(p)) AS letters FROM f GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, level, line ORDER BY kind DESC, letters DESC, found DESC) AS r FROM s),
k AS (
  SELECT conv_id, turn, count(*) AS n_linked, max(CASE WHEN level = 1 THEN {'kind': kind, 'letters': letters, 'found': found} END).found AS found
  FROM g WHERE r = 1 GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
x AS (
  SELECT b.conv_id, b.turn, b.role, b.text, b.body, b.n_quotes, coalesce(k.n_linked, 0)::BIGINT AS n_linked, coalesce(k.found, t.prev) AS parent_turn
  FROM b LEFT JOIN t ON t.conv_id = b.conv_id AND t.turn = b.turn LEFT JOIN k ON k.conv_id = b.conv_id AND k.turn = b.turn)
SELECT * EXCLUDE (text), CASE WHEN conv_id IS NULL THEN 1 ELSE rank() OVER (PARTITION BY conv_id ORDER BY parent_turn NULLS FIRST, turn NULLS LAST, role NULLS FIRST, md5(text) NULLS FIRST) END::BIGINT AS position FROM x
"""
