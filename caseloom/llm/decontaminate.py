"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``build_index`` stores the postings (term, document row, position) of every training token that any test
item has, sorted by term inside each file.  Each document also has one posting of the empty term, whose
position is its number of words, so nothing reads the texts a second time.

Phrase search, per window of an item: its two rarest terms, counted over the whole index, are looked
up; both lists are shifted by the terms' offsets and intersected.  What is left are diagonals
(document row, item, shift).  On each of them the lists of all the item's terms, again shifted, are
intersected with the diagonal, and runs of at least a window's length are the exact phrase matches.

A window that several items share is searched once, as the window of the first of them; the items
are attached to what was found.

Proximity search: a window is near where, seen from one of its three rarest words, all of its words stand within
``slop`` words of their places, but for one in ``window`` of them, which may be missing or unknown to the corpus.  Two of the
three must then stand close to each other; only such places are looked at in full.

Edge cases: null or word-less texts have no words and are never hit; word-less items have no window;
rows that repeat an id are judged, and dropped, one by one; items that share an id count once; a null item id reads as
the empty string in the digest; without items or without documents nothing is hit; windows of one word are never
near.  Very long texts and items are rows of one word each from the start.  Ties in rarity go by place and term.  Columns
beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import free_name, keep, read_table
from caseloom.llm.registry import query

WINDOW = 13
SLOP = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, in order: ASCII letters (made small), digits and everything beyond ASCII."""
    small = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(small, _NO_WORD, -1), "")


def broadcast_checked(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 16 << 20) -> DataFrame:
    """``df``, a kept table, as a broadcast side if it is measured to be small; else unchanged."""
    sizes = [F.octet_length(F.col(c)) for c, kind in df.dtypes if kind == "string"]
    sizes += [F.octet_length(F.to_json(F.col(c))) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(sizes, F.lit(0))).alias("b")).first()
    return F.broadcast(df) if row.n <= max_rows and (row.b or 0) <= max_bytes else df


def item_terms(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """``item, item_id, n, j, term``: the words of each item, ``n`` in all; kept."""
    numbered = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"),
        words_of(F.col(text)).alias("words"),
    )
    return keep(
        numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("j", "term")),
        "decon-items",
    )


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``term, row, pos, doc_id`` of the words in ``terms``.

    ``doc_id`` stands in the posting of the empty term only, at the position that is the number of words.
    """
    vocabulary = keep(terms.select("term").union(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct(), "decon-terms")
    numbered = docs.select(
        F.col(key).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.concat(words_of(F.col(text)), F.array(F.lit(""))).alias("words"),
    )
    placed = numbered.select("doc_id", "row", F.posexplode("words").alias("pos", "term"))
    found = placed.join(broadcast_checked(vocabulary), "term", "left_semi")
    listed = found.select("term", "row", "pos", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"))
    return keep(listed.sortWithinPartitions("term"), "decon-index")


def _spread(items: DataFrame, window: int, *columns: str) -> DataFrame:
    """Each word of an item once for every window it is in: ``item, start`` and ``columns``."""
    last = F.greatest(F.col("n") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("j") - (window - 1), F.lit(0)), F.least("j", last))
    return items.select("item", F.explode(starts).alias("start"), *columns)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, start, lead, lead_start``: each window, and the first window that has its words; kept."""
    words = _spread(items, window, "j", "term").groupBy("item", "start")
    said = words.agg(F.array_sort(F.collect_list(F.struct("j", "term"))).alias("words"))
    windows = keep(said.select("item", "start", F.array_join("words.term", " ").alias("words")), "decon-windows")
    first = windows.groupBy("words").agg(F.min(F.struct("item", "start")).alias("lead"))
    return keep(
        windows.join(first, "words").select("item", "start", F.col("lead.item").alias("lead"), F.col("lead.start").alias("lead_start")),
        "decon-leads",
    )


def ranked_words(items: DataFrame, index: DataFrame, window: int = WINDOW, leads: DataFrame | None = None) -> DataFrame:
    """``item, start, k, known``: of each window, or those in ``leads``, its size and its words that the index has, rarest first."""
    counts = index.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    spread = _spread(items.join(counts, "term", "left"), window, F.struct("freq", "j", "term").alias("word"))
    if leads is not None:
        spread = spread.join(leads, ["item", "start"], "left_semi")
    known = F.collect_list(F.when(F.col("word.freq").isNotNull(), F.col("word")))
    return spread.groupBy("item", "start").agg(F.count(F.lit(1)).alias("k"), F.array_sort(known).alias("known"))


def rare_pairs(items: DataFrame, index: DataFrame, window: int = WINDOW, ranked: DataFrame | None = None) -> DataFrame:
    """``item, first, second``: places and terms of the two rarest words of each window; kept.

    A window with a word that the index lacks occurs nowhere and is left out.  ``second`` is null for
    windows of one word.
    """
    ranked = ranked_words(items, index, window) if ranked is None else ranked
    words = [F.get("known", F.lit(i)) for i in range(2)]
    places = [F.struct(w.j.alias("j"), w.term.alias("term")) for w in words]
    whole = ranked.filter(F.size("known") == F.col("k"))
    pairs = whole.select("item", places[0].alias("first"), F.when(F.size("known") > 1, places[1]).alias("second"))
    return keep(pairs.distinct(), "decon-pairs")


def rare_postings(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postings of the windows' rare words, shifted: ``row, item, j, diagonal``; kept."""
    return anchor_postings(
        index, pairs.select("item", "first.*").union(pairs.filter("second is not null").select("item", "second.*"))
    )


def anchor_postings(index: DataFrame, anchors: DataFrame) -> DataFrame:
    hits = index.join(broadcast_checked(keep(anchors.distinct(), "decon-anchors")), "term")
    return keep(hits.select("row", "item", "j", (F.col("pos") - F.col("j")).alias("diagonal")), "decon-rare")


def phrase_matches(index: DataFrame, items: DataFrame, pairs: DataFrame, rare: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches ``row, item, j, start, stop``: document words that repeat a window or more of an item, from its word ``j`` on."""
    lists = keep(
        pairs.groupBy("item").agg(
            F.collect_list(F.struct(F.col("first.j").alias("a"), F.coalesce("second.j", "first.j").alias("b"))).alias("pairs")
        ),
        "decon-lists",
    )
    met = rare.groupBy("row", "item", "diagonal").agg(F.collect_set("j").alias("js"))
    both = F.exists("pairs", lambda p: F.array_contains("js", p.a) & F.array_contains("js", p.b))
    diagonals = keep(
        met.join(broadcast_checked(lists), "item").filter(both).select("row", "item", "diagonal"), "decon-diagonals"
    )
    expected = diagonals.join(broadcast_checked(items), "item").select(
        "row", "item", "diagonal", "n", "j", "term", (F.col("diagonal") + F.col("j")).alias("pos")
    )
    rows = keep(diagonals.select("row").distinct(), "decon-rows")
    there = index.select("row", "pos", "term").join(broadcast_checked(rows), "row", "left_semi")
    matched = expected.filter("pos >= 0").join(there, ["row", "pos", "term"])
    line = Window.partitionBy("row", "item", "diagonal").orderBy("j")
    runs = (
        matched.withColumn("run", F.col("j") - F.row_number().over(line))
        .groupBy("row", "item", "diagonal", "n", "run")
        .agg(F.min("pos").alias("start"), F.min("j").alias("j"), F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") >= F.least(F.col("n"), F.lit(window)))
    )
    return runs.select("row", "item", "n", "j", "start", (F.col("start") + F.col("size")).alias("stop"))


def proximity_matches(pairs: DataFrame, rare: DataFrame, slop: int = SLOP) -> DataFrame:
    """Near matches ``row, item``: two rarest words of a window at most ``slop`` words off their distance."""
    places = pairs.filter("second is not null").select(
        "item", F.col("first.j").alias("a"), F.col("second.j").alias("b")
    )
    bucket = F.floor(F.col("diagonal") / (slop + 1))
    places = broadcast_checked(keep(places.distinct(), "decon-places"))
    left = rare.withColumnRenamed("j", "a").join(places, ["item", "a"]).select("row", "item", "a", "b", "diagonal")
    left = left.withColumn("at", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed("diagonal", "d")
    right = rare.withColumnRenamed("j", "b").withColumn("at", bucket)
    near = left.join(right, ["row", "item", "b", "at"]).filter(F.abs(F.col("d") - F.col("diagonal")) <= slop)
    return near.select("row", "item").distinct()


def near_windows(
    index: DataFrame, items: DataFrame, ranked: DataFrame, slop: int = SLOP, window: int = WINDOW
) -> DataFrame:
    """``row, item, start``: windows near some place of a document, as the module says."""
    missing = F.floor(F.col("k") / window)
    able = ranked.filter((F.size("known") >= F.col("k") - missing) & (F.size("known") > 1))
    trios = keep(able.select("item", "start", "k", F.slice("known", 1, 3).alias("trio")), "decon-trios")
    rare = anchor_postings(index, trios.select("item", F.explode("trio").alias("word")).select("item", "word.j", "word.term"))
    places = trios.select("item", "start", "k", "trio", F.explode("trio.j").alias("a"))
    places = keep(places.select("item", "start", "k", "a", F.explode("trio.j").alias("b")).filter("a <> b"), "decon-places")
    # another of the three within slop of the first one's diagonal
    two = broadcast_checked(keep(places.select("item", "a", "b").distinct(), "decon-two"))
    width = 2 * slop + 1
    reach = lambda at: F.array_distinct(F.array(F.floor((at - slop) / width), F.floor((at + slop) / width)))
    left = rare.select("row", "item", F.col("j").alias("a"), F.col("diagonal").alias("d")).join(two, ["item", "a"])
    left = left.withColumn("at", F.explode(reach(F.col("d"))))
    right = rare.select("row", "item", F.col("j").alias("b"), "diagonal", F.floor(F.col("diagonal") / width).alias("at"))
    close = left.join(right, ["row", "item", "b", "at"]).filter(F.abs(F.col("d") - F.col("diagonal")) <= slop)
    seen = close.select("row", "item", "a", "b", "d").distinct().join(broadcast_checked(places), ["item", "a", "b"])
    candidates = keep(seen.select("row", "item", "start", "k", "d").distinct(), "decon-near")
    # all words of the window around that diagonal
    spelled = candidates.withColumn("j", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k").cast("int") - 1)))
    spelled = spelled.join(broadcast_checked(items.select("item", "j", "term")), ["item", "j"])
    spelled = spelled.withColumn("want", F.col("d") + F.col("j")).withColumn("at", F.explode(reach(F.col("want"))))
    rows = broadcast_checked(keep(candidates.select("row").distinct(), "decon-near-rows"))
    there = index.filter("term <> ''").select("row", "pos", "term").join(rows, "row", "left_semi")
    met = spelled.join(there.withColumn("at", F.floor(F.col("pos") / width)), ["row", "term", "at"])
    met = met.filter(F.abs(F.col("pos") - F.col("want")) <= slop)
    counted = met.groupBy("row", "item", "start", "k", "d").agg(F.count_distinct("j").alias("met"))
    return counted.filter(F.col("met") >= F.col("k") - missing).select("row", "item", "start").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, near: bool = False, slop: int = SLOP,
) -> DataFrame:
    """One row per row of ``docs``: its words, those that repeat items, and which items.

    ``near`` adds ``n_near_items``: items with a window near some place, but none that occurs.
    """
    terms = item_terms(items, item_key, item_text, window)
    index = build_index(docs, terms, key, text)
    windows = item_windows(terms, window)
    leads = windows.filter("item = lead and start = lead_start").select("item", "start")
    ranked = keep(ranked_words(terms, index, window, leads), "decon-ranked")
    pairs = rare_pairs(terms, index, window, ranked)
    spans = keep(phrase_matches(index, terms, pairs, rare_postings(index, pairs), window), "decon-spans")
    earlier = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    hit = (
        spans.withColumn("new", F.greatest(F.col("stop") - covered, F.lit(0))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    )
    last = F.col("j") + F.col("stop") - F.col("start") - F.least(F.col("n"), F.lit(window))
    found = spans.select("row", "item", F.explode(F.sequence(F.col("j"), last.cast("int"))).alias("start")).distinct()
    found = found.withColumn("exact", F.lit(True))
    if near:
        found = found.union(near_windows(index, terms, ranked, slop, window).withColumn("exact", F.lit(False)))
    names = terms.select("item", "item_id").distinct()
    owners = keep(
        windows.join(names, "item").select(F.col("lead").alias("item"), F.col("lead_start").alias("start"), "item_id").distinct(),
        "decon-owners",
    )
    owned = found.join(broadcast_checked(owners), ["item", "start"])
    listed = owned.groupBy("row").agg(
        F.collect_set(F.when(F.col("exact"), F.col("item_id"))).alias("items"),
        F.collect_set(F.when(~F.col("exact"), F.col("item_id"))).alias("near"),
    )
    base = index.filter("term = ''").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    exact, close = (F.coalesce(c, F.array().cast("array<string>")) for c in ("items", "near"))
    return base.join(hit, "row", "left").join(listed, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(exact).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(exact), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([F.size(F.array_except(close, exact)).cast("long").alias("n_near_items")] if near else []),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated ones; rows that share an id, or have none, are judged one by one."""
    mark = free_name(docs, "row")
    numbered = keep(docs.withColumn(mark, F.monotonically_increasing_id()), "decon-docs")
    found = contamination(numbered, items, mark, text, **options).filter("contaminated")
    return numbered.join(found.select(F.col("doc_id").alias(mark)), mark, "left_anti").select(*docs.columns)


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)
),
m AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, win)),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM m),
h AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY 1),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1
),
post AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
freq AS (SELECT term, count(*) AS freq FROM post GROUP BY 1),
ww AS (SELECT win, k, unnest(string_split(win, ' ')) AS term, unnest(range(0, k)) AS j FROM (SELECT DISTINCT win, k FROM bw) WHERE k > 1),
known AS (
  SELECT win, k, j, term, count(*) OVER (PARTITION BY win) AS there,
         row_number() OVER (PARTITION BY win ORDER BY freq, j) AS place
  FROM ww JOIN freq USING (term)
),
able AS (SELECT * FROM known WHERE there >= k - k // {WINDOW} AND there > 1 AND place <= 3),
seen AS (SELECT doc_id, win, k, j, pos - j AS d FROM able JOIN post USING (term)),
cand AS (
  SELECT DISTINCT x.doc_id, x.win, x.k, x.d FROM seen x JOIN seen y ON x.doc_id = y.doc_id AND x.win = y.win
  WHERE x.j <> y.j AND abs(x.d - y.d) <= {SLOP}
),
near AS (
  SELECT c.doc_id, c.win FROM cand c JOIN ww USING (win) JOIN post p ON p.doc_id = c.doc_id AND p.term = ww.term
  WHERE abs(p.pos - (c.d + ww.j)) <= {SLOP}
  GROUP BY c.doc_id, c.win, c.k, c.d HAVING count(DISTINCT ww.j) >= c.k - c.k // {WINDOW}
),
near_items AS (
  SELECT doc_id, count(DISTINCT CAST(bw.item_id AS VARCHAR)) AS n_near_items
  FROM near JOIN bw USING (win)
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = near.doc_id AND m.item_id = bw.item_id) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every row of ``documents`` repeats ``benchmark`` items, word by word or nearly."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), near=True)
