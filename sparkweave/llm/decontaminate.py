"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

The index stores postings (document, position, term) of the training texts. Its
lists are looked up from the rarest terms of a test phrase on: a posting of a
term that stands at offset o of a phrase says where the phrase would start, so
lists are adjusted by their offsets and intersected by (document, start). A phrase
stands where all of its lists meet.

Lists are read in two steps. The ``LISTS`` rarest of every phrase are stored for all
documents; what they leave are the few places where a phrase may stand. The longer
lists are then stored for the documents of those places alone and intersected there.
A phrase with a term that no document has is dropped before. So what is stored and
shuffled follows the matches and not the corpus, and no posting carries text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.storage import materialize

WINDOW = 10
#: Lists of each phrase that are stored for all documents, the rarest first.
LISTS = 2
#: Rows and bytes of a table up to which each executor gets a copy.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 25
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before the words of each text, so that the index has a row for every document.
_MARK = ""


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters (lower-cased) and all that isn't ASCII."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")  # splitting is ten times as fast as extracting matches


def _small(df: DataFrame) -> DataFrame:
    """``df`` (materialized), to be copied to all executors if its counted rows and bytes allow it."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        text = F.array_join(F.col(name), "") if kind == "array<string>" else F.col(name).cast("string")
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    seen = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= BROADCAST_ROWS and seen["bytes"] <= BROADCAST_BYTES else df


def phrases(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, ws): the different windows of all items, and (wid, item_id): the items that have them."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    each = items.select("item_id", "ws", F.explode(starts).alias("at")).select("item_id", F.slice("ws", F.col("at"), window).alias("ws"))
    each = materialize(each.distinct(), "windows")
    numbered = materialize(each.select("ws").distinct().withColumn("wid", F.monotonically_increasing_id()), "phrases")
    return numbered, each.join(numbered, "ws").select("wid", "item_id")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two hashes of id and text name a row; rows equal in both are one document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text")


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` stands in all documents; those that don't have no row."""
    found = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return found.join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: k1, k2, term, pos of each place of ``terms``.

    The row of a document itself has an empty term, position -1, its id and its number of words.
    """
    each = keyed.select("doc_id", "k1", "k2", words(F.col("text")).alias("ws"))
    each = each.select("doc_id", "k1", "k2", F.size("ws").alias("size"), F.posexplode(F.concat(F.array(F.lit(_MARK)), F.col("ws"))).alias("pos", "term"))
    own = F.col("pos") == 0
    each = each.select(
        F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("size")).cast("long").alias("n_words"), "k1", "k2", "term", (F.col("pos") - 1).alias("pos")
    )
    mark = terms.sparkSession.range(1).select(F.lit(_MARK).alias("term"))
    wanted = materialize(terms.select("term").distinct().unionByName(mark), "terms")
    return each.join(_small(wanted), "term")


def _looked_up(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, term, off, rank, lists): the terms of each window whose terms all occur, the rarest first."""
    each = windows.select("wid", F.size("ws").alias("lists"), F.posexplode("ws").alias("off", "term"))
    known = each.join(counts, "term")
    own = Window.partitionBy("wid")
    return (
        known.withColumn("have", F.count("*").over(own))
        .where("have = lists")
        .withColumn("rank", F.row_number().over(own.orderBy("n", "off")))
        .select("wid", "term", "off", "rank", "lists")
    )


def build(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The stored index of the rarest lists, and the look-ups of all lists."""
    terms = materialize(windows.select(F.explode("ws").alias("term")).distinct(), "terms")
    counts = materialize(term_counts(docs, text_col, _small(terms)), "term-counts")
    lookups = materialize(_looked_up(windows, counts), "look-ups")
    index = materialize(postings(_keyed(docs, id_col, text_col), lookups.where(F.col("rank") <= LISTS)), "postings")
    return index, lookups


def _longer_lists(docs: DataFrame, places: DataFrame, lookups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, term, pos) of the lists that ``build`` left out, for the documents of ``places``."""
    those = materialize(places.select("k1", "k2").distinct(), "searched")
    terms = lookups.where(F.col("rank") > LISTS)
    found = postings(_keyed(docs, id_col, text_col).join(_small(those), ["k1", "k2"], "left_semi"), terms)
    return found.where("pos >= 0").select("k1", "k2", "term", "pos")


def _met() -> Column:
    """Which lists meet at a place, as bits; rows that repeat a document set the same ones."""
    return F.expr("bit_or(shiftleft(1L, rank - 1))").alias("met")


def _all_of(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def phrase_matches(docs: DataFrame, index: DataFrame, lookups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, wid, start, size): every place where a window's words stand consecutively."""
    key = ["k1", "k2", "wid", "start"]
    rare = _small(materialize(lookups.where(F.col("rank") <= LISTS), "rare-look-ups"))
    adjusted = index.where(F.col("pos") >= 0).join(rare, "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    met = adjusted.groupBy(*key, "lists").agg(_met())
    rarest = met.where(F.col("met") == _all_of(F.least("lists", F.lit(LISTS)))).select(*key, "lists")
    rarest = materialize(rarest, "candidates")
    whole = rarest.where(F.col("lists") <= LISTS)
    open_ = rarest.where(F.col("lists") > LISTS)
    longer = _longer_lists(docs, open_, lookups, id_col, text_col)
    rest = _small(materialize(lookups.where(F.col("rank") > LISTS).drop("lists"), "other-look-ups"))
    asked = open_.join(rest, "wid").withColumn("pos", (F.col("start") + F.col("off")).cast("int"))
    met = asked.join(longer.hint("merge"), ["k1", "k2", "term", "pos"]).groupBy(*key, "lists").agg(_met())
    stands = met.where(F.col("met") == _all_of(F.col("lists")) - _all_of(F.lit(LISTS))).select(*key, "lists")
    return whole.unionByName(stands).withColumnRenamed("lists", "size")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items, contaminated.

    A word is hit if it lies in any place where ``window`` consecutive words of
    an item (or all words of a shorter one) stand in the text. ``items`` are the
    ids of the items found, as sorted strings. Null texts and items without a
    word have nothing to hit; an item without an id hits but isn't listed; rows
    that repeat an id are judged each by its own text. Empty tables give zeros or
    no rows.
    """
    if not 1 <= window <= 63:
        raise ValueError("the lists that meet are bits of a long")
    windows, items = phrases(benchmark, item_col, item_text_col, window)
    index, lookups = build(docs, windows, id_col, text_col)
    found = materialize(phrase_matches(docs, index, lookups, id_col, text_col), "matches")
    places = found.select("k1", "k2", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct()
    hits = places.groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    named = found.select("k1", "k2", "wid").distinct().join(_small(materialize(items, "items")), "wid").where(F.col("item_id").isNotNull())
    listed = (
        named.select("k1", "k2", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    rows = index.where("pos < 0").select("doc_id", "k1", "k2", "n_words")
    nothing = F.array().cast("array<string>")
    return (
        rows.join(hits.join(listed, ["k1", "k2"], "left"), ["k1", "k2"], "left")
        .withColumn("items", F.coalesce("items", nothing))
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            "items",
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def proximity(
    docs: DataFrame,
    benchmark: DataFrame,
    distance: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """(doc_id, item_id, at): places where all terms of a window of an item stand within ``distance`` words of its rarest term.

    ``at`` is the place of the rarest term. Postings meet in stretches of
    ``distance`` words, each filed under its own and the stretches beside it, so
    a frequent term is compared with what is near it and not with its whole text.
    As for phrases, the rarest lists are intersected first and the longer ones are
    stored for the documents that are left. Null texts, items without a word or an
    id and empty tables give no rows.
    """
    windows, items = phrases(benchmark, item_col, item_text_col, window)
    different = windows.select("wid", F.array_distinct("ws").alias("ws"))
    index, lookups = build(docs, different, id_col, text_col)
    stretch = F.floor(F.col("pos") / F.lit(distance)).cast("long")
    place = ["k1", "k2", "wid", "at"]

    def beside(at: DataFrame, other: DataFrame) -> DataFrame:
        around = at.withColumn("s", F.floor(F.col("at") / F.lit(distance)).cast("long")).withColumn("s", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
        near = around.join(other.withColumn("s", stretch).hint("merge"), ["k1", "k2", "term", "s"]).where(F.abs(F.col("pos") - F.col("at")) <= distance)
        return near.groupBy(*place, "lists").agg(_met())

    rare = _small(materialize(lookups.where(F.col("rank") == 1).select("wid", "term", "lists"), "rarest"))
    at = index.where("pos >= 0").join(rare, "term").select("k1", "k2", "wid", F.col("pos").alias("at"), "lists").distinct()
    second = _small(materialize(lookups.where("rank > 1").where(F.col("rank") <= LISTS).select("wid", "term", "rank"), "second"))
    met = beside(at.where("lists > 1").join(second, "wid"), index.where("pos >= 0").select("k1", "k2", "term", "pos"))
    left = met.where(F.col("met") == _all_of(F.least("lists", F.lit(LISTS))) - 1).select(*place, "lists")
    left = materialize(at.where("lists = 1").unionByName(left), "near-candidates")
    open_ = left.where(F.col("lists") > LISTS)
    rest = _small(materialize(lookups.where(F.col("rank") > LISTS).select("wid", "term", "rank"), "other"))
    met = beside(open_.join(rest, "wid"), _longer_lists(docs, open_, lookups, id_col, text_col))
    stands = met.where(F.col("met") == _all_of(F.col("lists")) - _all_of(F.lit(LISTS))).select(*place)
    found = left.where(F.col("lists") <= LISTS).select(*place).unionByName(stands)
    names = index.where("pos < 0").select("doc_id", "k1", "k2").distinct()
    named = found.join(items.where(F.col("item_id").isNotNull()), "wid").join(names, ["k1", "k2"])
    return named.select("doc_id", "item_id", "at").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, each judged by its own text, also where ids repeat or are absent."""
    windows, _ = phrases(benchmark, "item_id", "text", WINDOW)
    index, lookups = build(docs, windows, id_col, text_col)
    bad = phrase_matches(docs, index, lookups, id_col, text_col).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    bad = materialize(bad, "contaminated")
    keyed = docs.select("*", F.xxhash64(id_col, text_col).alias("__k1"), F.xxhash64(text_col, id_col).alias("__k2"))
    own = (keyed["__k1"] == bad["__k1"]) & (keyed["__k2"] == bad["__k2"]) & keyed[text_col].isNotNull()
    return keyed.join(bad, own, "left_anti").drop("__k1", "__k2")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS s
  FROM (SELECT item_id, list_slice(ws, i, i + 9) AS w FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0))),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s
  FROM (SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, ks WHERE len(ws) >= k)),
m AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN it USING (rid)
"""

#: Words between which the registered query looks for the terms of a window.
NEAR = 12

NEAR_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS w FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
v AS (SELECT w, row_number() OVER () AS wid FROM (SELECT DISTINCT w FROM bw)),
t AS (SELECT wid, x, min(o) AS o FROM (SELECT wid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS o FROM v) GROUP BY wid, x),
p AS (SELECT rid, unnest(ws) AS x, unnest(range(0, len(ws))) AS i FROM d),
n AS (SELECT x, count(*) AS n FROM p WHERE x IN (SELECT x FROM t) GROUP BY x),
l AS (SELECT wid, x, count(*) OVER (PARTITION BY wid) AS size, row_number() OVER (PARTITION BY wid ORDER BY n, o) AS rank FROM t LEFT JOIN n USING (x) QUALIFY count(n) OVER (PARTITION BY wid) = size),
a AS (SELECT rid, wid, size, i AS place FROM l JOIN p USING (x) WHERE rank = 1),
m AS (SELECT a.rid, wid, place FROM a JOIN l USING (wid) JOIN p ON p.rid = a.rid AND p.x = l.x AND abs(p.i - place) <= 12 GROUP BY a.rid, wid, place, a.size HAVING count(DISTINCT l.x) = a.size)
SELECT DISTINCT doc_id, item_id, place AS "at" FROM m JOIN v USING (wid) JOIN bw USING (w) JOIN d USING (rid) WHERE item_id IS NOT NULL
"""
