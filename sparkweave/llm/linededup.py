"""Line dedup by content-defined chunks.

Lines are hashed, and a rolling hash over the line hashes chooses boundaries: of
each run of lines with ``MIN_WORDS`` words, the place where the hash of two lines
is the least. Equal runs have the same boundary wherever they stand, whatever is
inserted before or after. A boundary whose hash stands nowhere else lies in no
repeated passage and is dropped with its chunks; a chunk is a shortest run of
``MIN_WORDS`` words around a boundary that it chose. A single line of so many words
is a run of its own.

Of chunks with equal hashes the first (by document id, then place) stays. Chunks
of a document that repeat the same place are joined to segments, the lines of
both places are compared byte for byte, and what is equal is removed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.storage import discard, materialize

#: Words that a chunk has at least.
MIN_WORDS = 50
#: The rolling hash sees so many lines.
SEEN = 2
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def boundaries(keys: list[int], runs: list[tuple[int, int]]) -> Iterator[int]:
    """Of each run the first place with its least key. Neither the runs' beginnings nor their ends ever decrease."""
    kept: deque[int] = deque()
    reached = 0
    for a, b in runs:
        for i in range(max(reached, a), b):
            while kept and keys[kept[-1]] > keys[i]:
                kept.pop()
            kept.append(i)
        reached = max(reached, b)
        while kept[0] < a:
            kept.popleft()
        yield kept[0]


def chunks(lines: list[bytes]) -> set[tuple[int, int, int, int, int]]:
    """(first line, line after the last, hash, boundary's line, boundary's hash) of all chunks of a text."""
    n = len(lines)
    words = [len(x.split()) for x in lines]
    prefix, powers, total = [0], [1], [0]
    for x, w in zip(lines, words, strict=True):
        prefix.append((prefix[-1] * _BASE + xxhash.xxh64_intdigest(x) + 1) & _MASK)
        powers.append(powers[-1] * _BASE & _MASK)
        total.append(total[-1] + w)
    if total[n] < MIN_WORDS:
        return set()

    def rolled(a: int, b: int) -> int:
        return (prefix[b] - prefix[a] * powers[b - a]) & _MASK

    begin = end = 0
    onward, upto = [], []
    for i in range(n):  # the shortest run from each line on
        while end < n and total[end] - total[i] < MIN_WORDS:
            end += 1
        if total[end] - total[i] < MIN_WORDS:
            break
        onward.append((i, end))
    for i in range(1, n + 1):  # the shortest run up to each line
        while total[i] - total[begin + 1] >= MIN_WORDS:
            begin += 1
        if total[i] - total[begin] >= MIN_WORDS:
            upto.append((begin, i))
    # Lines without a word are no boundary; every run has others.
    pairs = [rolled(i, i + SEEN) if total[i + SEEN] > total[i] else _MASK + 1 for i in range(n - SEEN + 1)]
    out = set()
    for runs in (onward, upto):
        several = [(a, b) for a, b in runs if b - a >= SEEN]
        at = dict(zip(several, boundaries(pairs, [(a, b - SEEN + 1) for a, b in several]), strict=True))
        for a, b in runs:
            edge = at.get((a, b), a)
            out.add((a, b, rolled(a, b) - (1 << 63), edge, rolled(edge, min(edge + SEEN, b)) - (1 << 63)))
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            row, found = [], []
            for i, text in enumerate(part.column(3).cast(pa.binary())):
                own = chunks((text.as_py() or b"").split(b"\n"))
                row += [i] * len(own)
                found += own
            keys = [part.column(c).take(pa.array(row, pa.int64())) for c in range(3)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*keys, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))],
                names=["doc_id", "k1", "k2", "first", "last", "h", "edge", "edge_h"],
            )


def _keyed(docs: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    """Two hashes of id and text name a row: rows equal in both are one document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), carried.alias("row"))
    return source.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text", "row")


def _around_repeated(places: DataFrame) -> DataFrame:
    """The chunks whose boundaries stand in several places."""
    spot = F.xxhash64("k1", "k2", "edge")
    several = places.groupBy("edge_h").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a < b").select("edge_h")
    several = materialize(several, "boundaries")  # written, so that the join stands alone and a frequent boundary can be split
    found = materialize(places.join(several.hint("merge"), "edge_h", "left_semi").drop("edge", "edge_h"), "repeated-chunks")
    discard(several)
    return found


def _segments(places: DataFrame) -> DataFrame:
    """(k1, k2, first, last, o1, o2, shift): runs of lines that repeat the lines ``shift`` further on in the earlier document o1, o2."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2", "first")
    owners = places.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("owner")).where("n > 1")
    owners = materialize(owners, "owners")  # written, so that the join stands alone and a hot passage can be split
    repeats = (
        places.join(owners.hint("merge"), "h")
        .where("NOT (k1 = owner.k1 AND k2 = owner.k2 AND first = owner.first)")
        .select("k1", "k2", F.col("owner.k1").alias("o1"), F.col("owner.k2").alias("o2"), (F.col("owner.first") - F.col("first")).alias("shift"), "first", "last")
    )
    run = ["k1", "k2", "o1", "o2", "shift"]
    order = Window.partitionBy(*run).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.distinct().withColumn("new", F.when(F.col("first") <= reached, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*run, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted run of lines of a text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            row, first, last, data = [], [], [], []
            for i, (text, wanted) in enumerate(zip(part.column(2).cast(pa.binary()), part.column(3), strict=True)):
                lines = (text.as_py() or b"").split(b"\n")
                for w in wanted.as_py():
                    row.append(i)
                    first.append(w["first"])
                    last.append(w["last"])
                    data.append(b"\n".join(lines[w["first"] : w["last"]]))
            keys = [part.column(c).take(pa.array(row, pa.int64())) for c in range(2)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(data, pa.binary())],
                names=["o1", "o2", "o_first", "o_last", "data"],
            )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without those runs of lines that are, byte for byte, what they are said to repeat."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts, before, gone, words = [], [], [], []
            for text, found in zip(part.column(1).cast(pa.binary()), part.column(2), strict=True):
                text, out = text.as_py(), set()
                lines = (text or b"").split(b"\n")
                for s in found.as_py() or ():
                    if b"\n".join(lines[s["first"] : s["last"]]) == s["data"]:
                        out.update(range(s["first"], s["last"]))
                before.append(len(lines))
                gone.append(len(out))
                words.append(sum(len(lines[i].split()) for i in out))
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in (before, gone, words))],
                names=["row", "text", "n_lines", "n_removed", "removed_words"],
            )


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    """``carried`` as ``row``, text, n_lines, n_removed and removed_words of each row."""
    keyed = _keyed(docs, id_col, text_col, carried)
    kind = keyed.schema["doc_id"].dataType
    columns = {"k1": "long", "k2": "long", "first": "integer", "last": "integer", "h": "long", "edge": "integer", "edge_h": "long"}
    schema = T.StructType([T.StructField("doc_id", kind)])
    for name, type_ in columns.items():
        schema.add(name, type_)
    places = materialize(keyed.select("doc_id", "k1", "k2", "text").mapInArrow(_places, schema), "chunks")
    repeated = _around_repeated(places)
    discard(places)
    segments = materialize(_segments(repeated), "segments")
    discard(repeated)
    # What is repeated is cut out of its first document once, however many repeat it, and then joined to those that do.
    source = [F.col("o1"), F.col("o2"), (F.col("first") + F.col("shift")).alias("o_first"), (F.col("last") + F.col("shift")).alias("o_last")]
    wanted = segments.select(*source).distinct().groupBy("o1", "o2").agg(
        F.collect_list(F.struct(F.col("o_first").alias("first"), F.col("o_last").alias("last"))).alias("wanted")
    )
    texts = keyed.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), "text").join(wanted.hint("merge"), ["o1", "o2"])  # no side has a bound, so none is copied
    data = texts.select("o1", "o2", "text", "wanted").mapInArrow(_cut_out, "o1 long, o2 long, o_first int, o_last int, data binary")
    data = materialize(data.dropDuplicates(["o1", "o2", "o_first", "o_last"]), "repeated")
    # Written, so that the join stands alone and what a hot passage's thousands of places ask for can be split.
    repeats = segments.select("k1", "k2", "first", "last", *source).join(data.hint("merge"), ["o1", "o2", "o_first", "o_last"])
    found = repeats.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "data")).alias("found"))
    out = T.StructType(
        [T.StructField("row", keyed.schema["row"].dataType), T.StructField("text", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "removed_words")]
    )
    return keyed.join(found.hint("merge"), ["k1", "k2"], "left").select("row", "text", "found").mapInArrow(_removed, out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, its text without repeated chunks, n_lines, n_removed, removed_words.

    A run of lines with ``MIN_WORDS`` words or more that stands in several places
    stays where the document id is smallest (null last), there at its first
    place; shorter runs are never touched. Rows equal in id and text are one
    document and stay alike. Null texts stay null, texts of nothing but repeated
    lines become empty. No rows give no rows.
    """
    return _without_repeats(docs, id_col, text_col, F.col(id_col)).withColumnRenamed("row", "doc_id")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns, their texts without repeated chunks, and their lengths brought up to date if there is such a column."""
    others = [c for c in docs.columns if c != text_col]
    out = _without_repeats(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in others)))
    values = {c: F.col("row").getField(c) for c in others} | {text_col: F.col("text")}
    if length_col in docs.columns:
        values[length_col] = F.length("text").cast(docs.schema[length_col].dataType)
    return out.select(*(values[c].alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM d),
c AS (SELECT *, sum(nw) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS nw FROM l)),
w AS (SELECT *, upto - nw AS before FROM c WHERE nw > 0),
r AS (
  SELECT a.rid, a.doc_id, a.i AS f, b.i AS t FROM c a ASOF JOIN w b ON a.rid = b.rid AND a.upto - a.nw + 50 <= b.upto
  UNION SELECT b.rid, b.doc_id, a.i, b.i FROM c b ASOF JOIN w a ON b.rid = a.rid AND b.upto - 50 >= a.before),
s AS (SELECT r.rid, r.doc_id, f, t, array_to_string(list_slice(ls, f, t), chr(10)) AS s FROM r JOIN d USING (rid)),
p AS (SELECT rid, f, t, row_number() OVER (PARTITION BY s ORDER BY doc_id, f) AS place FROM s),
g AS (SELECT DISTINCT rid, unnest(range(f, t + 1)) AS i FROM p WHERE place > 1),
m AS (SELECT c.rid, c.i, x, nw, g.i IS NOT NULL AS gone FROM c LEFT JOIN g ON c.rid = g.rid AND c.i = g.i),
o AS (
  SELECT rid, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    CAST(coalesce(sum(nw) FILTER (WHERE gone), 0) AS BIGINT) AS removed_words
  FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, n_lines, n_removed, removed_words FROM d JOIN o USING (rid)
"""
