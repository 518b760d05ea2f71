"""SimHash near-duplicates whose texts are then compared: five-word shingles, a Jaccard similarity of 0.8 or more.

Texts that are so similar differ in about ten of 64 fingerprint bits, too many for
files of equal blocks of bits. So fingerprints are filed by shingles: shingles are
put in one order for all documents, frequent ones last; of two sets that are similar
enough, the first shingle that both have lies within the first n - ceil(0.8 n) + 1
of each, so documents are filed under those alone. How frequent shingles are is
guessed from a sample of documents; any order finds the same pairs, a good one
compares fewer.

In a file fingerprints are compared bit-sliced, up to ``RADIUS`` bits. Bits of two
texts at the limit differ with a chance of 0.19 at most (four shingles of five), so
one such pair in ten million is further apart. Whatever is within the radius and may
be similar by its size and place in the file is compared shingle by shingle.

Neighbours by size within files are compared first. Of the rest only what isn't
joined by then is compared, so a group of many near copies takes about as many
comparisons as it has rows in files, and not their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.rows import keep_first, row_key
from sparkweave.llm.simhash import majority, near
from sparkweave.operators.components import star_components
from sparkweave.storage import discard, materialize

SHINGLE = 5
#: Similarity from which two documents are near-duplicates, as a fraction.
PART, WHOLE = 4, 5
SEED = 42
#: Differing bits up to which texts are compared.
RADIUS = 28
#: Rows of a file that are compared at once; a larger file is dealt out by pairs of such blocks.
BLOCK = 4096
#: Rows of a table of documents asked for (four longs each) up to which each executor gets a copy.
BROADCAST_ROWS = 500_000
#: One document in so many is looked at for frequent shingles; those seen so often there are ordered by that, at most so many of them.
SAMPLED, OFTEN, ORDERED = 8, 3, 200_000


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The different XXH64 of all runs of ``size`` words, ascending; a shorter text is one run."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(min(size, len(words)))), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=max(1, len(words) - size + 1))
    return np.unique(hashes.view(np.int64))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            found = [shingles(t.as_py()) for t in batch.column(0).slice(at, 256).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])


def _frequent(docs: DataFrame, key: Column, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled documents have, ascending, and how many."""
    sample = docs.where(F.pmod(key, F.lit(SAMPLED)) == 0).select(F.col(text_col).alias("text"))
    counted = sample.mapInArrow(_each, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    rows = sorted((r["h"], r["n"]) for r in counted.orderBy(F.desc("n"), "h").limit(ORDERED).collect())
    return np.array([h for h, _ in rows], dtype=np.int64), np.array([n for _, n in rows], dtype=np.int64)


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of ``found`` by (frequency, hash), as many as a near-duplicate can't all be without."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
    return found[np.argsort(rank, kind="stable")[: n + (-n * PART // WHOLE) + 1]]


def _sets(frequent: np.ndarray, counts: np.ndarray):
    """A row for each document; sets that a task has met before aren't filed again, so no file is hot by copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t.as_py()) for t in part.column(3).cast(pa.binary())]
                names = [xxhash.xxh64_intdigest(s.tobytes()) for s in found]
                first = []
                for name, s in zip(names, found, strict=True):
                    first.append(found[0][:0] if name in met else prefix(s, frequent, counts))
                    met.add(name)
                if len(met) > 1 << 20:
                    met.clear()
                ends = np.concatenate([[0], np.cumsum([len(p) for p in first])])
                filed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))
                v = pa.array(np.array(names, dtype=np.uint64).view(np.int64))
                fp = pa.array([majority(s.view(np.uint64)) for s in found], pa.int64())
                n = pa.array([len(s) for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], v, fp, n, filed], names=["id", "k1", "k2", "v", "fp", "n", "filed"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, v, fp, size) in order: those of files with more than one set, each set once."""
    held, met = np.zeros((4, 0), dtype=np.int64), False  # the last row, and whether one of its file stands before it
    names = ["h", "v", "fp", "size"]
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))]
        follows = rows[0, 1:] == rows[0, :-1]
        after = np.append(met, follows)
        kept = rows[:, :-1][:, after[:-1] | follows]
        held, met = rows[:, -1:], bool(after[-1])
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in kept], names=names)
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names=names)


def _may(size, other):
    """Whether two sets whose first shared shingle stands at these places can be similar enough. A size is n << 32 | place; columns or arrays."""
    n, m = size >> 32, other >> 32
    least = np.minimum(n - (size & 0xFFFFFFFF), m - (other & 0xFFFFFFFF))
    return (PART + WHOLE) * least >= PART * (n + m)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of sets of different labels within the radius, from rows (h, low, high, block, v, fp, size, label) in order.

    Rows of one block meet each other, rows of two blocks those of the other one.
    """
    held = np.zeros((8, 0), dtype=np.int64)

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.shape[1]
        stops = np.append(np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1, n)
        ends = np.repeat(stops, np.diff(np.append(0, stops)))
        begins = np.arange(1, n + 1)
        apart = rows[1] != rows[2]
        inner = np.append(np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1, n)
        begins = np.where(apart, np.repeat(inner, np.diff(np.append(0, inner))), begins)
        _, v, fp, size, label = rows[3], rows[4], rows[5], rows[6], rows[7]
        for a, b in near(fp.view(np.uint64), ends, RADIUS, begins):
            good = (label[a] != label[b]) & _may(size[a], size[b])
            x, y = v[a[good]], v[b[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        same = (rows[:3] == rows[:3, -1:]).all(axis=0)
        cut = 0 if same.all() else rows.shape[1] - int(np.argmin(same[::-1]))
        if cut:
            yield from pairs(rows[:, :cut])
        held = rows[:, cut:]
    if held.shape[1]:
        yield from pairs(held)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts x, y are similar enough."""
    for batch in batches:
        good, last, x = [], None, np.zeros(0)
        for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
            if a != last:
                last, x = a, shingles(s.as_py())
            y = shingles(t.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(WHOLE * both >= PART * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near-duplicates."""
    pairs = materialize(pairs.distinct(), f"{label}-pairs")
    asked = pairs.select(F.col("a").alias("v")).unionAll(pairs.select(F.col("b").alias("v"))).distinct()
    one = rows.join(asked, "v").groupBy("v").agg(F.min(F.struct("k1", "k2")).alias("k")).select("v", "k.k1", "k.k2")
    one = materialize(one, f"{label}-asked")
    texts = materialize(docs.join(_small(one), ["k1", "k2"]).select("v", "text").dropDuplicates(["v"]), f"{label}-texts")
    left = texts.select(F.col("v").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")  # no side has a bound, so none is copied
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), f"{label}-links")
    for done in (texts, one, pairs):
        discard(done)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, component) for each row of ``docs``: rows that chains of near-duplicates join have one component.

    Two rows are near-duplicates if the different shingles of both are at least
    ``PART`` / ``WHOLE`` of the different shingles of either. A text of fewer words
    than a shingle is one shingle; texts without a word are alike. k1 and k2 are the
    ``row_key``. No rows give no rows.
    """
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("k1", "k2", "v", "fp", "n")]
    schema = T.StructType([keyed.schema["id"], *longs, T.StructField("filed", T.ArrayType(T.LongType()))])
    frequent = _frequent(docs, k1, text_col)
    sets = materialize(keyed.mapInArrow(_sets(*frequent), schema), "shingle-sets")
    filed = sets.select("v", "fp", "n", F.posexplode("filed").alias("pos", "h"))
    filed = filed.select("h", "v", "fp", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("size"))
    dealt = filed.repartition("h").sortWithinPartitions("h", "v")
    shared = materialize(dealt.mapInArrow(_shared, "h long, v long, fp long, size long"), "shared-shingles")
    rows = materialize(sets.select("id", "k1", "k2", "v"), "named-sets")
    discard(sets)
    texts = keyed.select("k1", "k2", "text")

    order = Window.partitionBy("h").orderBy("size", "v")
    beside = shared.select("*", *(F.lag(c).over(order).alias(f"other_{c}") for c in ("v", "fp", "size")))
    n, m = (F.shiftright(c, 32) for c in ("size", "other_size"))
    place, other_place = (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("size", "other_size"))
    may = (PART + WHOLE) * F.least(n - place, m - other_place) >= PART * (n + m)
    beside = beside.where(may & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= RADIUS))
    links = _verified(beside.select(F.least("v", "other_v").alias("a"), F.greatest("v", "other_v").alias("b")), rows, texts, "beside")

    joined = materialize(star_components(links, "a", "b"), "joined")
    discard(links)
    placed = shared.join(joined.withColumnRenamed("id", "v"), "v", "left").withColumn("label", F.coalesce("label", "v"))
    placed = materialize(placed, "placed")
    discard(shared)
    apart = placed.groupBy("h").agg((F.min("label") < F.max("label")).alias("several"), F.count("*").alias("rows")).where("several").select("h", "rows")
    apart = materialize(apart, "open-files")
    blocks = placed.join(apart.hint("merge"), "h").select("*", F.expr(f"(row_number() OVER (PARTITION BY h ORDER BY size, v) - 1) div {BLOCK}").alias("block"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {BLOCK}"))).alias("other")
    blocks = blocks.select("h", "block", "v", "fp", "size", "label", others)
    blocks = blocks.select("h", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "v", "fp", "size", "label")
    keys = ["h", "low", "high"]
    across = blocks.repartition(*keys).sortWithinPartitions(*keys, "block", "size", "v").mapInArrow(_compared, "a long, b long")
    rest = _verified(across, rows, texts, "across")
    discard(placed)
    discard(apart)
    labels = materialize(star_components(joined.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(rest), "a", "b"), "labels")
    discard(joined)
    discard(rest)
    named = rows.join(labels.withColumnRenamed("id", "v"), "v", "left")
    return named.select("id", "k1", "k2", F.coalesce("label", "v").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first by id (null last) and text."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
