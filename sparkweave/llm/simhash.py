"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in vertical layout: bit plane b holds bit b of 64
fingerprints in each machine word. Distances of 64 fingerprints to one query are
kept in carry-save counter words and a word of lanes that are already too far; a
block whose lanes are all too far is abandoned.

Candidates come from the pigeonhole principle alone: of five blocks of bits two
differing bits leave three equal, so each distinct fingerprint is filed under its
ten choices of three blocks (38 bits or more). A file of more than ``BLOCK``
fingerprints is filed again by thirds of its free bits, of which one must be
equal too. Nothing is capped: every pair within the radius meets in some file.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.rows import keep_first, row_key
from sparkweave.operators.components import star_components
from sparkweave.storage import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes between two looks at which blocks can be abandoned.
LOOK = 16
#: Pairs of a query and a block that are compared at once; bounds memory.
AT_ONCE = 1 << 16
#: Shingles whose bits are counted at once; bounds memory for very long texts.
COUNTED = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all shingles, as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as a signed 64-bit integer."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masks(radius: int) -> list[tuple[int, list[int]]]:
    """For each choice of blocks: its mask, and the masks of radius + 1 parts of the other bits."""
    blocks = radius + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        own = [b for i in chosen for b in range(edges[i], edges[i + 1])]
        free = sorted(set(range(64)) - set(own))
        parts = [free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
        out.append((sum(1 << b for b in own), [sum(1 << b for b in p) for p in parts]))
    return out


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit b of value r is lane r % 64 of word r // 64 of plane b."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _lanes(first: np.ndarray, last: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Lanes of ``word`` that hold rows from ``first`` up to and without ``last``."""
    low = np.clip(first - word * 64, 0, 64)
    high = np.clip(last - word * 64, 0, 64)

    def below(k: np.ndarray) -> np.ndarray:
        return np.where(k >= 64, FULL, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))

    return below(high) & ~below(low)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``, compared from the highest bit on."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            over |= equal & counters[j]
            equal &= ~counters[j]
    return over


def near(values: np.ndarray, ends: np.ndarray, radius: int, begins: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers at ``radius`` or fewer differing bits; row i is compared with rows from ``begins[i]`` (the next one) up to ``ends[i]``.

    Each lane counts in as many carry-save words as the radius has bits; what
    overflows them is too far.
    """
    planes = bit_planes(values)
    rows = np.arange(len(values), dtype=np.int64)
    begins = rows + 1 if begins is None else begins
    first, last = begins >> 6, (ends - 1) >> 6
    spans = np.where(ends > begins, last - first + 1, 0)
    before = np.concatenate([[0], np.cumsum(spans)])
    total = int(before[-1])
    for at in range(0, total, AT_ONCE):
        index = np.arange(at, min(total, at + AT_ONCE))
        query = np.searchsorted(before, index, side="right") - 1
        word = first[query] + index - before[query]
        far = ~_lanes(begins[query], ends[query], word)
        counters = [np.zeros_like(far) for _ in range(max(1, radius.bit_length()))]
        asked = values[query]
        for b in range(64):
            carry = planes[b][word] ^ (np.uint64(0) - ((asked >> np.uint64(b)) & np.uint64(1)))
            for j, counter in enumerate(counters):
                counters[j], carry = counter ^ carry, counter & carry
            far |= carry
            if b % LOOK == LOOK - 1:
                far |= _beyond(counters, radius)
                alive = far != FULL
                if not alive.all():
                    query, word, asked, far = query[alive], word[alive], asked[alive], far[alive]
                    counters = [c[alive] for c in counters]
                if not len(query):
                    break
        if len(query):
            bits = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(bits)
            yield query[hit], word[hit] * 64 + lane


def forest(values: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (child, root): links that join what ``near`` finds, at most one a row."""
    root = np.arange(len(values), dtype=np.int64)
    for a, b in near(values, ends, radius):
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(values)))
    return child, root[child]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros((4, 0), dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            stops = np.append(change, len(values))
            sizes = np.diff(np.concatenate([[0], stops]))
            child, root = forest(values, np.repeat(stops, sizes), radius)
            out = values.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(out[child]), pa.array(out[root])], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            values = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, values = np.concatenate([held_key, keys], axis=1), np.concatenate([held, values])
            if not len(values):
                continue
            same = (keys == keys[:, -1:]).all(axis=0)
            cut = len(values) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield links(keys[:, :cut], values[:cut])
            held_key, held = keys[:, cut:], values[cut:]
        if len(held):
            yield links(held_key, held)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column ``fp`` that connect all pairs within the radius.

    The links of a file are a spanning forest of it, so their number grows with
    the rows and never with their pairs.
    """
    masks = _masks(radius)
    filed = distinct.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).cast("long").alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
                    for i, (m, _) in enumerate(masks)
                ]
            )
        ).alias("f"),
    ).select("fp", "f.c", "f.k")
    shared = filed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = filed.join(shared, ["c", "k"])
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("v")))
    parts = F.lit(None).cast("array<struct<p:bigint,v:bigint>>")
    for i, (_, thirds) in enumerate(masks):
        again = F.array(
            *[
                F.struct(F.lit(j).cast("long").alias("p"), F.col("fp").bitwiseAND(F.lit(_signed(t))).alias("v"))
                for j, t in enumerate(thirds)
            ]
        )
        parts = F.when(F.col("c") == i, again).otherwise(parts)
    files = rows.select("c", "k", "fp", F.explode(F.when(F.col("n") <= BLOCK, whole).otherwise(parts)).alias("s"))
    keys = ["c", "k", "p", "v"]
    dealt = files.select("c", "k", "s.p", "s.v", "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """(id, fp, component): each row with the smallest id that chains of near fingerprints reach from it.

    Rows are linked where their fingerprints differ in ``radius`` bits or fewer;
    empty, null and very short texts are linked like any other. Rows that repeat
    an id stay separate rows. A null id never names a component; a component
    without any id has a null one. No rows give no rows.
    """
    if not 0 <= radius <= 2:
        raise ValueError("files by equal blocks of bits are for a radius of 0, 1 or 2")
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    labels = star_components(fingerprint_links(distinct.select("fp"), radius), "a", "b")
    rooted = distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(rooted.join(named, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first by id (null last) and text.

    Rows are judged each by its own text, so those that repeat an id or have none
    stay or go like any other.
    """
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2")).alias("key"), F.col(text_col).alias("text"))
    found = near_duplicates(keyed, "key", "text", radius)
    return keep_first(docs, found.select("id.id", "id.k1", "id.k2", "component"), id_col, text_col)
