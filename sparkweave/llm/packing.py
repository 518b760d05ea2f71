"""Packing of token sequences by minimum bin slack.

Documents are cut into full windows and a rest. What remains is a multiset of
rest lengths, at most ``capacity`` different ones, however many documents there
are. The planner fills one kind of window after another: it takes the longest
rest left and lets a subset-sum dynamic program over a bitset of reachable
lengths pick the multiset of other rests that comes closest to capacity; counts
are found by walking back through the bitsets. A filling is used as many times
as the counts allow, so the plan is as long as there are fillings and not as
there are windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.tokens import encoder
from sparkweave.storage import materialize

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
#: Rows of equal length are numbered in at least so many parts, and in so many that a part has about so many rows.
SHARDS, SHARD_ROWS = 64, 1_000_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Full windows and the rest of each document: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` (little-endian unsigned 32-bit) if asked for.

    Every document has its end id, so an empty or null text is one piece of
    length 1. Rows that repeat an id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, start, length, crc, total, held = [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = known.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        piece = ids[4 * s : 4 * (s + capacity)]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            held.append(piece)
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                if with_ids:
                    columns.append(pa.array(held, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    longs = ["start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in longs)]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def closest(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """How many of each length to put beside one of ``first`` so that the window is as full as can be.

    Bit k of ``reach[i]`` says that the first i kinds of items can fill exactly
    k; an item is a length taken 1, 2, 4, ... times, so that counts are covered
    by a few shifts each. Longer lengths come first, and a window that is full
    ends the search.
    """
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    left = counts | {first: counts[first] - 1}
    reach, items = [1], []
    for length in sorted((n for n, c in left.items() if c > 0 and n <= room), reverse=True):
        most, size = min(left[length], room // length), 1
        while most > 0:
            take = min(size, most)
            now = reach[-1] | (reach[-1] << (take * length)) & mask
            most, size = most - take, size * 2
            if now != reach[-1]:
                items.append((length, take))
                reach.append(now)
        if reach[-1] >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    chosen = {first: 1}
    for i in range(len(items), 0, -1):
        length, take = items[i - 1]
        if not reach[i - 1] >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    assert at == 0
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}): fillings that use each length as often as it is there."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        first = max(left)
        chosen = closest(left, first, capacity)
        times = min(left[n] // c for n, c in chosen.items())
        out.append((times, chosen))
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return out


def _slots(fillings: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, count in a window, first sequence, offset of the first) of each length in each filling."""
    out, sequence, used = [], 0, {}
    for times, chosen in fillings:
        offset = 0
        for length in sorted(chosen, reverse=True):
            c = chosen[length]
            begin = used.get(length, 0)
            out.append((length, begin, begin + times * c, c, sequence, offset))
            used[length] = begin + times * c
            offset += c * length
        sequence += times
    return out


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (materialized pieces) with sequence_id and offset.

    Only the counts of lengths, ``capacity`` numbers at most, reach the driver.
    Pieces of one length are numbered in parts by hash, more parts where there are
    more pieces, so a length that a third of all pieces share is no single task's work.
    """
    spark = cut.sparkSession
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(SHARDS, max(counted.values(), default=0) // SHARD_ROWS)
    slots = _slots(plan(counted, capacity))
    fields = ["length", "low", "high", "each", "sequence", "at"]
    table = spark.createDataFrame(slots, ", ".join(f"{f} long" for f in fields))
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    rows = cut.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    shards = rows.groupBy("length", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("length", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "shard").orderBy(*keys)
    ranked = (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(bases, ["length", "shard"])
        .withColumn("rank", F.col("base") + F.col("inside"))
        .drop("shard", "base", "inside")
    )
    # A length's slots are an array in one row, of which the one that holds the rank is taken.
    bounds = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "sequence", "at"))).alias("slots"))
    found = ranked.join(F.broadcast(bounds), "length")  # a row for each of at most `capacity` lengths
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    return (
        found.withColumn("slot", slot)
        .withColumn("step", F.col("rank") - F.col("slot.low"))
        .withColumn("sequence_id", F.col("slot.sequence") + F.expr("step div slot.each"))
        .withColumn("offset", F.col("slot.at") + (F.col("step") % F.col("slot.each")) * F.col("length"))
        .drop("slots", "slot", "step", "rank")
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each stands. No rows give no rows."""
    cut = materialize(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    return assign(cut, capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, padded_length, ids) from pieces packed with their ids; ids are padded, except at a power of two."""
    gathered = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    n = F.col("n_tokens")
    padded = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(capacity).cast("long"))
    whole = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    padding = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast(padded_length - n_tokens AS int)))")
    return gathered.withColumn("padded_length", padded).select(
        "sequence_id",
        "n_tokens",
        "padded_length",
        F.concat(whole, padding).alias("ids"),
    )
