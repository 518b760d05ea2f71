"""Operators on sequences: DataFrames with ``idx`` (long, distinct) and ``value``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators.scan import prefix_scan


def new_array(spark: SparkSession, n: int, value) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(value).alias("value"))


#: Values that one task of a general reduction folds at a time.
CHUNK = 1024


def _fold(seq: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """One row, ``value``, by an associative ``op`` that keeps the order: chunks of consecutive places are folded, then what they came to, and so on.

    A chunk has ``CHUNK`` places at most, so no task or row grows with the sequence.
    """
    ends = seq.agg(F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if ends["low"] is None:
        return seq.agg(F.max("value").alias("value"))
    span = ends["high"] - ends["low"] + 1
    level = seq.select((F.col("idx") - ends["low"]).alias("idx"), "value")
    while True:
        inside = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda r: r["value"])
        rest = F.slice("all", 2, F.size("all"))
        chunks = level.groupBy(F.floor(F.col("idx") / CHUNK).cast("long").alias("idx")).agg(inside.alias("all"))
        level = chunks.select("idx", F.aggregate(rest, F.col("all")[0], lambda a, b: op(a, b)).alias("value"))
        span = -(-span // CHUNK)
        if span == 1:
            return level.select("value")


def reduce(seq: DataFrame, op: str | Callable[[Column, Column], Column] = "sum") -> DataFrame:
    """One row, ``value``; null of no rows. ``op`` is sum, min or max, which pass over nulls, or any associative function of two values, which must give their type and is handed nulls too."""
    if callable(op):
        return _fold(seq.select("idx", "value"), op)
    return seq.agg({"sum": F.sum, "min": F.min, "max": F.max}[op]("value").alias("value"))


def map_reduce(seq: DataFrame, map_: Callable[[Column], Column], op: str | Callable[[Column, Column], Column] = "sum") -> DataFrame:
    return reduce(seq.select("idx", map_(F.col("value")).alias("value")), op)


def max_index(seq: DataFrame, better: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row, ``idx``: where the largest value stands, or the one ``better`` (a strict order: is the first better than the second) than all others; the first of them. Null values are never largest."""
    known = seq.where(F.col("value").isNotNull())
    if better is None:
        return known.agg(F.max_by("idx", F.struct("value", (-F.col("idx")).alias("first"))).alias("idx"))
    pairs = known.select("idx", F.struct("value", "idx").alias("value"))
    best = _fold(pairs, lambda a, b: F.when(better(b["value"], a["value"]), b).otherwise(a))
    return best.select(F.col("value.idx").alias("idx"))


def scan(seq: DataFrame, op: str = "sum", inclusive: bool = False, backward: bool = False) -> DataFrame:
    """(idx, value): of each row ``op`` over the values before it (after it if backward), with its own if inclusive."""
    out = prefix_scan(seq.select("idx", "value"), ["idx"], {"scanned": "value"}, op, inclusive, backward)
    return out.select("idx", F.col("scanned").alias("value"))


def enumerate_flags(seq: DataFrame, flag: Column) -> DataFrame:
    """(idx, value): how many rows before each have the flag."""
    return scan(seq.select("idx", flag.cast("long").alias("value")))


def sum_flags(seq: DataFrame, flag: Column) -> DataFrame:
    return seq.agg(F.count_if(flag).alias("value"))


def filter_seq(seq: DataFrame, keep: Column) -> DataFrame:
    """Rows that ``keep`` holds for, with their old places."""
    return seq.where(keep)


def pack(seq: DataFrame, flag: Column) -> DataFrame:
    """(idx, value) of flagged rows in their order, numbered anew from 0."""
    kept = seq.where(flag).select("idx", "value").withColumn("one", F.lit(1))
    return prefix_scan(kept, ["idx"], {"place": "one"}).select(F.col("place").alias("idx"), "value")


def pack2(seq: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows of the first flag, then rows of the second, numbered through; a row with both stands twice."""
    both = seq.where(first).select(F.lit(0).alias("side"), "idx", "value").unionByName(seq.where(second).select(F.lit(1).alias("side"), "idx", "value"))
    return prefix_scan(both.withColumn("one", F.lit(1)), ["side", "idx"], {"place": "one"}).select(F.col("place").alias("idx"), "value")


def pack_index(seq: DataFrame, flag: Column) -> DataFrame:
    """The old places of flagged rows, as values numbered from 0."""
    return pack(seq.where(flag).select("idx", F.col("idx").alias("value")), F.lit(True))


def gather(a: DataFrame, where: DataFrame, n: int) -> DataFrame:
    """(idx, value): B[i % n] = A[where[i]]; of several probes of one slot the last counts. A place that A hasn't writes nothing."""
    found = where.select(F.col("idx").alias("i"), F.col("value").alias("idx")).join(a, "idx")
    return found.groupBy((F.col("i") % n).alias("idx")).agg(F.max_by("value", "i").alias("value"))


def scatter(a: DataFrame, where: DataFrame, n: int) -> DataFrame:
    """(idx, value): B[where[i]] = A[i % n]; of several writes to one place the last counts."""
    probes = where.select(F.col("idx").alias("i"), F.col("value").alias("to"), (F.col("idx") % n).alias("idx"))
    return probes.join(a, "idx").groupBy(F.col("to").alias("idx")).agg(F.max_by("value", "i").alias("value"))
