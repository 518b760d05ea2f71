"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most ``most`` documents of each label, none of them held out.

    A weight is the number of labelled documents that the row stands for.

    Which ones follows from a hash of the id, over all labelled rows. An id with
    several labels counts by their mean, and with several texts by the smallest;
    null ids and labels are passed over.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col, folds, fold))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.unionAll(some)
    # At most 2 * `most` ids, so a copy for each executor.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = found.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id").collect()
    found_of = {y: sum(r["y"] == y for r in rows) for y in (0, 1)}
    return [(r["text"] or "", r["y"], totals[r["y"]] / found_of[r["y"]]) for r in rows]
