"""Rows named by their contents, so that those that repeat an id or have none are judged each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.storage import materialize


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of id and text name a row: rows equal in both are one document."""
    absent = F.col(id_col).isNull()
    return F.xxhash64(id_col, text_col, absent), F.xxhash64(text_col, id_col, absent)


def keep_first(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the first row by (id, text) of each component in ``judged`` (id, k1, k2, component); rows without an id come last."""
    judged = materialize(judged, "judged")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id")
    least = judged.groupBy("component").agg(F.min(place).alias("least"))
    first = judged.join(least, "component").where(F.col("id").eqNullSafe(F.col("least.id")))
    first = first.select("k1", "k2", "component").distinct()
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), k1.alias("k1"), k2.alias("k2"))
    found = keyed.join(first, ["k1", "k2"])
    one = Window.partitionBy("component").orderBy(F.col("kept").getField(text_col))
    ranked = found.select("kept", F.row_number().over(one).alias("place"))
    return ranked.where("place = 1").select("kept.*")
