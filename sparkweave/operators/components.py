"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.storage import discard, materialize

#: Links up to which a round writes nothing but its result.
FEW = 1_000_000


def star_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, label) for each vertex with an edge to another; label is the smallest id of its component.

    Each round hooks every vertex to the smallest neighbour, first over larger
    and then over smaller neighbours, so the number of rounds grows with the
    logarithm of the longest path and not with the path. Hubs are safe: minima are
    partial aggregates, and where there are over ``FEW`` links they are written before
    they are joined back: then both sides of a join come from exchanges of its own
    and AQE can split a hub.

    Null ends and self-loops carry no link and are ignored; repeated edges count
    once; no edges give no rows.
    """
    ends = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    links = ends.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    sums = {"n": F.count("*"), "h": F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))}
    now: dict = {}
    links = materialize(links, "links", sums, now)
    before = None
    while now != before:
        before, now = now, {}
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        written: list[DataFrame] = []

        def stored(df: DataFrame, label: str, few: bool = before["n"] <= FEW, written: list[DataFrame] = written) -> DataFrame:
            if not few:
                written.append(df := materialize(df, label))
            return df

        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stored(large, "larger")
        root = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "roots")
        small = (
            large.join(root, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .unionByName(root.select("hi", F.col("m").alias("lo")))
        )
        after = materialize(small.distinct(), "links", sums, now)
        for done in (links, *written):
            discard(done)
        links = after
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("label")).unionByName(
        links.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct()
    )
