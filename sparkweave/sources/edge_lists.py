"""Edge lists of public network collections, as text or gzip."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.graph import Graph
from sparkweave.operators.generators import add_weights
from sparkweave.operators.scan import prefix_scan
from sparkweave.sources.adjacency import write_adjacency


@dataclass(frozen=True)
class EdgeListFormat:
    """How a collection writes its edges. Sparse ids are made dense in ascending order; dense ids are counted from ``base``."""

    separator: str
    directed: bool
    dense: bool
    base: int = 0
    weighted: bool = False
    comment: str = "#"


FORMATS = {
    "facebook": EdgeListFormat(" ", directed=False, dense=True),
    "twitter": EdgeListFormat(" ", directed=True, dense=False),
    "gplus": EdgeListFormat(" ", directed=True, dense=False),
    "youtube": EdgeListFormat("\t", directed=False, dense=True, base=1),
    "orkut": EdgeListFormat("\t", directed=False, dense=True, base=1),
    "friendster": EdgeListFormat("\t", directed=False, dense=True, base=1),
    "bitcoin_otc": EdgeListFormat(",", directed=True, dense=False, weighted=True),
    "bitcoin_alpha": EdgeListFormat(",", directed=True, dense=False, weighted=True),
}


def read_edges(spark: SparkSession, path: str, form: EdgeListFormat) -> DataFrame:
    """(src, dst[, weight]) as the file has them; ids can be larger than a long where they are to be made dense.

    Comment and blank lines, and lines without two ids, are passed over; columns
    after those known are not read.
    """
    columns = ["src", "dst", "weight"] if form.weighted else ["src", "dst"]
    rows = spark.read.csv(path, sep=form.separator, comment=form.comment, schema=", ".join(f"{c} string" for c in columns), mode="PERMISSIVE")
    kind = "long" if form.dense else "decimal(38,0)"
    ends = [F.trim(c).cast(kind).alias(c) for c in ("src", "dst")]
    weight = [F.trim("weight").cast("long").alias("weight")] if form.weighted else []
    return rows.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(*ends, *weight)


def read_graph(spark: SparkSession, path: str, form: str | EdgeListFormat) -> Graph:
    """The graph of an edge list: undirected edges go both ways, ids run from 0 to n - 1."""
    form = FORMATS[form] if isinstance(form, str) else form
    edges = read_edges(spark, path, form)
    if form.dense:
        edges = edges.withColumns({"src": F.col("src") - form.base, "dst": F.col("dst") - form.base})
        last = edges.agg(F.max(F.greatest("src", "dst")).alias("last")).first()["last"]
        graph = Graph.from_edges(edges, spark.range(0 if last is None else last + 1).select("id"))
    else:
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("one", F.lit(1))
        dense = prefix_scan(ids, ["id"], {"dense": "one"})
        left, right = dense.select(F.col("id").alias("src"), F.col("dense").alias("s")), dense.select(F.col("id").alias("dst"), F.col("dense").alias("d"))
        rest = ["weight"] if form.weighted else []
        mapped = edges.join(left, "src").join(right, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)
        graph = Graph(dense.select(F.col("dense").alias("id")), mapped)
    return graph if form.directed else graph.symmetrize()


def ingest(spark: SparkSession, inputs: dict[str, tuple[str, str]], out: str, exists: Callable[[str], bool], seed: int = 0) -> list[str]:
    """Write each input (name: (path, format)) as an adjacency file, and a weighted copy of those without weights; what is there already is left."""
    written = []
    for name, (path, form) in inputs.items():
        graph = read_graph(spark, path, form)
        copies = [(f"{out}/{name}", graph)]
        if not graph.weighted:
            copies.append((f"{out}/{name}_weighted", add_weights(graph, seed)))
        for target, copy in copies:
            if not exists(target):
                write_adjacency(copy, target)
                written.append(target)
    return written
