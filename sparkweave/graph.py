"""Directed multigraphs as DataFrames of vertices and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.scan import prefix_scan

INF = 9223372036854775807


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst[, weight])``. Parallel edges and self-loops count; vertices may be isolated."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """Rows with a null end are no edges. Without ``vertices`` they are the ends of the edges."""
        kept = [F.col(c).cast("long").alias(c) for c in ("src", "dst", "weight") if c in edges.columns]
        edges = edges.select(*kept).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id"))
        else:
            vertices = vertices.select(F.col("id").cast("long").alias("id")).where(F.col("id").isNotNull())
        return Graph(vertices.distinct(), edges)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def num_nodes(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def _turned(self) -> DataFrame:
        rest = ["weight"] if self.weighted else []
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)

    def reverse(self) -> Graph:
        return Graph(self.vertices, self._turned())

    def symmetrize(self) -> Graph:
        """Each edge both ways; duplicates are kept."""
        return Graph(self.vertices, self.edges.unionByName(self._turned()))

    def densify(self) -> tuple[Graph, DataFrame]:
        """The graph with ids 0 to n - 1 in ascending order of the old ones, and the (id, dense) map."""
        ids = prefix_scan(self.vertices.withColumn("one", F.lit(1)), ["id"], {"dense": "one"}).select("id", "dense")
        rest = ["weight"] if self.weighted else []
        left = ids.select(F.col("id").alias("src"), F.col("dense").alias("s"))
        right = ids.select(F.col("id").alias("dst"), F.col("dense").alias("d"))
        edges = self.edges.join(left, "src").join(right, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)
        return Graph(ids.select(F.col("dense").alias("id")), edges), ids

    def shift(self, by: int) -> Graph:
        rest = ["weight"] if self.weighted else []
        edges = self.edges.select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst"), *rest)
        return Graph(self.vertices.select((F.col("id") + by).alias("id")), edges)

    def _degrees(self, end: str) -> DataFrame:
        counted = self.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def out_degrees(self) -> DataFrame:
        """(id, degree) of every vertex; parallel edges count each."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def neighbors(self, direction: str = "out") -> DataFrame:
        """(id, neighbors[, weights]) of vertices that have any, sorted by neighbour and weight.

        An adjacency list is one row, so a hub's row is as long as its degree.
        """
        own, other = ("src", "dst") if direction == "out" else ("dst", "src")
        if not self.weighted:
            return self.edges.groupBy(F.col(own).alias("id")).agg(F.sort_array(F.collect_list(other)).alias("neighbors"))
        pairs = F.sort_array(F.collect_list(F.struct(F.col(other).alias("n"), F.col("weight").alias("w"))))
        both = self.edges.groupBy(F.col(own).alias("id")).agg(pairs.alias("p"))
        return both.select("id", F.col("p.n").alias("neighbors"), F.col("p.w").alias("weights"))

    def offsets(self) -> DataFrame:
        """(id, offset): edges of all vertices before, by ascending id."""
        return prefix_scan(self.out_degrees(), ["id"], {"offset": "degree"}).select("id", "offset")

    def scan(self, direction: str = "out") -> DataFrame:
        """(id, neighbor) of every edge."""
        own, other = ("src", "dst") if direction == "out" else ("dst", "src")
        return self.edges.select(F.col(own).alias("id"), F.col(other).alias("neighbor"))


def transpose_violations(out_edges: DataFrame, in_edges: DataFrame) -> DataFrame:
    """(src, dst, missing): edges of the out-side that the in-side hasn't, and the other way round; multiplicity doesn't count.

    Both frames hold edges as (src, dst), the in-side as source and destination too.
    """
    out, into = out_edges.select("src", "dst").distinct(), in_edges.select("src", "dst").distinct()
    return (
        out.join(into, ["src", "dst"], "left_anti")
        .withColumn("missing", F.lit("in"))
        .unionByName(into.join(out, ["src", "dst"], "left_anti").withColumn("missing", F.lit("out")))
    )


def rank_of(id_: Column, n: int, ranks: int) -> Column:
    """Which of ``ranks`` blocks of consecutive ids an id of 0 to n - 1 is in; the last takes the remainder."""
    return F.least(F.floor(id_ / F.lit(max(n // ranks, 1))), F.lit(ranks - 1)).cast("long")


def rank_bounds(n: int, ranks: int) -> list[tuple[int, int, int]]:
    """(rank, first id, id after the last)."""
    size = max(n // ranks, 1)
    return [(r, min(r * size, n), n if r == ranks - 1 else min((r + 1) * size, n)) for r in range(ranks)]


def with_inf(result: DataFrame, column: str = "dist") -> DataFrame:
    """Nulls (unreached) as the largest long."""
    return result.withColumn(column, F.coalesce(column, F.lit(INF)))
