"""Random graphs. All draws are hashes of the row and a seed, so a task that runs again draws the same."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkweave.graph import Graph

#: Published quadrant chances of the recursive-matrix model.
RMAT = (0.57, 0.19, 0.19, 0.05)


def _uniform(seed: int, *keys: Column | str) -> Column:
    """A number from 0 up to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def _integer(below: int, seed: int, *keys: Column | str) -> Column:
    return F.floor(_uniform(seed, *keys) * below).cast("long")


def add_weights(graph: Graph, seed: int = 0, most: int = 10) -> Graph:
    """Whole weights from 0 to ``most``, one an edge; parallel edges draw alike."""
    return Graph(graph.vertices, graph.edges.select("src", "dst", _integer(most + 1, seed, "src", "dst").alias("weight")))


def hashed_weights(graph: Graph) -> Graph:
    """Weights from 0 to 10 that follow from the ends."""
    return Graph(graph.vertices, graph.edges.select("src", "dst", F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(11)).alias("weight")))


def uniform_graph(spark: SparkSession, n: int, m: int, weighted: bool = False, negative: float = 0.0, seed: int = 0) -> Graph:
    """m edges with independent uniform ends among n vertices; weights from 0 to 500, negated with chance ``negative``."""
    edges = spark.range(m).select(
        "id", _integer(n, seed, F.lit("src"), "id").alias("src"), _integer(n, seed, F.lit("dst"), "id").alias("dst")
    )
    if weighted:
        size = _integer(501, seed, F.lit("weight"), "id")
        edges = edges.withColumn("weight", F.when(_uniform(seed, F.lit("sign"), "id") < negative, -size).otherwise(size))
    return Graph(spark.range(n).select("id"), edges.drop("id"))


def rmat_graph(spark: SparkSession, n: int, m: int, seed: int = 0, chances: tuple[float, float, float, float] = RMAT, symmetric: bool = True) -> Graph:
    """m power-law edges among n vertices: each level of halving picks a quadrant. The halved square is scaled down to n, so an id has one or two of its cells. Symmetric graphs have each both ways."""
    levels = max(1, (n - 1).bit_length())
    a, b, c, _ = chances
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(levels):
        u = _uniform(seed, F.lit(level), "id")
        low = F.when(u < a + b, 0).otherwise(1)
        right = F.when((u < a) | ((u >= a + b) & (u < a + b + c)), 0).otherwise(1)
        src, dst = src * 2 + low, dst * 2 + right
    if 2 * levels < 63:
        scaled = [F.shiftright(end * n, levels) for end in (src, dst)]
    else:
        scaled = [F.floor(end.cast("decimal(38,0)") * n / (1 << levels)).cast("long") for end in (src, dst)]
    edges = spark.range(m).select(scaled[0].alias("src"), scaled[1].alias("dst"))
    graph = Graph(spark.range(n).select("id"), edges)
    return graph.symmetrize() if symmetric else graph


def uniform_grid(sizes: list[int], ratios: list[float], negatives: list[float], copies: int) -> list[dict]:
    """Arguments of ``uniform_graph`` for every combination, with a seed for each copy."""
    return [
        {"n": n, "m": int(n * r), "negative": neg, "weighted": True, "seed": k}
        for n in sizes
        for r in ratios
        for neg in negatives
        for k in range(copies)
    ]
