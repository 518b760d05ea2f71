"""Breadth-first search, shortest paths, components and PageRank."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.graph import Graph
from sparkweave.operators.components import star_components
from sparkweave.plans.superstep import SMALL_STATE, Result, VertexProgram, run_vertex_program
from sparkweave.storage import bucketed, checkpointed, discard

DAMP = 0.85


def _distances(result: Result) -> Result:
    return replace(result, values=result.values.withColumnRenamed("value", "dist"))


def _from_root(root: int) -> dict:
    at_root = F.col("id") == F.lit(root)
    return {"init": F.when(at_root, F.lit(0)).cast("long"), "active": at_root}


def bfs(graph: Graph, root: int, strategy: str = "auto") -> Result:
    """(id, dist): edges on the shortest directed path from ``root``; null where there is none, everywhere if the root is no vertex."""
    reached = VertexProgram(**_from_root(root), message=lambda value, level: level, improves=lambda old, new: old.isNull())
    return _distances(run_vertex_program(graph, reached, strategy=strategy))


def sssp(graph: Graph, root: int, max_rounds: int | None = None, strategy: str = "auto") -> Result:
    """(id, dist): the least weight of a directed path from ``root``; weights may be negative.

    After n rounds, or ``max_rounds``, it stops; ``converged`` is false if then
    some distance still changes (a negative cycle, or too few rounds). An edge
    with a null weight can't be used.
    """
    relax = VertexProgram(**_from_root(root), message=lambda value, level: value + F.col("weight"))
    return _distances(run_vertex_program(graph, relax, -1 if max_rounds is None else max_rounds, strategy))


def min_label_propagation(graph: Graph, strategy: str = "auto") -> Result:
    """(id, label): the smallest id among a vertex and those that reach it along directed edges."""
    spread = VertexProgram(F.col("id"), F.lit(True), message=lambda value, level: value)
    found = run_vertex_program(graph, spread, strategy=strategy)
    return replace(found, values=found.values.withColumnRenamed("value", "label"))


def weakly_connected_components(graph: Graph) -> DataFrame:
    """(id, label): the smallest id that edges, taken either way, connect to each vertex."""
    found = star_components(graph.edges, "src", "dst")
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


@dataclass(frozen=True)
class Ranks:
    scores: DataFrame
    deltas: list[float]


def pagerank(graph: Graph, iters: int = 10, damp: float = DAMP, measure: bool = False) -> Ranks:
    """(id, score) after exactly ``iters`` rounds from 1 / n; what sinks hold is not handed on.

    Parallel edges hand on each. Edges are bucketed by source with their
    source's share (1 / out-degree) and don't move; a round shuffles partial sums by
    destination, and small states. ``measure`` gives the summed absolute change of each round.
    """
    degrees = graph.edges.groupBy("src").agg((1.0 / F.count("*")).alias("share"))
    vertices, seen = checkpointed(graph.vertices, {"n": F.count("*")})
    n = seen["n"]
    if not n:
        return Ranks(vertices.withColumn("score", F.lit(0.0)), [])
    edges, _ = bucketed(graph.edges.select("src", "dst").join(degrees, "src"), "src", "shares")
    small = n <= SMALL_STATE
    if not small:
        few, (vertices, _) = vertices, bucketed(vertices, "id", "vertices")
        discard(few)
    ranks, last = vertices.withColumn("score", F.lit(1.0 / n)), None
    change = {"delta": F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(1.0 / n))))}
    deltas = []
    for _ in range(iters):
        known = ranks.select(F.col("id").alias("src"), "score")
        handed = edges.join(F.broadcast(known) if small else known, "src")  # a copy of at most SMALL_STATE rows of two numbers
        sums = handed.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("sum"))
        score = F.lit((1 - damp) / n) + F.lit(damp) * F.coalesce("sum", F.lit(0.0))
        after = ranks.select("id", F.col("score").alias("old")).join(sums, "id", "left").select("id", score.alias("score"), "old")
        stored, seen = checkpointed(after, change) if small else bucketed(after, "id", "ranks", change, placed=True)
        if measure:
            deltas.append(seen["delta"])
        if last is not None:
            discard(last)
        ranks = last = stored
    discard(edges)
    if last is not None:
        discard(vertices)
    return Ranks(ranks.select("id", "score"), deltas)
