"""Vertex programs: rounds of messages along edges, until no vertex changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.graph import Graph
from sparkweave.storage import bucketed, checkpointed, discard

#: A frontier under n / PUSH vertices pushes: it is copied to the edges, which then don't move.
PUSH = 20
#: And only if it has at most so many rows (two longs each). Up to here a pulled one is copied too, unless pulling is asked for: edges needn't be sorted then.
BROADCAST_ROWS = 1_000_000
#: A state of at most so many vertices is a checkpoint, which costs a round little; a larger one is a table bucketed by vertex, which isn't shuffled to be joined.
SMALL_STATE = 1_000_000
#: A frontier of so few vertices is looked up in the buckets that have them, if there are so many edges.
LOOKED_UP, MANY_EDGES = 64, 10_000_000
_MERGES = {"min": F.min, "max": F.max, "sum": F.sum}


@dataclass(frozen=True)
class VertexProgram:
    """``init`` and ``active`` over ``id``; ``message`` over value, src, dst, weight and level, sent along out-edges of active vertices.

    Messages to a vertex are merged; ``improves(old, new)`` says if the merged
    one replaces the vertex's value, which makes it active in the next round.
    """

    init: Column
    active: Column
    message: Callable[[Column, Column], Column]
    merge: str = "min"
    improves: Callable[[Column, Column], Column] = lambda old, new: old.isNull() | (new < old)


@dataclass(frozen=True)
class Result:
    values: DataFrame
    rounds: int
    converged: bool
    #: For each round how many vertices were active, and whether they were pushed.
    trace: tuple[tuple[int, bool], ...] = ()


def run_vertex_program(graph: Graph, program: VertexProgram, max_rounds: int | None = None, strategy: str = "auto") -> Result:
    """(id, value) after the last round.

    Edges lie in buckets of their source and don't move. Large states lie in buckets
    of their vertex, so a round shuffles messages only, combined before; small ones
    are checkpoints and shuffled too. A round reads the state once and writes it
    once to shared storage; the number of changed vertices comes
    with the write. ``strategy`` is push, pull, or auto (by the frontier's size);
    it decides how the frontier reaches the edges and never what comes out.
    ``max_rounds`` of -1 stands for the number of vertices.
    """
    changed = {"changed": F.count_if("changed"), "n": F.count("*")}
    start = graph.vertices.select("id", program.init.alias("value")).withColumn("changed", program.active)
    state, seen = checkpointed(start, changed)
    edges, stored = bucketed(graph.edges, "src", "edges", {"n": F.count("*")})
    if max_rounds == -1:
        max_rounds = seen["n"]
    trace: list[tuple[int, bool]] = []
    while seen["changed"] and (max_rounds is None or len(trace) < max_rounds):
        frontier = state.where("changed").select(F.col("id").alias("src"), "value")
        small = seen["changed"] < max(seen["n"] // PUSH, 1) if strategy == "auto" else strategy == "push"
        push = small and seen["changed"] <= BROADCAST_ROWS
        trace.append((seen["changed"], push))
        candidates = edges
        if push:
            if seen["changed"] <= LOOKED_UP and stored["n"] >= MANY_EDGES:
                candidates = edges.where(F.col("src").isin([r["src"] for r in frontier.select("src").collect()]))
        if push or (strategy == "auto" and seen["changed"] <= BROADCAST_ROWS):
            frontier = F.broadcast(frontier)
        sent = candidates.join(frontier, "src").withColumn("message", program.message(F.col("value"), F.lit(len(trace)).cast("long")))
        merged = sent.groupBy(F.col("dst").alias("id")).agg(_MERGES[program.merge]("message").alias("merged"))
        better = F.col("merged").isNotNull() & program.improves(F.col("value"), F.col("merged"))
        after = state.join(merged, "id", "left").select(
            "id", F.when(better, F.col("merged")).otherwise(F.col("value")).alias("value"), F.coalesce(better, F.lit(False)).alias("changed")
        )
        last = state
        state, seen = checkpointed(after, changed) if seen["n"] <= SMALL_STATE else bucketed(after, "id", "state", changed, placed=len(trace) > 1)
        discard(last)
    discard(edges)
    return Result(state.select("id", "value"), len(trace), not seen["changed"], tuple(trace))
