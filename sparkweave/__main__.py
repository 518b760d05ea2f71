"""``python -m sparkweave bfs|sssp|components|pagerank <adjacency file> [runs]`` prints the mean seconds of a run, without reading the file."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from functools import partial
from random import Random

from pyspark.sql import DataFrame, SparkSession

from sparkweave.graph import Graph
from sparkweave.operators import traversal
from sparkweave.sources.adjacency import read_adjacency
from sparkweave.storage import materialize

RUNS = 4
#: By name: whether the file has weights, and what one run from a root is.
ALGORITHMS = {
    "bfs": (False, lambda graph, root: traversal.bfs(graph, root).values),
    "sssp": (True, lambda graph, root: traversal.sssp(graph, root).values),
    "components": (False, lambda graph, root: traversal.min_label_propagation(graph).values),
    "pagerank": (False, lambda graph, root: traversal.pagerank(graph).scores),
}


def _timed(run: Callable[[], DataFrame]) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def mean_seconds(spark: SparkSession, algorithm: str, path: str, runs: int = RUNS, seed: int = 0) -> float:
    """The mean over ``runs``, each from a root drawn by ``seed``. A graph without vertices is an error."""
    weighted, run = ALGORITHMS[algorithm]
    read = read_adjacency(spark, path, weighted).graph
    graph = Graph(materialize(read.vertices, "vertices"), materialize(read.edges, "edges"))
    n, draw = graph.num_nodes(), Random(seed)
    if n == 0:
        raise ValueError(f"{path} has no vertices")
    return sum(_timed(partial(run, graph, draw.randrange(n))) for _ in range(runs)) / runs


def main(arguments: list[str]) -> None:
    if len(arguments) not in (2, 3) or arguments[0] not in ALGORITHMS:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    print(mean_seconds(spark, arguments[0], arguments[1], *map(int, arguments[2:])))


if __name__ == "__main__":
    main(sys.argv[1:])
