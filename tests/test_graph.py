"""Golden results on hand-made graphs, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweave import storage
from sparkweave.functions import scalars
from sparkweave.graph import INF, Graph, rank_bounds, rank_of, transpose_violations, with_inf
from sparkweave.operators import generators, traversal
from sparkweave.operators.components import star_components
from sparkweave.plans.superstep import VertexProgram, run_vertex_program
from sparkweave.queries import root_of

TOY = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 0), (3, 0), (3, 1)]


def graph(spark, edges, n):
    weighted = any(len(e) == 3 for e in edges)
    schema = "src long, dst long" + (", weight long" if weighted else "")
    return Graph.from_edges(spark.createDataFrame(edges, schema), spark.range(n).select("id"))


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(("root", "want"), [(0, [0, 1, 1, 2]), (1, [2, 0, 1, 1]), (2, [1, 2, 0, 1]), (3, [1, 1, 2, 0])])
def test_toy_distances(spark, root, want):
    g = graph(spark, TOY, 4)
    assert column(traversal.bfs(g, root).values, "dist") == want
    if root == 0:
        ones = Graph(g.vertices, g.edges.withColumn("weight", F.lit(1).cast("long")))
        assert column(traversal.sssp(ones, root).values, "dist") == want


def test_toy_other(spark):
    g = graph(spark, TOY, 4)
    assert column(traversal.min_label_propagation(g).values, "label") == [0, 0, 0, 0]
    assert column(traversal.weakly_connected_components(g), "label") == [0, 0, 0, 0]
    assert column(traversal.pagerank(g).scores, "score") == pytest.approx([0.25] * 4)
    assert column(g.out_degrees(), "degree") == column(g.in_degrees(), "degree") == [2, 2, 2, 2]
    assert transpose_violations(g.edges, g.edges).isEmpty()
    assert (g.num_nodes(), g.num_edges()) == (4, 8)


def test_isolated_and_unreached(spark):
    g = graph(spark, [(0, 1)], 3)
    assert column(with_inf(traversal.bfs(g, 0).values), "dist") == [0, 1, INF]
    assert column(traversal.weakly_connected_components(g), "label") == [0, 0, 2]
    assert column(traversal.bfs(g, 99).values, "dist") == [None] * 3


def test_directed_and_weak_components_differ(spark):
    g = graph(spark, [(1, 0)], 2)
    assert column(traversal.min_label_propagation(g).values, "label") == [0, 1]
    assert column(traversal.weakly_connected_components(g), "label") == [0, 0]


def test_dangling_rank_is_dropped(spark):
    found = traversal.pagerank(graph(spark, [(0, 1)], 2), measure=True)
    assert column(found.scores, "score") == pytest.approx([0.075, 0.13875])
    assert len(found.deltas) == 10 and found.deltas[-1] == pytest.approx(0)


def test_parallel_edges_and_loops_count(spark):
    g = graph(spark, [(0, 1), (0, 1), (0, 2), (1, 0), (2, 0)], 3)
    assert column(g.out_degrees(), "degree")[0] == 3
    one = column(traversal.pagerank(g, 1).scores, "score")
    assert one[1] - 0.05 == pytest.approx(2 * (one[2] - 0.05))
    loop = graph(spark, [(0, 0), (0, 1)], 2)
    assert column(traversal.bfs(loop, 0).values, "dist") == [0, 1]
    assert column(loop.out_degrees(), "degree") == [2, 0]


def test_weights(spark):
    assert column(traversal.sssp(graph(spark, [(0, 1, 5), (0, 1, 2)], 2), 0).values, "dist") == [0, 2]
    negative = traversal.sssp(graph(spark, [(0, 1, 4), (0, 2, 1), (2, 1, -2)], 3), 0)
    assert column(negative.values, "dist") == [0, -1, 1] and negative.converged
    cycle = traversal.sssp(graph(spark, [(0, 1, 1), (1, 2, -2), (2, 0, 0)], 3), 0)
    assert column(cycle.values, "dist") == [-1, 1, -1] and not cycle.converged and cycle.rounds == 3


def test_transpose_violations(spark):
    out, into = graph(spark, [(0, 1)], 3).edges, graph(spark, [(0, 2)], 3).edges
    assert {tuple(r) for r in transpose_violations(out, into).collect()} == {(0, 1, "in"), (0, 2, "out")}


def test_offsets_with_empty_vertices(spark):
    assert column(graph(spark, [(0, 3), (3, 0)], 4).offsets(), "offset") == [0, 1, 1, 1]


def test_transforms(spark):
    g = graph(spark, [(10, 30, 1), (30, 20, 2), (30, 20, 2)], 0)
    g = Graph.from_edges(g.edges)
    dense, ids = g.densify()
    assert sorted(map(tuple, dense.edges.collect())) == [(0, 2, 1), (2, 1, 2), (2, 1, 2)]
    assert sorted(map(tuple, ids.collect())) == [(10, 0), (20, 1), (30, 2)]
    assert sorted(map(tuple, g.reverse().reverse().edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert g.symmetrize().num_edges() == 6
    assert {r["id"]: (r["neighbors"], r["weights"]) for r in g.neighbors().collect()} == {10: ([30], [1]), 30: ([20, 20], [2, 2])}
    assert {r["id"]: r["neighbors"] for r in g.neighbors("in").collect()} == {30: [10], 20: [30, 30]}
    assert sorted(column(g.shift(-10).vertices, "id")) == [0, 10, 20]


def test_ranks(spark):
    ids = spark.range(10).select(rank_of(F.col("id"), 10, 3).alias("id"))
    assert column(ids, "id") == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert rank_bounds(10, 3) == [(0, 0, 3), (1, 3, 6), (2, 6, 10)]


def test_nulls_and_nothing(spark):
    holes = spark.createDataFrame([(0, None), (None, 1), (0, 1)], "src long, dst long")
    assert Graph.from_edges(holes).num_edges() == 1
    none = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert traversal.bfs(none, 0).values.count() == 0
    assert traversal.weakly_connected_components(none).count() == 0
    assert traversal.pagerank(none).scores.count() == 0
    assert traversal.min_label_propagation(none).values.count() == 0


def test_metrics_of_no_rows(spark):
    """Metrics of frames of which Spark learns only while it runs that they have no rows."""
    none = spark.range(10).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    metrics = {"rows": F.count("*"), "most": F.max("n")}
    seen = {}
    storage.materialize(none.repartition(3, "id"), "none", metrics, seen)
    found = [seen, storage.checkpointed(none, metrics)[1]]
    found += [storage.bucketed(none, "id", "none", metrics, placed)[1] for placed in (False, True)]
    assert found == [{"rows": 0, "most": None}] * 4


def _reference_sssp(n, edges, root):
    best = {root: 0}
    for _ in range(n):
        for s, d, w in edges:
            if s in best and best[s] + w < best.get(d, 1 << 60):
                best[d] = best[s] + w
    return [best.get(i) for i in range(n)]


def test_random_graph_properties(spark):
    rng = random.Random(5)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 20)) for _ in range(90)]
    g = graph(spark, edges, n)
    want = _reference_sssp(n, edges, edges[0][0])
    for strategy in ("push", "pull", "auto"):
        assert column(traversal.sssp(g, edges[0][0], strategy=strategy).values, "dist") == want
    hops = _reference_sssp(n, [(s, d, 1) for s, d, _ in edges], edges[0][0])
    assert column(traversal.bfs(g, edges[0][0]).values, "dist") == hops
    assert column(traversal.min_label_propagation(g.symmetrize()).values, "label") == column(traversal.weakly_connected_components(g), "label")


def test_long_path_contracts(spark):
    rng = random.Random(2)
    names = list(range(300))
    rng.shuffle(names)
    path = [(names[i], names[i + 1]) for i in range(299)]
    found = star_components(spark.createDataFrame([*path, (1000, 1001), (7, 7)], "a long, b long"), "a", "b")
    labels = {r["id"]: r["label"] for r in found.collect()}
    assert set(labels.values()) == {0, 1000} and len(labels) == 302


def test_vertex_program_widest_label(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 2)], 4)
    program = VertexProgram(F.col("id"), F.lit(True), lambda value, level: value, "max", lambda old, new: new > old)
    assert column(run_vertex_program(g, program).values, "value") == [0, 1, 3, 3]


def test_generators(spark):
    g = generators.uniform_graph(spark, 100, 500, weighted=True, negative=0.5, seed=3)
    rows = g.edges.collect()
    assert len(rows) == 500 and all(0 <= r["src"] < 100 and 0 <= r["dst"] < 100 and -500 <= r["weight"] <= 500 for r in rows)
    assert any(r["weight"] < 0 for r in rows) and any(r["weight"] > 0 for r in rows)
    again = generators.uniform_graph(spark, 100, 500, weighted=True, negative=0.5, seed=3).edges.repartition(7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    skewed = generators.rmat_graph(spark, 1000, 4000, seed=1)
    assert skewed.num_edges() == 8000
    assert skewed.out_degrees().agg(F.max("degree")).first()[0] > 40
    assert generators.add_weights(g).edges.agg(F.min("weight"), F.max("weight")).first()[:] == (0, 10)
    assert len(generators.uniform_grid([10, 20], [1, 2], [0.0], 3)) == 12


def _mix(a):
    w = 0xFFFFFFFF
    a = (a + 0x7ED55D16 + (a << 12)) & w
    a = a ^ 0xC761C23C ^ (a >> 19)
    a = (a + 0x165667B1 + (a << 5)) & w
    a = ((a + 0xD3A2646C) ^ (a << 9)) & w
    a = (a + 0xFD7046C5 + (a << 3)) & w
    return a ^ 0xB55A4F09 ^ (a >> 16)


def test_scalars(spark):
    values = [0, 1, 2, 3, 4, 5, 7, 8, 9, 1000, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(v,) for v in values], "id long")
    assert column(df.select("id", scalars.hash32(F.col("id")).alias("v")), "v") == [_mix(v) for v in values]
    assert column(df.select("id", scalars.hash_int(F.col("id")).alias("v")), "v") == [_mix(v) & 0x7FFFFFFF for v in values]
    assert column(df.select("id", scalars.hash2(F.col("id")).alias("v")), "v") == [(1103515245 * v + 12345) % 2**32 % 0xFFFFFFFF for v in values]
    assert column(df.select("id", scalars.log2_up(F.col("id")).alias("v")), "v") == [0 if v <= 1 else (v - 1).bit_length() for v in values]
    pair = F.struct(F.col("id").alias("first"), F.lit(5).alias("second"))
    some = df.select(
        "id", scalars.larger(scalars.first(pair), scalars.second(pair)).alias("v"), scalars.smaller(F.col("id"), scalars.zero(F.col("id"))).alias("w"),
        scalars.add(scalars.identity(F.col("id")), scalars.absolute(-F.col("id"))).alias("x"), scalars.non_negative(F.col("id")).alias("y"),
    )
    assert column(some, "v")[:3] == [5, 5, 5] and column(some, "x")[:3] == [0, 2, 4] and all(column(some, "y"))
    with pytest.raises(Exception, match="too large"):
        df.select(scalars.require(F.col("id") < 5, "too large")).collect()


def test_trace(spark):
    star = graph(spark, [(0, i) for i in range(1, 100)] + [(5, 0)], 200)
    found = traversal.bfs(star, 0)
    assert found.rounds == 2 and found.trace == ((1, True), (99, False))
    assert [p for _, p in traversal.bfs(star, 0, strategy="pull").trace] == [False, False]


def test_root(spark):
    assert root_of(graph(spark, [(3, 1), (3, 2), (2, 1), (2, 0), (1, 0)], 4)) == 2
