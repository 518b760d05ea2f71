"""Queries over the test tables, and SQL that says what they return.

The graph has an edge from each part of an order to the next one in it, weighted
by quantity, over all orders. The root is the vertex with most out-edges, the
smallest of several.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.functions import scalars
from sparkweave.functions.results import mean_results, select_results
from sparkweave.graph import Graph, rank_of, transpose_violations, with_inf
from sparkweave.operators import generators, sequence, traversal
from sparkweave.operators.scan import prefix_scan
from sparkweave.plans.superstep import VertexProgram, run_vertex_program
from sparkweave.sources.adjacency import catalog, from_one_side, read_adjacency, write_adjacency, write_one_side
from sparkweave.sources.edge_lists import FORMATS, EdgeListFormat, read_graph
from sparkweave.storage import materialize, new_path, table


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lines.select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.floor("l_quantity").cast("long").alias("weight")
    ).where("dst IS NOT NULL")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    graph = Graph.from_edges(materialize(part_edges(spark, sf_dir), "edges"))
    return Graph(materialize(graph.vertices, "vertices"), graph.edges)


def _with_all_parts(spark: SparkSession, sf_dir: str) -> Graph:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    edges = part_edges(spark, sf_dir)
    return Graph.from_edges(edges, Graph.from_edges(edges).vertices.unionByName(parts))


def root_of(graph: Graph) -> int:
    degrees = graph.edges.groupBy("src").agg(F.count("*").alias("n"))
    return degrees.agg(F.max_by("src", F.struct("n", (-F.col("src")).alias("first"))).alias("root")).first()["root"]


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    return with_inf(traversal.bfs(graph, root_of(graph)).values)


def bfs_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfs_levels(spark, sf_dir).groupBy("dist").agg(F.count("*").alias("n"))


def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    return with_inf(traversal.sssp(graph, root_of(graph)).values)


def sssp_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to larger ids alone, so there is no cycle; weights from -2 on."""
    whole = part_graph(spark, sf_dir)
    graph = Graph(whole.vertices, whole.edges.where("src < dst").withColumn("weight", F.col("weight") - 3))
    return with_inf(traversal.sssp(graph, root_of(whole)).values)


def min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.min_label_propagation(part_graph(spark, sf_dir)).values


def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.weakly_connected_components(part_graph(spark, sf_dir))


def wcc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wcc(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def pagerank10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.pagerank(part_graph(spark, sf_dir)).scores.select("id", F.round("score", 8).alias("score"))


def pagerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = traversal.pagerank(part_graph(spark, sf_dir), measure=True).deltas
    rows = spark.createDataFrame([(i + 1, d) for i, d in enumerate(deltas)], "iteration int, delta double")
    return rows.select("iteration", F.round("delta", 8).alias("delta"))


def vertex_program_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    at_root = F.col("id") == root_of(graph)
    program = VertexProgram(F.when(at_root, F.lit(0)).cast("long"), at_root, lambda value, level: value + 1)
    return with_inf(run_vertex_program(graph, program).values.withColumnRenamed("value", "dist"))


def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_all_parts(spark, sf_dir).out_degrees()


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_all_parts(spark, sf_dir).in_degrees()


def _lists(direction: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = Graph.from_edges(part_edges(spark, sf_dir)).neighbors(direction)
    return lists.select("id", F.array_join("neighbors", ",").alias("neighbors"), F.array_join("weights", ",").alias("weights"))


def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(part_edges(spark, sf_dir)).reverse().edges


def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(part_edges(spark, sf_dir)).symmetrize().edges


def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).densify()[0].edges.select("src", "dst")


def transpose_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph against an in-side that lacks the edges between equal ids' neighbours (dst = src + 1): those are missing."""
    edges = materialize(part_edges(spark, sf_dir), "edges")
    return transpose_violations(edges, edges.where("dst <> src + 1"))


def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).offsets()


def csr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = part_graph(spark, sf_dir).densify()
    path = new_path(spark, "adjacency")
    write_adjacency(Graph(graph.vertices, materialize(graph.edges, "dense")), path)
    return read_adjacency(spark, path, weighted=True).graph.edges


def _dense(spark: SparkSession, sf_dir: str, weighted: bool) -> Graph:
    graph, _ = part_graph(spark, sf_dir).densify()
    return Graph(graph.vertices, materialize(graph.edges if weighted else graph.edges.drop("weight"), "dense"))


def csr_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the file, read back: the in-side's edges are given as it lists them."""
    path = new_path(spark, "adjacency")
    write_adjacency(_dense(spark, sf_dir, False), path)
    found = read_adjacency(spark, path, validate=True)
    sides = found.graph.edges.withColumn("side", F.lit("out")).unionByName(found.in_edges.withColumn("side", F.lit("in")))
    return sides.select("side", "src", "dst")


def csr_one_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "one-side")
    write_one_side(_dense(spark, sf_dir, False).symmetrize(), path)
    return from_one_side(spark, path).edges


def graph_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "graphs")
    graph = _dense(spark, sf_dir, True)
    write_adjacency(graph, f"{folder}/directed")
    write_adjacency(graph.symmetrize(), f"{folder}/both_ways", single_file=True)
    return catalog(spark, f"{folder}/*")


def _edge_list(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part graph's edges written as a collection writes them, with comments, and read as a graph."""
    form = FORMATS[name]
    edges = part_edges(spark, sf_dir)
    first, step = (form.base, 1) if form.dense else (1_000_000_007, 1_000_003)  # sparse ids keep their order
    ends = [(F.col(end) * step + first).cast("string") for end in ("src", "dst")]
    more = [(F.col("weight") - 25).cast("string"), F.lit("1289241911.72836")] if form.weighted else []
    lines = edges.select(F.concat_ws(form.separator, *ends, *more).alias("line"))
    comments = spark.createDataFrame([("# an edge a line",), ("# source, destination",)], "line string")
    path = new_path(spark, name)
    (lines if form.weighted else comments.unionByName(lines)).write.text(path)
    return read_graph(spark, path, name).edges


def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(part_edges(spark, sf_dir)).shift(-1).edges


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _with_all_parts(spark, sf_dir)
    return spark.createDataFrame([(graph.num_nodes(), graph.num_edges())], "n long, m long")


def edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(part_edges(spark, sf_dir)).scan("in")


def edge_scan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(part_edges(spark, sf_dir)).scan("out")


def weights_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws have no SQL of their own: what is given is how many edges have weights of the range, and whether all of them occur alike."""
    edges = generators.add_weights(Graph.from_edges(part_edges(spark, sf_dir)), seed=5).edges.select("src", "dst", "weight").distinct()
    return edges.groupBy("weight").agg(F.count("*").alias("k")).agg(
        F.sum("k").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"), (F.max("k") < 2 * F.min("k")).alias("even")
    )


def _drawn(graph: Graph) -> DataFrame:
    """(eighth, k): how many ends of edges lie in each eighth of the ids."""
    n = graph.num_nodes()
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.floor(F.col("id") * 8 / n).cast("long").alias("eighth")).agg(F.count("*").alias("k"))


def random_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform graph as large as the parts, ten edges a vertex; a tenth of the weights is drawn negative."""
    n = table(spark, sf_dir, "part").count()
    graph = generators.uniform_graph(spark, n, 10 * n, weighted=True, negative=0.1, seed=3)
    ends = _drawn(graph).agg(F.sum("k").alias("ends"), F.count("*").alias("eighths"), (F.max("k") < 1.5 * F.min("k")).alias("even"))
    signs = F.count_if(F.col("weight") < 0) / F.count("*")
    weights = graph.edges.agg(F.count("*").alias("m"), F.max(F.abs("weight")).alias("high"), signs.between(0.05, 0.15).alias("signed"))
    return ends.crossJoin(weights).withColumn("n", F.lit(n).cast("long"))  # one row each


def random_rmat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive-matrix graph as large as the parts: every edge both ways, ids in range, the first eighth of the ids the fullest."""
    n = table(spark, sf_dir, "part").count()
    graph = generators.rmat_graph(spark, n, 8 * n, seed=2)
    graph = Graph(graph.vertices, materialize(graph.edges, "rmat"))
    lacking = transpose_violations(graph.edges, graph.reverse().edges).count()
    ends = _drawn(graph).agg(
        F.sum("k").alias("ends"), F.min("eighth").alias("first"), F.max("eighth").alias("last"), F.max_by("eighth", "k").alias("fullest")
    )
    return ends.withColumns({"n": F.lit(n).cast("long"), "lacking": F.lit(lacking).cast("long")})


def random_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").count()
    grid = generators.uniform_grid([n, 2 * n], [1.0, 10.0], [0.0, 0.01], 5)
    return spark.createDataFrame([(g["n"], g["m"], g["negative"], g["seed"]) for g in grid], "n long, m long, negative double, seed long")


def new_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.new_array(spark, table(spark, sf_dir, "part").count(), 7)


def rank_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = part_graph(spark, sf_dir).densify()[0].vertices
    n = dense.count()
    return dense.groupBy(rank_of(F.col("id"), n, 7).alias("rank")).agg(F.count("*").alias("n"))


def weights_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.hashed_weights(Graph.from_edges(part_edges(spark, sf_dir))).edges


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a sequence: the order key, total price in cents, and whether the order is finished."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"), (F.col("o_orderstatus") == "F").alias("done")
    )


def _scan(inclusive: bool, backward: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.scan(cents(spark, sf_dir), "sum", inclusive, backward)


def scan_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.scan(cents(spark, sf_dir), "max", True, False)


def enumerate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.enumerate_flags(cents(spark, sf_dir), F.col("done"))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pack(cents(spark, sf_dir), F.col("done"))


def pack2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pack2(cents(spark, sf_dir), F.col("done"), ~F.col("done"))


def pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pack_index(cents(spark, sf_dir), F.col("done"))


def filter_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.filter_seq(cents(spark, sf_dir), F.col("value") >= 10_000_000).select("idx", "value")


def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.reduce(cents(spark, sf_dir))


def map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.map_reduce(cents(spark, sf_dir), lambda v: scalars.absolute(v - 10_000_000), "min")


def reduce_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.reduce(cents(spark, sf_dir), lambda a, b: a.bitwiseXOR(b))


def max_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.max_index(cents(spark, sf_dir))


def best_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the orders whose price has the largest last three digits."""
    return sequence.max_index(cents(spark, sf_dir), lambda a, b: a % 1000 > b % 1000)


def sum_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sum_flags(cents(spark, sf_dir), F.col("done"))


def _parts_and_probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.length("p_name").cast("long").alias("value"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    numbered = prefix_scan(lines.withColumn("one", F.lit(1)), order, {"idx": "one"})
    return a, numbered.select("idx", F.col("l_partkey").alias("value"))


def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, probes = _parts_and_probes(spark, sf_dir)
    return sequence.gather(a, probes, 1000)


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, probes = _parts_and_probes(spark, sf_dir)
    return sequence.scatter(a, probes, a.count())


def _of_parts(value: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), value(F.col("p_partkey")).alias("value"))


def bench_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as timing results: quantities are seconds, line numbers are numbers of workers."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("strong").alias("kind"), F.col("l_linestatus").alias("algorithm"), F.col("l_returnflag").alias("graph"), F.col("l_linenumber").alias("workers"), F.col("l_quantity").alias("seconds")
    )
    means = mean_results(select_results(rows, kind="strong", graph="R"), ["algorithm", "workers"])
    return means.select("algorithm", "workers", F.round("ms", 4).alias("ms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bfs_levels": bfs_levels,
    "bfs_histogram": bfs_histogram,
    "sssp": sssp,
    "sssp_negative": sssp_negative,
    "min_label": min_label,
    "wcc": wcc,
    "wcc_sizes": wcc_sizes,
    "pagerank10": pagerank10,
    "pagerank_delta": pagerank_delta,
    "vertex_program_bfs": vertex_program_bfs,
    "out_degree": out_degree,
    "in_degree": in_degree,
    "neighbors_out": partial(_lists, "out"),
    "neighbors_in": partial(_lists, "in"),
    "transpose": transpose,
    "symmetrize": symmetrize,
    "densify": densify,
    "transpose_check": transpose_check,
    "csr_offsets": csr_offsets,
    "csr_roundtrip": csr_roundtrip,
    "csr_unweighted": csr_unweighted,
    "csr_one_side": csr_one_side,
    "graph_catalog": graph_catalog,
    **{f"edge_list_{name}": partial(_edge_list, name) for name in FORMATS},
    "shift": shift,
    "graph_counts": graph_counts,
    "edge_scan": edge_scan,
    "edge_scan_out": edge_scan_out,
    "rank_partition": rank_partition,
    "weights_deterministic": weights_deterministic,
    "weights_random": weights_random,
    "random_uniform": random_uniform,
    "random_rmat": random_rmat,
    "random_grid": random_grid,
    "new_array": new_array,
    "scan_excl": partial(_scan, False, False),
    "scan_incl": partial(_scan, True, False),
    "scan_back": partial(_scan, False, True),
    "scan_incl_back": partial(_scan, True, True),
    "scan_max": scan_max,
    "enumerate_flags": enumerate_flags,
    "pack": pack,
    "pack2": pack2,
    "pack_index": pack_index,
    "filter_seq": filter_seq,
    "reduce_sum": reduce_sum,
    "map_reduce": map_reduce,
    "reduce_general": reduce_general,
    "max_index": max_index,
    "best_index": best_index,
    "sum_flags": sum_flags,
    "gather": gather,
    "scatter": scatter,
    "hash32": partial(_of_parts, scalars.hash32),
    "hash_int": partial(_of_parts, scalars.hash_int),
    "hash2": partial(_of_parts, scalars.hash2),
    "log2_up": partial(_of_parts, scalars.log2_up),
    "bench_mean": bench_mean,
}

_EDGES = """e AS (
  SELECT src, dst, weight FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst,
      CAST(floor(l_quantity) AS BIGINT) AS weight FROM lineitem) WHERE dst IS NOT NULL),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
root AS (SELECT src AS id FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"""
_DENSE = f"{_EDGES}, dn AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS k FROM v)"
_INF = 9223372036854775807


def _paths(edges: str) -> str:
    """Least weights from the root, each vertex kept with its best so far."""
    return f"""WITH RECURSIVE {_EDGES}, w AS ({edges}), t(id, d) USING KEY (id) AS (
  SELECT id, CAST(0 AS BIGINT) FROM root
  UNION
  SELECT w.dst, min(t.d + w.weight) FROM t JOIN w ON w.src = t.id LEFT JOIN recurring.t AS r ON r.id = w.dst
  WHERE r.d IS NULL OR t.d + w.weight < r.d GROUP BY w.dst)
SELECT v.id, coalesce(t.d, {_INF}) AS dist FROM v LEFT JOIN t ON t.id = v.id"""


def _labels(edges: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, w AS ({edges}), t(id, label) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT w.dst, min(t.label) FROM t JOIN w ON w.src = t.id JOIN recurring.t AS r ON r.id = w.dst WHERE t.label < r.label GROUP BY w.dst)
SELECT id, label FROM t"""


_HOPS = _paths("SELECT DISTINCT src, dst, 1 AS weight FROM e")
_BOTH = _labels("SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e")
_RANKS = f"""WITH RECURSIVE {_EDGES}, n AS (SELECT count(*) AS n FROM v),
c AS (SELECT e.src, e.dst, 1.0 / d.k AS share FROM e JOIN (SELECT src, count(*) AS k FROM e GROUP BY src) d ON d.src = e.src),
s AS (SELECT src, dst, CAST(sum(share) AS DOUBLE) AS share FROM c GROUP BY src, dst),
t(i, id, score) AS (
  SELECT 0, id, 1e0 / n FROM v, n
  UNION ALL
  SELECT i + 1, id, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * coalesce(got, 0e0) FROM (
    SELECT a.i, a.id, b.got FROM t a LEFT JOIN (SELECT s.dst, sum(t.score * s.share) AS got FROM t JOIN s ON s.src = t.id GROUP BY s.dst) b ON b.dst = a.id), n
  WHERE i < 10)"""
_SEQ = "q AS (SELECT o_orderkey AS idx, CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderstatus = 'F' AS done FROM orders)"
_PROBES = """a AS (SELECT p_partkey AS idx, CAST(length(p_name) AS BIGINT) AS value FROM part), n AS (SELECT count(*) AS n FROM part),
r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, l_partkey AS p FROM lineitem)"""


def _window(frame: str, order: str = "") -> str:
    return f"WITH {_SEQ} SELECT idx, CAST(coalesce(sum(value) OVER (ORDER BY idx {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}), 0) AS BIGINT) AS value FROM q"


def _mix(x: str) -> str:
    query = f"SELECT p_partkey AS id, ({x} & 4294967295) AS v FROM part"
    for constant, put_in, put_shifted, by in scalars.MIX:
        first = f"((v + {constant}) & 4294967295)" if put_in == "add" else f"xor(v, {constant})"
        shifted = f"((v << {by}) & 4294967295)" if by > 0 else f"(v >> {-by})"
        e = f"(({first} + {shifted}) & 4294967295)" if put_shifted == "add" else f"xor({first}, {shifted})"
        query = f"SELECT id, {e} AS v FROM ({query})"
    return query


_NEIGHBORS = """WITH {edges} SELECT {own} AS id, string_agg(CAST({other} AS VARCHAR), ',' ORDER BY {other}, weight) AS neighbors,
  string_agg(CAST(weight AS VARCHAR), ',' ORDER BY {other}, weight) AS weights FROM e GROUP BY {own}"""
_DEGREE = "WITH {edges}, p AS (SELECT id FROM v UNION SELECT p_partkey FROM part) SELECT p.id, count({end}) AS degree FROM p LEFT JOIN e ON e.{end} = p.id GROUP BY p.id"



def _listed(form: EdgeListFormat) -> str:
    """The edges of a format's graph: dense ids are the parts' own, sparse ones are ranked."""
    weight = ", weight - 25 AS weight" if form.weighted else ""
    if not form.dense:
        return f"WITH {_DENSE} SELECT a.k AS src, b.k AS dst{weight} FROM e JOIN dn a ON a.id = e.src JOIN dn b ON b.id = e.dst"
    return f"WITH {_EDGES} SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"


ORACLE: dict[str, str] = {
    "bfs_levels": _HOPS,
    "bfs_histogram": f"SELECT dist, count(*) AS n FROM ({_HOPS}) GROUP BY dist",
    "sssp": _paths("SELECT src, dst, min(weight) AS weight FROM e GROUP BY src, dst"),
    "sssp_negative": _paths("SELECT src, dst, min(weight) - 3 AS weight FROM e WHERE src < dst GROUP BY src, dst"),
    "min_label": _labels("SELECT DISTINCT src, dst FROM e"),
    "wcc": _BOTH,
    "wcc_sizes": f"SELECT label, count(*) AS n FROM ({_BOTH}) GROUP BY label",
    "pagerank10": f"{_RANKS} SELECT id, round(score, 8) AS score FROM t WHERE i = 10",
    "pagerank_delta": f"{_RANKS} SELECT a.i + 1 AS iteration, round(sum(abs(b.score - a.score)), 8) AS delta FROM t a JOIN t b ON b.i = a.i + 1 AND b.id = a.id GROUP BY a.i",
    "vertex_program_bfs": _HOPS,
    "out_degree": _DEGREE.format(edges=_EDGES, end="src"),
    "in_degree": _DEGREE.format(edges=_EDGES, end="dst"),
    "neighbors_out": _NEIGHBORS.format(edges=_EDGES, own="src", other="dst"),
    "neighbors_in": _NEIGHBORS.format(edges=_EDGES, own="dst", other="src"),
    "transpose": f"WITH {_EDGES} SELECT dst AS src, src AS dst, weight FROM e",
    "symmetrize": f"WITH {_EDGES} SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e",
    "densify": f"WITH {_DENSE} SELECT a.k AS src, b.k AS dst FROM e JOIN dn a ON a.id = e.src JOIN dn b ON b.id = e.dst",
    "transpose_check": f"WITH {_EDGES} SELECT DISTINCT src, dst, 'in' AS missing FROM e WHERE dst = src + 1",
    "csr_offsets": f"WITH {_EDGES}, d AS (SELECT id, count(src) AS k FROM v LEFT JOIN e ON src = id GROUP BY id) SELECT id, CAST(coalesce(sum(k) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d",
    "csr_roundtrip": f"WITH {_DENSE} SELECT a.k AS src, b.k AS dst, weight FROM e JOIN dn a ON a.id = e.src JOIN dn b ON b.id = e.dst",
    "csr_unweighted": f"WITH {_DENSE} SELECT side, a.k AS src, b.k AS dst FROM (VALUES ('out'), ('in')) s(side), e JOIN dn a ON a.id = e.src JOIN dn b ON b.id = e.dst",
    "csr_one_side": f"WITH {_DENSE}, k AS (SELECT a.k AS src, b.k AS dst FROM e JOIN dn a ON a.id = e.src JOIN dn b ON b.id = e.dst) SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k",
    "graph_catalog": f"WITH {_EDGES} SELECT name, (SELECT count(*) FROM v) AS n, times * (SELECT count(*) FROM e) AS m FROM (VALUES ('directed', 1), ('both_ways', 2)) s(name, times)",
    **{f"edge_list_{name}": _listed(form) for name, form in FORMATS.items()},
    "shift": f"WITH {_EDGES} SELECT src - 1 AS src, dst - 1 AS dst, weight FROM e",
    "graph_counts": f"WITH {_EDGES}, p AS (SELECT id FROM v UNION SELECT p_partkey FROM part) SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM e) AS m",
    "edge_scan_out": f"WITH {_EDGES} SELECT src AS id, dst AS neighbor FROM e",
    "edge_scan": f"WITH {_EDGES} SELECT dst AS id, src AS neighbor FROM e",
    "rank_partition": f"WITH {_DENSE}, n AS (SELECT count(*) AS n FROM dn) SELECT least(k // greatest(n // 7, 1), 6) AS rank, count(*) AS n FROM dn, n GROUP BY 1",
    "weights_deterministic": f"WITH {_EDGES} SELECT src, dst, (src * 31 + dst * 17) % 11 AS weight FROM e",
    "weights_random": f"WITH {_EDGES} SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, CAST(10 AS BIGINT) AS high, true AS even FROM (SELECT DISTINCT src, dst FROM e)",
    "random_uniform": "SELECT count(*) AS n, 10 * count(*) AS m, 20 * count(*) AS ends, CAST(8 AS BIGINT) AS eighths, true AS even, CAST(500 AS BIGINT) AS high, true AS signed FROM part",
    "random_rmat": "SELECT count(*) AS n, 32 * count(*) AS ends, CAST(0 AS BIGINT) AS \"first\", CAST(7 AS BIGINT) AS \"last\", CAST(0 AS BIGINT) AS fullest, CAST(0 AS BIGINT) AS lacking FROM part",
    "random_grid": "WITH p AS (SELECT count(*) AS n FROM part) SELECT n * s AS n, n * s * r AS m, CAST(g AS DOUBLE) AS negative, CAST(k AS BIGINT) AS seed FROM p, (VALUES (1), (2)) a(s), (VALUES (1), (10)) b(r), (VALUES (0.0), (0.01)) c(g), range(5) t(k)",
    "new_array": "SELECT idx, 7 AS value FROM (SELECT unnest(range(count(*))) AS idx FROM part)",
    "scan_excl": _window("1 PRECEDING"),
    "scan_incl": _window("CURRENT ROW"),
    "scan_back": _window("1 PRECEDING", "DESC"),
    "scan_incl_back": _window("CURRENT ROW", "DESC"),
    "scan_max": f"WITH {_SEQ} SELECT idx, max(value) OVER (ORDER BY idx) AS value FROM q",
    "enumerate_flags": f"WITH {_SEQ} SELECT idx, CAST(coalesce(sum(CAST(done AS INT)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS value FROM q",
    "pack": f"WITH {_SEQ} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, value FROM q WHERE done",
    "pack2": f"WITH {_SEQ} SELECT row_number() OVER (ORDER BY done DESC, idx) - 1 AS idx, value FROM q",
    "pack_index": f"WITH {_SEQ} SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, idx AS value FROM q WHERE done",
    "filter_seq": f"WITH {_SEQ} SELECT idx, value FROM q WHERE value >= 10000000",
    "reduce_sum": f"WITH {_SEQ} SELECT CAST(sum(value) AS BIGINT) AS value FROM q",
    "map_reduce": f"WITH {_SEQ} SELECT min(abs(value - 10000000)) AS value FROM q",
    "reduce_general": f"WITH {_SEQ} SELECT bit_xor(value) AS value FROM q",
    "best_index": f"WITH {_SEQ} SELECT idx FROM q ORDER BY value % 1000 DESC, idx LIMIT 1",
    "max_index": f"WITH {_SEQ} SELECT idx FROM q ORDER BY value DESC, idx LIMIT 1",
    "sum_flags": f"WITH {_SEQ} SELECT count(*) AS value FROM q WHERE done",
    "gather": f"WITH {_PROBES} SELECT i % 1000 AS idx, arg_max(value, i) AS value FROM r JOIN a ON a.idx = r.p GROUP BY 1",
    "scatter": f"WITH {_PROBES} SELECT p AS idx, arg_max(value, i) AS value FROM r, n JOIN a ON a.idx = r.i % n.n GROUP BY 1",
    "hash32": f"SELECT id, v AS value FROM ({_mix('p_partkey')})",
    "hash_int": f"SELECT id, v & 2147483647 AS value FROM ({_mix('p_partkey')})",
    "hash2": "SELECT p_partkey AS id, ((1103515245 * p_partkey + 12345) & 4294967295) % 4294967295 AS value FROM part",
    "log2_up": "SELECT p_partkey AS id, CAST(CASE WHEN p_partkey <= 1 THEN 0 ELSE length(ltrim(bin(p_partkey - 1), '0')) END AS BIGINT) AS value FROM part",
    "bench_mean": "SELECT l_linestatus AS algorithm, l_linenumber AS workers, round(avg(l_quantity) * 1000, 4) AS ms FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
}
