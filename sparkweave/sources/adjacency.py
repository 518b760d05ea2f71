"""Adjacency files: n, m, then offsets and edges of the out-side and of the in-side, as whitespace-separated numbers.

An edge entry is a vertex, or a vertex and a weight. Line breaks mean nothing to
the reader; the writer puts one number or pair in a line, in files whose names
are in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.graph import Graph, transpose_violations
from sparkweave.operators.scan import prefix_scan
from sparkweave.storage import materialize


@dataclass(frozen=True)
class AdjacencyFile:
    graph: Graph
    #: Edges as the in-side lists them, as (src, dst[, weight]).
    in_edges: DataFrame


def _tokens(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(at, token): all numbers with their places, found by a prefix sum over the lines' counts."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.array_remove(F.split("value", r"\s+"), "").alias("words"),
    )
    lines = lines.where(F.size("words") > 0)
    if header:  # a title without a number
        lines = lines.where(F.col("words")[0].rlike(r"^-?\d+$"))
    numbered = prefix_scan(lines.withColumn("n", F.size("words")), ["file", "block", "line"], {"before": "n"})
    each = numbered.select("before", F.posexplode("words").alias("pos", "word"))
    return each.select((F.col("before") + F.col("pos")).alias("at"), F.col("word").cast("long").alias("token"))


def _side(tokens: DataFrame, begin: int, n: int, m: int, weighted: bool) -> DataFrame:
    """(own, other[, weight]) of one side, by expanding each vertex's range of places and joining on the place."""
    width = 2 if weighted else 1
    offsets = tokens.where(F.col("at").between(begin, begin + n - 1)).select((F.col("at") - begin).alias("own"), F.col("token").alias("low"))
    after = offsets.select((F.col("own") - 1).alias("own"), F.col("low").alias("high"))
    ranges = offsets.join(after, "own", "left").select("own", "low", F.coalesce("high", F.lit(m).cast("long")).alias("high"))
    checked = ranges.select("own", "low", F.when(F.col("high") >= F.col("low"), F.col("high")).otherwise(F.raise_error(F.lit("offsets fall"))).alias("high"))
    places = checked.where("high > low").select("own", F.explode(F.sequence("low", F.col("high") - 1)).alias("place"))
    first = begin + n
    entries = tokens.where(F.col("at").between(first, first + m * width - 1)).withColumn("k", F.col("at") - first)
    if not weighted:
        return places.join(entries.select(F.col("k").alias("place"), F.col("token").alias("other")), "place").select("own", "other")
    pairs = entries.groupBy(F.expr("k div 2").alias("place")).agg(
        F.max(F.when(F.col("k") % 2 == 0, F.col("token"))).alias("other"), F.max(F.when(F.col("k") % 2 == 1, F.col("token"))).alias("weight")
    )
    return places.join(pairs, "place").select("own", "other", "weight")


def read_adjacency(spark: SparkSession, path: str, weighted: bool = False, header: bool = False, validate: bool = False) -> AdjacencyFile:
    """The graph of a file (or folder of files in name order), all n vertices included; the out-side counts.

    A file whose numbers are more or fewer than its n and m say is an error, and
    so are falling offsets. ``header`` passes over title lines. ``validate``
    makes sides that differ an error.
    """
    tokens = materialize(_tokens(spark, path, header), "tokens")
    head = {r["at"]: r["token"] for r in tokens.where("at < 2").collect()}
    if len(head) < 2:
        raise ValueError(f"{path} has no n and m")
    n, m = head[0], head[1]
    width = 2 if weighted else 1
    count = tokens.count()
    if count != 2 + 2 * (n + m * width):
        raise ValueError(f"{path} has {count} numbers; n = {n} and m = {m} need {2 + 2 * (n + m * width)}")
    rest = ["weight"] if weighted else []
    out = materialize(_side(tokens, 2, n, m, weighted), "out-side").select(F.col("own").alias("src"), F.col("other").alias("dst"), *rest)
    into = _side(tokens, 2 + n + m * width, n, m, weighted).select(F.col("other").alias("src"), F.col("own").alias("dst"), *rest)
    if validate and not transpose_violations(out, into).isEmpty():
        raise ValueError(f"the sides of {path} differ")
    return AdjacencyFile(Graph(spark.range(n).select("id"), out), into)


def write_adjacency(graph: Graph, path: str, single_file: bool = False, mode: str = "error") -> None:
    """Write a graph with dense ids from 0; neighbours stand in ascending order (then by weight). A null weight counts as 0."""
    _write(graph, path, [graph, graph.reverse()], [], single_file, mode)


def write_one_side(graph: Graph, path: str, title: str = "AdjacencyGraph", single_file: bool = False, mode: str = "error") -> None:
    """Write a title, n, m and the out-side alone, as ``from_one_side`` reads them."""
    _write(graph, path, [graph], [title], single_file, mode)


def _write(graph: Graph, path: str, sides: list[Graph], titles: list[str], single_file: bool, mode: str) -> None:
    spark = graph.vertices.sparkSession
    head = [*titles, str(graph.num_nodes()), str(graph.num_edges())]
    rows = spark.createDataFrame([(0, at, 0, line) for at, line in enumerate(head)], "section int, a long, b long, line string").withColumn("w", F.lit(0).cast("long"))
    for section, side in enumerate(sides):
        section = 2 * section + 1
        offsets = side.offsets().select(F.lit(section).alias("section"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("offset").cast("string").alias("line"), F.lit(0).cast("long").alias("w"))
        weight = F.coalesce("weight", F.lit(0)).cast("long") if graph.weighted else F.lit(0).cast("long")
        text = F.concat_ws(" ", F.col("dst").cast("string"), *([weight.cast("string")] if graph.weighted else []))
        edges = side.edges.select(F.lit(section + 1).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), text.alias("line"), weight.alias("w"))
        rows = rows.unionByName(offsets).unionByName(edges)
    order = ["section", "a", "b", "w"]
    dealt = rows.coalesce(1) if single_file else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.mode(mode).text(path)


def from_one_side(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """A graph from a file with a title and the out-side alone (n, m, offsets, edges); it must be symmetric, as its in-side is taken to be the same."""
    tokens = materialize(_tokens(spark, path, True), "tokens")
    head = {r["at"]: r["token"] for r in tokens.where("at < 2").collect()}
    n, m = head[0], head[1]
    rest = ["weight"] if weighted else []
    out = _side(tokens, 2, n, m, weighted).select(F.col("own").alias("src"), F.col("other").alias("dst"), *rest)
    graph = Graph(spark.range(n).select("id"), materialize(out, "out-side"))
    if not transpose_violations(graph.edges, graph.reverse().edges).isEmpty():
        raise ValueError(f"{path} isn't symmetric")
    return graph


def find(spark: SparkSession, pattern: str) -> dict[str, str]:
    """Name and path of every file or folder that a glob pattern matches."""
    glob, files = _files(spark, pattern)
    return {s.getPath().getName(): s.getPath().toString() for s in files.globStatus(glob) or []}


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The file at ``path``, or those in the folder that hold anything, in name order."""
    hadoop, files = _files(spark, path)
    if files.getFileStatus(hadoop).isFile():
        return [path]
    inside = [s.getPath() for s in files.listStatus(hadoop) if s.isFile() and s.getLen() > 0]
    return sorted(p.toString() for p in inside if not p.getName().startswith(("_", ".")))


def catalog(spark: SparkSession, paths: dict[str, str] | str) -> DataFrame:
    """(name, n, m) of adjacency files, from their first two numbers; ``paths`` are names and paths, or a glob pattern.

    Of a folder only the first parts in name order are opened. A file without two numbers is an error.
    """
    rows = []
    for name, path in sorted((find(spark, paths) if isinstance(paths, str) else paths).items()):
        numbers: list[int] = []
        for part in _parts(spark, path):
            numbers += [int(x) for r in spark.read.text(part).take(2) for x in r["value"].split()[:2]]
            if len(numbers) >= 2:
                break
        if len(numbers) < 2:
            raise ValueError(f"{path} has no n and m")
        rows.append((name, numbers[0], numbers[1]))
    return spark.createDataFrame(rows, "name string, n long, m long")
