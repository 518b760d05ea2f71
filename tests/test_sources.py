"""Files in and out."""

import gzip

import pytest

from sparkweave.__main__ import ALGORITHMS, main, mean_seconds
from sparkweave.config import load_settings
from sparkweave.functions.results import mean_results, merge_json, select_results
from sparkweave.graph import Graph
from sparkweave.sources.adjacency import catalog, from_one_side, read_adjacency, write_adjacency, write_one_side
from sparkweave.sources.edge_lists import ingest, read_graph

TOY = "4\n8\n0\n2\n4\n6\n1\n2\n2\n3\n3\n0\n0\n1\n0\n2\n4\n6\n2\n3\n0\n3\n0\n1\n1\n2\n"


def edges(g):
    return sorted(map(tuple, g.edges.collect()))


def test_read_toy(spark, tmp_path):
    (tmp_path / "toy.txt").write_text(TOY)
    found = read_adjacency(spark, str(tmp_path / "toy.txt"), validate=True)
    assert edges(found.graph) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 0), (2, 3), (3, 0), (3, 1)]
    assert sorted(map(tuple, found.in_edges.collect())) == edges(found.graph)
    (tmp_path / "one_line.txt").write_text(TOY.replace("\n", " "))
    assert edges(read_adjacency(spark, str(tmp_path / "one_line.txt")).graph) == edges(found.graph)
    assert [tuple(r) for r in catalog(spark, {"toy": str(tmp_path / "toy.txt")}).collect()] == [("toy", 4, 8)]


def test_catalog_of_folders(spark, tmp_path):
    """A folder's first part in name order has n and m, however long the others are."""
    for name, parts in {"split": ["3\n", "", "1\n" + "0\n" * 50], "one": ["4 8 0 2"]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "_SUCCESS").write_text("")
        for i, text in enumerate(parts):
            (tmp_path / name / f"part-{i}").write_text(text)
    assert [tuple(r) for r in catalog(spark, f"{tmp_path}/*").collect()] == [("one", 4, 8), ("split", 3, 1)]
    assert catalog(spark, f"{tmp_path}/none*").count() == 0
    (tmp_path / "empty").write_text("")
    with pytest.raises(ValueError, match="no n and m"):
        catalog(spark, {"empty": str(tmp_path / "empty")})


@pytest.mark.parametrize("algorithm", sorted(ALGORITHMS))
def test_entry_point(spark, tmp_path, algorithm):
    rows = [(0, 1, 2), (1, 2, 3), (2, 0, 1)]
    graph = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight long"))
    path = str(tmp_path / "g")
    write_adjacency(graph if ALGORITHMS[algorithm][0] else Graph(graph.vertices, graph.edges.drop("weight")), path)
    assert mean_seconds(spark, algorithm, path, runs=1) > 0


def test_entry_point_usage():
    with pytest.raises(SystemExit):
        main(["walk", "file"])


def test_malformed(spark, tmp_path):
    for name, text in (("short", "4 8 0 2"), ("fall", "2 2 1 0 0 1 0 1 0 1"), ("differ", "3 1 0 1 1 1 0 0 0 0"), ("none", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="numbers|fall|differ|no n"):
            edges(read_adjacency(spark, str(tmp_path / name), validate=name == "differ").graph)


@pytest.mark.parametrize("weighted", [False, True])
def test_round_trip(spark, tmp_path, weighted):
    rows = [(0, 3, 5), (3, 0, -1), (3, 0, 2), (3, 3, 0)] if weighted else [(0, 3), (3, 0), (3, 0), (3, 3)]
    frame = spark.createDataFrame(rows, "src long, dst long" + ", weight long" * weighted)
    g = Graph.from_edges(frame, spark.range(6).select("id"))
    for single in (False, True):
        path = str(tmp_path / f"{weighted}-{single}")
        write_adjacency(g, path, single_file=single)
        again = read_adjacency(spark, path, weighted, validate=True).graph
        assert edges(again) == sorted(rows) and again.num_nodes() == 6


def test_empty_graph(spark, tmp_path):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    write_adjacency(g, str(tmp_path / "empty"))
    assert read_adjacency(spark, str(tmp_path / "empty")).graph.num_nodes() == 0


def test_one_sided(spark, tmp_path):
    (tmp_path / "sym.txt").write_text("AdjacencyGraph\n2\n2\n0\n1\n1\n0\n")
    assert edges(from_one_side(spark, str(tmp_path / "sym.txt"))) == [(0, 1), (1, 0)]
    write_one_side(from_one_side(spark, str(tmp_path / "sym.txt")), str(tmp_path / "again"))
    assert edges(from_one_side(spark, str(tmp_path / "again"))) == [(0, 1), (1, 0)]
    (tmp_path / "asym.txt").write_text("AdjacencyGraph\n2\n1\n0\n1\n1\n")
    with pytest.raises(ValueError, match="symmetric"):
        from_one_side(spark, str(tmp_path / "asym.txt"))


def test_edge_lists(spark, tmp_path):
    (tmp_path / "fb").write_text("0 1\n0 3\n")
    g = read_graph(spark, str(tmp_path / "fb"), "facebook")
    assert edges(g) == [(0, 1), (0, 3), (1, 0), (3, 0)] and g.num_nodes() == 4
    with gzip.open(tmp_path / "tw.txt.gz", "wt") as f:
        f.write("100 7\n7 123456789012345678901234\n100 7\n")
    g = read_graph(spark, str(tmp_path / "tw.txt.gz"), "twitter")
    assert edges(g) == [(0, 2), (1, 0), (1, 0)]
    (tmp_path / "yt").write_text("# a\n# b\n# c\n# d\n1\t2\n2\t4\n")
    g = read_graph(spark, str(tmp_path / "yt"), "youtube")
    assert edges(g) == [(0, 1), (1, 0), (1, 3), (3, 1)] and g.num_nodes() == 4
    (tmp_path / "btc").write_text("6,2,4,1289241911.72836\n6,5,-10,1289241941.53378\n")
    assert edges(read_graph(spark, str(tmp_path / "btc"), "bitcoin_otc")) == [(2, 0, 4), (2, 1, -10)]


def test_ingest(spark, tmp_path):
    (tmp_path / "fb").write_text("0 1\n")
    out = str(tmp_path / "out")
    there = {f"{out}/old"}
    inputs = {"fb": (str(tmp_path / "fb"), "facebook"), "old": (str(tmp_path / "fb"), "facebook")}
    assert ingest(spark, inputs, out, there.__contains__) == [f"{out}/fb", f"{out}/fb_weighted", f"{out}/old_weighted"]
    both = read_adjacency(spark, f"{out}/fb_weighted", weighted=True, validate=True)
    assert sorted(map(tuple, both.in_edges.collect())) == edges(both.graph)


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([("strong", "bfs", "g", 1, 2.0), ("strong", "bfs", "g", 1, 4.0), ("weak", "bfs", "g", 1, 9.0)], "kind string, algorithm string, graph string, workers int, seconds double")
    assert mean_results(select_results(rows, kind="strong"), ["algorithm"]).first()["ms"] == 3000
    path = str(tmp_path / "r.json")
    merge_json(path, "strong", "bfs", "g", 1, 2.0)
    assert merge_json(path, "strong", "bfs", "g", 2, 1.0) == {"strong": {"bfs": {"g": {"1": 2.0, "2": 1.0}}}}


def test_settings(tmp_path):
    (tmp_path / "s.ini").write_text("[paths]\ngraphs = /data/g\n[grid]\nsizes = 10, 20\ncopies = 2\n")
    found = load_settings(str(tmp_path / "s.ini"))
    assert found.paths == {"graphs": "/data/g"} and found.sizes == (10, 20) and found.copies == 2 and found.ratios == (1.0, 10.0)
