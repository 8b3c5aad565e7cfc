"""File formats: round trips, the documented shapes, errors."""

import struct

import pytest
from arbora.operators import report
from arbora.sources import binary, text
from arbora.sources.binary import BadFile


def put(path, data):
    path.write_bytes(data) if isinstance(data, bytes) else path.write_text(data)
    return str(path)


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_graph_file(spark, tmp_path):
    numbers = [4, 8, 0, 2, 5, 7, 8, 1, 2, 0, 2, 3, 0, 1, 1]
    n, arcs = binary.read_graph(spark, put(tmp_path / "g.bin", struct.pack("<15i", *numbers)))
    assert n == 4 and [r.dst for r in arcs.orderBy("arc_id").collect()] == numbers[7:]
    assert arcs.where("weight is not null").isEmpty()
    binary.write_graph(arcs.select("src", "dst"), 4, str(tmp_path / "h.bin"))
    assert (tmp_path / "h.bin").read_bytes() == (tmp_path / "g.bin").read_bytes()
    n, weighted = binary.read_graph(spark, put(tmp_path / "w.bin", struct.pack("<23i", *numbers, *range(8))))
    assert [r.weight for r in weighted.orderBy("arc_id").collect()] == list(range(8))
    n, same = text.read_graph_text(spark, put(tmp_path / "g.txt", "4 8\n0 2 5 7 8\n1 2 0 2 3\n0 1 1\n"))
    assert n == 4 and pairs(same) == pairs(arcs)


@pytest.mark.parametrize("numbers", [[4, 8, 0, 2], [2, 2, 0, 1, 2, 1, 7], [2, 2, 0, 2, 1, 1, 0], [2, 2, 0, 1, 2, 1, 0, 5]])
def test_bad_graph_file(spark, tmp_path, numbers):
    with pytest.raises(BadFile):
        binary.read_graph(spark, put(tmp_path / "g.bin", struct.pack(f"<{len(numbers)}i", *numbers)))


def test_missing_file(spark, tmp_path):
    with pytest.raises(BadFile):
        binary.read_graph(spark, str(tmp_path / "none.bin"))


def test_tree_file(spark, tmp_path):
    numbers = [6, 0, -1, 0, 0, 1, 1, 3, 3, 3, 5, 0, 2, 4, 5]
    tree, queries = binary.read_tree(spark, put(tmp_path / "t.in", struct.pack("<15i", *numbers)))
    assert {r.node: r.parent for r in tree.collect()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 1, 5: 3}
    assert [(r.x, r.y) for r in queries.orderBy("qid").collect()] == [(3, 5), (0, 2), (4, 5)]
    binary.write_tree(tree, queries, str(tmp_path / "u.in"))
    assert (tmp_path / "u.in").read_bytes() == (tmp_path / "t.in").read_bytes()
    tree2, _ = text.read_tree_text(spark, put(tmp_path / "t.txt", "6 0\n-1 0 0 1 1 3\n3\n3 5\n0 2\n4 5\n"))
    assert tree2.count() == 6
    answers = queries.selectExpr("qid", "x as lca")
    binary.write_answers(answers, str(tmp_path / "a.bin"))
    assert [r.lca for r in binary.read_answers(spark, str(tmp_path / "a.bin")).orderBy("qid").collect()] == [3, 0, 4]
    text.write_answers_text(answers, str(tmp_path / "a"))
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == ["3", "0", "4"]


def test_text_graphs(spark, tmp_path):
    n, arcs = text.read_dimacs(spark, put(tmp_path / "a.gr", "c 9th DIMACS Challenge\np sp 3 3\na 1 2 7\na 2 1 7\na 2 3 1\n"))
    assert n == 3 and pairs(arcs) == [(0, 1), (1, 0), (1, 2)] and arcs.agg({"weight": "sum"}).first()[0] == 15
    n, arcs = text.read_matrix_market(spark, put(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate integer general\n% c\n3 3 3\n1 2 5\n2 1 5\n1 2 6\n"))
    assert n == 3 and pairs(arcs) == [(0, 1), (0, 1), (1, 0), (1, 0)]
    n, arcs = text.read_matrix_market(spark, put(tmp_path / "b.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 1\n"))
    assert pairs(arcs) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    n, arcs = text.read_snap(spark, put(tmp_path / "a.txt", "# g\n# Nodes: 3 Edges: 3\n0\t1\n1\t0\n1\t2\n"))
    assert n == 3 and pairs(arcs) == [(0, 1), (1, 0), (1, 2), (2, 1)]


@pytest.mark.parametrize("read,body", [
    (text.read_dimacs, "c DIMACS\np sp 2 1\na 1 x 3\n"), (text.read_dimacs, "p sp 2 1\na 1 2 3\n"), (text.read_matrix_market, "%%MatrixMarket matrix array real general\n1 1 1\n"),
    (text.read_matrix_market, "%%MatrixMarket matrix coordinate pattern general\n2 3 1\n1 2\n"), (text.read_snap, "# Nodes: 2 Edges: 1\n0 2\n"), (text.read_snap, "0 1\n"),
])
def test_bad_text(spark, tmp_path, read, body):
    with pytest.raises(BadFile):
        read(spark, put(tmp_path / "bad", body))


def test_report(spark, tmp_path):
    log = "%%% file: a.mtx\n%%% n: 4\ntarjan: Spanning tree: 1.5 ms.\ntarjan: Overall: 4 ms.\n%%% file: b.mtx\nnaive: Overall: 2.5 ms.\nnoise\n"
    rows = report.parse_timings(report.read_logs(spark, put(tmp_path / "log", log))).collect()
    assert sorted((r.headers["file"], r.algo, r.phase, r.value) for r in rows) == [("a.mtx", "tarjan", "Overall", 4.0), ("a.mtx", "tarjan", "Spanning tree", 1.5), ("b.mtx", "naive", "Overall", 2.5)]
    runs = spark.createDataFrame([("a", "tarjan", "Overall", 1.0), ("a", "tarjan", "Overall", 3.0), ("a", "tarjan", "List rank", 2.0)], "file string, algo string, phase string, value double")
    got = {r.phase: (r.mean, r["std"]) for r in report.combined(runs, ["file", "algo"]).collect()}
    assert got == {"Overall": (2.0, 1.0), "List rank": (2.0, None)}
    assert [r.algo for r in report.ordered(spark.createDataFrame([("x",), ("b",), ("a",)], "algo string"), "algo", ["b", "a"]).collect()] == ["b", "a", "x"]


def test_report_of_runner_logs(spark, tmp_path):
    """Headers stand before and behind the timings, and blank lines end cases; a file's name holds the test's fields."""
    log = "%%% Bridges: File: a.mtx\n%%% N: 4\n%%% M: 8\ntarjan: Overall: 4 ms.\n%%% # Bridges: 2\n\n%%% Lca: File: dir/t$V_10#Q_20#grasp_-1\ninlabel: Queries: 1e-3 ms.\n%%% MaxHeight: 7\n"
    rows = report.parse_timings(report.read_logs(spark, put(tmp_path / "log", log))).collect()
    got = {r.algo: (r.headers, r.value) for r in rows}
    assert got == {"tarjan": ({"problem": "Bridges", "File": "a.mtx", "N": "4", "M": "8", "# Bridges": "2"}, 4.0), "inlabel": ({"problem": "Lca", "File": "dir/t$V_10#Q_20#grasp_-1", "MaxHeight": "7"}, 0.001)}
    names = spark.createDataFrame([("t$V_10#Q_20#grasp_-1",), ("plain.mtx",), ("x$grasp_3.bin",)], "file string")
    assert [tuple(r) for r in names.select(report.name_fields("file")).collect()] == [(10, 20, -1, None), (None,) * 4, (None, None, 3, None)]
