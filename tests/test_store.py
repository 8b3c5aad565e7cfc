"""The data sources for numbers and graphs: ranges, written folders, faults."""

import struct

import numpy as np
import pytest
from arbora.sources import binary, store
from arbora.sources.binary import BadFile

NUMBERS = [5, 8, 0, 2, 5, 5, 7, 8, 1, 2, 0, 2, 3, 0, 1, 1]  # node 2 has no arcs


def put(path, numbers):
    path.write_bytes(struct.pack(f"<{len(numbers)}i", *numbers))
    return str(path)


@pytest.mark.parametrize("step", [1, 3, 100])
def test_graph_file(spark, tmp_path, step):
    path = put(tmp_path / "g.bin", NUMBERS)
    want = sorted((r.arc_id, r.src, r.dst) for r in binary.read_graph(spark, path)[1].collect())
    assert want == [(0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 1, 3), (5, 3, 0), (6, 3, 1), (7, 4, 1)]
    rows = store.read_graph(spark, path, step)
    assert sorted((r.arc_id, r.src, r.dst) for r in rows.collect()) == want and rows.where("weight is not null").isEmpty()
    weighted = store.read_graph(spark, put(tmp_path / "w.bin", [*NUMBERS, *range(8)]), step)
    assert all(r.weight == r.arc_id for r in weighted.collect()) and weighted.count() == 8


def test_chunks(tmp_path, monkeypatch):
    """Hubs and runs of lone nodes that are longer than a step."""
    monkeypatch.setattr(store, "CHUNK", 3)
    degree = np.array([0, 0, 0, 0, 10, 0, 0, 0, 0, 0, 1, 7, 0, 0, 0, 0])
    src = np.repeat(np.arange(16), degree)
    path = put(tmp_path / "g.bin", [16, 18, 0, *np.cumsum(degree).tolist(), *(src[::-1].tolist())])
    for step in (1, 2, 5, 18, 40):
        reader = store.GraphReader({"path": path, "step": str(step)})
        rows = [tuple(x.values()) for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
        assert [r[:3] for r in rows] == list(zip(range(18), src.tolist(), src[::-1].tolist(), strict=True)), step


@pytest.mark.parametrize("numbers", [
    [4, 8, 0, 2], [2, 2, 0, 1, 2, 1, 7], [3, 6, 0, 5, 3, 6, 0, 1, 2, 0, 1, 2], [2, 2, 0, 1, 1, 1, 0], [2, 2, 1, 1, 2, 1, 0], [-1, 0, 0],
])
def test_bad_graphs(tmp_path, numbers):
    reader = store.GraphReader({"path": put(tmp_path / "g.bin", numbers), "step": "3"})
    with pytest.raises(BadFile):
        [list(reader.read(p)) for p in reader.partitions()]


def test_empty_graphs(spark, tmp_path):
    assert store.read_graph(spark, put(tmp_path / "a.bin", [0, 0, 0])).count() == 0
    assert store.read_graph(spark, put(tmp_path / "b.bin", [3, 0, 0, 0, 0, 0])).count() == 0
    with pytest.raises(Exception, match="no such file"):
        store.read_graph(spark, str(tmp_path / "none")).count()


def test_written_graph(spark, tmp_path):
    arcs = spark.createDataFrame([(0, 1, 7), (1, 0, 8), (3, 0, 9)] + [(4, i, i) for i in range(5)], "src long, dst long, weight long")
    path = str(tmp_path / "g")
    store.write_graph(arcs, 5, path)
    assert store.sizes(path) == (5, 8, True)
    got = store.read_graph(spark, path, 3).orderBy("arc_id").collect()
    assert [(r.src, r.dst, r.weight) for r in got] == sorted(tuple(r) for r in arcs.collect())
    with pytest.raises(Exception, match="there already"):
        store.write_graph(arcs, 5, path)
    assert store.read_graph(spark, path).count() == 8
    store.write_graph(arcs.where("src < 4").drop("weight"), 5, path, "overwrite")
    assert store.sizes(path) == (5, 3, False) and len(list(tmp_path.glob("g/part-*"))) == len(store.Numbers(path).parts)


@pytest.mark.parametrize("places", [[0, 2], [0, 1, 1], [1, 2]])
def test_places(spark, tmp_path, places):
    with pytest.raises(Exception, match="gaps or repeat"):
        store.write_numbers(spark.createDataFrame([(p, 5) for p in places], "at long, value long"), str(tmp_path / "n"))
    assert list(tmp_path.glob("n/*")) == []


def test_numbers_must_fit(spark, tmp_path):
    with pytest.raises(Exception, match="32 bits"):
        store.write_numbers(spark.createDataFrame([(0, 2**31)], "at long, value long"), str(tmp_path / "n"))


def test_what_failed_tries_leave(tmp_path):
    """Files of a try that was never committed aren't read."""
    import pyarrow as pa

    writer = store.NumbersWriter({"path": str(tmp_path)}, False)
    rows = [pa.RecordBatch.from_pydict({"at": [0, 1, 2], "value": [7, 8, 9]})]
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows)), None, writer.write(iter([]))])
    assert len(list(tmp_path.glob("part-*"))) == 2 and store.Numbers(str(tmp_path)).read(0, 3).tolist() == [7, 8, 9]


def test_written_tree(spark, tmp_path):
    tree = spark.createDataFrame(list(enumerate([None, 0, 0, 1, 1, 3])), "node long, parent long")
    queries = spark.createDataFrame([(0, 3, 5), (1, 0, 2), (2, 4, 5)], "qid long, x long, y long")
    store.write_tree(tree, queries, str(tmp_path / "t"))
    got, asked = store.read_tree(spark, str(tmp_path / "t"), 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in tree.collect())
    assert sorted(tuple(r) for r in asked.collect()) == [(0, 3, 5), (1, 0, 2), (2, 4, 5)]
