"""The streaming probe, and that queries exist with their SQL."""

import __spark_entry__
from arbora.streaming import lca_probe


def test_stream(spark, tmp_path):
    tree = spark.createDataFrame(list(enumerate([None, 0, 0, 1, 1, 3])), "node long, parent long")
    spark.createDataFrame([(0, 3, 5), (1, 0, 2), (2, 4, 5)], "qid long, x long, y long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, x long, y long").parquet(str(tmp_path / "in"))
    run = lca_probe.write(stream, tree, str(tmp_path / "out"), str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    assert {r.qid: r.lca for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 3, 1: 0, 2: 1}


def test_stream_goes_on(spark, tmp_path):
    """A stream that is stopped after a batch and started anew answers each pair once, later ones too."""
    tree = spark.createDataFrame(list(enumerate([None, 0, 0, 1, 1, 3])), "node long, parent long")
    rows = [(i, i % 6, (i * i + 1) % 6) for i in range(40)]
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]

    def put(part):
        spark.createDataFrame(part, "qid long, x long, y long").coalesce(1).write.mode("append").parquet(paths[0])

    for a in (0, 10, 20):
        put(rows[a : a + 10])
    run = lca_probe.write(lca_probe.pairs(spark, paths[0]), tree, *paths[1:])
    while not run.recentProgress and run.isActive:
        run.awaitTermination(0.1)
    run.stop()
    assert spark.read.parquet(paths[1]).count() >= 10
    lca_probe.drain(lca_probe.pairs(spark, paths[0]), tree, *paths[1:])
    put(rows[30:])
    got = lca_probe.drain(lca_probe.pairs(spark, paths[0]), tree, *paths[1:]).collect()
    up = {0: [0], 1: [1, 0], 2: [2, 0], 3: [3, 1, 0], 4: [4, 1, 0], 5: [5, 3, 1, 0]}
    assert sorted(tuple(r) for r in got) == [(i, x, y, next(a for a in up[x] if a in up[y])) for i, x, y in rows]


def test_entry():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 40
