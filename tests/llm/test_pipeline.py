import corpus_pipeline
import pytest
from conftest import prose


@pytest.fixture
def folder(spark, rng, tmp_path):
    """A small corpus with planted cases."""
    items = [(i, prose(rng, "fr", 40)) for i in range(3)]
    clean = [(i, prose(rng, "en", 80)) for i in range(60)]
    toxic = [(100 + i, prose(rng, "en", 40) + " villain scoundrel villain rascal " + prose(rng, "en", 20)) for i in range(30)]
    copies = [(200 + i, clean[7][1]) for i in range(5)] + [(210 + i, clean[8][1] + f" extra{i}") for i in range(3)]
    tainted = [(300 + i, prose(rng, "en", 20) + " " + items[i][1]) for i in range(3)]
    notice = prose(rng, "de", 60)
    lined = [(400 + i, prose(rng, "en", 70) + "\n" + notice) for i in range(6)]
    rows = clean + toxic + copies + tainted + lined
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return str(tmp_path), notice


def test_stages(spark, folder):
    path, notice = folder
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.where("n_chars <> length(text)").isEmpty()
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "line dedup":
            assert docs.where(docs.text.contains(notice)).isEmpty()
    everything = {*range(60), *range(200, 205), *range(210, 213), *range(300, 303), *range(400, 406)}
    assert left["toxicity"] == everything and left["line dedup"] == everything
    assert left["near dedup"] == everything - {*range(200, 205), *range(210, 213)}
    assert left["decontamination"] == left["near dedup"] - {300, 301, 302}
    assert left["mixing"] == left["decontamination"]
    assert set(docs.columns) == {"doc_id", "source", "size", "source_size", "target", "taken"}
    again = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_null_ids_do_not_pass(spark, folder, rng):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    none = [(docs.where(f"doc_id = {i}").first().text + more) for i, more in ((101, ""), (300, ""), (3, " of its own"))]
    docs = docs.unionByName(spark.createDataFrame([(None, t, "en", "s0", len(t)) for t in none], docs.schema))

    def left(stage):
        return {r.text for r in stage(spark, docs, path).where("doc_id is null").collect()}

    assert left(corpus_pipeline.toxic) == set(none[1:])
    assert left(corpus_pipeline.decontaminate) == {none[0], none[2]}
