"""The pipeline's stages one by one on the smallest tables."""

import corpus_pipeline as P
from cytoframe.llm import decontaminate, ngram_join, secrets


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    assert ngram_join.similar_documents(kept).where("component_id <> doc_id").count() == 0
    assert decontaminate.contamination(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    assert secrets.find_secrets(kept).where("size(spans) > 0").count() == 0
    packed = P.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words here again " * 20, "en", "s", 9), (4, "same words here again " * 20, "en", "s", 9), (None, "nameless text of some words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = P.near_duplicate_stage(spark, docs, sf)
    assert sorted(r.doc_id or 0 for r in near.collect()) == [0, 1, 2, 3]
    assert P.decontamination_stage(spark, docs, sf).count() == 5 and P.secrets_stage(spark, docs, sf).count() == 5
    assert P.packing_stage(spark, docs.where("false"), sf).count() == 0


def test_run_writes_and_rereads_each_stage(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "shared_dir", lambda spark: str(tmp_path), raising=False)
    got = P.run(spark, sf)
    tables = {p.name: p for p in tmp_path.glob("pipeline-*/*")}
    assert set(tables) == {name for name, _ in P.STAGES} and all((p / "_SUCCESS").exists() for p in tables.values())
    rows = {name: spark.read.parquet(str(p)) for name, p in tables.items()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.count() > rows["quality"].count() > rows["near_duplicates"].count() >= rows["decontamination"].count() == rows["secrets"].count()
    assert got.count() == rows["packing"].count() > 0


def test_repeated_rows_and_ids(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 200").first().text
    same, other = "the same ten words stand in all of these rows " * 3, "something else that nobody near has said before now " * 3
    rows = [(1, same), (1, same), (1, same), (2, same), (1, other), (None, same), (None, other + "x"), (3, ""), (3, ""), (4, item), (4, other + "y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = sorted((r.doc_id or -1, r.text) for r in P.near_duplicate_stage(spark, docs, sf).collect())
    assert len(near) == len(set(near)) and (1, same) not in near and (-1, same) in near and near.count((3, "")) == 1
    assert [i for i, t in near if t.startswith("something")] == [-1]
    clean = sorted((r.doc_id or -1, r.text) for r in P.decontamination_stage(spark, docs, sf).collect())
    assert clean == sorted((i or -1, t) for i, t in rows if t != item)
