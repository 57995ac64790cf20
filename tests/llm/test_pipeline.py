"""The pipeline's stages against plain versions, and the pipeline as a whole."""

from test_operators import docs_of, plain_components, plain_fingerprint, plain_groups, rows, some_texts, toxic_corpus

import corpus_pipeline
from fathomline.llm import simhash, toxicity


def written(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))


def test_stages_keep_columns_and_meet_plain_versions(spark, tmp_path):
    docs, labels = toxic_corpus(spark, 120)
    docs = docs.unionByName(docs_of(spark, some_texts()))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    scores = toxicity.score(docs, toxicity.fit(docs, labels))
    assert clean.count() == scores.where(f"score < {toxicity.THRESHOLD}").count()
    exact = stages["exact dedup"](spark, clean, str(tmp_path)).cache()
    texts = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert exact.count() == len({g[4] for g in plain_groups(texts)})
    near = stages["simhash near-dedup"](spark, exact, str(tmp_path)).cache()
    left = [(r["doc_id"], r["text"]) for r in exact.collect() if r["doc_id"] is not None]
    comp = plain_components([plain_fingerprint(t) for _, t in left])
    firsts = {min(left[k][0] for k in range(len(left)) if comp[k] == c) for c in comp}
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == firsts
    mixed = stages["mixing"](spark, near, str(tmp_path)).cache()
    assert set(rows(mixed)) <= set(rows(near))
    for df in (clean, exact, near, mixed):
        assert df.columns == docs.columns
    packed = stages["packing"](spark, mixed, str(tmp_path))
    assert packed.where("start = 0").count() == mixed.count()


def test_near_dedup_of_the_pipeline_broadcasts_no_keys(spark, tmp_path, monkeypatch):
    plans, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or components(edges))
    assert dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs_of(spark, some_texts()[:9]), str(tmp_path)).count() == 9
    assert len(plans) == 1 and "Broadcast" not in plans[0], plans


def test_stages_carry_columns_of_every_kind(spark, tmp_path):
    """Extra columns, a map and names that clash with inner ones included, nulls in labels, repeated rows, and empty documents."""
    from pyspark.sql import functions as F

    docs, labels = toxic_corpus(spark, 60)
    docs = docs.unionByName(docs_of(spark, some_texts()))
    docs = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("text")), "content": F.lit(1), "row": F.array(F.lit(2.5)), "fp": F.lit(None).cast("string"), "best": F.struct(F.col("lang"), F.create_map(F.lit(1), F.lit(2)).alias("n"))})
    docs = docs.unionByName(docs.limit(9))
    labels.unionByName(spark.createDataFrame([(None, 1), (None, None), (3, None)], labels.schema)).write.parquet(str(tmp_path / "labels.parquet"))
    for rows_in in (docs, docs.limit(0)):
        now, many = rows_in, rows_in.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path)).cache()
            assert after.dtypes == docs.dtypes, name
            assert (after.count() > 0) == (many > 0), name
            assert after.where("text is not null and m['k'] <> text").count() == 0
            now = after
        assert (corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0) == (many > 0)


def test_run(spark, tmp_path):
    docs, labels = toxic_corpus(spark, 60)
    written(docs, tmp_path)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
