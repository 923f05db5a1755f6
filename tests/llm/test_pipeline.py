from pyspark.sql import functions as F

from tidemark.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES:
        out = stage(spark, kept, SF)
        if name == "mixing":
            assert out.count() == kept.count()
            assert {"doc_id", "rate", "expected_tokens"} <= set(out.columns)
        else:
            assert sorted(out.columns) == sorted(docs.columns)
            out = out.cache()
            assert out.select("doc_id").exceptAll(kept.select("doc_id")).isEmpty()
            if name == "substring_dedup":
                assert out.count() == kept.count()
                assert out.where(F.col("n_chars") != F.length("text")).isEmpty()
            kept = out


def test_run_is_the_stages(spark):
    """All columns but the float ones of the last stage, which are compared to six places."""
    import corpus_pipeline as cp

    rows = cp.run(spark, SF)
    docs = cp.table(spark, SF, "documents").select(*cp.COLUMNS)
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF))
    want = cp.mixing_stage(spark, docs, SF)
    plain = lambda df: sorted((r.doc_id, r.n_tokens, r.domain, round(r.rate, 6), round(r.expected_tokens, 4), {k: round(v, 6) for k, v in r.posterior.items()}.items().__str__()) for r in df.collect())
    assert plain(rows) == plain(want)
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    assert all(r.n_tokens == words[r.doc_id] for r in rows.collect())


def test_toxicity_stage_is_the_operator(spark):
    import corpus_pipeline as cp

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r.doc_id for r in toxicity(docs, labels).where("predicted = 1").collect()}
    kept = {tuple(r) for r in cp.toxicity_stage(spark, docs.withColumn("score", F.lit(1)).withColumn("predicted", F.lit(1)), SF).select(*docs.columns).collect()}
    assert kept == {tuple(r) for r in docs.collect() if r.doc_id not in bad}


def test_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    story = " ".join(f"word{k}" for k in range(60))
    rows = [(None, None, None, None, None), (None, story, "en", "a", 1), (1, "", "en", "a", 0), (1, " \n", None, "a", 2), (2, "long " * 30000, "en", "b", 150000), (3, story, "en", "a", 400), (3, story, "en", "a", 400), (4, story, "de", "b", 400), (5, "What is the colour of the sky at noon? It is blue on most days.", "en", "b", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "What is the colour of the sky at noon? It is blue on most days."), (None, story), (2, None)], "item_id long, text string")
    for part, tables in (("full", (docs, labels, items)), ("none", (docs.limit(0), labels.limit(0), items.limit(0)))):
        for name, df in zip(("documents", "labels", "benchmark"), tables):
            df.withColumn("node", F.lit("x")).withColumn("rate", F.lit(2)).withColumn("print", F.lit(3)).write.parquet(f"{tmp_path}/{part}/{name}.parquet")
    out = cp.run(spark, f"{tmp_path}/full").collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 1, 2, 3, 3]
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
