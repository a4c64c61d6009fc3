import corpus_pipeline
from pyspark.sql import functions as F

from kinetrail.llm import mixing, neardup, packing, secrets, toxicity
from kinetrail.llm.common import table


def test_every_stage_acts_on_what_the_one_before_kept(spark, sf):
    docs = table(spark, sf, "documents")
    held = docs
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, held, sf)
        got = spark.createDataFrame(got.toPandas(), got.schema)
        ids, before = {r.doc_id for r in got.select("doc_id").collect()}, {r.doc_id for r in held.select("doc_id").collect()}
        assert ids <= before and got.count() == len(ids)
        if name == "toxicity":
            model = toxicity.train(held, table(spark, sf, "labels"))
            assert ids == {r.doc_id for r in held.collect() if model.score(r.text) < toxicity.THRESHOLD}
        if name == "near_dedup":
            classes = {r.doc_id: r.class_id for r in neardup.run(held).collect()}
            assert ids == set(classes.values())
        if name == "secrets":
            assert ids == before
            model = secrets.train(held)
            texts = {r.doc_id: r.text for r in held.collect()}
            for r in got.collect():
                assert (r.text != texts[r.doc_id]) == bool(model.scan(texts[r.doc_id])[1]) and r.n_chars == len(r.text)
        if name == "mixing":
            total = lambda df: df.agg(F.sum(packing.n_tokens())).first()[0]
            assert total(got) <= corpus_pipeline.MIX_SHARE * total(held) and ids < before
            assert mixing.select(held, 1.0, {}).count() == len(before)
        if name == "packing":
            assert ids == before and {"bucket", "batch", "place"} <= set(got.columns) and set(docs.columns) < set(got.columns)
            assert {r.doc_id: r.text for r in got.collect()} == {r.doc_id: r.text for r in held.collect()}
        else:
            assert got.columns == docs.columns
        held = got


def test_run_gives_the_rows_of_the_stages(spark, sf):
    held = table(spark, sf, "documents")
    for _, f in corpus_pipeline.STAGES:
        held = f(spark, held, sf)
        held = spark.createDataFrame(held.toPandas(), held.schema)
    key = lambda df: sorted((r.doc_id, r.bucket, r.batch, r.place) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(held)


def test_empty_tables(spark, tmp_path, sf):
    for name in ("documents", "labels"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
