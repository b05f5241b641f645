import corpus_pipeline


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 3 * before and out.where("NOT round_trip").count() == 0
