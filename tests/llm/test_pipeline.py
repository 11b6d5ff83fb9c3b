"""The pipeline's stages one after the other, each against what it must do."""

import corpus_pipeline
from test_langid import corpus


def test_stages_on_a_small_corpus(spark, documents_of, tmp_path):
    rows = corpus(90)
    long_text = " ".join(f"kalo{i} mira" for i in range(30))
    rows += [(200, long_text, "aa"), (201, long_text + " teno", "aa"), (202, "12 34", "aa"), (203, None, None),
             (204, "mira kalo teno joe@example.com salu porami kalo", "aa")]
    df = documents_of([(i, t, lang, f"s{i % 4}") for i, t, lang in rows])
    seen = {}
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = seen[name] = spark.read.parquet(path)
    ids = {n: {r.doc_id for r in d.collect()} for n, d in seen.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {202, 203}
    assert ids["language_id"] - ids["jaccard_join"] == {201}
    masked = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert masked[204] == "mira kalo teno [email] salu porami kalo"
    before = {r.doc_id: r.text for r in seen["jaccard_join"].collect()}
    assert all(masked[i] == before[i] for i in masked if i != 204)
    assert ids["mixing"] <= ids["pii"]
    mixed = sorted((r.doc_id, r.text) for r in seen["mixing"].collect())
    assert all(masked[i].startswith(t) for i, t in mixed)
    assert seen["sentencepiece"].count() == len(mixed)
    assert seen["sentencepiece"].where("not round_trip").count() == 0


def test_run_equals_the_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, docs.collect()))


def through(spark, docs, folder):
    """What each stage keeps, written and read again."""
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(folder / name))
        docs = seen[name] = spark.read.parquet(str(folder / name))
    return seen


def test_repeated_ids_nulls_and_clashing_columns(spark, documents_of, tmp_path):
    rows = [(i, t, lang, f"s{i % 3}") for i, t, lang in corpus(60)]
    # ids of one source come again with other texts in another, once without id or source
    rows += [(i, t + " joe@example.com", lang, "s9") for i, t, lang in corpus(12)]
    rows += [(None, rows[0][1] + " kalo mira teno", "aa", None), (300, None, None, None), (300, "", None, "s1")]
    extra = {"_score": "1.5", "_spans": "'kept'", "_taken": "7", "_id": "doc_id", "row": "'r'", "key": "'k'",
             "component_id": "-1", "n_words": "null", "_lettered": "false"}
    df = documents_of(rows).selectExpr("*", *(f"{v} as {k}" for k, v in extra.items()))
    seen = through(spark, df, tmp_path)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        kept = seen[name]
        assert kept.columns == df.columns
        assert kept.count() > 0
        wrong = " or ".join(f"not ({k} <=> {v})" for k, v in extra.items())
        assert kept.where(wrong).count() == 0, name
    assert seen["pii"].where("text like '%@%'").count() == 0
    assert seen["jaccard_join"].where("doc_id = 300").count() == 0
    assert seen["sentencepiece"].count() == seen["mixing"].count()


def test_an_empty_table_stays_empty(spark, documents_of, tmp_path):
    seen = through(spark, documents_of([(1, "kalo mira", "aa")]).limit(0), tmp_path)
    assert all(d.count() == 0 for d in seen.values())
