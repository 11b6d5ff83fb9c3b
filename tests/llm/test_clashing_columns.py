"""Extra columns keep their values, whatever their names are."""

import pytest
from pyspark.sql import functions as F
from test_langid import corpus

import corpus_pipeline
from tallyscope.llm import langid, mixing, pii, toxicity

#: Names that the operators use for columns of their own, in one list.
NAMES = ["_id", "_none", "_source", "_size", "_place", "_taken", "_epoch", "_some", "__some", "_spans",
         "row", "_row", "_lettered", "_lang_pred", "_score", "_languages", "_fit", "lang_pred", "score",
         "toxic", "taken", "size", "target", "key", "component_id", "n_links", "_range", "_key", "_words"]


@pytest.fixture(scope="module")
def crowded(documents_of):
    df = documents_of([(i, f"{t} joe{i}@example.com", lang, f"s{i % 3}") for i, t, lang in corpus(40)])
    for n, name in enumerate(NAMES):
        df = df.withColumn(name, F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")))
    return df


def kept(df):
    rows = df.collect()
    assert rows
    for r in rows:
        assert [r[name] for name in NAMES] == [f"{n}:{r.doc_id}" for n in range(len(NAMES))]
    return rows


@pytest.mark.parametrize("stage", [langid.in_a_language, mixing.mixed_documents, pii.masked])
def test_stages_leave_other_columns_alone(crowded, stage):
    out = stage(crowded)
    assert out.columns == crowded.columns
    kept(out)


def test_the_pipeline_too(spark, crowded, tmp_path):
    docs = crowded
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == crowded.columns
    assert all("[email]" in r.text or r.text.count(" ") < 40 for r in kept(docs))


def test_toxicity_ignores_a_column_named_like_the_label(spark, documents_of):
    df = documents_of([(i, "plain words" if i % 2 else "vile words") for i in range(60)])
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)], "doc_id long, toxic int")
    want = sorted(map(tuple, toxicity.toxicity_scores(df, labels).collect()))
    other = df.withColumn("toxic", F.lit(7)).withColumn("score", F.lit("x"))
    assert sorted(map(tuple, toxicity.toxicity_scores(other, labels).collect())) == want


def test_the_pipeline_on_an_empty_table_and_repeated_ids(spark, documents_of, tmp_path):
    rows = [(i % 7, t, lang, f"s{i % 2}") for i, t, lang in corpus(30)]
    rows += [(None, rows[0][1], None, None), (1, None, None, None), (1, "", "aa", "s1")]
    for n, df in enumerate((documents_of(rows), documents_of(rows).limit(0))):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{n}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}{name}"))
        assert (docs.count() > 0) == (n == 0)
