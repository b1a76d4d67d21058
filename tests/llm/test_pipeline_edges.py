"""The pipeline's stages on odd tables: nulls, empty texts, repeated rows, ties, clashing columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_llm import prose

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "spans", "items", "n_hit", "n_words", "contaminated", "component_id", "ids", "decoded", "log_words", "node", "_w")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, path = random.Random(6), str(tmp_path_factory.mktemp("odd"))
    good = [(i, prose(r, 60), "en", "s", 0) for i in range(60)]
    rows = [*good, good[3], (100, None, "en", None, None), (101, "", None, "s", 0), (102, good[5][1], "en", "s", 0), (103, "x password=abcdefgh12 y", "en", "s", 0), (None, prose(r, 20), "en", "s", 0), (104, good[8][1] + " " + prose(r, 2), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, good[7][1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, path


def test_stages_keep_columns_of_any_name(spark, tables):
    rows, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES), name
    assert p.STAGES[-1][1](spark, docs, path).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_decisions_on_odd_rows(spark, tables):
    rows, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    n = len(rows)
    assert p.keep_good(spark, docs, path).count() == n  # only good ones are labelled
    one = sorted(str(r["doc_id"]) for r in p.keep_one_of_near_duplicates(spark, docs, path).collect())
    assert one == sorted(str(x[0]) for x in rows if x[0] not in (102, 104))
    clean = sorted(str(r["doc_id"]) for r in p.drop_contaminated(spark, docs, path).collect())
    assert clean == sorted(str(x[0]) for x in rows if x[0] != 7)
    safe = {r["doc_id"]: r for r in p.redact_secrets(spark, docs, path).collect()}
    assert safe[103]["text"] == "x [secret] y" and safe[103]["n_chars"] == 12 and safe[100]["text"] is None and safe[100]["n_chars"] is None and safe[101]["text"] == ""
    coded = [r for r in p.encode(spark, docs, path).collect()]
    assert len(coded) == n and all(len(r["ids"]) == r["n_tokens"] for r in coded)
    assert {r["doc_id"]: r["ids"] for r in coded}[100] == [] == {r["doc_id"]: r["ids"] for r in coded}[101]


def test_no_rows(spark, tables):
    _, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, docs, path).count() == 0, name
