"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns, whatever they are called; the
last returns ids. A stage's result is written and read again before the next one.

Null texts count as empty ones and stay null. Rows that share an id are each scored, redacted and encoded on its own, and as
near duplicates they count as one document. An empty table of documents gives no rows; without labels nothing is rejected,
without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, decontam, jaccard_join, quality, secrets
from tapeloom.llm.common import stash, table
from tapeloom.llm.queries import tokenizer_path

#: Documents below this score of the quality classifier are rejected.
LEAST_QUALITY = 0.3
#: Near duplicates: shingles of so many words, and so many hundredths of their union in common.
SHINGLE_WORDS, SIMILARITY = 5, 80
WINDOW_WORDS = 10


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that none can clash with what an operator adds."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("string").alias("none")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("_rest"))


def _whole(bare: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return bare.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score LEAST_QUALITY or more; empty texts are scored like others, and a tie with it stays."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _whole(quality.score(_bare(docs), model).where(F.col("score") >= LEAST_QUALITY), docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the rows of the smallest id; texts without words and rows without an id stay."""
    return jaccard_join.deduplicate(docs, k=SHINGLE_WORDS, percent=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs; empty texts have none."""
    return _whole(decontam.drop_contaminated(_bare(docs), table(spark, sf_dir, "benchmark"), n=WINDOW_WORDS), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, n_chars (where there is such a column) counted anew; null texts stay null."""
    redacted = _whole(secrets.redact(secrets.scan(_bare(docs))), docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of all documents, in place of the texts and any other columns; an empty text has no ids."""
    coded = bpe.encode_decode(_bare(docs), tokenizer_path("word_bpe_49k.json"))
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded.select("doc_id", "_rest.lang", "_rest.source", "n_tokens", ids.alias("ids"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]
#: SQL can't express the classifier, the linking of secrets or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage{k}")
    return docs
