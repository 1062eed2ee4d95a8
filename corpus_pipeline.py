"""A corpus in five stages: toxic documents go, one of each group of near-duplicates stays, personal data is masked,
sources are mixed to their weights, texts become token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import common, mixing, neardup, pieces, pii, toxicity

#: No SQL: stages learn models from the data.
ORACLE_SQL = None

#: Similarity from which the stage links documents; 0.85 is the contract of the query op10 alone.
NEAR = 0.8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labels whose crc32(doc_id) mod 3 isn't 1.

    Null and empty texts score by the intercept alone and stay with clean ones.  Repeated rows share their score.  Without
    labels all scores are 0.5 and all documents stay.  Columns of any name pass through.  An empty table gives one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.fit_and_score(docs, labels).where("toxic_predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: of each component the rows of its least doc_id, exact repeats of these once.

    Null and empty texts are no one's copy and stay, once for each doc_id and text.  Columns of any name pass through; of
    rows that agree in doc_id and text one is kept.  An empty table gives one.
    """
    return neardup.keep_one(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by its kind in brackets.

    Null and empty texts, repeated rows and columns of any other name pass through unchanged.  An empty table gives one.
    """
    return pii.redact(docs, pii.train(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: not at all, once or twice.

    Null source is a source of its own, the last; documents without words take part with size 0.  Repeated rows are rows
    of their own.  Columns of any name keep their values.  An empty table gives one.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the ids of the text, their number, and digests of the ids and of the decoded text.

    Null and empty texts encode as begin and end; repeated rows give equal rows; an empty table gives one.
    """
    encoded = pieces.encode_documents(docs, pieces.default_path())
    return encoded.select("doc_id", "source", "lang", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
