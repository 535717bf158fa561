"""From raw documents to packed training sequences, in five stages that each are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import ngram_join, packing, quality_ranking, quality_rules, secret_scans
from shelfmark.llm._shared import id_fold, table
from shelfmark.session import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above its threshold, learned from two thirds of the labels.

    Null and empty texts are scored like others, repeated rows alike; a score of exactly the threshold is kept; an empty table gives none.
    """
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 3) != 1)
    ranked = quality_ranking.rank(docs, quality_ranking.train(docs, labels), docs.columns)
    # A filter is not pushed below a row's number; below the projections that count the words it would make each of them anew for every use.
    return ranked.withColumn("number", F.monotonically_increasing_id()).where("predicted = 1 AND number >= 0").select("doc.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's distributions.

    Null, empty and short texts (under ten words) fail; repeated rows are judged alike; a null language is a language of its own; an empty table gives none.
    """
    return quality_rules.judge(docs, docs.columns).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that links of 0.75 connect, that of the smallest id (null ids last), and all without words.

    Every row is a document: rows of one id with different texts stay unless their texts link; of repeated rows one stays. An empty table gives none.
    """
    return ngram_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans that the scan finds replaced by a mark and ``n_chars`` set anew where it changes. Null texts stay null, repeated rows repeated."""
    return secret_scans.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with the sequence and offset where it stands.

    Null and empty texts pack as their closing id; repeated rows are packed each; texts of any length are cut into pieces; an empty table gives none.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("ngram_join", near_duplicates),
    ("secret_scans", secrets),
    ("packing", sequences),
]

#: SQL can express neither the fitted ranking nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
