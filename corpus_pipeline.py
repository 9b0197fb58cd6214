"""A training corpus out of `documents`, in five stages, each an operator of gridloom.llm.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written and read again as the next one's docs.  All but the last return the
columns of documents, further ones among them, whatever their names.

Nulls may stand in any column, texts may be empty or as long as a row allows,
rows may repeat, and an empty table gives an empty result of the same columns;
what that means for a stage's decisions is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, mixing, ngram_join, quality, secret_scan
from gridloom.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from a bounded sample of labelled documents.

    Null, empty and blank texts are scored as one passage without features;
    rows that repeat are kept or rejected together; without labels of both
    kinds all rows have one score, and all stay unless the labels are all 0.
    """
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the least doc_id.

    Texts that are null, empty or without words link with nothing, and all of
    them stay, as do rows without doc_id; of rows with one doc_id one stays.
    """
    return ngram_join.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by a mark; n_chars follows the text; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them.

    A null source is one of its own; texts without words (null ones too) count
    nothing and stay once; rows with one doc_id, and those without, have one
    place in the seeded order.
    """
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the text decoded from them of each document of the mix; null and empty texts have no tokens."""
    return bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: A trained classifier is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is cut off in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
