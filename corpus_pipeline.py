"""A training-data pipeline over ``documents``: reject toxic and poor texts, keep one of each group of near copies, pack.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; between stages the rows are written
to the shared folder and read again.  SQL can't express the models, so there is no oracle.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import jaccard, packing, quality, toxicity
from gridspark.llm.common import table
from gridspark.scratch import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic; all of them if ``labels`` has not both kinds (``toxicity.keep_clean``)."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; all of them if ``labels`` has not both kinds (``quality.keep_good``)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; documents without words all stay (``jaccard.keep_one``)."""
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids (``packing.pack``); null and empty texts give their end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("ngram_jaccard_join", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
