"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of documents.

Defined cases, in every stage: a null text is the empty text and stays as it is; null ids pass; texts of any length are
read whole; an empty table gives no rows; columns beyond those of documents are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import jaccard_join, packing, span_dedup, toxicity
from pulsegrid.llm.storage import materialise
from pulsegrid.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, doesn't reject.

    Empty texts are scored like others; repeated rows get the same score and stay or go together.
    """
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 0").select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word shingles link.

    Of equal documents one stays, ties by the operator's fixed order; texts without words are linked with nothing and all stay.
    """
    ship(spark)
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier place has.

    A document whose whole text is repeated stays with the empty text.
    """
    ship(spark)
    return span_dedup.remove_repeats(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("jaccard_join", distinct_documents), ("span_dedup", without_repeats), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
