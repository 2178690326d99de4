"""From raw documents to token shards: five stages, each over all rows that the one before kept.

Every stage is a function of (spark, docs, sf_dir); its result is written and read again as the next
one's ``docs``.  Stages 1 to 4 return the columns of ``documents``; the last writes token shards and
returns one row for each sequence in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexivec.llm.decontaminate import drop_contaminated
from plexivec.llm.mixing import mixed_documents
from plexivec.llm.near_dedup import drop_near_duplicates
from plexivec.llm.quality import fit_scorer, score_quality
from plexivec.llm.token_shards import token_manifest
from plexivec.plans.staging import staged
from plexivec.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; fitted on the votes on all of ``docs``."""
    return score_quality(docs, fit_scorer(docs)).filter("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity 0.8."""
    return drop_near_duplicates(docs, n_words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the weights 3, 1, 2 in turn; documents come up to twice."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, repeats=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, and their sequences."""
    return token_manifest(docs, TOKENIZER, copies=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: The first stage is a trained model and the last a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
