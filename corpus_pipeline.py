"""Documents to a training corpus: quality, toxicity, near duplicates, mixture, tokens.

Each stage takes what the one before it kept. Rejected documents are taken out by their ids, so a row with a null
doc_id, which can't be told from others, stays. Rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bpe import bpe_encode
from tracewell.llm.common import materialise, table
from tracewell.llm.jaccard import ngram_jaccard_join
from tracewell.llm.mixing import mix_sources
from tracewell.llm.quality_model import quality_classifier
from tracewell.llm.toxicity import fit_toxicity, score_toxicity


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(materialise(rejected.select("doc_id").distinct(), "rejected"), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return _without(docs, quality_classifier(docs, table(spark, sf_dir, "labels")).where(~F.col("kept")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, score_toxicity(docs, model).where("toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return _without(docs, ngram_jaccard_join(docs).where(F.col("component_id") != F.col("doc_id")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, in its order: every document at least once, no source more than twice on average."""
    mixed = mix_sources(docs, target_entropy=0.5, most_repeats=2.0, budget_share=None)
    return mixed.repartitionByRange("mix_epoch", "mix_order").sortWithinPartitions("mix_epoch", "mix_order").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_encode(docs, path, public_tokenizers.PATTERN, ("ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Fitted models and a byte-pair encoder are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
