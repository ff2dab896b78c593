"""The corpus pipeline: from raw documents to token ids, each stage on all that the one before it kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, and further columns as
they came, whatever their names. Defined cases: an empty table stays empty; null and empty texts are scored like
any others, are no one's copies, hold no personal data, and have no tokens; rows with a null id are kept or
dropped like others; of rows alike in id and text the near-duplicate stage keeps one; very long texts are
worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import bpe, jaccard, mixing, pii, quality
from halyard.llm.common import col, materialise, table

#: A document goes if its score is under this.
KEEP_FROM = 0.3
MIX_SEED = 20


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from all labels of the stage's input."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, trees, keep=tuple(docs.columns), out_col="\u0000score")
    return scored.where(F.col("\u0000score") >= KEEP_FROM).select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one with the smallest id."""
    return jaccard.unique(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind, and count the characters anew."""
    clean = pii.scrub(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to the production weights; a document comes once for each epoch it is chosen in."""
    return mixing.blend(docs, mixing.production_levels(), mixing.WEIGHTS, max_epochs=2, seed=MIX_SEED, out_col="\u0000mix").select(*map(col, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document: doc_id, n_tokens, ids."""
    encoded = bpe.encode(docs, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express a trained classifier or byte-pair merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
