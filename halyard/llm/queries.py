"""The thin queries opN_<name> and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import bpe, curves, jaccard, langid, lzprint, mixing, oracles, order, pii, quality, repeats, resample, secretscan, spelling
from halyard.llm.common import scratch, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the words in 13-word windows that start in an earlier document too."""
    found = repeats.dedup(table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every whole text of documents, its edited form, and their likenesses."""
    return lzprint.with_next(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    import public_tokenizers as vocab

    ranks = vocab.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, vocab.PATTERN)
    decoded = bpe.decode(encoded, ranks, vocab.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Seed of the epochs' orders.
MIX_SEED = 20


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the production mixture, once for each epoch it is chosen in."""
    mixed = mixing.blend(table(spark, sf_dir, "documents"), mixing.production_levels(), mixing.WEIGHTS, max_epochs=2, seed=MIX_SEED)
    return mixed.select("doc_id", "mix.*")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every whole text of documents: five words, similarity 0.8 or more."""
    found = jaccard.join(table(spark, sf_dir, "documents"), n=5, percent=80)
    return found.select("doc_id", F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))


#: Key of the training order, and the id that pads a document's last sequence.
ORDER_KEY, PAD = 6, 50256


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents in training order to the shared folder; a row for each shard as it was read back."""
    import public_tokenizers as vocab

    path = f"{scratch(spark)}/halyard/order-{uuid.uuid4().hex}"
    order.write(table(spark, sf_dir, "documents"), path, ranks_path=vocab.path("byte_bpe_50k.tiktoken"), pattern=vocab.PATTERN, pad=PAD, key=ORDER_KEY)
    return spark.read.parquet(path).select("shard", "first_slot", "sequences", "tokens", F.sha2("payload", 256).alias("payload_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


def _crc(divisor: int) -> Column:
    """crc32 of the id's text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, _crc(4) != 2)
    return langid.predict(docs, model).select("doc_id", F.coalesce(_crc(4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the quality of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"), usable=_crc(5) != 0)
    return quality.score(docs, trees).select("doc_id", F.coalesce(_crc(5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other embeddings to each whose id is divisible by 100."""
    found = curves.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return secretscan.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, secretscan.KINDS), F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans")
    )


#: The share of long enough documents that is drawn, in percent, and the noise's seed.
DRAWN, DRAW_SEED = 10, 2024


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weigh every whole text of documents towards the benchmark's texts, and draw a tenth."""
    docs = table(spark, sf_dir, "documents")
    strings = resample.dictionary(docs, table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000)
    found = resample.draw(resample.weigh(docs, strings, longest=1), percent=DRAWN, seed=DRAW_SEED)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of documents, with the near word that occurs most and the root of their variants."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), shortest=5, least=3, one_in=97)
    return spelling.group(words, times=2).select("word", "n", "n_near", "form", "form_n", "root")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lz_fingerprint": op2_lz_fingerprint,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_mixing": op4_mixing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_training_order": op6_training_order,
    "op7_pii": op7_pii,
    "pipeline": pipeline,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_neighbours": op10_neighbours,
    "op11_secrets": op11_secrets,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_mixing": oracles.mixing(mixing.WEIGHTS, MIX_SEED),
    "op5_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op10_neighbours": oracles.NEIGHBOURS,
    "op12_importance_resampling": oracles.importance_resampling(DRAWN, DRAW_SEED),
    "op13_spelling_variants": oracles.SPELLING_VARIANTS,
}
