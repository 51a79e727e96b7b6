"""The registered queries opN_<name>: each operator over its whole table. Their SQL is in ``oracles``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import (
    hard_negatives,
    mixing,
    near_dedup,
    packing,
    pii,
    repetition,
    sharding,
    simhash,
    token_counts,
    token_store,
    topk,
    toxicity,
    whitening,
)
from evalweave.llm.oracles import ORACLES
from evalweave.llm.tokens import WORD_VOCABULARY, vocabulary_path
from evalweave.session import shared_path, stage

SHARDS = 16
SEQUENCE = 2048


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.with_shard(rows, "doc_id", [1.0] * SHARDS, grown_by=[1.0])
    return sharding.with_slots(placed, "shard")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write_store(
        documents(spark, sf_dir),
        "doc_id",
        "text",
        path,
        vocabulary=vocabulary_path(WORD_VOCABULARY),
        end_id=2,
    )
    return token_store.read_documents(spark, path).withColumnRenamed("key", "doc_id")


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_dedup.Near(words=3, percent=85)
    return near_dedup.near_duplicates(documents(spark, sf_dir), "doc_id", "text", near)


def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return repetition.with_measures(rows, "text").drop("text")


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path(token_counts.BYTE_VOCABULARY)
    counts = token_counts.count_tokens(documents(spark, sf_dir), "text", path, keep=("doc_id",))
    return token_counts.with_limit(counts, 1024)


def op6_exponential_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = mixing.word_count(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", "source", "text")
    identity = [F.col("doc_id"), F.col("text")]
    keyed = mixing.with_keys(rows, words, mixing.plain_quality(F.col("text"), words), identity, seed=0)
    stored = stage(keyed.drop("text"), "mix-rows")
    taken = mixing.with_copies(stored, mixing.mix_plan(stored, "source"), "source")
    return taken.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.with_spans(rows, "text", pii.train(rows, "text"), keep=("doc_id",))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans: str) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("all_spans").alias("spans"),
    )


def op8_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    seen = labels.filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(rows, seen, "doc_id", "text", "toxic")
    scored = toxicity.with_score(rows, "text", model, keep=("doc_id",))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        documents(spark, sf_dir),
        "doc_id",
        "text",
        vocabulary_path(WORD_VOCABULARY),
        end_id=1,
        length=SEQUENCE,
    )
    return packing.measured_pieces(packing.filled_sequences(pieces, capacity=SEQUENCE))


def scaled(x: Column, factor: int) -> Column:
    """``floor(factor * x)`` as a long."""
    # floor would make numbers of NaN and infinity; null keeps them out.
    part = x.cast("double")
    finite = ~F.isnan(part) & (F.abs(part) < F.lit(math.inf))
    return F.when(finite, F.floor(F.lit(factor) * part))


def op10_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda x: scaled(x, 256).cast("double")).alias("v")
    )
    return topk.top_k(rows.filter(F.col("vec_id") % 50 == 0), rows, "vec_id", "v", k=5)


def op11_slot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", label.alias("label"), F.transform("embedding", lambda x: scaled(x, 256)).alias("v")
    )
    return hard_negatives.hard_negatives(rows, "vec_id", "label", "v", F.col("vec_id") % 100 == 0)


def op12_trie_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text")


def op13_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda c: scaled(c, 64) + 1_000_000).alias("x")
    )
    stored, model = whitening.train(rows, "x", most=16)
    found = whitening.with_components(stored, "vec_id", "x", model)
    count = model.rows if model else 0
    error = whitening.identity_error(stored, "x", model) if model else 0.0
    return found.withColumns({"n": F.lit(count).cast("bigint"), "identity_error": F.lit(error)}).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


BUILDERS = {
    f.__name__: f
    for f in (
        op1_rendezvous_shards,
        op2_token_store,
        op3_tensored_minhash,
        op4_suffix_repetition,
        op5_whole_token_counts,
        op6_exponential_mix,
        op7_boosted_pii,
        op8_ngram_toxicity,
        op9_first_fit_packing,
        op10_cover_tree_search,
        op11_slot_hard_negatives,
        op12_trie_simhash,
        op13_cholesky_whitening,
    )
}

__all__ = ["BUILDERS", "ORACLES"]
