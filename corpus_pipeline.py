"""From documents to packed training sequences: rules, near-dedup, redaction, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. The stages
work on a ``doc_id`` and a ``text`` (mixing also on a ``source``); other columns pass through, whatever
their names. SQL cannot say these stages, so ``ORACLE_SQL`` is None and tests hold them against brute
force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import mixing, near_dedup, packing, pii, repetition
from evalweave.llm.names import columns_of
from evalweave.llm.tokens import WORD_VOCABULARY, vocabulary_path
from evalweave.session import ship_package, stage

SEQUENCE = 2048
END_ID = 1


def _free_prefix(docs: DataFrame, prefix: str) -> str:
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the repetition rules keep."""
    ship_package(spark)
    prefix = _free_prefix(docs, "q_")
    measured = repetition.with_measures(docs, "text", prefix=prefix)
    return measured.filter(f"`{prefix}kept`").select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity from 0.8."""
    ship_package(spark)
    return near_dedup.deduplicate(docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind in brackets."""
    ship_package(spark)
    return pii.redact(docs, "text", pii.train(docs, "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    ship_package(spark)
    # The operator adds columns of its own names, so the user's others step aside by number.
    names = docs.columns
    used = {"doc_id", "text", "source"}
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"k{i}") for i, c in enumerate(names)])
    words = mixing.word_count(F.col("text"))
    quality = mixing.plain_quality(F.col("text"), words)
    keyed = mixing.with_keys(plain, words, quality, [F.col("doc_id"), F.col("text")], seed=0)
    narrow = stage(keyed.select("source", "mix_size", "mix_key"), "mix-rows")
    copies = mixing.with_copies(keyed, mixing.mix_plan(narrow, "source"), "source")
    return mixing.repeat_rows(copies, "mix_copies").select(*plain.columns).toDF(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every sequence with its token ids, and the pieces of documents in it with their offsets."""
    ship_package(spark)
    path = vocabulary_path(WORD_VOCABULARY)
    pieces = packing.token_pieces(docs, "doc_id", "text", path, end_id=END_ID, length=SEQUENCE)
    return packing.filled_sequences(pieces, capacity=SEQUENCE)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
