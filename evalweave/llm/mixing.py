"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is its weight's share of all sizes, stopped at ``max_epochs`` times its own size;
what is cut off goes to the others by weight until none is above. A target of 2.3 times the source
means two complete epochs, and a third one in which documents come in the order of their
exponential key ``-ln(u) / quality`` until the prefix sum of sizes is nearest to the rest.

Defined results: null text has size 0; a null source is a source, last in the order; rows equal
in id and text are numbered, so that each has a draw of its own; sources without any words get target 0;
an empty table gives an empty table; other columns are kept, and added names start with ``mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.names import free_name
from evalweave.llm.sharding import with_slots
from evalweave.session import stage

#: Most sources whose plan (about 100 bytes a row) is sent to every task instead of shuffling the rows.
BROADCAST_SOURCES = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def plain_quality(text: Column, words: Column) -> Column:
    """A quality weight from the text: 1, halved for under 50 words and for odd mean word lengths."""
    length = F.coalesce(F.char_length(text), F.lit(0)) / F.greatest(words, F.lit(1))
    short = F.when(words < 50, 0.5).otherwise(1.0)
    odd = F.when(length.between(3, 12), 1.0).otherwise(0.5)
    return short * odd


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 over the seed and the keys."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def numbered_copies(df: DataFrame, identity: Sequence[Column]) -> DataFrame:
    """Adds ``mix_identity``, a digest, and ``mix_copy``, which numbers the rows that share one from 0.

    Which of equal rows gets which number does not matter, so reruns agree. Only repeated rows are
    numbered, in chunks: a digest may have any share of the rows.
    """
    parts = [F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("null")) for c in identity]
    named = df.withColumn("mix_identity", F.md5(F.concat_ws(":", *parts).cast("binary")))
    repeated = named.groupBy("mix_identity").agg(F.count(F.lit(1)).alias("mix_n")).filter("mix_n > 1")
    repeated = stage(repeated.select("mix_identity"), "mix-repeated")
    if repeated.isEmpty():
        return named.withColumn("mix_copy", F.lit(0).cast("bigint"))
    once = named.join(repeated, "mix_identity", "left_anti").withColumn("mix_copy", F.lit(0).cast("bigint"))
    several = with_slots(named.join(repeated, "mix_identity", "left_semi"), "mix_identity", "mix_copy")
    return once.unionByName(several)


def with_keys(df: DataFrame, size: Column, quality: Column, identity: Sequence[Column], seed: int) -> DataFrame:
    """Adds ``mix_size`` and the exponential key ``mix_key``, drawn by a hash of what identifies a row.

    ``identity`` is an id and the text, say; rows equal in it are told apart by a number.
    """
    df = numbered_copies(df, identity)
    exponential = F.lit(0.0) - F.log(uniform(seed, F.col("mix_identity"), F.col("mix_copy")))
    return df.withColumn("mix_size", size.cast("bigint")).withColumn("mix_key", exponential / quality).drop("mix_identity", "mix_copy")


def source_targets(keyed: DataFrame, source: str, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row per source: rows, size, weight (repeating in source order) and target.

    The level L of the water filling is the largest of (all - caps so far) / (weights left) over
    the sources in the order of cap / weight; a target is min(cap, L * weight).
    """
    sizes = keyed.groupBy(F.col(source).alias("mix_source")).agg(
        F.sum("mix_size").alias("mix_source_size"), F.count(F.lit(1)).alias("mix_rows")
    )
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    shares = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("mix_weight", F.element_at(shares, (place + 1).cast("int")))
    weighed = weighed.withColumn("mix_cap", (F.col("mix_source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("mix_cap") / F.col("mix_weight"), F.col("mix_source"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("mix_source_size").over(everything)
    left = total - F.coalesce(F.sum("mix_cap").over(earlier), F.lit(0.0))
    levels = weighed.withColumn("mix_level", left / F.sum("mix_weight").over(later))
    target = F.least("mix_cap", F.max("mix_level").over(everything) * F.col("mix_weight"))
    return levels.withColumn("mix_target", target).drop("mix_level", "mix_cap")


def mix_plan(
    keyed: DataFrame, source: str, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3
) -> DataFrame:
    """One row per source: ``source_targets`` plus complete epochs and the last key of the partial one.

    ``keyed`` is read several times: give a stored table of narrow rows. Keys are cut into about
    ``sqrt(rows)`` chunks per source by a rising function of the key, so that prefix sums run inside
    small chunks and over chunk totals; a source of any share is split.
    """
    targets = source_targets(keyed, source, weights, max_epochs)
    size = F.col("mix_source_size")
    epochs = F.when(size > 0, F.floor(F.col("mix_target") / size)).otherwise(0).cast("int")
    plan = targets.withColumn("mix_epochs", epochs).withColumn(
        "mix_rest", F.col("mix_target") - F.col("mix_epochs") * size
    )
    plan = stage(plan, "mix-targets")
    rows = keyed.select(F.col(source).alias("_source"), "mix_size", "mix_key")
    rows = rows.groupBy("_source", "mix_key").agg(F.sum("mix_size").alias("mix_size"))
    joined = with_plan(rows, plan.select("mix_source", "mix_rows", "mix_rest"), "_source").drop("_source")
    chunks = F.ceil(F.sqrt("mix_rows"))
    chunk = F.floor((F.lit(1.0) - F.exp(F.lit(0.0) - F.col("mix_key"))) * chunks).cast("int")
    cut = joined.withColumn("mix_chunk", chunk)
    totals = cut.groupBy("mix_source", "mix_chunk").agg(F.sum("mix_size").alias("chunk_size"))
    earlier = (
        Window.partitionBy("mix_source").orderBy("mix_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.withColumn("chunk_before", F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)))
    both = F.col("c.mix_source").eqNullSafe(F.col("b.mix_source")) & (
        F.col("c.mix_chunk") == F.col("b.mix_chunk")
    )
    inside = (
        Window.partitionBy("mix_source", "mix_chunk")
        .orderBy("mix_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        cut.alias("c")
        .join(before.alias("b"), both)
        .select("c.*", "chunk_before")
        .withColumn(
            "mix_before",
            F.col("chunk_before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)),
        )
    )
    last = (
        placed.filter(F.col("mix_before") + F.col("mix_size") / 2 <= F.col("mix_rest"))
        .groupBy("mix_source")
        .agg(F.max("mix_key").alias("mix_last_key"))
    )
    named = F.col("p.mix_source").eqNullSafe(F.col("l.mix_source"))
    return plan.alias("p").join(last.alias("l"), named, "left").select("p.*", "mix_last_key")


def with_plan(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Every row beside its source's columns of a stored ``plan``.

    The plan has one row per source. It is counted, and broadcast up to ``BROADCAST_SOURCES`` rows, so
    that a source with very many rows moves none of them; beyond that both sides are shuffled, and
    adaptive execution splits what is left of a large source.
    """
    small = plan.count() <= BROADCAST_SOURCES
    same = rows[source].eqNullSafe(plan["mix_source"])
    return rows.join(F.broadcast(plan) if small else plan, same)


def with_copies(keyed: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Adds ``mix_copies``, how often the mix takes the row, and the columns of its source's plan."""
    partial = F.coalesce(F.col("mix_key") <= F.col("mix_last_key"), F.lit(False)).cast("int")
    joined = with_plan(keyed, stage(plan, "mix-plan"), source)
    return joined.withColumn("mix_copies", F.col("mix_epochs") + partial).drop("mix_source")


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Every row as often as ``copies`` says; rows with 0 go."""
    copy = free_name(df, "_copy")
    wanted = df.filter(F.col(copies) > 0)
    return wanted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copy)


