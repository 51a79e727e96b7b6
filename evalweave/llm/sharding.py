"""Shards by weighted rendezvous hashing of a stable record key.

Every (key, shard) pair gets the score ``-weight / ln(u)`` of a uniform hash u; the highest score
wins, ties going to the lower shard. A further shard adds scores and changes none, so it takes rows
only into itself, in proportion to its weight.

Defined results: a null key is a key like any other; rows with equal keys share a shard; an empty
table gives an empty table; columns of the input are kept, whatever their names, but for ``shard``,
``grown_shard`` and the slot, which are set.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.names import columns_of, free_name
from evalweave.session import stage


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), shard), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.lit(0.0) - weight / F.log(uniform)


def _best(key: Column, weights: Sequence[float], seed: int) -> Column:
    """(score, -shard) of the winning shard."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("every shard needs a positive, finite weight")
    shards = F.array(
        *[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)]
    )
    scored = F.transform(
        shards,
        lambda s: F.struct(
            _score(key, s["shard"], s["weight"], seed).alias("score"), (-s["shard"]).alias("minus")
        ),
    )
    return F.array_max(scored)


def with_shard(
    df: DataFrame, key: str, weights: Sequence[float], *, grown_by: Sequence[float] = (), seed: int = 0
) -> DataFrame:
    """Adds ``shard``, and ``grown_shard``: where the row goes if shards of these weights are added."""
    whole = F.col(f"`{key}`").cast("string")
    # A null has a hash of its own here; xxhash64 alone would skip it.
    base = F.xxhash64(whole.isNull(), whole)
    own = free_name(df, "_best")
    best = df.withColumn(own, _best(base, weights, seed))
    out = best.withColumn("shard", (-F.col(own)["minus"]).cast("int"))
    if grown_by:
        more = F.greatest(
            F.col(own),
            *[
                F.struct(
                    _score(base, F.lit(i), F.lit(float(w)), seed).alias("score"),
                    F.lit(-i).alias("minus"),
                )
                for i, w in enumerate(grown_by, start=len(weights))
            ],
        )
        out = out.withColumn("grown_shard", (-more["minus"]).cast("int"))
    return out.drop(own)


def with_slots(df: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Numbers the rows of every shard from 0 without gaps.

    The rows are written once with a row id, dealt into about ``sqrt(rows of a shard)`` chunks by a
    hash of it, and numbered inside their chunk; what earlier chunks hold comes from a table of one
    row per (shard, chunk). No task gets a whole shard, whatever its share of the rows.
    """
    row, chunk, rows, before = (free_name(df, n) for n in ("_row", "_chunk", "_rows", "_before"))
    stored = stage(df.withColumn(row, F.monotonically_increasing_id()), "shard-rows")
    largest = stored.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, math.isqrt(largest))
    cut = stored.withColumn(chunk, F.pmod(F.xxhash64(row), F.lit(chunks)).cast("int"))
    earlier = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(shard, chunk).agg(F.count(F.lit(1)).alias(rows))
    starts = counts.withColumn(before, F.coalesce(F.sum(rows).over(earlier), F.lit(0))).drop(rows)
    inside = Window.partitionBy(shard, chunk).orderBy(row)
    number = (F.col(before) + F.row_number().over(inside) - 1).cast("bigint")
    return cut.join(starts, [shard, chunk]).select(*columns_of(df), number.alias(slot))
