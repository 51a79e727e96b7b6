"""Order-dependent operators that no single task, group or driver has to hold whole.

A plain window over a run puts the run into one task. Here a run is cut into chunks by a monotone
function of its order; windows work inside chunks, and what earlier chunks of a long run add (a
count, a running value, a last row) comes from a table with one row per chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators.skew import lookup_join
from evalweave.session import stage

CHUNK_STEPS = 4096
SMALL_LIMIT = 10_000
_POSITION_MASK = (1 << 33) - 1


def chunk_of(order: str, steps: int = CHUNK_STEPS) -> Column:
    """Chunk number of an integer order column."""
    return F.floor(F.col(order) / F.lit(steps)).cast("bigint")


def _long_keys(cut: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys whose rows lie in more than one chunk; null when there are none.

    Nearly always the whole table is one chunk, which a minimum and a maximum of the order column
    tell. Only otherwise are the keys looked at.
    """
    low, high = F.min("_chunk").alias("low"), F.max("_chunk").alias("high")
    whole = cut.agg(low, high).first()
    if whole["low"] == whole["high"]:
        return None
    spans = cut.groupBy(*keys).agg(low, high).filter(F.col("low") != F.col("high"))
    spans = stage(spans.select(*keys), "long-keys")
    return None if spans.isEmpty() else spans


def scan_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    number: str | None = None,
    running: Mapping[str, tuple[str, Column]] | None = None,
    previous: Mapping[str, str] | None = None,
    span_by: Sequence[str] | None = None,
) -> DataFrame:
    """Row number (from 0), running sum/max and previous value per ``keys`` in ``order``.

    ``running`` maps a new column to ("sum" | "max", expression), ``previous`` a new column to the
    column it looks back at. ``order`` must be unique within ``keys``, ``keys`` must not be null,
    and ``chunk`` must never fall as the order rises. ``df`` should be a stored table: it is first
    asked, by its order column, whether any key is longer than a chunk. If none is, this is one
    shuffle and one window; if some are, the rows of just those keys are read once more for their
    chunk totals. ``span_by`` names fewer keys to ask by, where that is cheaper.
    """
    keys = list(keys)
    span_by = list(span_by or keys)
    running, previous = dict(running or {}), dict(previous or {})
    folds = {"sum": F.sum, "max": F.max}
    cut = df.withColumn("_chunk", chunk)

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns(
        {"_local": F.row_number().over(inside)}
        | {f"_in_{name}": folds[fold](value).over(upto) for name, (fold, value) in running.items()}
        | {
            f"_in_{name}": F.lag(F.struct(F.col(source).alias("v"))).over(inside)
            for name, source in previous.items()
        }
    )
    long_keys = _long_keys(cut, span_by)
    if long_keys is None:
        added = [F.col(f"_in_{name}").alias(name) for name in running]
        added += [F.col(f"_in_{name}")["v"].alias(name) for name in previous]
        if number:
            added.append((F.col("_local") - 1).cast("bigint").alias(number))
        return local.select(*df.columns, *added)

    totals = [F.count(F.lit(1)).alias("_rows")]
    totals += [folds[fold](value).alias(f"_all_{name}") for name, (fold, value) in running.items()]
    totals += [
        F.max_by(F.struct(F.col(source).alias("v")), F.struct(*order)).alias(f"_last_{name}")
        for name, source in previous.items()
    ]
    long_rows = lookup_join(cut, long_keys, span_by, "left_semi", stored=True)
    per_chunk = long_rows.groupBy(*keys, "_chunk").agg(*totals)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys,
        "_chunk",
        F.sum("_rows").over(earlier).alias("_before"),
        *[
            folds[fold](f"_all_{name}").over(earlier).alias(f"_from_{name}")
            for name, (fold, _) in running.items()
        ],
        *[F.lag(f"_last_{name}").over(across).alias(f"_from_{name}") for name in previous],
    )
    joined = local.join(carry, [*keys, "_chunk"], "left")

    added = []
    for name, (fold, _) in running.items():
        parts = (F.col(f"_from_{name}"), F.col(f"_in_{name}"))
        whole = (
            F.greatest(*parts)
            if fold == "max"
            else F.coalesce(parts[0] + parts[1], parts[1], parts[0])
        )
        added.append(whole.alias(name))
    for name in previous:
        added.append(F.coalesce(F.col(f"_in_{name}"), F.col(f"_from_{name}"))["v"].alias(name))
    if number:
        at = F.coalesce("_before", F.lit(0)) + F.col("_local") - 1
        added.append(at.cast("bigint").alias(number))
    return joined.select(*df.columns, *added)


def dense_index(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "row_index",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Number all rows 0..n-1 in ``order`` (unique, or with interchangeable ties).

    One range sort, written once so that a retried task cannot move a row, then a prefix sum over
    one count per sorted partition. A window over everything would be a single task. ``order`` is
    columns, ascending or descending; a computed key is made a column first, as a sort would work
    it out at every comparison. ``keep`` names the columns wanted back (default all).
    """
    keep = list(df.columns if keep is None else keep)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select(
        *keep,
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias("_pos"),
    )
    placed = stage(placed, "dense-index")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort: its size never depends on the number of rows.
    return placed.join(F.broadcast(starts), "_part").select(
        *keep, (F.col("_start") + F.col("_pos")).cast("bigint").alias(name)
    )


def content(df: DataFrame) -> Column:
    """A digest of a whole row, by which rows of equal order are put in a fixed order."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return F.sha2(F.coalesce(whole, F.lit("")).cast("binary"), 256)


def _then(order: Sequence[str | Column], more: Sequence[str]) -> list[str | Column]:
    """``order`` and behind it the columns of ``more`` that it does not name."""
    named = {o for o in order if isinstance(o, str)}
    return [*order, *[c for c in more if c not in named]]


def number_rows(
    df: DataFrame, order: Sequence[str | Column], key: Sequence[str], name: str = "row_index"
) -> DataFrame:
    """``dense_index`` for wide rows: only the sort columns and the key are sorted and staged.

    ``key`` names columns that identify a row; rows of equal order follow each other by it. The wide
    rows are then shuffled once, to meet their number; sorting them instead would read them twice (a
    range sort samples first) and write them once more. Should the key be null or repeated somewhere,
    the rows are sorted whole after all, by ``order``, key and then content, which no layout can
    change. Only fully equal rows are told apart by their place in a stored copy, so that a large group
    of them is split like any other.
    """
    order = _then(order, key)
    numbers = dense_index(df, order, name, keep=key)
    absent = functools.reduce(Column.__or__, [F.col(c).isNull() for c in key])
    unfit = numbers.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | absent)
    if not unfit.isEmpty():
        tied = stage(df.withColumn("_content", content(df)), "tied-rows")
        tied = tied.withColumn("_tie", F.monotonically_increasing_id())
        return dense_index(tied, [*order, "_content", "_tie"], name, keep=df.columns)
    return df.join(numbers, list(key)).select(*df.columns, name)


def limit_ordered(
    df: DataFrame, order: Sequence[str | Column], n: int | None, key: Sequence[str] | None = None
) -> DataFrame:
    """The first ``n`` rows in ``order``; all of them when ``n`` is null.

    Rows of equal order follow each other by ``key`` (as in ``number_rows``) and then by ``content``, so
    the same rows are kept for any layout and any ``n``. A small ``n`` is a top-n; a large one would
    gather all its rows in one task and is cut by row number instead, in the same order.
    """
    if n is None:
        return df
    if n <= 0:
        raise ValueError("the limit must be greater than zero")
    if n <= SMALL_LIMIT:
        return df.orderBy(*_then(order, key or ()), content(df)).limit(n)
    if key:
        return number_limited(df, order, n, key, "_at").drop("_at")
    numbered = dense_index(df.withColumn("_content", content(df)), [*order, "_content"], "_at")
    return numbered.filter(F.col("_at") < n).select(*df.columns)


def number_limited(
    df: DataFrame, order: Sequence[str | Column], n: int | None, key: Sequence[str], name: str = "row_index"
) -> DataFrame:
    """The first ``n`` rows (all when null) as ``limit_ordered`` keeps them, numbered as ``number_rows`` does."""
    if n is not None and n <= SMALL_LIMIT:
        return number_rows(limit_ordered(df, order, n, key), order, key, name)
    numbered = number_rows(df, order, key, name)
    return numbered if n is None else numbered.filter(F.col(name) < n)


def group_percentile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, *, bins: int = 1024, few: int = 4096
) -> DataFrame:
    """Exact percentile with linear interpolation per ``keys``, whatever the size of a group.

    Selection by histograms that merge: a group's two wanted ranks lie in a range of values, first
    the whole group's. Rows count into ``bins`` bins of the range, which combine before the shuffle
    and carry their own least and greatest value; the bin that holds the rank is the next range. Once
    at most ``few`` rows are left (often from the start) or they are all equal, their counted distinct
    values are gone through in order. Null and NaN values are left out.
    """
    keys = list(keys)
    v = F.col("_v")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    facts = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    rank = F.lit(q) * (F.col("_n") - 1)
    ends = F.array(*[F.struct(F.lit(i).alias("_end"), f(rank).cast("bigint").alias("_rank")) for i, f in enumerate((F.floor, F.ceil))])
    wanted = rows.groupBy(*keys).agg(*facts).withColumns({"_share": rank - F.floor(rank), "_e": F.explode(ends)})
    wanted = stage(wanted.select(*keys, "_share", "_e.*", "_n", "_low", "_high"), "ranks")
    target = [*keys, "_end", "_rank", "_share"]
    open_ = (F.col("_n") > few) & (F.col("_low") < F.col("_high"))

    def narrowed(ranges: DataFrame, place: Column) -> DataFrame:
        """The part, by ``place`` inside it, of every range that holds its rank; ranks then count from its start."""
        asked = ranges.select(*target, "_low", "_high")
        inside = _beside(rows, asked, keys).filter(v.between(F.col("_low"), F.col("_high")))
        parts = inside.withColumn("_part", place).groupBy(*target, "_part").agg(*facts)
        before = Window.partitionBy(*target).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counted = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        here = counted.filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        return here.withColumn("_rank", F.col("_rank") - F.col("_before")).select(*target, "_n", "_low", "_high")

    low, high = F.col("_low"), F.col("_high")
    # Halves, so that a range of nearly all doubles does not overflow; its ends are bins of their own.
    share = F.coalesce(F.nanvl(F.try_divide(v / 2 - low / 2, high / 2 - low / 2), F.lit(0.0)), F.lit(0.0))
    even = F.when(v <= low, -1).when(v >= high, bins).otherwise(F.floor(share * bins)).cast("int")
    found = wanted.filter(~open_)
    wanted = wanted.filter(open_)
    while not wanted.isEmpty():
        wanted = stage(narrowed(wanted, even), "ranks")
        found = found.unionByName(wanted.filter(~open_))
        wanted = wanted.filter(open_)
    several = low < high
    values = found.filter(~several).select(*target, "_low")
    values = values.unionByName(narrowed(found.filter(several), v).select(*target, "_low"))
    ends_of = [F.max(F.when(F.col("_end") == i, F.col("_low"))) for i in (0, 1)]
    # Equal ends, infinite ones too, are the percentile themselves.
    between = F.when(ends_of[0] == ends_of[1], ends_of[0]).otherwise(
        ends_of[0] + (ends_of[1] - ends_of[0]) * F.max("_share")
    )
    return values.groupBy(*keys).agg(between.alias(name))


def _beside(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows next to the ranges (at most two) of their keys, null keys included."""
    both = ranges.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in ranges.columns if c not in keys])).alias("_r"))
    same = functools.reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys], F.lit(True))
    joined = rows.alias("l").join(both.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in keys], "_v", F.explode("_r").alias("_x")).select(*keys, "_v", "_x.*")
