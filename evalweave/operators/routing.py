"""Expert-routing scores: one input row per (event, token) with ``scores array<float>``.

An event is one forward pass through one router; a step may hold several, told apart by their order
in it. ``route_tokens`` reads the wide scores and leaves
a few narrow columns; everything after works on those. ``stored_route_tokens`` also writes them, so
that a summary, which needs them more than once, reads the scores a single time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.vectors import ROUTE_FIELDS, bind, map_columns, route_columns
from evalweave.operators.ordered import group_percentile, scan_in_order
from evalweave.operators.skew import lookup_join
from evalweave.session import stage

BUSIEST = 8


def route_tokens(
    df: DataFrame, keep: Sequence[str], scores: str = "scores", selected: int = 8
) -> DataFrame:
    """Top experts and the per-token measures, under both ways of reading the scores."""
    return map_columns(df, keep, [scores], ROUTE_FIELDS, lambda s: route_columns(s, selected))


def stored_route_tokens(
    df: DataFrame, keep: Sequence[str], scores: str = "scores", selected: int = 8
) -> DataFrame:
    return stage(route_tokens(df, keep, scores, selected), "route-tokens")


def normalization(tokens: DataFrame, event: Sequence[str]) -> DataFrame:
    """Per event: keep the scores as they are (every token sums to one), or soft-max them all."""
    return tokens.groupBy(*event).agg(
        F.count(F.lit(1)).alias("tokens_routed"),
        F.bool_and("looks_normalized").alias("kept"),
    )


def expert_counts(tokens: DataFrame, event: Sequence[str]) -> DataFrame:
    """Per event a zero-filled count per expert and the load fractions.

    Counting by (event, expert) first combines on the map side, so an event of any size arrives as
    one row per expert.
    """
    chosen = tokens.select(
        *event, "experts", F.posexplode("expert_ids").alias("_rank", "_expert")
    )
    bins = chosen.groupBy(*event, "_expert").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_rank") == 0).alias("_first"),
        F.max("experts").alias("_experts"),
    )
    per_event = bins.groupBy(*event).agg(
        F.map_from_entries(F.collect_list(F.struct("_expert", "_n"))).alias("_counts"),
        F.sum("_n").alias("_assigned"),
        F.sum("_first").alias("_tokens"),
        F.max("_experts").alias("routed_expert_count"),
    )
    counts = F.transform(
        F.sequence(F.lit(0), F.col("routed_expert_count") - 1),
        lambda e: F.coalesce(F.try_element_at("_counts", e), F.lit(0).cast("bigint")),
    )
    counted = per_event.withColumn("expert_token_counts", counts)
    load = F.transform(
        "expert_token_counts", lambda n: n / F.greatest(F.col("_assigned"), F.lit(1))
    )
    return counted.select(
        *event,
        "routed_expert_count",
        (F.col("_assigned") / F.col("_tokens")).cast("int").alias("selected_experts_per_token"),
        "expert_token_counts",
        load.alias("expert_load_fraction"),
    )


def expert_bins(counted: DataFrame, event: Sequence[str]) -> DataFrame:
    """Count and load as one row per (event, expert), zero bins included."""
    bins = F.arrays_zip("expert_token_counts", "expert_load_fraction")
    return counted.select(*event, F.posexplode(bins).alias("expert_id", "b")).select(
        *event,
        "expert_id",
        F.col("b.expert_token_counts").alias("token_count"),
        F.col("b.expert_load_fraction").alias("load_fraction"),
    )


def busiest_experts(counted: DataFrame, busiest: int = BUSIEST) -> DataFrame:
    """Adds ``most_used_experts``: the highest loads, ties to the lower expert."""
    entries = F.transform(
        "expert_load_fraction", lambda v, i: F.struct((-v).alias("neg"), i.alias("expert_id"))
    )
    best = F.transform(
        F.slice(F.array_sort(entries), 1, busiest),
        lambda s: F.struct(s["expert_id"].alias("expert_id"), (-s["neg"]).alias("load_fraction")),
    )
    return counted.withColumn("most_used_experts", best)


def load_variation(counted: DataFrame) -> DataFrame:
    """Adds ``expert_load_cv``: population deviation over mean, zero bins included."""
    load = F.col("expert_load_fraction")
    experts = F.col("routed_expert_count")

    def variation(mean):
        spread = F.aggregate(load, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        return F.when(mean > 0, F.sqrt(spread / experts) / mean).otherwise(F.lit(0.0))

    mean = F.aggregate(load, F.lit(0.0), lambda a, v: a + v) / experts
    return counted.withColumn("expert_load_cv", bind(mean, variation))


def event_measures(tokens: DataFrame, event: Sequence[str]) -> DataFrame:
    """Entropy mean and exact 95th percentile, and top-1 margin, per event.

    One aggregate decides which reading of the scores counts. The percentile is then selected among
    the entropies of that reading, so no event's values are ever gathered.
    """
    measured = tokens.groupBy(*event).agg(
        F.count(F.lit(1)).alias("tokens_routed"),
        F.bool_and("looks_normalized").alias("kept"),
        F.avg("entropy_kept").alias("_ek"),
        F.avg("entropy_softmax").alias("_es"),
        F.avg("margin_kept").alias("_mk"),
        F.avg("margin_softmax").alias("_ms"),
    )
    measured = stage(measured, "event-measures")
    decided = lookup_join(
        tokens.select(*event, "entropy_kept", "entropy_softmax"), measured.select(*event, "kept"), event, stored=True
    )

    def choose(kept: str, soft: str):
        return F.when(F.col("kept"), F.col(kept)).otherwise(F.col(soft))

    chosen = decided.select(*event, choose("entropy_kept", "entropy_softmax").alias("_entropy"))
    quantile = group_percentile(chosen, event, "_entropy", 0.95, "_p95")
    mean = choose("_ek", "_es")
    return measured.join(quantile, list(event), "left").select(
        *event,
        "tokens_routed",
        "kept",
        mean.alias("router_entropy_mean"),
        # One undefined entropy makes the mean undefined, and with it the percentile.
        F.when(F.isnan(mean), mean).otherwise(F.col("_p95")).alias("router_entropy_p95"),
        choose("_mk", "_ms").alias("top1_router_margin_mean"),
    )


def summarize(tokens: DataFrame, event: Sequence[str]) -> DataFrame:
    """The full router summary per event, from stored tokens.

    Both halves are grouped by event and join in place.
    """
    counted = load_variation(busiest_experts(expert_counts(tokens, event)))
    return (
        event_measures(tokens, event)
        .join(counted, list(event))
        .withColumn("shared_expert_active", F.lit(True))
    )


def token_route_overlap(
    tokens: DataFrame, lane: Sequence[str], order: Sequence[str], chunk
) -> DataFrame:
    """Per token, the Jaccard overlap of its experts with the same token one event earlier.

    ``lane`` holds the columns that separate independent sequences of events (run, canvas, layer),
    ``order`` those that put the events of a lane in order (step, place in the step). Looking back per token keeps one huge event spread over as many groups as it has tokens.
    """
    looked = scan_in_order(
        tokens.select(*lane, *order, "token_index", "expert_ids").withColumn(
            "_now", F.struct(*order, F.col("expert_ids").alias("ids"))
        ),
        [*lane, "token_index"],
        order,
        chunk,
        previous={"_before": "_now"},
        span_by=lane,
    )
    shared = F.size(F.array_intersect("expert_ids", F.col("_before.ids")))
    pooled = F.size("expert_ids") + F.size(F.col("_before.ids")) - shared
    return looked.select(
        *lane,
        *order,
        "token_index",
        F.size("expert_ids").alias("k"),
        *[F.col(f"_before.{c}").alias(f"before_{c}") for c in order],
        F.size(F.col("_before.ids")).alias("before_k"),
        F.when(
            F.col("_before").isNotNull(), shared / F.greatest(pooled, F.lit(1))
        ).alias("overlap"),
    )


def change_rates(overlap: DataFrame, lane: Sequence[str], order: Sequence[str], chunk) -> DataFrame:
    """Per event 1 - mean overlap; null without an earlier event or when its shape differs.

    The table of one row per event is written, as looking back reads it more than once.
    """
    before = F.struct(*[F.col(f"before_{c}").alias(c) for c in order])
    before = F.when(F.col(f"before_{order[0]}").isNotNull(), before)
    per_event = overlap.groupBy(*lane, *order).agg(
        F.count(F.lit(1)).alias("_tokens"),
        F.max("k").alias("_k"),
        F.count(before).alias("_matched"),
        F.min(before).alias("_oldest"),
        F.max("before_k").alias("_before_k"),
        F.avg("overlap").alias("_overlap"),
    )
    looked = scan_in_order(
        stage(per_event, "event-overlap").withColumn(
            "_now", F.struct(F.struct(*order).alias("at"), F.col("_tokens").alias("tokens"))
        ),
        lane,
        order,
        chunk,
        previous={"_before": "_now"},
    )
    same_shape = (
        (F.col("_before.tokens") == F.col("_tokens"))
        & (F.col("_matched") == F.col("_tokens"))
        & (F.col("_oldest") == F.col("_before.at"))
        & (F.col("_before_k") == F.col("_k"))
    )
    return looked.select(
        *lane, *order, F.when(same_shape, 1 - F.col("_overlap")).alias("expert_set_change_rate")
    )


def forward_index(df: DataFrame, run: str, order: Sequence[str], chunk) -> DataFrame:
    """Forward passes of each run numbered from 0, one row per (run, step, place in the step)."""
    passes = stage(df.select(run, *order).distinct(), "passes")
    return scan_in_order(passes, [run], order, chunk, number="forward_index")


def unflushed(events: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Router events whose step never came."""
    return events.join(steps.select(*keys).distinct(), list(keys), "left_anti")
