"""Hard negatives by slot-decomposed selection over exact integer inner products.

An anchor's positives are its best rows of the same label. A positive with score p asks for the best
rows of other labels whose score lies in ``[low% of p, high% of p]``, so the windows of one anchor
overlap. Their upper limits, in order, split the scores into disjoint slots. Every other-label score
falls into one slot at most, and each task keeps the best few per anchor and slot; a window per
(anchor, slot) merges what the tasks kept. Read from the highest slot down, the slots of an anchor
are one descending list: a positive's answer is the head of the part at or below its own limit, cut
at its lower limit. So one pass over the scores answers all windows of an anchor.

Anchors and rows are dealt into blocks; a task takes one block of each, and the rows are copied once
for every block of anchors. Positives are sought within one label only, so that pass compares only
blocks of equal labels.

Defined results: rows without an id or label, and vectors that are null, empty or hold a null, take
no part; a row meets only vectors of its own length and never a row of its own id; equal rows of an
anchor are one anchor, other repeated rows count each time; a positive with a negative score has an
empty window; scores must stay below 2**53, or an error is raised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.session import stage

#: Rows and anchors of a task, and anchors whose scores are held at a time.
DATA_BLOCK, ANCHOR_BLOCK, ANCHORS_HELD = 8192, 4096, 128
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """Positives per anchor, negatives per positive, and the window in percent of the positive's score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high or min(self.positives, self.negatives) < 1:
            raise ValueError("a window needs 0 <= low <= high, and counts must be positive")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products, as integers."""
    largest = [float(np.abs(m).max(initial=0)) for m in (left, right)]
    if largest[0] * largest[1] * left.shape[1] >= 2**53:
        raise ValueError("inner products may reach 2**53, beyond exact doubles")
    return (left @ right.T).astype(np.int64)


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best entries of every row, ties to the smaller id; ``NONE`` never counts."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
        row, column = np.nonzero((scores >= least) & (scores != NONE))
    else:
        row, column = np.nonzero(scores != NONE)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def best_of_slots(
    scores: np.ndarray, ids: np.ndarray, uppers: list[list[int]], lowers: list[list[int]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, column) of the ``k`` best entries of every row in each of its slots.

    Slot j of a row holds its scores above upper limit j - 1 up to limit j, and not below lower limit j.
    """
    found = []
    for slot in range(max(map(len, uppers), default=0)):
        some = np.array([i for i, u in enumerate(uppers) if len(u) > slot])
        upper, lower = (np.array([x[i][slot] for i in some]) for x in (uppers, lowers))
        if slot:
            lower = np.maximum(lower, np.array([uppers[i][slot - 1] + 1 for i in some]))
        own = scores[some]
        inside = np.where((own >= lower[:, None]) & (own <= upper[:, None]), own, NONE)
        row, column = best_of_rows(inside, ids, k)
        found.append((some[row], np.full(len(row), slot), column))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def cells(anchors: DataFrame, rows: DataFrame, within: list[str]) -> DataFrame:
    """Anchors and rows of every pair of blocks, told apart by ``anchor``, which rows do not have.

    Blocks are counted per value of the columns ``within``, so one value may hold any share of the rows.
    """

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*within).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    counts = blocks(anchors, ANCHOR_BLOCK, "anchor_blocks").join(blocks(rows, DATA_BLOCK, "row_blocks"), within)
    counts = stage(counts, "mining-blocks")

    def dealt(df: DataFrame, salt: str, own: str, other: str) -> DataFrame:
        placed = df.join(counts, within).withColumn(own, F.pmod(F.xxhash64(salt), F.col(f"{own}s")))
        copied = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return copied.drop("anchor_blocks", "row_blocks")

    left = dealt(anchors, "anchor", "anchor_block", "row_block")
    right = dealt(rows, "row", "row_block", "anchor_block")
    return left.unionByName(right, allowMissingColumns=True)


def split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    is_anchor = table.column("anchor").is_valid()
    return table.filter(is_anchor), table.filter(pc.invert(is_anchor))


def best_positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``anchor, anchor_id, positive_id, positive_score`` of the best ``k`` rows of the anchor's label."""

    def find(table: pa.Table) -> pa.Table:
        asks, base = split(table)
        ids, own = (t.column("id").to_numpy() for t in (base, asks))
        anchor, left, right = asks.column("anchor").to_numpy(), matrix(asks.column("v")), matrix(base.column("v"))
        found = []
        for at in range(0, len(own), ANCHORS_HELD) if len(ids) else ():
            scores = exact_scores(left[at : at + ANCHORS_HELD], right)
            scores[own[at : at + ANCHORS_HELD, None] == ids] = NONE
            row, column = best_of_rows(scores, ids, k)
            found.append((anchor[at + row], own[at + row], ids[column], scores[row, column]))
        return as_table(found, ("anchor", "anchor_id", "positive_id", "positive_score"))

    inside = cells(anchors, rows, ["label", "size"]).groupBy("label", "size", "anchor_block", "row_block")
    best = inside.applyInArrow(find, "anchor long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def best_in_slots(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``anchor, slot, negative_id, negative_score``: the best ``k`` of each slot among rows of other labels."""

    def find(table: pa.Table) -> pa.Table:
        asks, base = split(table)
        ids, labels = base.column("id").to_numpy(), base.column("label").to_numpy()
        anchor, own = asks.column("anchor").to_numpy(), asks.column("id").to_numpy()
        label, left, right = asks.column("label").to_numpy(), matrix(asks.column("v")), matrix(base.column("v"))
        uppers, lowers = asks.column("uppers").to_pylist(), asks.column("lowers").to_pylist()
        found = []
        for at in range(0, len(own), ANCHORS_HELD) if len(ids) else ():
            part = slice(at, at + ANCHORS_HELD)
            scores = exact_scores(left[part], right)
            scores[(label[part, None] == labels) | (own[part, None] == ids)] = NONE
            row, slot, column = best_of_slots(scores, ids, uppers[part], lowers[part], k)
            found.append((anchor[at + row], slot, ids[column], scores[row, column]))
        return as_table(found, ("anchor", "slot", "negative_id", "negative_score"))

    inside = cells(asked, rows, ["size"]).groupBy("size", "anchor_block", "row_block")
    best = inside.applyInArrow(find, "anchor long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def as_table(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*found, strict=True) if found else [[np.zeros(0, np.int64)]] * len(names)
    return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(names, columns, strict=True)})


def hard_negatives(
    df: DataFrame, key: str, label: str, vector: str, anchor: Column, mining: Mining = Mining()
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector`` holds whole numbers; ``anchor`` says of a row whether it is one. Ids and labels are
    integers. A positive without any negative in its window gives no row.
    """
    parts = F.col(vector).cast("array<bigint>")
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        parts.alias("v"), F.size(parts).alias("size"), anchor.alias("is_anchor"),
    )
    whole = (F.col("size") > 0) & F.forall("v", lambda x: x.isNotNull())
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "mining-rows")
    anchors = rows.filter("is_anchor").select("id", "label", "v", "size").distinct()
    anchors = stage(anchors.withColumn("anchor", F.monotonically_increasing_id()), "mining-anchors")
    rows = rows.drop("is_anchor")

    positives = best_positives(anchors, rows, mining.positives).filter("positive_score >= 0")
    upper = F.expr(f"positive_score * {mining.high} div 100")
    lower = F.expr(f"(positive_score * {mining.low} + 99) div 100")
    positives = stage(positives.withColumns({"upper": upper, "lower": lower}), "positives")
    slots = positives.groupBy("anchor", "upper").agg(F.min("lower").alias("lower"))
    slots = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("upper", "lower"))).alias("s"))
    slots = slots.select("anchor", F.col("s.upper").alias("uppers"), F.col("s.lower").alias("lowers"))

    kept = best_in_slots(stage(anchors.join(slots, "anchor"), "slots"), rows, mining.negatives)
    # At most positives * negatives rows an anchor.
    entry = F.struct((-F.col("negative_score")).alias("minus"), "negative_id")
    chain = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("chain"))
    below = F.filter("chain", lambda x: -x["minus"] <= F.col("upper"))
    inside = F.filter(F.slice(below, 1, mining.negatives), lambda x: -x["minus"] >= F.col("lower"))
    answers = positives.join(chain, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "x")
    )
    return answers.select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("x.negative_id").alias("negative_id"),
        "positive_score", (-F.col("x.minus")).alias("negative_score"),
    )
