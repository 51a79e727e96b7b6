"""Near-duplicates by SimHash: 64-bit fingerprints joined by walking one binary trie against itself.

The trie over all distinct fingerprints is never built: a node is a prefix, and the fingerprints below
it are a range of a sorted list. Pairs of nodes of equal depth are walked down together, adding up the
bits in which their prefixes differ, and a pair is left as soon as that exceeds what is allowed. Two
fingerprints that differ in ``budget`` bits differ in at most half of them in one half of their 64 bits.
So the trie is walked twice, once with the halves exchanged, and each time the first 32 levels allow only
``budget // 2`` differing bits: pairs of nodes stay few where tries are densest.

The upper part of the walk is a join of prefix tables in Spark. It starts at the depth where an even trie
has small nodes; pairs of larger nodes are taken down by four bits at a time until they are small. The
pairs left are cells of bounded size; a task walks all its cells' subtrees level by level in NumPy.

Only what is connected matters, so the walk runs with one differing bit first, then with the whole
budget, and each time leaves out pairs of nodes whose fingerprints are all in one component already. A
dense cluster of near copies is one component after the first walk and costs no pairs in the second.
A task passes on a spanning forest of the links it found, not all of them.

Defined results: A-Z is folded; fewer words than a shingle are one shingle; null texts and texts
without words have fingerprint zero, which links like any other; rows with equal doc ids are one
document, which links their texts; ids that are null are never representatives beside others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.batches import Texts, lean, offsets_of, ragged_index, text_slices, words_of
from evalweave.llm.components import components
from evalweave.session import stage

SEED = 42
#: Fingerprints below a node that a task may hold, and rows of cells walked together.
NODE, WALKED = 2048, 16_384
#: Products of node sizes from which on two nodes are compared directly, and levels taken at a time in Spark.
DIRECT, STEP = 64, 4
#: Pairs of fingerprints compared at a time.
COMPARED = 1 << 20
SLICE_BYTES = 1 << 20


def shingle_hashes(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, repeats included, and the bounds of each text's."""
    data, starts, ends, first = words_of(texts, fold_case=True)
    sizes = ends - starts
    begins = offsets_of(sizes + 1)
    # All words with one space behind each: a shingle is a run of these bytes.
    joined = np.full(begins[-1], 0x20, np.uint8)
    joined[ragged_index(begins[:-1], sizes)] = data[ragged_index(starts, sizes)]
    counts = np.diff(first)
    lengths = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    one = ragged_index(first[:-1], lengths)
    last = one + np.repeat(np.minimum(counts, words), lengths) - 1
    raw = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[one].tolist(), (begins[last] + sizes[last]).tolist(), strict=True)
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(one))
    return hashes, offsets_of(lengths)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text the bits that more than half of its hashes have; zero without hashes."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Bits are added as bytes, eight to a word, over runs of at most 255 hashes, which no byte overflows.
    runs = -(-counts[some] // 255)
    begins = ragged_index(np.zeros(len(runs), np.int64), runs) * 255 + np.repeat(bounds[:-1][some], runs)
    ends = np.minimum(begins + 255, np.repeat(bounds[1:][some], runs))
    sums = np.empty((len(begins), 64), np.uint8)
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + (1 << 16), side="right")))
        part = hashes[begins[at] : ends[to - 1]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums[at:to] = np.add.reduceat(bits, begins[at:to] - begins[at], axis=0).view(np.uint8)
        at = to
    total = np.add.reduceat(sums, offsets_of(runs)[:-1], axis=0, dtype=np.int64)
    bits = 2 * total > counts[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """``id, fp`` of every row, the fingerprint as a signed long."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", SLICE_BYTES):
            found = majority(*shingle_hashes(texts, words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def turned(x: np.ndarray) -> np.ndarray:
    """The two halves of each fingerprint exchanged."""
    return (x << np.uint64(32)) | (x >> np.uint64(32))


def _turned(x: Column) -> Column:
    return F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))


def _prefix(x: Column, depth: int) -> Column:
    return F.shiftrightunsigned(x, 64 - depth) if depth else F.lit(0).cast("bigint")


def allowed(depth: int, budget: int) -> int:
    """Differing bits that two prefixes of this depth may have."""
    return budget // 2 if depth <= 32 else budget


def nodes(points: DataFrame, depth: int) -> DataFrame:
    """One row per prefix: its fingerprints, and the least and greatest component among them."""
    at = points.select(_prefix(F.col("x"), depth).alias("node"), "comp")
    return at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))


def _sides(pairs: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Pairs (a, b, d) beside the facts of both nodes, without those of a single component."""
    for side in ("a", "b"):
        named = {"n": f"n_{side}", "low": f"low_{side}", "high": f"high_{side}", on: side}
        pairs = pairs.join(table.withColumnsRenamed(named), side)
    one = F.least("low_a", "low_b") == F.greatest("high_a", "high_b")
    return pairs.filter(~one)


def cells(points: DataFrame, budget: int, total: int) -> DataFrame:
    """The fingerprints of every pair of small nodes: ``depth, a, b, d, side, x, comp``."""
    depth = min(32, math.ceil(math.log2(total / NODE)) + 2) if total > 2 * NODE else 0
    masks = [0] + [1 << i for i in range(depth)] if allowed(depth, budget) else [0]
    if allowed(depth, budget) > 1:
        raise ValueError("a budget above three bits needs more parts than two halves")
    first = stage(nodes(points, depth), "trie-nodes")
    mask = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
    pairs = first.select(F.col("node").alias("a"), mask.alias("m")).select(
        "a", F.col("a").bitwiseXOR(F.col("m")).alias("b"), F.bit_count("m").cast("int").alias("d")
    )
    pairs = stage(_sides(pairs.filter("a <= b"), first, "node"), "node-pairs")
    ready = []
    while True:
        large = (F.col("n_a") + F.col("n_b") > 2 * NODE) & F.lit(depth < 64)
        ready.append(_members(points, pairs.filter(~large).select("a", "b", "d"), depth))
        pairs = pairs.filter(large).select("a", "b", "d")
        if pairs.isEmpty():
            break
        step = min(STEP, (32 - depth) if depth < 32 else (64 - depth))
        depth += step
        below = stage(nodes(points, depth), "trie-nodes")
        child = below.select(_up(F.col("node"), step).alias("up"), "node")
        for side in ("a", "b"):
            pairs = pairs.join(child.withColumnsRenamed({"up": side, "node": f"{side}_to"}), side)
        more = F.bit_count(F.col("a_to").bitwiseXOR(F.col("b_to")).bitwiseAND(F.lit((1 << step) - 1)))
        grown = pairs.withColumn("d", F.col("d") + more.cast("int")).filter(F.col("d") <= allowed(depth, budget))
        grown = grown.filter("a <> b or a_to <= b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"), "d")
        pairs = stage(_sides(grown, below, "node"), "node-pairs")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out


def _up(node: Column, step: int) -> Column:
    return F.shiftrightunsigned(node, step)


def _members(points: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    at = points.select(_prefix(F.col("x"), depth).alias("node"), "x", "comp")
    left = at.join(pairs.withColumn("node", F.col("a")), "node").withColumn("side", F.lit(0))
    right = at.join(pairs.filter("a <> b").withColumn("node", F.col("b")), "node").withColumn("side", F.lit(1))
    both = left.unionByName(right)
    return both.select(F.lit(depth).alias("depth"), "a", "b", "d", "side", "x", "comp")


CELL = ("depth", "a", "b", "d")


def walk(cell: np.ndarray, depth: np.ndarray, d: np.ndarray, side: np.ndarray, x: np.ndarray, comp: np.ndarray, budget: int):
    """Places (i, j) of all pairs of different components within ``budget`` that the cells' node pairs hold.

    Rows are sorted by cell, side and fingerprint.
    """
    edge = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
    begin, end = edge[:-1], edge[1:]
    right = begin + np.add.reduceat(side == 0, begin)
    self_pair = right == end
    start_depth = depth[begin]
    # A range whose components are all equal ends before the run of its first one does.
    breaks = np.append(np.flatnonzero(np.diff(comp)) + 1, len(comp))
    run_end = breaks[np.searchsorted(breaks, np.arange(len(comp)), side="right")]
    fresh = np.stack([begin, right, np.where(self_pair, begin, right), end, d[begin]], axis=1)
    front = np.zeros((0, 5), np.int64)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for level in range(int(start_depth.min(initial=64)), 65):
        front = np.concatenate([front, fresh[start_depth == level]])
        a, a_end, b, b_end, _ = front.T
        one = (run_end[a] >= a_end) & (run_end[b] >= b_end) & (comp[a] == comp[b])
        front = front[~one]
        a, a_end, b, b_end, apart = front.T
        few = ((a_end - a) * (b_end - b) <= DIRECT) | (level == 64)
        for i, j in _products(front[few, :4]):
            near = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget) & (comp[i] != comp[j])
            found_i.append(i[near])
            found_j.append(j[near])
        front = front[~few]
        if level == 64 or not len(front):
            continue
        a, a_end, b, b_end, apart = front.T
        ones = offsets_of((x >> np.uint64(63 - level)) & np.uint64(1))
        a_mid, b_mid = (to - (ones[to] - ones[at]) for at, to in ((a, a_end), (b, b_end)))
        same = a == b
        children = [
            np.stack([a, a_mid, b, b_mid, apart], axis=1),
            np.stack([a_mid, a_end, b_mid, b_end, apart], axis=1),
            np.stack([a, a_mid, b_mid, b_end, apart + 1], axis=1),
            np.stack([a_mid, a_end, b, b_mid, apart + 1], axis=1)[~same],
        ]
        front = np.concatenate(children)
        a, a_end, b, b_end, apart = front.T
        front = front[(a < a_end) & (b < b_end) & (apart <= allowed(level + 1, budget))]
    return np.concatenate(found_i), np.concatenate(found_j)


def _products(ranges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of each pair of small ranges (a, a_end, b, b_end), a bounded number at a time."""
    for at in range(0, len(ranges), COMPARED // DIRECT):
        a, a_end, b, b_end = ranges[at : at + COMPARED // DIRECT].T
        wide = b_end - b
        count = (a_end - a) * wide
        place = ragged_index(np.zeros(len(count), np.int64), count)
        width = np.repeat(wide, count)
        yield np.repeat(a, count) + place // width, np.repeat(b, count) + place % width


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (i, j) connect, one per node but the roots."""
    names, both = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = both[: len(i)], both[len(i) :]
    root = np.arange(len(names))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        i, j, low, high = i[apart], j[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    some = np.flatnonzero(root != np.arange(len(names)))
    return names[some], names[root[some]]


def walked(table: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between components, from whole cells; a cell's rows meet in one task, sorted."""
    rows = table.repartition(*CELL).sortWithinPartitions(*CELL, "side", F.col("x").bitwiseXOR(F.lit(-(1 << 63))))
    rows = rows.select(*CELL, "side", "x", "comp")

    def links_of(part: pa.Table) -> pa.RecordBatch:
        depth, a, b, d, side, x, comp = (part.column(c).to_numpy() for c in part.column_names)
        fresh = np.zeros(len(x), dtype=bool)
        for column in (depth, a, b, d):
            fresh[1:] |= column[1:] != column[:-1]
        i, j = walk(np.cumsum(fresh), depth, d, side, x.view(np.uint64), comp, budget)
        one, two = forest(comp[i], comp[j])
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < WALKED:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in CELL])
            # The last cell may go on in the next batch.
            cut = int(np.argmax((keys == keys[:, -1:]).all(axis=0)))
            if cut:
                yield links_of(whole.slice(0, cut))
            held, count = whole.slice(cut).to_batches(), len(whole) - cut
        if count:
            yield links_of(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "a long, b long")


def merged(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The points with components joined by ``edges`` between components."""
    if edges.isEmpty():
        return points
    labels = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    joined = points.join(labels, "comp", "left")
    return stage(joined.select("fp", F.coalesce("to", "comp").alias("comp")), "simhash-points")


def connected(points: DataFrame, budget: int = 3) -> DataFrame:
    """``fp, comp`` after linking all fingerprints that differ in at most ``budget`` bits."""
    total = points.count()
    for bits in sorted({min(1, budget), budget}):
        links = []
        for turn in (False, True) if bits else ():
            x = _turned(F.col("fp")) if turn else F.col("fp")
            table = cells(points.select(x.alias("x"), "comp"), bits, total)
            links.append(stage(walked(table, bits), "simhash-links"))
        if links:
            points = merged(points, stage(links[0].unionByName(links[1]).distinct(), "simhash-links"))
    return points


def same_document(rows: DataFrame) -> DataFrame:
    """Links between the fingerprints of rows that share a doc id."""
    pairs = rows.filter("id is not null").select("id", "fp").distinct()
    first = pairs.groupBy("id").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stage(pairs.join(first, "id").filter("a <> fp").select("a", F.col("fp").alias("b")), "same-document")


def near_duplicates(docs: DataFrame, key: str, text: str, *, words: int = 3, budget: int = 3) -> DataFrame:
    """``key, fingerprint, component_id`` of every row."""
    rows = stage(fingerprints(docs, key, text, words), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-classes")
    points = classes.select("fp", F.col("fp").alias("comp"))
    points = connected(merged(points, same_document(rows)), budget)
    named = classes.join(points, "fp")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = stage(named.join(smallest, "comp").select("fp", "component_id"), "simhash-labels")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(labels, "fp").select(F.col("id").alias(key), shown, "component_id")
