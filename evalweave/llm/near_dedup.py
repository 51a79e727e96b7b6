"""Near-duplicates by MinHash with tensored bands, every link confirmed on the full shingle sets.

Two collections of ``bands`` sub-bands of ``rows`` minhashes are computed, 2 * bands * rows minhashes
in all. A table key combines one sub-band of each collection, so there are bands ** 2 tables of
2 * rows minhashes each: plain banding would need bands ** 2 * 2 * rows minhashes for as many. Two
sets meet if a sub-band of each collection agrees; the number of bands is the least for which sets
at the threshold miss each other with probability 0.0001 at most (11 for 85 percent, 14 for 80).

What happens in the tables (all on distinct sets; equal sets are one class from the start):

1. Sub-bands that only one class has cannot make a shared table key and are dropped beforehand.
2. Every key's members are compared with its centre, the class that shares most sub-bands with
   others. Members linked to one centre are one group from then on.
3. Keys whose members are not yet one group tie classes into families. In a family, every class
   outside the largest group is compared with all others, by an inverted index over the sets, in
   tasks of bounded blocks of the family. So all that meets in a key is confirmed, refuted, or known
   to be connected; nothing is capped, and no table of pairs of a family is ever made.

Before sets are fetched for step 2, a pair must have sizes and one-byte minhash prints that allow
the threshold (five and a half standard deviations); a pair refused wrongly comes back in step 3.

Defined results: A-Z is folded; null texts and texts without words have no shingles, link with
nothing and are their own component; fewer words than a shingle form one shingle; rows with equal
doc ids are one document, which links their texts; a null id is never a representative beside another id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.batches import (
    Texts,
    coded,
    lean,
    mix64,
    offsets_of,
    ragged_index,
    spans_array,
    text_slices,
    words_of,
)
from evalweave.llm.components import components
from evalweave.llm.names import columns_of, free_name
from evalweave.session import stage

#: Greatest probability with which two sets at the threshold do not meet in a table.
MISSED = 0.0001
#: Most classes, and megabytes of their sets, on either side of a block of a family.
BLOCK_CLASSES, BLOCK_BYTES = 512, 8 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Near:
    """Words per shingle, least similarity in percent, and the shape of the tensored tables."""

    words: int = 5
    percent: int = 80
    rows: int = 3
    seed: int = 0

    @property
    def bands(self) -> int:
        missed = 1 - (self.percent / 100) ** self.rows
        return max(1, math.ceil(math.log(MISSED / 2) / math.log(max(missed, 1e-9))))

    @property
    def hashes(self) -> int:
        return 2 * self.bands * self.rows

    @property
    def least_prints(self) -> int:
        """Prints that must agree: five and a half standard deviations below the mean at the threshold."""
        p = self.percent / 100
        return max(0, int(self.hashes * p - 5.5 * (self.hashes * p * (1 - p)) ** 0.5))


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, sorted, one text after another, and their bounds."""
    data, starts, ends, first = words_of(texts, fold_case=True)
    codes, values = coded(spans_array(data, starts, ends))
    hashed = np.array([xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()], np.uint64)[codes]
    counts = np.diff(first)
    lengths = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = offsets_of(lengths)
    doc = np.repeat(np.arange(len(counts)), lengths)
    at = first[:-1][doc] + np.arange(len(doc)) - bounds[doc]
    used = np.minimum(counts, words)[doc]
    shingles = mix64(used.astype(np.uint64) * _GOLD)
    for k in range(words):
        inside = used > k
        shingles[inside] = mix64(shingles[inside] * _GOLD + hashed[at[inside] + k])
    sets = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), offsets_of(sizes)


def class_hashes(flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each set, as signed numbers."""
    sums = [segment_sums_wrapping(mix64(flat ^ np.uint64(salt)), bounds) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [mix64(s + np.diff(bounds).astype(np.uint64)).view(np.int64) for s in sums]


def segment_sums_wrapping(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out[bounds[1:]] - out[bounds[:-1]]


def minhashes(flat: np.ndarray, bounds: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` minima per non-empty set: one row per set, one column per hash function."""
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = random.integers(0, 1 << 63, count, dtype=np.uint64)
    begins = bounds[:-1]
    out = np.empty((len(begins), count), np.uint64)
    for k in range(count):
        scrambled = (flat ^ masks[k]) * factors[k]
        scrambled ^= scrambled >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(scrambled * factors[k], begins) if len(begins) else 0
    return out


SKETCH = "id {id}, n_shingles long, class1 long, class2 long, bands array<long>, prints binary"


def sketches(docs: DataFrame, key: str, text: str, near: Near) -> DataFrame:
    """One narrow row per document: set size, hashes of the whole set, sub-bands and minhash prints."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    per_band = 2 * near.bands

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            flat, bounds = shingle_sets(texts, near.words)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            minima = minhashes(flat, offsets_of(sizes[some]), near.hashes, near.seed)
            bands = np.zeros((len(some), per_band), np.uint64)
            for r in range(near.rows):
                bands = mix64(bands * _GOLD + minima[:, r :: near.rows])
            prints = mix64(minima).astype(np.uint8)
            own: list[bytes | None] = [None] * len(sizes)
            for i, p in zip(some.tolist(), prints, strict=True):
                own[i] = p.tobytes()
            offsets = pa.array(offsets_of(np.where(sizes > 0, per_band, 0)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel()))
            columns = [part.column("id"), pa.array(sizes), *map(pa.array, class_hashes(flat, bounds))]
            names = ["id", "n_shingles", "class1", "class2", "bands", "prints"]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(own, pa.binary())], names=names)

    return rows.mapInArrow(run, SKETCH.format(id=docs.schema[key].dataType.simpleString()))


def table_keys(classes: DataFrame, near: Near) -> DataFrame:
    """``key, cls, weight``: the tensored keys that two classes or more share."""
    bands = classes.select("cls", F.posexplode("bands").alias("band", "value"))
    bands = bands.withColumn("sub", F.xxhash64("band", "value"))
    shared = bands.groupBy("sub").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    alive = bands.join(shared, "sub").groupBy("cls").agg(
        F.collect_list(F.when(F.col("band") < near.bands, F.col("sub"))).alias("first"),
        F.collect_list(F.when(F.col("band") >= near.bands, F.col("sub"))).alias("second"),
        F.sum("classes").alias("weight"),
    )
    # The lists are stored and not the keys made of them, which are many times as many.
    alive = stage(alive, "live-bands")
    one = alive.select("cls", "weight", "second", F.explode("first").alias("one"))
    two = one.select("cls", "weight", "one", F.explode("second").alias("two"))
    keys = two.select(F.xxhash64("one", "two").alias("key"), "cls", "weight")
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return stage(keys.join(several.select("key"), "key"), "table-keys")


def possible(pairs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose sizes and prints allow the threshold."""
    facts = classes.select("cls", "n_shingles", "prints")
    for side in ("a", "b"):
        named = {"cls": side, "n_shingles": f"n_{side}", "prints": f"prints_{side}"}
        pairs = pairs.join(facts.withColumnsRenamed(named), side)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    agree = F.aggregate(
        F.sequence(F.lit(1), F.lit(near.hashes)),
        F.lit(0),
        lambda total, i: total + (_byte("prints_a", i) == _byte("prints_b", i)).cast("int"),
    )
    fits = pairs.filter((small * 100 >= large * near.percent) & (agree >= near.least_prints))
    return fits.select("a", "b")


def _byte(column: str, i: Column) -> Column:
    return F.substring(F.col(column), i, F.lit(1))


def candidate_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, near: Near) -> DataFrame:
    """``cls, shingles`` of the wanted classes (cls, rep), worked out from the whole texts again."""
    reps = wanted.select(F.col("rep").alias("id")).distinct()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.alias("r").join(reps.alias("w"), F.col("r.id").eqNullSafe(F.col("w.id")), "left_semi")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text"):
            flat, bounds = shingle_sets(texts, near.words)
            sets = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            one, two = class_hashes(flat, bounds)
            columns = [pa.array(one), pa.array(two), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["class1", "class2", "shingles"])

    sets = rows.select("text").mapInArrow(run, "class1 long, class2 long, shingles binary")
    sets = sets.withColumn("cls", F.xxhash64("class1", "class2")).join(wanted.select("cls"), "cls", "left_semi")
    return stage(sets.select("cls", "shingles").dropDuplicates(["cls"]), "shingle-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.withColumnsRenamed({"cls": side, "shingles": f"set_{side}"}), side)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                common = int(np.sum(np.diff(np.sort(np.concatenate([a, b]), kind="stable")) == 0))
                keep[i] = 100 * common >= near.percent * (len(a) + len(b) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def families(keys: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks of the families: ``family, block, query, cls, grp, shingles``.

    A row stands in every block in which it is a query (``query`` true) or is compared with queries.
    """
    named = keys.join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    state = named.groupBy("key").agg(
        F.max(F.struct("weight", "cls")).alias("centre"), F.min("grp").alias("low"), F.max("grp").alias("high")
    )
    open_ = state.filter("low <> high").select("key", F.col("centre.cls").alias("a"))
    edges = stage(keys.join(open_, "key").select("a", F.col("cls").alias("b")).distinct(), "family-edges")
    member = components(edges).withColumnsRenamed({"node": "cls", "comp": "family"})
    member = member.join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    sizes = sets.select("cls", F.octet_length("shingles").alias("bytes"))
    member = stage(member.join(sizes, "cls"), "family-members")
    by_group = member.groupBy("family", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    by_family = by_group.groupBy("family").agg(
        F.max(F.struct("n", "bytes", "grp")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_CLASSES), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    cut = by_family.select(
        "family",
        F.col("most.grp").alias("most"),
        blocks(F.col("n"), F.col("bytes")).alias("targets"),
        blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("queries"),
    )
    placed = member.select("cls", "grp", "family").join(cut, "family")
    place = F.xxhash64("cls")
    target, query = F.pmod(place, F.col("targets")), F.pmod(place, F.col("queries"))
    as_target = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)))
    as_target = as_target.withColumns({"block": F.col("q") * F.col("targets") + target, "query": F.lit(False)})
    as_query = placed.filter("grp <> most").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("targets") - 1)))
    as_query = as_query.withColumns({"block": query * F.col("targets") + F.col("t"), "query": F.lit(True)})
    columns = ["family", "block", "query", "cls", "grp"]
    return as_target.select(columns).unionByName(as_query.select(columns)).join(sets, "cls")


def block_links(blocks: DataFrame, near: Near) -> DataFrame:
    """Links between the queries and the other classes of each block, one per query and other group."""

    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        targets = [r for r in rows if not r[2]]
        sets = [np.frombuffer(r[5], np.uint64) for r in targets]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        groups = np.array([r[4] for r in targets], np.int64)
        found = []
        for _, _, _, cls, grp, raw in (r for r in rows if r[2]):
            own = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
            common = np.bincount(owner[ragged_index(low, high - low)], minlength=len(sets))
            near_enough = 100 * common >= near.percent * (sizes + len(own) - common)
            hits = np.flatnonzero(near_enough & (groups != grp))
            _, one = np.unique(groups[hits], return_index=True)
            found += [(cls, targets[h][3]) for h in hits[one]]
        return found

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True)
        )
        for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
            found = links_of(list(group))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = blocks.select("family", "block", "query", "cls", "grp", "shingles")
    ordered = ordered.repartition("family", "block").sortWithinPartitions("family", "block", "query")
    return ordered.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, key: str, text: str, classes: DataFrame, near: Near) -> DataFrame:
    """Confirmed links between classes that connect all that the tables bring together.

    Links inside a group that is already connected may be left out; no connection is.
    """
    keys = table_keys(classes, near)
    met = classes.join(keys.select("cls").distinct(), "cls", "left_semi")
    sets = candidate_sets(docs, key, text, met.select("cls", "rep"), near)
    centres = keys.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("centre"))
    pairs = keys.join(centres, "key").filter("cls <> centre.cls")
    pairs = pairs.select(F.col("centre.cls").alias("a"), F.col("cls").alias("b"), "centre.weight").distinct()
    fit = stage(possible(pairs.drop("weight"), classes, near), "pairs")
    stars = stage(confirmed(fit, sets, near), "star-links")
    heavy = classes.join(keys.select("cls", "weight").distinct(), "cls").select(F.col("cls").alias("a"), "weight")
    groups = stars.join(heavy, "a").groupBy(F.col("b").alias("cls")).agg(F.max(F.struct("weight", "a")).alias("to"))
    # A centre that is linked to none stands for its own group; the others go with their heaviest one.
    groups = stage(groups.select("cls", F.col("to.a").alias("grp")), "groups")
    return stars.unionByName(stage(block_links(families(keys, groups, sets), near), "block-links"))


def near_duplicates(docs: DataFrame, key: str, text: str, near: Near = Near()) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row; see the module for the defined results."""
    sketch = stage(
        sketches(docs, key, text, near).withColumn("cls", F.xxhash64("class1", "class2")), "sketches"
    )
    classes = stage(
        sketch.filter("n_shingles > 0")
        .groupBy("cls")
        .agg(
            F.min("id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("prints").alias("prints"),
        ),
        "classes",
    )
    edges = links(docs, key, text, classes, near).unionByName(same_document(sketch))
    labels = components(edges).withColumnRenamed("node", "cls")
    grouped = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = grouped.groupBy("comp").agg(F.min("rep").alias("component_id"))
    ids = grouped.join(smallest, "comp").select("cls", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    rows = sketch.select("id", "n_shingles", "cls").join(ids, "cls", "left")
    rows = rows.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"))
    return rows.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def same_document(sketch: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc id."""
    texts = sketch.filter("n_shingles > 0 and id is not null").select("id", "cls").distinct()
    first = texts.groupBy("id").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return texts.join(first, "id").filter("a <> cls").select("a", F.col("cls").alias("b"))


def deduplicate(docs: DataFrame, key: str, text: str, near: Near = Near()) -> DataFrame:
    """One row of every component, with all its columns: the one of the least id, any id before a null one.

    Rows are told apart by a stored row id, so null or repeated ids neither keep copies nor link texts.
    Only the row ids that go meet the texts.
    """
    row = free_name(docs, "_row")
    stored = stage(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-rows")
    found = near_duplicates(stored.select(row, F.col(f"`{text}`").alias("text" + row)), row, "text" + row, near).select(row, "component_id")
    own, words = F.col(f"`{key}`"), F.xxhash64(f"`{text}`")
    # Of rows with one id, the text decides, not the layout of the files.
    keys = stored.select(row, own.isNull().alias("none"), own.alias("own"), words.alias("words"))
    verdict = stage(found.join(keys, row), "verdicts")
    best = verdict.groupBy("component_id").agg(F.min(F.struct("none", "own", "words", row)).alias("best"))
    removed = verdict.join(best.select(F.col(f"best.{row}").alias(row)), row, "left_anti").select(row)
    return stored.join(removed, row, "left_anti").select(*columns_of(docs))
