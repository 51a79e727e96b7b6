"""Packing token pieces into sequences: first-fit decreasing over a tournament tree, group by group.

A document's ids (with the end id) are cut every ``length`` ids. Pieces are dealt into randomised
groups of about ``group_size``, and each group is packed by itself: pieces from long to short, each
into the first sequence with room, which a tournament tree of free lengths finds in log steps.

Defined results: null text is the empty text, whose one piece is the end id; repeated rows are
pieces of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.batches import lean, offsets_of, ragged_index, text_slices, trim_memory
from evalweave.llm.names import columns_of, free_name
from evalweave.llm.tokens import WordEncoder, crc_of, with_end
from evalweave.session import stage

PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)
IDS = T.StructField("ids", T.BinaryType())
#: Most groups (of 4,096 pieces, 33 MB at most) to a task on average.
GROUPS_A_TASK = 8


def token_pieces(
    docs: DataFrame, key: str, text: str, path: str, *, end_id: int, length: int, with_ids: bool = True
) -> DataFrame:
    """One row per piece: key, place in the document, length, checksum and (little-endian) ids."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [T.StructField(key, docs.schema[key].dataType), *PIECE.fields] + [IDS] * with_ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for part, texts in text_slices(batches, "text"):
            ids, bounds = with_end(*encoder.encode(texts), end_id)
            totals = np.diff(bounds)
            counts = -(-totals // length)
            doc = np.repeat(np.arange(len(totals)), counts)
            start = ragged_index(np.zeros(len(counts), np.int64), counts) * length
            size = np.minimum(totals[doc] - start, length)
            at = offsets_of(size)
            pieces = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [
                part.column("key").take(pa.array(doc)),
                *[pa.array(c, pa.int64()) for c in (start, size, [crc_of(p) for p in pieces], totals[doc])],
            ]
            if with_ids:
                columns.append(pa.array([p.astype("<u4").tobytes() for p in pieces], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal lengths keep their order.

    ``free`` is a tournament tree: node n holds the larger free length of nodes 2n and 2n + 1, the
    leaves are the bins. Going left whenever the left half has room ends at the first bin that fits.
    """
    leaves = 1 << max(len(lengths) - 1, 0).bit_length()
    free = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for place in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[place])
        if need > capacity:
            raise ValueError("a piece is longer than a sequence")
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[place], offsets[place] = node - leaves, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def _stored(pieces: DataFrame, group_size: int) -> tuple[DataFrame, str, int]:
    """The pieces written once with a row id, the name of that, and the number of groups."""
    row = free_name(pieces, "_row")
    stored = stage(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    return stored, row, max(1, math.ceil(stored.count() / group_size))


def _group(row: str, groups: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(row)), F.lit(groups))


def pack(pieces: DataFrame, *, capacity: int, group_size: int = 4096, seed: int = 0) -> DataFrame:
    """Adds ``sequence_id`` (group number times 2**32 plus bin) and ``offset`` to the pieces.

    The pieces are written once with a row id, whose hash deals them into groups: no key decides the
    group, so none can fill it. A task packs whole groups, one after another.
    """
    stored, row, groups = _stored(pieces, group_size)
    narrow = stored.select(F.col(row).alias("row"), "length", _group(row, groups, seed).alias("group"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        return pd.DataFrame({"row": frame["row"], "sequence_id": frame["group"] * (1 << 32) + bins, "offset": offsets})

    placed = narrow.groupBy("group").applyInPandas(place, "row long, sequence_id long, offset long")
    placed = placed.withColumnRenamed("row", row)
    return stored.join(placed, row).select(*columns_of(pieces), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence, unpadded, as little-endian binary (at most one sequence each)."""
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        F.sum("length").alias("used"),
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", "used", joined.alias("ids"))


def filled_sequences(pieces: DataFrame, *, capacity: int, group_size: int = 4096, seed: int = 0) -> DataFrame:
    """Packs as ``pack`` does and gives each sequence: its id, ``used``, its unpadded ``ids`` and its pieces.

    ``parts`` are the pieces in order, with ``offset`` and all their other columns. A task that packs a
    group also joins its ids, so these are shuffled once, by group.
    """
    stored, row, groups = _stored(pieces, group_size)
    others = [f for f in pieces.schema.fields if f.name != "ids"]
    part = T.StructType([T.StructField("offset", T.LongType()), *[T.StructField(f.name, f.dataType) for f in others]])
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("used", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("parts", T.ArrayType(part)),
        ]
    )

    # Arrow functions find their columns by plain names.
    names = [f.name for f in others]
    plain = stored.select(
        F.col(row).alias("row"), _group(row, groups, seed).alias("group"), F.col("length").alias("size"),
        F.col("ids").alias("bytes"), *[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)],
    )

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        bins, offsets = first_fit_decreasing(table.column("size").to_numpy(), capacity)
        order = np.lexsort((offsets, bins))
        table = table.take(pa.array(order)).combine_chunks()
        bins, offsets = bins[order], offsets[order]
        first = np.append(np.flatnonzero(np.diff(bins, prepend=-1)), len(bins)).astype(np.int32)
        _, at, data = table.column("bytes").chunk(0).buffers()
        bytes_at = np.frombuffer(at, np.int32)[first]
        columns = [pa.array(offsets, pa.int64()), *[table.column(f"k{i}").chunk(0) for i in range(len(names))]]
        struct = pa.StructArray.from_arrays(columns, names=part.names)
        sequence = table.column("group").to_numpy()[0] * (1 << 32) + bins[first[:-1]]
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(sequence), [None, pa.py_buffer(bytes_at), data])
        parts = pa.ListArray.from_arrays(pa.array(first), struct)
        trim_memory()
        return pa.table([pa.array(sequence, pa.int64()), pa.array(np.diff(bytes_at) // 4, pa.int64()), ids, parts], schema.names)

    # A task packs its groups one after another; more tasks than the session asks for only if it had too many.
    tasks = math.ceil(groups / GROUPS_A_TASK)
    if tasks > int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        plain = plain.repartition(tasks, "group")
    return plain.groupBy("group").applyInArrow(fill, schema)


def measured_pieces(filled: DataFrame) -> DataFrame:
    """The pieces of ``filled_sequences``; their length and checksum are those of the ids between two offsets."""
    names = [f.name for f in filled.schema["parts"].dataType.elementType.fields if f.name != "offset"]
    ends = F.concat(
        F.transform(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))), lambda p: p["offset"]),
        F.array((F.octet_length("ids") / 4).cast("bigint")),
    )

    def measured(part: Column, at: Column) -> Column:
        length = F.element_at("ends", at + 1) - part["offset"]
        own = F.substring("ids", (4 * part["offset"] + 1).cast("int"), (4 * length).cast("int"))
        fresh = {"length": length, "ids_crc32": F.crc32(own)}
        return F.struct(*[fresh.get(n, part[n]).alias(n) for n in names], part["offset"].alias("offset"))

    cut = filled.withColumn("ends", ends).select("sequence_id", F.transform("parts", measured).alias("parts"))
    pieces = cut.select("sequence_id", F.explode("parts").alias("part"))
    return pieces.select(*[f"part.{n}" for n in names], "sequence_id", "part.offset")
