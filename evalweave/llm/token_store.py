"""Token ids of a corpus in key order, in shards that a minimal perfect hash opens by key.

The store is a table of shard records, each of a few megabytes:

* ``payload``: the ids of all its documents, little-endian unsigned 32-bit, one after another;
* ``offsets``: where each document's ids begin, little-endian unsigned 64-bit, one entry more;
* ``index_*``: a minimal perfect hash of the distinct keys with a stored fingerprint per slot, and
  per slot the first document of the key and how many follow each other;
* ``part``, ``shard``: the shard's place in key order; ``ids_before``: ids before it in its part;
* ``keys``, ``first_key``, ``last_key``: the keys in order, and the bounds that prune a read.

Spark writes and reads it, so it may lie in any store Spark reaches. ``bases`` next to it holds, for
each part, the ids of all parts before.

Defined results: null text is the empty text; a null key comes first; repeated keys lie next to each
other, ordered by a hash of their text, and are found together.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm import perfect_hash
from evalweave.llm.batches import lean, text_slices
from evalweave.llm.tokens import WordEncoder, crc_of, with_end

#: Ids after which a shard is closed, unless one document alone has more.
SHARD_IDS = 1 << 20
_U8, _U4 = np.dtype("<u8"), np.dtype("<u4")


def key_hashes(keys: Sequence[object], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(repr(k), seed=seed) for k in keys], np.uint64)


def _shard_record(keys: list, ids: list[np.ndarray]) -> dict:
    """The index and payload of documents whose equal keys are neighbours."""
    first = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
    distinct = [keys[i] for i in first]
    seed = 0
    while len(np.unique(hashes := key_hashes(distinct, seed))) < len(distinct):
        seed += 1
    index = perfect_hash.build(hashes)
    slots = perfect_hash.find(index, hashes)
    begin, count = np.zeros(len(first), _U4), np.zeros(len(first), _U4)
    begin[slots], count[slots] = first, np.diff([*first, len(keys)])
    offsets = np.zeros(len(ids) + 1, _U8)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    return {
        "keys": keys,
        "first_key": keys[0],
        "last_key": keys[-1],
        "n_docs": len(keys),
        "n_ids": int(offsets[-1]),
        "offsets": offsets.tobytes(),
        "index_seed": seed,
        "index_sizes": index.sizes.tolist(),
        "index_bits": index.words.tobytes(),
        "index_fingerprints": index.fingerprints.astype(_U4).tobytes(),
        "index_first": begin.tobytes(),
        "index_count": count.tobytes(),
        "payload": np.concatenate(ids).astype(_U4).tobytes(),
    }


class Shard:
    """One shard record, opened."""

    def __init__(self, record: dict):
        words = np.frombuffer(record["index_bits"], _U8)
        ranks = perfect_hash.offsets_of(np.bitwise_count(words).astype(np.int64))[:-1]
        prints = np.frombuffer(record["index_fingerprints"], _U4)
        sizes = np.array(record["index_sizes"], np.int64)
        self.index = perfect_hash.PerfectHash(sizes, words, ranks, prints)
        self.seed = record["index_seed"]
        self.first = np.frombuffer(record["index_first"], _U4)
        self.counts = np.frombuffer(record["index_count"], _U4)
        self.offsets = np.frombuffer(record["offsets"], _U8).astype(np.int64)
        self.payload = np.frombuffer(record["payload"], _U4)

    def runs(self, keys: Sequence[object]) -> list[tuple[int, int]]:
        """For each key the first document and the number of documents; (0, 0) for unknown keys."""
        slots = perfect_hash.find(self.index, key_hashes(keys, self.seed))
        return [(int(self.first[s]), int(self.counts[s])) if s >= 0 else (0, 0) for s in slots]

    def ids(self, document: int) -> np.ndarray:
        return self.payload[self.offsets[document] : self.offsets[document + 1]]


def _schema(key: T.DataType) -> T.StructType:
    longs = {"n_docs", "n_ids", "index_seed", "ids_before"}
    fields = [("part", T.IntegerType()), ("shard", T.IntegerType()), ("ids_before", T.LongType())]
    fields += [("keys", T.ArrayType(key)), ("first_key", key), ("last_key", key)]
    rest = "n_docs n_ids offsets index_seed index_sizes index_bits index_fingerprints index_first index_count payload"
    for name in rest.split():
        kind = T.ArrayType(T.LongType()) if name == "index_sizes" else T.BinaryType()
        fields.append((name, T.LongType() if name in longs else kind))
    return T.StructType([T.StructField(n, k) for n, k in fields])


def write_store(
    docs: DataFrame, key: str, text: str, path: str, *, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS
) -> None:
    """Encode every whole text, append ``end_id``, and write the store to ``path``.

    The texts are range-partitioned by key and encoded where they arrive, so no id crosses the
    network; each task closes a shard whenever it is full.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    schema = _schema(docs.schema[key].dataType)
    names = [f.name for f in schema]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(vocabulary), TaskContext.get().partitionId()
        state = {"shard": 0, "ids_before": 0}
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            record = {"part": part, **state, **_shard_record(keys, held)}
            state["shard"] += 1
            state["ids_before"] += record["n_ids"]
            return pa.RecordBatch.from_pydict({n: [record[n]] for n in names}, schema=arrow)

        arrow = _arrow_schema(schema)
        for some, texts in text_slices(batches, "text"):
            ids, bounds = with_end(*encoder.encode(texts), end_id)
            for k, a, b in zip(some.column("key").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                if keys and size + (b - a) > shard_ids:
                    yield close()
                    keys, held, size = [], [], 0
                keys.append(k)
                held.append(ids[a:b])
                size += b - a
        if keys:
            yield close()

    shards = ordered.mapInArrow(run, schema)
    shards.write.option("compression", "zstd").parquet(f"{path}/shards")
    spark = docs.sparkSession
    written = spark.read.schema(schema).parquet(f"{path}/shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = written.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    bases = totals.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    bases.write.parquet(f"{path}/bases")


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/shards")


def read_documents(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Every document of the store by keyed access: key, ``start``, ``n_tokens``, ``ids_crc32``.

    Each key of a shard is looked up through the shard's index; ``start`` counts the ids of all
    documents before it in the store.
    """
    shards = open_store(spark, path)
    key = shards.schema["first_key"].dataType
    fields = [T.StructField("part", T.IntegerType()), T.StructField("key", key)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                record = batch.slice(i, 1).to_pylist()[0]
                shard, keys = Shard(record), record["keys"]
                distinct = [k for j, k in enumerate(keys) if j == 0 or k != keys[j - 1]]
                found = [
                    (k, d)
                    for k, (first, count) in zip(distinct, shard.runs(distinct), strict=True)
                    for d in range(first, first + count)
                ]
                ids = [shard.ids(d) for _, d in found]
                columns = {
                    "part": [record["part"]] * len(found),
                    "key": [k for k, _ in found],
                    "start": [record["ids_before"] + int(shard.offsets[d]) for _, d in found],
                    "n_tokens": [len(x) for x in ids],
                    "ids_crc32": [crc_of(x) for x in ids],
                }
                if with_ids:
                    columns["ids"] = [x.tobytes() for x in ids]
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    bases = spark.read.parquet(f"{path}/bases")
    read = shards.mapInArrow(run, schema).join(bases, "part")
    return read.withColumn("start", F.col("start") + F.col("base")).drop("base", "part")


def fetch(spark: SparkSession, path: str, keys: Sequence[object]) -> DataFrame:
    """The ids of a short list of keys, reading only shards whose key bounds hold one of them."""
    wanted = list(dict.fromkeys(keys))
    shards = open_store(spark, path)
    if not wanted:
        return spark.createDataFrame([], T.StructType([T.StructField("key", shards.schema["first_key"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))]))
    inside = [
        F.col("first_key").isNull()
        if k is None
        else (F.col("last_key") >= F.lit(k)) & (F.col("first_key").isNull() | (F.col("first_key") <= F.lit(k)))
        for k in wanted
    ]
    some = shards.filter(functools.reduce(operator.or_, inside)).drop("keys")
    schema = T.StructType(
        [T.StructField("key", shards.schema["first_key"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))]
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                rows = [
                    (k, shard.ids(d).tolist())
                    for k, (first, count) in zip(wanted, shard.runs(wanted), strict=True)
                    for d in range(first, first + count)
                ]
                yield pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "ids": [r[1] for r in rows]}, schema=arrow)

    return some.mapInArrow(run, schema)
