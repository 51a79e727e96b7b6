"""Repeated ids of an unending input, told as they come, with state that lies in files.

``dropDuplicates`` keeps every id in its state store for ever and drops repeats without a word. Here the
ids seen so far are a ledger of files in a fixed number of buckets, and every bucket has a Bloom filter.
A micro-batch first asks the filters: an id that its filter does not know is new, and only the buckets of
the others are read. The filters are of a fixed size, so what a batch costs beyond its own rows is one
small row a bucket.

Each batch writes below its own number and replaces what a failed try of it left, so a restarted
stream gives the same ledger and the same rejects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.session import shared_path, stage

REJECTS = "id string, place bigint, first_place bigint"


@dataclass(frozen=True)
class Ledger:
    """A ledger below ``path``: ``buckets`` Bloom filters of ``filter_bytes`` each, ``hashes`` bits an id.

    At 10 bits an id and 7 hashes a filter is wrong for one id in a hundred, which costs a look into the
    bucket and never a wrong verdict. Size the filters for the ids expected of a bucket.
    """

    path: str
    buckets: int = 64
    filter_bytes: int = 1 << 17
    hashes: int = 7

    def bucket(self, column: str = "id"):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def part(self, what: str, batch: int) -> str:
        return f"{self.path}/{what}/batch={batch}"


def _bits(h: np.ndarray, hashes: int, size: int) -> np.ndarray:
    """Bit numbers of each hash: one row of ``hashes`` numbers below ``size``."""
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(hashes, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) % np.uint64(size)).astype(np.int64)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _possible(ids: DataFrame, filters: DataFrame, ledger: Ledger) -> DataFrame:
    """The ids (id, bucket, h) that the filter of their bucket may know.

    Filters are asked bucket by bucket, ids next to the one row of their filter.
    """
    asked = ids.select("bucket", "id", "h", F.lit(None).cast("binary").alias("bits"))
    known = filters.select("bucket", F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("h"), "bits")
    rows = asked.unionByName(known).repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            is_filter = batch.column("bits").is_valid().to_numpy(zero_copy_only=False)
            h = batch.column("h").fill_null(0).to_numpy().view(np.uint64)
            keep = np.zeros(len(bucket), dtype=bool)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if is_filter[begin]:
                    bits = np.frombuffer(batch.column("bits")[int(begin)].as_buffer(), np.uint8)
                    held = (int(bucket[begin]), np.unpackbits(bits, bitorder="little"))
                if held is None or held[0] != bucket[begin]:
                    continue
                own = np.arange(begin, end)[~is_filter[begin:end]]
                keep[own] = held[1][_bits(h[own], ledger.hashes, len(held[1]))].all(axis=1)
            yield batch.select(["id", "bucket", "h"]).filter(pa.array(keep))

    return rows.mapInArrow(run, "id string, bucket int, h bigint")


def _grown(filters: DataFrame, ids: DataFrame, ledger: Ledger) -> DataFrame:
    """The filters with the bits of new ids set: one row for every bucket that has any."""
    added = ids.select("bucket", "h", F.lit(None).cast("binary").alias("bits"))
    known = filters.select("bucket", F.lit(None).cast("bigint").alias("h"), "bits")
    rows = added.unionByName(known).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bits = None, None

        def done() -> pa.RecordBatch:
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["bucket", "bits"])

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            is_filter = batch.column("bits").is_valid().to_numpy(zero_copy_only=False)
            h = batch.column("h").fill_null(0).to_numpy().view(np.uint64)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if number != bucket[begin]:
                    if number is not None:
                        yield done()
                    number, bits = int(bucket[begin]), np.zeros(8 * ledger.filter_bytes, np.uint8)
                own = np.arange(begin, end)
                bits[_bits(h[own[~is_filter[own]]], ledger.hashes, len(bits)).ravel()] = 1
                for at in own[is_filter[own]].tolist():
                    raw = np.frombuffer(batch.column("bits")[at].as_buffer(), np.uint8)
                    bits |= np.unpackbits(raw, bitorder="little")
        if number is not None:
            yield done()

    return rows.mapInArrow(run, "bucket int, bits binary")


def take_batch(rows: DataFrame, batch: int, ledger: Ledger) -> None:
    """One micro-batch of (id, place): new ids go into the ledger, repeats into the rejects.

    ``place`` is unique and says which of two rows came first inside a batch; an id of an earlier
    batch came before all of this one. Rows with a null or empty id are not looked at.
    """
    spark = rows.sparkSession
    named = rows.filter("id <> ''").select("id", F.col("place").cast("bigint").alias("place"))
    named = stage(named.withColumns({"bucket": ledger.bucket(), "h": F.xxhash64("id", F.lit(1))}), "ledger-batch")
    firsts = named.groupBy("id", "bucket", "h").agg(F.min("place").alias("first_place"))
    filters = _read(spark, ledger.part("filters", batch - 1), "bucket int, bits binary")
    asked = stage(_possible(firsts.select("id", "bucket", "h"), filters, ledger), "ledger-asked")
    seen = _read(spark, f"{ledger.path}/ids", "id string, first_place bigint, batch int, bucket int")
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    before = seen.filter((F.col("batch") < batch) & F.col("bucket").isin(wanted)).select("id", "first_place")
    known = stage(asked.join(before, "id").select("id", "first_place"), "ledger-known")

    fresh = firsts.join(known, "id", "left_anti")
    places = known.unionByName(fresh.select("id", "first_place"))
    repeats = named.join(places, "id").filter(F.col("place") != F.col("first_place"))
    repeats.select("id", "place", "first_place").write.mode("overwrite").parquet(ledger.part("rejects", batch))
    new = fresh.select("id", "first_place", "bucket").repartition("bucket")
    new.write.mode("overwrite").partitionBy("bucket").parquet(ledger.part("ids", batch))
    _grown(filters, fresh.select("bucket", "h"), ledger).write.mode("overwrite").parquet(ledger.part("filters", batch))


def rejects(spark: SparkSession, ledger: Ledger) -> DataFrame:
    """Repeated rows so far: the id, the row's place, and the place of the id's first row."""
    return _read(spark, f"{ledger.path}/rejects", REJECTS + ", batch int").select("id", "place", "first_place")


def run_ledger(stream: DataFrame, ledger: Ledger | None = None, checkpoint: str | None = None) -> Ledger:
    """Drain a stream of (id, place) through a ledger; the same ledger and checkpoint go on where they stopped."""
    spark = stream.sparkSession
    ledger = ledger or Ledger(shared_path(spark, "id-ledger"))
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, ledger))
        .option("checkpointLocation", checkpoint or f"{ledger.path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return ledger
