"""A seeded shuffle for rows that are read lazily: through a buffer of bounded size, file by file.

A whole shuffle sorts all rows. A reader that goes through its files once can only hold ``buffer`` rows:
each row that comes in takes a drawn place in the buffer and sends out the row that was there; at the
end of a file what is left goes out in a drawn order. The files (shards) themselves are taken in a drawn
order. Draws are hashes of the seed, the shard and the row's place in it, so the result depends neither
on how rows are cut into batches nor on which task reads a shard, and a retried task repeats it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The odd step and the two factors of the published splitmix64 generator.
STEP, FACTOR_1, FACTOR_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Offset of the places whose draws order what is left at the end of a shard.
LEFT = 1 << 40


def draws(key: int, places: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit draw for each place of a shard."""
    x = np.uint64(key) + places.astype(np.uint64) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FACTOR_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FACTOR_2)
    return x ^ (x >> np.uint64(31))


class Buffer:
    """The rows of one shard on their way through a buffer of ``size`` rows."""

    def __init__(self, key: int, size: int, schema: pa.Schema):
        self.key, self.size, self.seen, self.sent = key, size, 0, 0
        self.held = schema.empty_table()
        self.held_places = np.zeros(0, np.int64)

    def push(self, rows: pa.Table) -> Iterator[pa.Table]:
        """Takes rows in; gives those that leave, in order."""
        fill = min(self.size - len(self.held), len(rows))
        if fill:
            self.held = pa.concat_tables([self.held, rows.slice(0, fill)]).combine_chunks()
            self.held_places = np.append(self.held_places, self._places(fill))
        for at in range(fill, len(rows), self.size):
            part = rows.slice(at, self.size)
            places = self._places(len(part))
            yield self._out(self._exchanged(part, places))

    def _places(self, count: int) -> np.ndarray:
        self.seen += count
        return np.arange(self.seen - count, self.seen)

    def _exchanged(self, rows: pa.Table, places: np.ndarray) -> pa.Table:
        """What the rows push out: the row held in their slot, or the last of them that went there."""
        slots = (draws(self.key, places) % np.uint64(self.size)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        of = slots[order]
        first = np.append(True, of[1:] != of[:-1])
        out = np.empty(len(rows), np.int64)
        out[order] = np.where(first, of, self.size + np.append(0, order[:-1]))
        stay = np.arange(self.size)
        last = np.append(first[1:], True)
        stay[of[last]] = self.size + order[last]
        both = pa.concat_tables([self.held, rows]).combine_chunks()
        self.held = both.take(pa.array(stay))
        self.held_places = np.append(self.held_places, places)[stay]
        return both.take(pa.array(out))

    def rest(self) -> pa.Table:
        """What is still held, in its drawn order."""
        order = np.argsort(draws(self.key, self.held_places + LEFT), kind="stable")
        return self._out(self.held.take(pa.array(order)))

    def _out(self, rows: pa.Table) -> pa.Table:
        places = np.arange(self.sent, self.sent + len(rows))
        self.sent += len(rows)
        shard = pa.array(np.full(len(rows), self.key), pa.int64())
        return rows.append_column("shuffle_shard", shard).append_column("shuffle_place", pa.array(places))


def shard_key(seed: int, shard: Sequence[str]) -> Column:
    """A hash of seed and shard, by which shards are put in order; 60 bits of an MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in shard]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("bigint")


def buffered_shuffle(df: DataFrame, shard: Sequence[str], *, seed: int, buffer: int = 10_000) -> DataFrame:
    """Adds ``shuffle_shard`` and ``shuffle_place``; in this order the rows are shuffled.

    The columns ``shard`` name the file (or block of a file) of a row. The rows of a shard must come one
    after another in one partition, as a scan of files gives them; filters and projections keep that.
    One narrow pass: a task holds ``buffer`` rows and the batch that comes in.
    """
    if buffer <= 0:
        raise ValueError("the buffer must hold at least one row")
    names = df.columns
    keyed = df.select(shard_key(seed, shard).alias("k"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    added = [T.StructField(n, T.LongType()) for n in ("shuffle_shard", "shuffle_place")]
    schema = T.StructType([*keyed.schema.fields[1:], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Buffer | None = None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            rows = pa.Table.from_batches([batch]).remove_column(0)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if open_ is None or open_.key != keys[begin]:
                    if open_ is not None:
                        yield from open_.rest().to_batches()
                    open_ = Buffer(int(keys[begin]), buffer, rows.schema)
                for out in open_.push(rows.slice(begin, end - begin)):
                    yield from out.to_batches()
        if open_ is not None:
            yield from open_.rest().to_batches()

    shuffled = keyed.mapInArrow(run, schema)
    return shuffled.toDF(*names, *[f.name for f in added])
