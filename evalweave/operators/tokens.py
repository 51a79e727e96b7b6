"""Token ids and their texts. A vocabulary has columns token_id, token_text, is_special.

A vocabulary of bounded size is broadcast. Of a larger one, each slice of the rows (with a bounded number of
different tokens) is handed the entries that occur in it: the slice's distinct tokens meet the vocabulary in a join, and
what they find goes to the slice. Tokens never become rows that move, repeated ones least of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.operators.ordered import dense_index
from evalweave.operators.skew import lookup_join
from evalweave.operators.workers import lean
from evalweave.session import stage

#: Most bytes of a vocabulary that every task may hold, and ids decoded at a time.
DICTIONARY_BYTES = 64 << 20
TOKENS_HELD = 1 << 20
#: Ids, or bytes of text, that are looked through at a time, and entries after which a slice ends.
PART_TOKENS, PART_BYTES, SLICE_ENTRIES = 1 << 20, 8 << 20, 1 << 19


@dataclass(frozen=True)
class Dictionary:
    """Entries of a vocabulary as Arrow columns, by ascending id; a flag that is not known is null."""

    ids: np.ndarray
    texts: pa.Array
    flags: pa.Array

    @classmethod
    def of(cls, entries: pa.Table) -> Dictionary:
        table = entries.select(["token_id", "token_text", "is_special"]).sort_by("token_id").combine_chunks()
        ids, texts, flags = (c.combine_chunks() for c in table.columns)
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (np.diff(ids) == 0).any():
            raise ValueError("a token id has several texts")
        return cls(ids, texts.cast(pa.large_string()), flags)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where each id stands; -1 for those that are not there."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def places_in(self, flat: pa.Array) -> np.ndarray:
        """``places`` of a column of ids; -1 for null."""
        given = flat.is_valid().to_numpy(zero_copy_only=False)
        return np.where(given, self.places(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)), -1)


def _entries(vocab: DataFrame, textless: bool = False) -> DataFrame:
    there = F.col("token_id").isNotNull()
    rows = vocab.filter(there if textless else there & F.col("token_text").isNotNull())
    return rows.select("token_id", "token_text", "is_special")


def dictionary(vocab: DataFrame, most_bytes: int = DICTIONARY_BYTES, *, textless: bool = False) -> Dictionary | None:
    """The stored vocabulary on the driver, if its texts and ids take at most ``most_bytes``; else null.

    A vocabulary belongs to a model and does not grow with the data, but that is measured here. Entries
    without a text are left out unless ``textless`` is set.
    """
    bulk = vocab.agg(F.sum(F.coalesce(F.octet_length("token_text"), F.lit(0)) + F.lit(16))).first()[0]
    return None if (bulk or 0) > most_bytes else Dictionary.of(_entries(vocab, textless).toArrow())


def detokenize(
    df: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame, most_bytes: int = DICTIONARY_BYTES
) -> DataFrame:
    """The ids with their raw text (all tokens), clean text (no special ones) and an error for unknown ids.

    A null list counts as an empty one. ``vocab`` is a stored table; beyond ``most_bytes`` it is dealt to
    slices of the rows.
    """
    added = [T.StructField(n, T.StringType()) for n in ("raw_response", "clean_text", "response_error")]
    return _told(df, keys, ids, vocab, added, _decoded, most_bytes)


def token_events(
    df: DataFrame, keys: Sequence[str], ids: str, vocab: DataFrame, most_bytes: int = DICTIONARY_BYTES
) -> DataFrame:
    """One row per generated token, with its step and its own text (special tokens included).

    ``vocab`` is a stored table, taken in as ``detokenize`` does; an unknown id has no text.
    """
    lists = (("_texts", T.StringType()), ("_flags", T.BooleanType()))
    added = [T.StructField(n, T.ArrayType(t)) for n, t in lists]
    rows = _told(df, keys, ids, vocab, added, _listed, most_bytes, textless=True)
    token = F.posexplode(F.arrays_zip(F.col(f"`{ids}`").alias("id"), F.col("_texts").alias("text"), F.col("_flags").alias("flag")))
    names = {"id": "token_id", "text": "token_text", "flag": "is_special"}
    steps = rows.select(*[F.col(f"`{c}`") for c in keys], token.alias("token_step", "_t"))
    return steps.select(
        *[F.col(f"`{c}`") for c in keys], "token_step", *[F.col(f"_t.{c}").alias(name) for c, name in names.items()]
    )


def _told(
    df: DataFrame,
    keys: Sequence[str],
    ids: str,
    vocab: DataFrame,
    added: list[T.StructField],
    tell: Callable[[pa.ListArray, Dictionary], list[pa.Array]],
    most_bytes: int,
    *,
    textless: bool = False,
) -> DataFrame:
    """``keys``, the ids (null: empty) and what ``tell`` makes of lists of ids and a dictionary that holds them."""
    kind = df.schema[ids].dataType
    held_kind = kind if kind == T.ArrayType(T.IntegerType(), kind.containsNull) else T.ArrayType(T.LongType())
    given = F.col(f"`{ids}`").cast(held_kind)
    plain = df.select(_key(keys), F.coalesce(given, F.array().cast(held_kind)).alias("ids"))
    schema = T.StructType([*plain.schema.fields, *added])
    held = dictionary(vocab, most_bytes, textless=textless)

    def told(rows: pa.RecordBatch, entries: Dictionary) -> Iterator[pa.RecordBatch]:
        for part in _cut(rows, _list_bounds(rows, "ids"), TOKENS_HELD):
            yield pa.RecordBatch.from_arrays([*part.columns, *tell(part.column("ids"), entries)], schema.names)

    if held is None:
        made = _told_by_slices(plain, _entries(vocab, textless), told, schema)
    else:
        shared = df.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from told(batch, shared.value)

        made = plain.mapInArrow(run, schema)
    return made.select(*_unkeyed(keys), F.col("ids").cast(kind).alias(ids), *[f.name for f in added])


def _key(keys: Sequence[str]) -> Column:
    """All keys as one column ``k``, under plain names."""
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]).alias("k")


def _unkeyed(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"k.k{i}").alias(c) for i, c in enumerate(keys)]


def _list_bounds(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).offsets.to_numpy().astype(np.int64)


def _text_bounds(batch: pa.RecordBatch, name: str) -> np.ndarray:
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes.astype(np.int64)))


def _cut(batch: pa.RecordBatch, bounds: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of at most ``most`` between ``bounds``, or one row that has more."""
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def _parts(
    batches: Iterator[pa.RecordBatch], bounds: Callable[[pa.RecordBatch], np.ndarray], most: int
) -> Iterator[pa.RecordBatch]:
    """The rows of a task in parts of at most ``most`` (or one row that has more), however small their batches."""
    held, size = [], 0
    for batch in batches:
        for part in _cut(batch, bounds(batch), most):
            own = bounds(part)
            own = int(own[-1] - own[0])
            if held and size + own > most:
                yield _one(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)


def _rows_of(number: int, columns: list[pa.Array], behind: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """Rows of a slice; the columns of its entries are null."""
    size = len(columns[0])
    empty = [pa.nulls(size, t) for t in behind]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), *columns, *empty], names)


def _entries_of(number: int, columns: list[pa.Array], like: pa.RecordBatch) -> pa.RecordBatch:
    """What the rows of a slice ask for, under the columns of those rows."""
    size = len(columns[0])
    empty = [pa.nulls(size, f.type) for f in list(like.schema)[1 : -len(columns)]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), *empty, *columns], like.schema.names)


def _optional(*fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("slice", T.LongType()), *[T.StructField(f.name, f.dataType) for f in fields]])


def _told_by_slices(
    plain: DataFrame,
    entries: DataFrame,
    told: Callable[[pa.RecordBatch, Dictionary], Iterator[pa.RecordBatch]],
    schema: T.StructType,
) -> DataFrame:
    cut = _optional(*plain.schema.fields, T.StructField("token_id", T.LongType()))
    most, entries_most = PART_TOKENS, SLICE_ENTRIES

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, rows = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64), None
        for part in _parts(batches, lambda b: _list_bounds(b, "ids"), most):
            rows = _rows_of(number, part.columns, [pa.int64()], cut.names)
            yield rows
            asked = pc.unique(part.column("ids").flatten()).drop_null()
            seen = np.union1d(seen, asked.to_numpy(zero_copy_only=False).astype(np.int64))
            if len(seen) >= entries_most:
                yield _entries_of(number, [pa.array(seen)], rows)
                number, seen = number + 1, seen[:0]
        if len(seen):
            yield _entries_of(number, [pa.array(seen)], rows)

    # Stored, so that a slice is the same rows for both of its readers.
    stored = stage(plain.mapInArrow(run, cut), "token-slices")
    asked = stored.filter(F.col("token_id").isNotNull()).select("slice", "token_id")
    known = entries.withColumn("token_id", F.col("token_id").cast("bigint"))
    found = lookup_join(asked, known, ["token_id"], "inner", stored=True)
    found = found.select("slice", *known.columns)
    rows = stored.filter(F.col("ids").isNotNull()).drop("token_id")
    return _met(rows, found, Dictionary.of, told, schema)


def _met(rows: DataFrame, entries: DataFrame, hold: Callable, tell: Callable, schema: T.StructType) -> DataFrame:
    """``tell(rows, hold(entries))`` of every slice, rows in parts; a task holds the entries of one slice."""
    names, own = rows.columns[1:], entries.columns[1:]

    def nothing(df: DataFrame, columns: list[str]) -> list[Column]:
        return [_blank(df.schema[c].dataType).alias(c) for c in columns]

    entries = _packed(entries)
    # Entries before rows by one number, which sorts by its digits.
    turn = F.col("slice") * 2
    left = entries.select("slice", turn.alias("turn"), *own, *nothing(rows, names))
    right = rows.select("slice", (turn + 1).alias("turn"), *nothing(entries, own), *names)
    both = left.union(right).repartition("slice").drop("slice").sortWithinPartitions("turn")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if at != turns[begin] // 2:
                    at, parts, held = turns[begin] // 2, [], None
                piece = batch.slice(begin, end - begin)
                if turns[begin] % 2 == 0:
                    parts.append(pa.RecordBatch.from_arrays([piece.column(c).flatten() for c in own], own))
                    continue
                if held is None:
                    flat = pa.schema([(c, batch.schema.field(c).type.value_type) for c in own])
                    held = hold(pa.Table.from_batches(parts, flat))
                    parts = []
                yield from tell(piece.select(names), held)

    return both.mapInArrow(run, schema)


def _packed(entries: DataFrame) -> DataFrame:
    """Entries of a slice that lie together in a task as one row of lists: the columns of the slices' rows, which
    entries leave blank, cost as much in every row that goes to Python."""
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in entries.schema.fields[1:]]
    schema = T.StructType([entries.schema.fields[0], *lists])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1))
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, c) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), *columns], schema.names)

    return entries.sortWithinPartitions("slice").mapInArrow(run, schema)


def _blank(kind: T.DataType) -> Column:
    """A value that nobody reads. Lists and maps are empty: behind each row that goes to Python in Arrow form, the
    offsets of all null lists since the last given one are written again, which takes the square of a run of them."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_blank(f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.create_map().cast(kind) if isinstance(kind, T.MapType) else F.lit(None).cast(kind)


def _decoded(lists: pa.ListArray, vocab: Dictionary) -> list[pa.Array]:
    """Raw text, clean text and error of each list of ids."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, flat = offsets - offsets[0], lists.flatten()
    given = flat.is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    at = vocab.places_in(flat)
    special = pc.fill_null(vocab.flags, False).to_numpy(zero_copy_only=False).astype(bool)
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    lost = at < 0
    bad = np.zeros(len(lists), dtype=bool)
    bad[row[lost]] = True
    # The least unknown id of a row, nulls last.
    least = np.full(len(lists), np.iinfo(np.int64).max)
    np.minimum.at(least, row[lost & given], ids[lost & given])
    named = np.zeros(len(lists), dtype=bool)
    named[row[lost & given]] = True
    errors = [
        f"KeyError: unknown token id {least[i] if named[i] else 'null'}" if b else None for i, b in enumerate(bad.tolist())
    ]
    joined = []
    for keep in (~lost, ~lost & ~special[at] if len(vocab.ids) else ~lost):
        ends = np.append(0, np.cumsum(keep))[offsets]
        texts = pa.LargeListArray.from_arrays(pa.array(ends), vocab.texts.take(pa.array(at[keep])))
        whole = pc.binary_join(texts, pa.scalar("", pa.large_string()))
        joined.append(pc.if_else(pa.array(bad), pa.scalar(None, pa.large_string()), whole).cast(pa.string()))
    return [*joined, pa.array(errors, pa.string())]


def _listed(lists: pa.ListArray, vocab: Dictionary) -> list[pa.Array]:
    """Texts and flags of the ids of each list."""
    at = vocab.places_in(lists.flatten())
    places = pa.array(at, mask=at < 0)
    offsets = lists.offsets.to_numpy()
    offsets = pa.array(offsets - offsets[0], pa.int32())
    return [
        pa.ListArray.from_arrays(offsets, values.take(places).cast(kind))
        for values, kind in ((vocab.texts, pa.string()), (vocab.flags, pa.bool_()))
    ]


def encode_words(df: DataFrame, keys: Sequence[str], text: str, vocab: DataFrame, name: str) -> DataFrame:
    """``keys`` and the ids of the words between single blanks of ``text``; unknown words are null.

    The way back of ``detokenize``, by the same dictionary or the same slices. Null text has a null list; of
    several ids with one text the least is taken.
    """
    held = dictionary(vocab)
    plain = df.select(_key(keys), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if held is None:
        return _encoded_by_slices(plain, vocab, schema).select(*_unkeyed(keys), F.col("ids").alias(name))
    shared = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, numbers = shared.value.texts, pa.array(shared.value.ids.astype(np.int32))
        for batch in batches:
            coded, offsets, mask = _coded(batch.column("text"))
            ids = numbers.take(pc.index_in(coded.dictionary, texts)).take(coded.indices)
            lists = pa.ListArray.from_arrays(offsets, ids, mask=mask)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], schema.names)

    return plain.mapInArrow(run, schema).select(*_unkeyed(keys), F.col("ids").alias(name))


def _coded(texts: pa.Array) -> tuple[pa.DictionaryArray, pa.Array, pa.Array | None]:
    """All words of some texts, the bounds of each text's words and which texts are null."""
    words = pc.split_pattern(texts.cast(pa.large_string()), " ")
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return words.flatten().dictionary_encode(), pa.array(offsets), words.is_null() if words.null_count else None


def _encoded_by_slices(plain: DataFrame, vocab: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows hold their words as places in the list of their slice's words, which get their ids by a join."""
    cut = _optional(*schema.fields, T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType()))
    most, entries_most = PART_BYTES, SLICE_ENTRIES

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.array([], pa.large_string())
        number, seen, rows = TaskContext.get().partitionId() << 32, none, None

        def entries() -> pa.RecordBatch:
            places = pa.array(np.arange(len(seen), dtype=np.int32))
            return _entries_of(number, [places, seen.cast(pa.string())], rows)

        for part in _parts(batches, lambda b: _text_bounds(b, "text"), most):
            coded, offsets, mask = _coded(part.column("text"))
            at = pc.fill_null(pc.index_in(coded.dictionary, seen), -1).to_numpy(zero_copy_only=False).copy()
            fresh = at < 0
            at[fresh] = len(seen) + np.arange(fresh.sum())
            lists = pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32()).take(coded.indices), mask=mask)
            rows = _rows_of(number, [*part.columns[:-1], lists], [pa.int32(), pa.string()], cut.names)
            yield rows
            seen = pa.concat_arrays([seen, coded.dictionary.filter(pa.array(fresh))])
            if len(seen) >= entries_most:
                yield entries()
                number, seen = number + 1, none
        if len(seen):
            yield entries()

    stored = stage(plain.mapInArrow(run, cut), "word-slices")
    asked = stored.filter(F.col("word").isNotNull()).select("slice", "at", "word")
    ids = vocab.select(F.col("token_text").alias("word"), F.col("token_id").cast("int").alias("id"))
    found = lookup_join(asked, ids, ["word"], stored=True).select("slice", "at", "id")

    def hold(entries: pa.Table) -> pa.Array:
        ordered = entries.sort_by([("at", "ascending"), ("id", "ascending")]).combine_chunks()
        first = np.diff(ordered.column("at").to_numpy(), prepend=-1) != 0
        return ordered.column("id").combine_chunks().filter(pa.array(first))

    def told(rows: pa.RecordBatch, numbers: pa.Array) -> Iterator[pa.RecordBatch]:
        for part in _cut(rows, _list_bounds(rows, "ids"), TOKENS_HELD):
            lists = part.column("ids")
            bounds = lists.offsets.to_numpy()
            mask = lists.is_null() if lists.null_count else None
            made = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), numbers.take(lists.flatten()), mask=mask)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], schema.names)

    rows = stored.filter(F.col("word").isNull()).drop("at", "word")
    return _met(rows, found, hold, told, schema)


def capture_errors(decoded: DataFrame) -> DataFrame:
    """A row that failed to decode keeps its ids and its error, and has an empty text."""
    return decoded.withColumn("final_text", F.coalesce("clean_text", F.lit(""))).drop("clean_text")


def words_of(df: DataFrame, text: str, name: str = "word") -> DataFrame:
    """The words between single blanks of ``text``; rows that lie together give each of their words once."""
    most = PART_BYTES

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, lambda b: _text_bounds(b, "text"), most):
            words = _coded(part.column("text"))[0].dictionary
            yield pa.RecordBatch.from_arrays([words.cast(pa.string())], [name])

    schema = T.StructType([T.StructField(name, T.StringType())])
    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def dense_vocabulary(words: DataFrame, word: str, special_every: int) -> DataFrame:
    """Distinct words numbered in word order, as a stored table."""
    # Stored, as a range sort reads its input twice.
    distinct = stage(words.select(word).distinct(), "words")
    numbered = dense_index(distinct, [word], "token_id")
    vocab = numbered.select(
        F.col("token_id").cast("int").alias("token_id"),
        F.col(word).alias("token_text"),
        (F.col("token_id") % special_every == 0).alias("is_special"),
    )
    return stage(vocab, "vocabulary")
