"""Token counts of whole texts by a byte-level vocabulary, merging only what is no whole token.

Before any counting, ``prove_whole_tokens`` has the library encode every string of the vocabulary
and keeps those that come out as the single token they are. While counting, a text is cut at its
ASCII white space into pieces that the vocabulary's pattern can never join: a word with the one
blank before it, or the rest of a gap. Distinct pieces that are proven tokens count 1 by a hash
lookup; the others are cut into pre-tokens by the pattern, and only those that are no proven token
are merged by the library.

A text with a special string, with white space outside ASCII (where the pattern's look-ahead sees
more than the cut does), or with letters beyond the settled ranges is counted by the library whole.

Defined results: null and empty texts have 0 bytes and 0 tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.batches import Texts, coded, lean, segment_sums, spans_array, text_slices, words_of
from evalweave.llm.tokens import REMEMBERED, tokenizer

BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Code points that some engines take for white space and that the cut does not treat as such.
_ODD = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029]
_ODD += [0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD_SPACE = regex.compile("[" + "".join(map(chr, _ODD)) + "]")
#: Ranges whose classes (letter, number, other) all Unicode versions share.
_RANGES = [(0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC)]
_SETTLED = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES) + "]*+")


def prove_whole_tokens(path: str) -> list[str]:
    """Strings of the vocabulary that the library encodes, alone, as their own single id."""
    library = tokenizer(path)
    ids = sorted(library.get_vocab(with_added_tokens=False).values())
    texts = library.decode_batch([[i] for i in ids], skip_special_tokens=False)
    encoded = library.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, i, e in zip(texts, ids, encoded, strict=True) if e.ids == [i]]


class TokenCounter:
    def __init__(self, path: str, proven: list[str]):
        self.library = tokenizer(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.whole = frozenset(proven)
        self.whole_bytes = pa.array([p.encode() for p in proven], pa.large_binary())
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merged: dict[str, int] = {}

    def _merge_counts(self, pieces: list[str]) -> list[int]:
        """Tokens of pieces that are not proven themselves."""
        if len(self.merged) > REMEMBERED:
            self.merged = {}
        whole, merged, cut = self.whole, self.merged, self.pattern.findall
        parts = [cut(p) if p not in merged else None for p in pieces]
        rest = {p for own in parts if own for p in own if p not in whole and p not in merged}
        fresh = list(rest)
        for begin in range(0, len(fresh), 20_000):
            some = fresh[begin : begin + 20_000]
            encoded = self.library.encode_batch_fast(some, add_special_tokens=False)
            merged.update(zip(some, map(len, encoded), strict=True))
        return [
            merged[p] if own is None else sum(1 if q in whole else merged[q] for q in own)
            for p, own in zip(pieces, parts, strict=True)
        ]

    def _piece_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, values = coded(spans_array(data, starts, ends))
        if not len(codes):
            return codes
        counts = np.ones(len(values), np.int64)
        known = pc.is_in(values, value_set=self.whole_bytes).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~known)
        if len(rest):
            others = values.take(pa.array(rest)).cast(pa.large_string()).to_pylist()
            counts[rest] = self._merge_counts(others)
        return counts[codes]

    def count(self, texts: Texts) -> np.ndarray:
        data, starts, ends, first = words_of(texts)
        if not len(data):
            return np.zeros(len(texts.bounds) - 1, np.int64)
        # The gap before a word runs from the word before it, or from the beginning of the text.
        before = np.maximum(np.append(0, ends)[:-1], np.repeat(texts.bounds[:-1], np.diff(first)))
        gap = starts > before
        blank = gap & (data[starts - 1] == 0x20)
        # Its last byte goes to the word if it is a blank, else it is a piece, and a token, by itself.
        total = segment_sums(self._piece_counts(data, starts - blank, ends) + (gap & ~blank), first)
        long = starts - 1 > before
        gaps = np.zeros(len(starts), np.int64)
        gaps[long] = self._piece_counts(data, before[long], starts[long] - 1)
        total += segment_sums(gaps, first)
        last = np.where(np.diff(first) > 0, np.append(ends, 0)[first[1:] - 1], texts.bounds[:-1])
        tail = texts.bounds[1:] > last
        total[tail] += self._piece_counts(data, last[tail], texts.bounds[1:][tail])
        for i, raw in self._unsettled(texts):
            total[i] = len(self.library.encode(raw, add_special_tokens=False))
        return total

    def _unsettled(self, texts: Texts) -> Iterator[tuple[int, str]]:
        """Texts that must not be cut: special strings, odd white space, letters beyond the ranges."""
        data, after = texts.data, np.append(texts.data[1:], 0)
        odd = (data == 0xC2) & ((after == 0x85) | (after == 0xA0))
        rare = (data >= 0xC9) | odd | ((data >= 0x1C) & (data <= 0x1F))
        marks = np.flatnonzero(rare | ((data == ord("<")) & (after == ord("|"))))
        for i in np.unique(np.searchsorted(texts.bounds, marks, side="right") - 1):
            raw = data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()
            special = any(s in raw for s in self.special)
            if special or _ODD_SPACE.search(raw) or not _SETTLED.fullmatch(raw):
                yield int(i), raw


def count_tokens(df: DataFrame, text: str, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``n_bytes`` and ``n_tokens`` of every row.

    The proven strings go to the workers as a broadcast bounded by the vocabulary (50,000 strings).
    """
    proven = df.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))
    kept = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens")]
    out = T.StructType([*kept.schema.fields[:-1], *longs])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, proven.value)
        for part, texts in text_slices(batches, "text"):
            counts = [pa.array(c, pa.int64()) for c in (np.diff(texts.bounds), counter.count(texts))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *counts], names=out.names)

    return kept.mapInArrow(run, out).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
