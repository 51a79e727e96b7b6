"""Quality rules from a suffix array over words: how much of a text repeats, and how long at a time.

The words of a slice of texts get exact ids; prefix doubling ranks all suffixes, each text apart from
the others, and from one step to the next only suffixes that still tie are sorted again. Neighbours
in suffix order share a prefix whose length (the LCP) a linear scan in text order finds. The
deepest LCP interval that holds a suffix has the larger of the two LCP values beside it: that is the
longest repeated substring beginning there, and maximal repeats are the runs that nothing extends.
Their spans are united; a text fails if the union covers too much of it or one repeat is too long.

Defined results: a null or empty text has zeros everywhere and fails the word minimum; overlapping
occurrences count as repeats; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.batches import Texts, coded, lean, offsets_of, segment_sums, spans_array, text_slices, words_of

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


@dataclass(frozen=True)
class Rules:
    """Words a repeat must have to count; limits on the covered percentage and the longest repeat."""

    repeat_words: int = 8
    covered_percent: int = 40
    longest_words: int = 100


class Suffixes:
    """Ranks of all suffixes of ragged id lists, by doubling the words they are ranked by; lists never mix.

    Of the steps only what is read again is kept: ranks by one and two words, the suffixes still tied
    by two words and by the greatest power of two within ``minimum``, and the final ranks.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, minimum: int):
        count = len(ids)
        self.ids, self.minimum = ids.astype(np.int32), max(minimum, 1)
        self.last = np.repeat(first[1:].astype(np.int32), np.diff(first))
        doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        order = np.lexsort((self.ids, doc)).astype(np.int32) if count > 1 else np.arange(count, dtype=np.int32)
        fresh = np.ones(count, dtype=bool)
        fresh[1:] = (doc[order[1:]] != doc[order[:-1]]) | (self.ids[order[1:]] != self.ids[order[:-1]])
        rank = np.empty(count, np.int32)
        rank[order] = np.flatnonzero(fresh).astype(np.int32)[np.cumsum(fresh) - 1] if count else order
        tied = self._tied(order, fresh)
        self.one, self.two, self.tied_two, self.tied = rank, None, None, None
        step, wanted = 1, 1 << (self.minimum.bit_length() - 1)
        while True:
            if step == 2:
                self.two, self.tied_two = rank, tied
            if step == wanted:
                self.tied = tied
            if not len(tied):
                break
            rank, tied = self._doubled(rank, tied, step)
            step *= 2
        self.rank = rank

    @staticmethod
    def _tied(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Suffixes, in order, that are not alone in their group."""
        alone = fresh & np.append(fresh[1:], True)
        return order[~alone]

    def _doubled(self, old: np.ndarray, tied: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Sort the tied suffixes by their own rank and the rank of what follows ``step`` words on."""
        after = tied + np.int32(step)
        inside = after < self.last[tied]
        second = np.zeros(len(tied), np.int32)
        second[inside] = old[after[inside]] + 1
        del after, inside
        own = old[tied]
        order = np.lexsort((second, own)).astype(np.int32)
        tied, own, second = tied[order], own[order], second[order]
        del order
        group = np.ones(len(tied), dtype=bool)
        group[1:] = own[1:] != own[:-1]
        fresh = group.copy()
        fresh[1:] |= second[1:] != second[:-1]
        del second
        begins = np.flatnonzero(group).astype(np.int32)[np.cumsum(group, dtype=np.int32) - 1]
        parts = np.flatnonzero(fresh).astype(np.int32)[np.cumsum(fresh, dtype=np.int32) - 1]
        rank = old.copy()
        rank[tied] = own + parts - begins
        return rank, self._tied(tied, fresh)

    def common(self, suffixes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with its other one (none where that is -1); suffixes ascend.

        The next suffix of a list shares at most one word less with the one before it in suffix order,
        so the words compared are linear in all (Kasai's scan).
        """
        ids, last = memoryview(self.ids), memoryview(self.last)
        shared = np.zeros(len(suffixes), np.int32)
        held, before = 0, -2
        for at, (i, j) in enumerate(zip(memoryview(suffixes), memoryview(others), strict=True)):
            held = held - 1 if held and i == before + 1 else 0
            before = i
            if j < 0:
                held = 0
                continue
            room = min(last[i] - i, last[j] - j)
            while held < room and ids[i + held] == ids[j + held]:
                held += 1
            shared[at] = held
        return shared

    def longest_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that begin a repeat of at least ``minimum`` words, and its greatest length."""
        if self.tied is None or not len(self.tied):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = self.tied[np.argsort(self.rank[self.tied])]
        before = np.full(len(some), -1, np.int32)
        same = self.last[some[1:]] == self.last[some[:-1]]
        before[1:][same] = some[:-1][same]
        order = np.argsort(some)
        lcp = np.zeros(len(some) + 1, np.int32)
        lcp[order] = self.common(some[order], before[order])
        longest = np.maximum(lcp[:-1], lcp[1:])
        enough = longest >= self.minimum
        return some[enough].astype(np.int64), longest[enough].astype(np.int64)

    def repeated_windows(self) -> np.ndarray:
        """Starts of the three-word windows that occur at least twice in their list."""
        if self.tied_two is None or not len(self.tied_two):
            return np.zeros(0, np.int64)
        pairs = self.tied_two
        pairs = pairs[pairs + 2 < self.last[pairs]]
        if not len(pairs):
            return pairs.astype(np.int64)
        two, third = self.two[pairs], self.one[pairs + 2]
        order = np.lexsort((third, two))
        pairs, two, third = pairs[order], two[order], third[order]
        same = (two[1:] == two[:-1]) & (third[1:] == third[:-1])
        return pairs[np.append(same, False) | np.append(False, same)].astype(np.int64)


def _covered(starts: np.ndarray, lengths: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` words lie in one of the spans."""
    edges = np.bincount(starts, minlength=count + 1) - np.bincount(starts + lengths, minlength=count + 1)
    return np.cumsum(edges[:count]) > 0


def measure(texts: Texts, rules: Rules) -> dict[str, np.ndarray]:
    """The counts and verdicts of every text, and ``spans``: united repeats as (text, word, words)."""
    data, starts, ends, first = words_of(texts)
    n_words = np.diff(first)
    codes, _ = coded(spans_array(data, starts, ends))
    suffixes = Suffixes(codes, first, rules.repeat_words)
    del codes

    ink = np.zeros(len(data) + 1, np.int64)
    ink[starts] += 1
    ink[ends] -= 1
    ink = np.cumsum(ink)[:-1] > 0
    letters = ink & ((data & 0xC0) != 0x80)

    windows = suffixes.repeated_windows()
    in_windows = _covered(windows, np.full(len(windows), 3), first[-1])
    at, longest = suffixes.longest_repeats()
    in_repeats = _covered(at, longest, first[-1])
    del suffixes
    most = np.zeros(len(n_words), np.int64)
    text_of = np.searchsorted(first, at, side="right") - 1
    np.maximum.at(most, text_of, longest)

    repeat_words = segment_sums(in_windows, first)
    covered = segment_sums(in_repeats, first)
    base_failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    too_much = 100 * covered > rules.covered_percent * n_words
    return {
        "n_words": n_words,
        "word_chars": segment_sums(letters, texts.bounds),
        "n_symbols": segment_sums(_SYMBOL[data], texts.bounds),
        "n_dup_lines": _repeated_lines(texts, ink),
        "n_repeat_words": repeat_words,
        "covered_words": covered,
        "longest_repeat": most,
        "base_failed": base_failed,
        "kept": ~(base_failed | too_much | (most > rules.longest_words)),
        "spans": _united(in_repeats, first),
    }


def _repeated_lines(texts: Texts, ink: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    ends = np.sort(np.concatenate([breaks, texts.bounds[1:]]))
    starts = np.sort(np.concatenate([texts.bounds[:-1], breaks + 1]))
    inked = offsets_of(ink)
    filled = inked[ends] > inked[starts]
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(texts.bounds, starts, side="right") - 1
    codes, values = coded(spans_array(texts.data, starts, ends))
    kinds = np.unique(text * max(len(values), 1) + codes) // max(len(values), 1)
    count = len(texts.bounds) - 1
    return np.bincount(text, minlength=count) - np.bincount(kinds, minlength=count)


def _united(covered: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs of covered words as rows of (text, first word in the text, words); runs end with their text."""
    begins, ends = covered.copy(), covered.copy()
    edge = np.zeros(len(covered) + 1, dtype=bool)
    edge[first] = True
    begins[1:] &= ~covered[:-1] | edge[1:-1]
    ends[:-1] &= ~covered[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(first, start, side="right") - 1
    return np.stack([text, start - first[text], end - start], axis=1)


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
FLAGS = ("base_failed", "kept")
SPAN = T.StructType([T.StructField("word", T.LongType()), T.StructField("words", T.LongType())])


def with_measures(
    df: DataFrame, text: str, *, rules: Rules = Rules(), prefix: str = "", spans: bool = False
) -> DataFrame:
    """All columns of ``df`` and the measures, whose names get ``prefix``.

    ``spans`` adds the united repeats as an array of (word, words).
    """
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    text_at = f"k{names.index(text)}"
    added = [T.StructField(prefix + n, T.LongType()) for n in LONGS]
    added += [T.StructField(prefix + n, T.BooleanType()) for n in FLAGS]
    if spans:
        added.append(T.StructField(prefix + "spans", T.ArrayType(SPAN)))
    schema = T.StructType([*plain.schema.fields, *added])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_at):
            found = measure(texts, rules)
            columns = [pa.array(found[n], pa.int64()) for n in LONGS]
            columns += [pa.array(found[n], pa.bool_()) for n in FLAGS]
            if spans:
                text_no, word, size = found["spans"].T
                items = pa.StructArray.from_arrays([pa.array(word), pa.array(size)], names=["word", "words"])
                counts = np.bincount(text_no, minlength=part.num_rows)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), items))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(names)})
