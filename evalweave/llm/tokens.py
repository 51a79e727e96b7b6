"""Token ids of whole texts by the public tokenizers library, word by word.

The word vocabulary drops white space and never merges across it, so the ids of a text are the ids
of its white-space separated words in turn. Each distinct word of a slice is therefore encoded by
the library once and its ids are dealt out to all places. Three things keep this exact: A-Z is
folded beforehand (the tokenizer folds case anyway), words are cut only where a letter or digit and
an ASCII sign other than the apostrophe meet (where its pattern always cuts too), and a text holding
``<|``, which may start a special token, is given to the library whole.
"""

from __future__ import annotations

import codecs
import functools
import re
import zlib
from itertools import repeat
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow.compute as pc
from tokenizers import Tokenizer

from evalweave.llm.batches import (
    Texts,
    coded,
    offsets_of,
    ragged_index,
    spans_array,
    words_of,
)

WORD_VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 400_000

#: 1 for ASCII letters and digits, 2 for ASCII signs other than the apostrophe, else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[ord("'")] = 0
for _low, _high in (("a", "z"), ("A", "Z"), ("0", "9")):
    _KIND[ord(_low) : ord(_high) + 1] = 1


#: Letters in normal form: a-z, and of Latin-1 U+00C0 to U+00D6, U+00D8 to U+00F6 and U+00F8 to U+00FF.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The second byte of those of Latin-1, after 0xC3.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: The signs by which byte-level vocabularies write the bytes of those letters (fixed values); the
#: capitals of Latin-1 (0x80 to 0x9E) have those of their small letters, 0x20 further on.
_SMALL = [b + 0x20 if 0x80 <= b <= 0x9E else b for b in range(256)]
_BYTE_SIGNS = "".join(chr({0xAD: 0x143}.get(b, b + 0xA2 if 0x7F <= b <= 0xA0 else b)) for b in _SMALL)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


def encode_words(library: Tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all the words, whose A-Z are folded, and how many each has.

    A word of plain letters is one pre-token that the normaliser at most folds, so its merges are
    asked for directly; any other word takes the library's whole way.
    """
    merge, number = library.model.tokenize, attrgetter("id")
    ids: list[int] = []
    sizes: list[int] = []
    signs = codecs.charmap_decode(b"\n".join(words), "strict", _BYTE_SIGNS)[0].split("\n")
    for word, sign in zip(words, signs, strict=True):
        if word.isalpha() or _LETTERS.fullmatch(word):
            own = merge(sign)
            ids.extend(map(number, own))
        else:
            # Not in a batch: for that the library starts a thread for every core of the machine.
            own = library.encode(word.decode(), add_special_tokens=False).ids
            ids += own
        sizes.append(len(own))
    return np.array(ids, np.uint32), np.array(sizes, np.int64)


class WordEncoder:
    """Encodes slices of texts with a word vocabulary, remembering words it has seen."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _look_up(self, values: list[bytes]) -> np.ndarray:
        """The number under which each of these different words is kept, encoding the words met first."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        place = np.fromiter(map(known.get, values, repeat(-1)), np.int64, len(values))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [values[k] for k in new.tolist()]
            ids, sizes = encode_words(self.tokenizer, fresh)
            place[new] = np.arange(len(known), len(known) + len(fresh))
            known.update(zip(fresh, place[new].tolist(), strict=True))
            self.at = np.append(self.at, self.at[-1] + np.cumsum(sizes))
            self.flat = np.append(self.flat, ids)
        return place

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and the bounds of each text's ids."""
        data, starts, ends, begins = words_of(texts, fold_case=True, cuts=self._sign_cuts(texts.data))
        special = self._special(texts)
        codes, values = coded(spans_array(data, starts, ends))
        place = self._look_up(values.to_numpy(zero_copy_only=False).tolist())[codes] if len(codes) else codes
        first = self.at[place]
        sizes = self.at[place + 1] - first
        ids = self.flat[ragged_index(first, sizes)]
        bounds = offsets_of(sizes)[begins]
        return self._with_special(texts, special, ids, bounds) if len(special) else (ids, bounds)

    @staticmethod
    def _sign_cuts(data: np.ndarray) -> np.ndarray:
        """Marks the bytes before which a letter or digit and an ASCII sign other than the apostrophe meet."""
        kind = _KIND[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[latin] = _LATIN[data[latin]]
        marks = np.zeros(len(data) + 1, dtype=bool)
        marks[1:-1] = (kind[:-1] ^ kind[1:]) == 3
        return marks

    @staticmethod
    def _special(texts: Texts) -> np.ndarray:
        marks = np.flatnonzero((texts.data[:-1] == ord("<")) & (texts.data[1:] == ord("|")))
        return np.unique(np.searchsorted(texts.bounds, marks, side="right") - 1)

    def _with_special(self, texts, special, ids, bounds):
        parts, sizes = [], np.diff(bounds)
        at = 0
        for i in special:
            raw = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode()
            own = np.array(self.tokenizer.encode(raw, add_special_tokens=False).ids, np.uint32)
            parts += [ids[at : bounds[i]], own]
            at, sizes[i] = bounds[i + 1], len(own)
        return np.concatenate([*parts, ids[at:]]), offsets_of(sizes)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's."""
    count = len(bounds) - 1
    out = np.full(len(ids) + count, end_id, np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[bounds[1:] + np.arange(count)] = False
    out[keep] = ids
    return out, bounds + np.arange(count + 1)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def has_text(column) -> np.ndarray:
    return pc.is_valid(column).to_numpy(zero_copy_only=False)
