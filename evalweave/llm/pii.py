"""Personal data: base patterns, and boosted trees over candidates that looser patterns propose.

The base patterns find e-mail addresses, IP addresses, card and phone numbers of strict form, and
those spans always stay. High-recall generators propose overlapping spans besides: addresses with
written-out signs, and every run of whole digit groups with any of the usual separators, each under
every kind it might be. Features describe a candidate's format and its surroundings; boosted trees score it, and a
threshold calibrated for precision on candidates kept from training selects what is added. An added
span never overlaps a base span, nor a better added one.

Training labels come from the corpus: base spans are positive, written also in looser forms (without
the country sign, in parentheses, with other separators, with written-out signs, beside another
number); other proposals, parts of such numbers and broken copies of the base spans are negative. The
sample is bounded by ``sample_texts`` and ``sample_rows``.

Defined results: null text is the empty text; offsets are code points, ends exclusive; without any
candidates nothing is added.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm import boosting
from evalweave.llm.batches import lean, offsets_of, ragged_index, text_slices
from evalweave.session import stage

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base forms. Runs are possessive and begin where a run begins, which finds the
# same spans in linear time.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WINDOW = 256

# Generators: looser forms.
_LOOSE_AT = re.compile(
    r"(?:@|\(at\)|\[at\]|\{at\}| at )"
    r"(?=( ?[a-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[a-z0-9-]{1,63}+)++))",
    re.I | re.A,
)
_WRITTEN_DOT = re.compile(r"[( \[{]dot[) \]}]", re.I)
#: Most characters of the part before the sign.
_LOCAL_MOST = 64
_DIGIT_RUN = re.compile(r"[0-9]++(?:[ ().\-/]{1,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]++")
_GROUP_BEFORE = re.compile(r"([0-9]++)([ ().\-/]{1,2})\(?\Z")
_GROUP_AFTER = re.compile(r"([ ().\-/]{1,2})([0-9]++)")
#: Most digits of a candidate, and candidates that are scored at a time.
_MOST_DIGITS, _SCORED = 19, 20_000
#: Groups of its run that a candidate leaves out at most, those of longer rows come apart; groups of a row
#: that are looked at together, and characters before a candidate.
BESIDE, _ROW, _BEFORE = 6, 4096, 24
_LUHN = np.array([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])
_PROSE = re.compile(r"\b[a-z]{2,9}\b")
_APART = "\n" * 40
_CUES = {
    "email": re.compile(r"mail|contact|write|correo|courriel|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.I),
    "card": re.compile(r"card|visa|credit|payment|tarjeta|carte|karte", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|ruf", re.I),
}


#: Words that stand before "at" in prose (fixed values).
_WORDS = ("us", "look", "met", "is", "was", "live", "looked", "arrive", "works", "online", "available", "stay")


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    sample_texts: int = 40_000
    precision: float = 0.98
    least_threshold: float = 0.9
    seed: int = 0


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def _emails(text: str) -> Iterator[Span]:
    """From sign to sign, so that long runs of letters cost nothing: the local part is read backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            piece = text[max(done, start - _WINDOW) : start]
            kept = len(piece.rstrip(_LOCAL))
            start -= len(piece) - kept
            if kept:
                break
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The strict spans, by start and then kind."""
    spans = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _loose_emails(text: str) -> Iterator[Span]:
    """From sign to sign, whatever else the text holds; the local part is a whole run of its letters."""
    for m in _LOOSE_AT.finditer(text):
        end = m.start()
        end -= text[end - 1 : end] == " "
        piece = text[max(0, end - _LOCAL_MOST - 1) : end]
        size = len(piece) - len(piece.rstrip(_LOCAL))
        if 0 < size <= _LOCAL_MOST:
            yield "email", end - size, m.end(1)


class Numbers:
    """Candidates among the digit groups of a text, and their features, as arrays.

    A run is digit groups with one or two separators between them. Candidates are runs of whole groups
    whose digits fit a kind: any for a phone number, those that pass Luhn's test for a card, four
    parts up to 255 for an address. A datum mostly stands beside few other numbers: such candidates leave at
    most ``BESIDE`` groups of their run out. Those of longer rows (``rows``) are as many as their groups allow
    and come in parts.
    """

    def __init__(self, text: str, least: int = 7):
        self.text = text
        starts, ends, runs = [], [], []
        for n, run in enumerate(_DIGIT_RUN.finditer(text)):
            if run.end() - run.start() >= least:
                for g in _GROUP.finditer(text, run.start(), run.end()):
                    starts.append(g.start())
                    ends.append(g.end())
                    runs.append(n)
        self.starts, self.ends, self.runs = (np.array(x, np.int64) for x in (starts, ends, runs))
        self.sizes = self.ends - self.starts
        self.first = offsets_of(self.sizes)
        if not starts:
            return
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.digits = (self.code[ragged_index(self.starts, self.sizes)] - ord("0")).astype(np.int64)
        place = np.arange(len(self.digits))
        doubled = _LUHN[self.digits]
        self.even = offsets_of(np.where(place % 2 == 0, self.digits, doubled))
        self.odd = offsets_of(np.where(place % 2 == 1, self.digits, doubled))
        self.dots = offsets_of(self.code == ord("."))
        small = (self.sizes <= 3) & (np.add.reduceat(self.digits * 10 ** np.minimum(np.repeat(self.first[1:], self.sizes) - place - 1, 4), self.first[:-1]) <= 255)
        self.octet = offsets_of(small)

    def luhn(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Do the digits of groups i to j pass Luhn's test."""
        begin, end = self.first[i], self.first[j + 1]
        sums = np.where((end - 1) % 2 == 0, self.even[end] - self.even[begin], self.odd[end] - self.odd[begin])
        return sums % 10 == 0

    def spans(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where groups i to j stand in the text, with a bracket and a plus sign before them."""
        start = self.starts[i]
        for sign in "+(":
            start = start - ((start > 0) & (self.code[start - 1] == ord(sign)))
        return start, self.ends[j]

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind, first group, last group) of all candidates that leave few groups out, kinds as numbers."""
        return self._fitting(0, len(self.starts), rows=False)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All other candidates, in parts."""
        if len(self.starts) and np.bincount(self.runs).max() > BESIDE + 1:
            for begin in range(0, len(self.starts), _ROW):
                yield self._fitting(begin, begin + _ROW, rows=True)

    def _fitting(self, begin: int, end: int, *, rows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        count = len(self.starts)
        for width in range(1, min(count, _MOST_DIGITS) + 1):
            i = np.arange(begin, min(end, count - width + 1))
            j = i + width - 1
            i = i[(self.runs[i] == self.runs[j]) & (self.first[j + 1] - self.first[i] <= _MOST_DIGITS)]
            i = i[(self._run_size[i] - width > BESIDE) == rows]
            j = i + width - 1
            digits = self.first[j + 1] - self.first[i]
            start, stop = self.spans(i, j) if len(i) else (none, none)
            phone = (digits >= 7) & (digits <= 15)
            card = (digits >= 13) & (digits <= 19)
            card[card] = self.luhn(i[card], j[card])
            ip = np.zeros(len(i), dtype=bool)
            if width == 4:
                ip = (digits >= 7) & (self.dots[stop] - self.dots[start] == 3) & (self.octet[j + 1] - self.octet[i] == 4)
            for kind, which in (("phone", phone), ("card", card), ("ip", ip)):
                found.append((np.full(int(which.sum()), KINDS.index(kind)), i[which], j[which]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def features(self, kind: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """One row for each candidate: the same measures, in the same order, as ``features``."""
        start, end = self.spans(i, j)
        signs = self._signs

        def held(c: str, low: np.ndarray = start, high: np.ndarray = end) -> np.ndarray:
            return signs[c][high] - signs[c][low]

        groups = j - i + 1
        at = i[:, None] + np.arange(int(groups.max()))
        inside = at <= j[:, None]
        sizes = self.sizes[np.minimum(at, len(self.sizes) - 1)]
        ordered = np.sort(np.where(inside, sizes, 1 << 30), axis=1)
        rows = np.arange(len(i))
        digits = self.first[j + 1] - self.first[i]
        kinds = np.zeros((len(i), 10))
        for d, own in enumerate(self._kinds):
            kinds[:, d] = own[self.first[j + 1]] > own[self.first[i]]
        # What stands before and after, of the same run or any other sign.
        last = len(self.starts) - 1
        left = (i > 0) & (self.runs[np.maximum(i - 1, 0)] == self.runs[i]) & (start > self.ends[np.maximum(i - 1, 0)])
        right = (j < last) & (self.runs[np.minimum(j + 1, last)] == self.runs[j])
        left_end, right_start = self.ends[np.maximum(i - 1, 0)], self.starts[np.minimum(j + 1, last)]
        left_blank = held(" ", np.where(left, left_end, start), start) == start - left_end
        right_blank = held(" ", end, np.where(right, right_start, end)) == right_start - end
        cues = {k: self._cue(k, start) for k in _CUES}
        own_cue, other_cue = np.zeros(len(i), dtype=bool), np.zeros(len(i), dtype=bool)
        for k, hit in cues.items():
            own_cue |= hit & (kind == KINDS.index(k))
            other_cue |= hit & (kind != KINDS.index(k))
        pairs = self._pairs
        zero = np.zeros(len(i))
        columns = [
            *[kind == n for n in range(len(KINDS))],
            digits, zero, held(" "), held("."), held("-"), held("/"), held("(["), zero,
            (digits >= 13) & self.luhn(i, j),
            (groups == 4) & (self.octet[j + 1] - self.octet[i] == 4),
            ordered[rows, groups - 1], ordered[:, 0], groups, self.sizes[i], self.sizes[j], ordered[rows, groups // 2],
            kinds.sum(axis=1), self._word(start - 1), self._word(end), own_cue, other_cue, self.sizes[j],
            np.where(left, self.sizes[np.maximum(i - 1, 0)], 0), np.where(left, left_blank, -1.0),
            np.where(right, self.sizes[np.minimum(j + 1, last)], 0), np.where(right, right_blank, -1.0),
            zero, zero, pairs[np.maximum(end - 1, start)] > pairs[start], zero,
        ]
        return np.stack([np.asarray(c, float) for c in columns], axis=1)

    # What the features count in, worked out once however many candidates a text has.

    @functools.cached_property
    def _run_size(self) -> np.ndarray:
        return np.bincount(self.runs)[self.runs]

    @functools.cached_property
    def _signs(self) -> dict[str, np.ndarray]:
        return {c: offsets_of(np.isin(self.code, [ord(x) for x in c])) for c in (" ", ".", "-", "/", "([")}

    @functools.cached_property
    def _kinds(self) -> list[np.ndarray]:
        return [offsets_of(self.digits == d) for d in range(10)]

    @functools.cached_property
    def _pairs(self) -> np.ndarray:
        joined = ". "
        return offsets_of(np.append((self.code[:-1] == ord(joined[0])) & (self.code[1:] == ord(joined[1])), False))

    @functools.cached_property
    def _cues(self) -> dict[str, np.ndarray]:
        return {k: np.array([m.span() for m in c.finditer(self.text)], np.int64).reshape(-1, 2) for k, c in _CUES.items()}

    def _cue(self, kind: str, start: np.ndarray) -> np.ndarray:
        """Does the kind's cue stand within the characters before each start."""
        spans = self._cues[kind]
        if not len(spans):
            return np.zeros(len(start), dtype=bool)
        at = np.searchsorted(spans[:, 1], start, side="right") - 1
        return (at >= 0) & (spans[np.maximum(at, 0), 0] >= start - _BEFORE)

    def _word(self, at: np.ndarray) -> np.ndarray:
        """Is there a letter, a digit or a sign that ties words at each place."""
        there = (at >= 0) & (at < len(self.code))
        values, which = np.unique(self.code[np.where(there, at, 0)], return_inverse=True)
        flags = np.array([chr(v).isalnum() or chr(v) in "_=#/\"'" for v in values.tolist()], dtype=bool)
        return there & flags[which]


def candidates(text: str) -> Iterator[tuple[list[Span], np.ndarray]]:
    """Spans that may be personal data, overlapping and under several kinds, with their features; in parts.

    Numbers of long rows are not among them; ``every_candidate`` gives those as well.
    """
    return _candidates(text, Numbers(text))


def every_candidate(text: str) -> Iterator[tuple[list[Span], np.ndarray]]:
    """``candidates`` and those of long rows of numbers, of which no more than a part is held."""
    numbers = Numbers(text)
    yield from _candidates(text, numbers)
    for found in numbers.rows():
        yield from _featured(numbers, *found)


def _candidates(text: str, numbers: Numbers) -> Iterator[tuple[list[Span], np.ndarray]]:
    mails = list(_loose_emails(text))
    if mails:
        yield mails, np.array([features(k, *_context(text, s, e)) for k, s, e in mails])
    yield from _featured(numbers, *numbers.candidates())


def _featured(numbers: Numbers, kind: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[list[Span], np.ndarray]]:
    for at in range(0, len(kind), _SCORED):
        part = slice(at, at + _SCORED)
        start, end = numbers.spans(i[part], j[part])
        spans = list(zip([KINDS[k] for k in kind[part]], start.tolist(), end.tolist(), strict=True))
        yield spans, numbers.features(kind[part], i[part], j[part])


def proposals(text: str) -> list[Span]:
    """The spans of all ``candidates``."""
    return [span for spans, _ in candidates(text) for span in spans]


def span_features(text: str, spans: list[Span]) -> np.ndarray:
    """Features of given spans; those of numbers begin and end with a digit group of the text."""
    x = np.zeros((len(spans), len(features("ip", "", "", ""))))
    numbers = Numbers(text, least=1)
    given = [n for n, s in enumerate(spans) if s[0] != "email"]
    for n, (kind, start, end) in enumerate(spans):
        if kind == "email":
            x[n] = features(kind, *_context(text, start, end))
    if given:
        kind = np.array([KINDS.index(spans[n][0]) for n in given])
        i = np.searchsorted(numbers.starts, [spans[n][1] for n in given])
        j = np.searchsorted(numbers.ends, [spans[n][2] for n in given])
        x[given] = numbers.features(kind, i, j)
    return x


def features(kind: str, before: str, span: str, after: str) -> list[float]:
    """Format and surroundings of one span; none of them is the base form itself."""
    digits = _digits(span)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    sizes = [len(g) for g in groups] or [0]
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    local = span[: len(span) - len(span.lstrip(_LOCAL))] if kind == "email" else ""
    left = _GROUP_BEFORE.search(before) if groups else None
    right = _GROUP_AFTER.match(after) if groups else None
    return [
        *[float(kind == k) for k in KINDS],
        len(digits),
        sum(c.isalpha() for c in span),
        span.count(" "),
        span.count("."),
        span.count("-"),
        span.count("/"),
        span.count("(") + span.count("["),
        float("@" in span),
        float(luhn(digits)) if len(digits) >= 13 else 0.0,
        float(octets),
        max(sizes),
        min(sizes),
        len(sizes),
        sizes[0],
        sizes[-1],
        float(sorted(sizes)[len(sizes) // 2]),
        len(set(digits)),
        float(before[-1:].isalnum() or before[-1:] in "_=#/\"'" and before != ""),
        float(after[:1].isalnum() or after[:1] in "_=#/\"'" and after != ""),
        float(any(c.search(before) is not None for k, c in _CUES.items() if k == kind)),
        float(any(c.search(before) is not None for k, c in _CUES.items() if k != kind)),
        float(len(re.split(r"[^A-Za-z0-9]+", span)[-1])),
        float(len(left[1])) if left else 0.0,
        float(left[2].isspace()) if left else -1.0,
        float(len(right[2])) if right else 0.0,
        float(right[1].isspace()) if right else -1.0,
        len(local),
        sum(not c.isalpha() for c in local),
        float(". " in span),
        len(_WRITTEN_DOT.findall(span)) if kind == "email" else 0,
    ]


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - _BEFORE) : start], text[start:end], text[end : end + 8]


def looser_forms(kind: str, span: str) -> list[str]:
    """The same datum in forms that the base patterns miss."""
    if kind == "phone":
        digits = _digits(span)[-10:]
        a, b, c = digits[:3], digits[3:6], digits[6:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"] if len(digits) == 10 else []
    if kind == "card":
        digits = _digits(span)
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(four), "/".join(four)]
    if kind == "email":
        name, _, domain = span.partition("@")
        letters = "".join(c for c in name if c.isalpha()) or "name"
        half = len(letters) // 2
        dotted = f"{letters[:half] or 'a'}.{letters[half:]}"
        forms = []
        for local, host in ((name, domain), (letters, domain), (dotted, ".".join(domain.split(".")[-2:]))):
            spaced, marked = f"{local} at {host.replace('.', ' dot ')}", f"{local} (at) {host.replace('.', ' (dot) ')}"
            forms += [spaced, marked, f"{local}(at){host}", f"{local}[at]{host.replace('.', '[dot]')}"]
            forms += [spaced.upper(), marked.replace("(at)", "(AT)").replace("(dot)", "(DOT)")]
            if not local.isalpha():
                forms += [f"{local} at {host}", f"{local} at {host}".upper(), f"{local} [At] {host}"]
        return forms
    return []


def broken_forms(kind: str, span: str, text: str) -> list[tuple[str, str, str]]:
    """(before, span, after) that look alike and are no personal data; words come from the text."""
    digits = _digits(span)
    if kind == "card":
        other = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [("", other, ""), ("id-", digits[:13], "")]
    if kind == "phone":
        pairs = " ".join(digits[i : i + 2] for i in range(0, len(digits), 2))
        return [("x", digits, "f"), ("", pairs, ""), ("", "/".join([digits[:4], digits[4:8]]), "")]
    if kind == "ip":
        return [("v", span.replace(".", "-"), ""), ("v", span, ""), ("", span, ".7")]
    domain = span.partition("@")[2]
    pick = zlib.crc32(span.encode())
    prose = _PROSE.findall(text, 0, 4096) if pick % 2 else []
    word = prose[pick % len(prose)] if prose else _WORDS[pick % len(_WORDS)]
    site = ".".join(domain.split(".")[-2:])
    return [("", form, "") for form in (f"{word} at this. Then", f"{word} at noon. We", f"{word} at {domain}", f"{word} at {site}")]


def beside_numbers(kind: str, before: str, span: str, after: str) -> list[tuple[str, list[Span]]]:
    """The datum, in some of its forms, beside another number: texts and the spans that are true in them."""
    pick = zlib.crc32(span.encode())
    digits = _digits(span)
    plain = " ".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if kind == "card" else span
    forms = [span, plain, *looser_forms(kind, span)]
    out = []
    for turn in range(3):
        form = forms[(pick + turn) % len(forms)]
        left, right = [
            ("", ""), ("", " 12/25"), ("", f" {form}"), (f"Suite {pick % 1900 + 100} ", ""),
            ("", f" {form}"), ("2024 ", ""), ("", f" {pick % 900 + 100}"), ("No. 7 ", " 2023"),
        ][(pick // 8 + 3 * turn) % 8]
        start = len(before) + len(left)
        true = [(kind, start, start + len(form))]
        if right.endswith(form):
            end = start + len(form) + len(right)
            true.append((kind, end - len(form), end))
        out.append((before + left + form + right + after, true))
    return out


def examples(text: str) -> tuple[list[str], list[int], np.ndarray]:
    """Labelled candidates of one text: kinds, labels, features.

    The proposals of the text itself are right where they are base spans. Each base span is then
    written again, alone between its own surroundings: in looser forms that are right, in broken forms
    that are not, and beside other numbers, where only it is right among all that is proposed.
    """
    base = base_spans(text)
    exact = set(base)
    kinds, labels, rows = [], [], []

    def add(spans: list[Span], x: np.ndarray, right: list[bool]) -> None:
        kinds.extend(k for k, _, _ in spans)
        labels.extend(map(int, right))
        rows.append(x)

    for spans, x in every_candidate(text):
        same = [s in exact for s in spans]
        inside = [any(s < e2 and s2 < e for _, s2, e2 in base) for _, s, e in spans] if base else [False] * len(spans)
        keep = [n for n, (one, two) in enumerate(zip(same, inside, strict=True)) if one or not two]
        add([spans[n] for n in keep], x[keep], [same[n] for n in keep])
    # All rewritten forms in one text, so far apart that none stands in another's surroundings.
    parts, given, right = [], [], []
    proposed: list[tuple[str, list[Span]]] = []
    at = 0

    def write(form: str, spans: list[tuple[Span, bool]]) -> None:
        nonlocal at
        parts.append(form)
        given.extend((k, s + at, e + at) for (k, s, e), _ in spans)
        right.extend(flag for _, flag in spans)
        at += len(form) + len(_APART)

    for kind, start, end in base:
        before, span, after = _context(text, start, end)
        write(before + span + after, [((kind, len(before), len(before) + len(span)), True)])
        for form in looser_forms(kind, span):
            write(before + form + after, [((kind, len(before), len(before) + len(form)), True)])
        for b, form, a in broken_forms(kind, span, text):
            begin = len(before) + len(b)
            write(before + b + form + a + after, [((kind, begin, begin + len(form)), False)])
        if kind in ("card", "phone"):
            proposed += beside_numbers(kind, before, span, after)
    if parts:
        add(given, span_features(_APART.join(parts), given), right)
    for form, true in proposed:
        for spans, x in candidates(form):
            keep = [n for n, (k, _, _) in enumerate(spans) if k != "email"]
            add([spans[n] for n in keep], x[keep], [spans[n] in true for n in keep])
    width = len(features("ip", "", "", ""))
    return kinds, labels, np.concatenate([np.zeros((0, width)), *rows])


@dataclass(frozen=True)
class Detector:
    model: boosting.Boosted
    thresholds: dict[str, float]

    def likely(self, texts: list[str]) -> Iterator[tuple[int, float, Span]]:
        """Proposals that reach their threshold, as (text, score, span); a bounded number is scored at a time."""
        held: list[tuple[int, list[Span], np.ndarray]] = []
        count = 0
        for i, text in enumerate(texts):
            for spans, x in every_candidate(text):
                held.append((i, spans, x))
                count += len(spans)
                if count >= _SCORED:
                    yield from self._scored(held)
                    held, count = [], 0
        yield from self._scored(held)

    def _scored(self, held: list[tuple[int, list[Span], np.ndarray]]) -> Iterator[tuple[int, float, Span]]:
        if not held:
            return
        p = self.model.probability(np.concatenate([x for _, _, x in held]))
        named = [(i, span) for i, spans, _ in held for span in spans]
        limits = np.array([self.thresholds[span[0]] for _, span in named])
        for n in np.flatnonzero(p >= limits).tolist():
            yield named[n][0], float(p[n]), named[n][1]

    def find_all(self, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text, by start and then kind; of equal scores the longer span wins."""
        likely: dict[int, list[tuple[float, Span]]] = {}
        for i, p, span in self.likely(texts):
            likely.setdefault(i, []).append((p, span))
        for i, text in enumerate(texts):
            base = base_spans(text)
            taken, covered = list(base), bytearray(len(text) if i in likely else 0)
            for _, start, end in base if i in likely else ():
                covered[start:end] = b"\1" * (end - start)
            for _, (kind, start, end) in sorted(likely.get(i, ()), key=lambda c: (-c[0], c[1][1] - c[1][2])):
                if not any(covered[start:end]):
                    taken.append((kind, start, end))
                    covered[start:end] = b"\1" * (end - start)
            yield base, sorted(taken, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    def find(self, text: str) -> tuple[list[Span], list[Span]]:
        return next(self.find_all([text]))


_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_OPENS = np.zeros(256, dtype=bool)
_OPENS[[ord(c) for c in "([{ "]] = True
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[[ord(c) for c in ")]} "]] = True


def suspicious(texts) -> np.ndarray:
    """Texts with a digit, an at-sign, or a written-out one between brackets or blanks: all others hold no candidate."""
    data = texts.data
    low = data | 0x20
    written = np.zeros(len(data), dtype=bool)
    written[:-3] = (low[1:-2] == ord("a")) & (low[2:-1] == ord("t")) & _OPENS[data[:-3]] & _CLOSES[data[3:]]
    marks = np.flatnonzero(_DIGIT[data] | (data == ord("@")) | written)
    flags = np.zeros(len(texts.bounds) - 1, dtype=bool)
    flags[np.searchsorted(texts.bounds, marks, side="right") - 1] = True
    return flags


def train(docs: DataFrame, text: str, settings: Settings = Settings()) -> Detector:
    """Fits on at most ``sample_rows`` labelled candidates of about ``sample_texts`` texts drawn by a hash."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    share = min(1.0, settings.sample_texts / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = rows.filter(drawn)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            some = np.flatnonzero(suspicious(texts))
            for own in part.column("text").take(pa.array(some)).to_pylist():
                kinds, labels, x = examples(own)
                offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                columns = [pa.array(kinds, pa.string()), pa.array(labels, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "label", "x"])

    labelled = rows.mapInArrow(run, "kind string, label int, x array<double>")
    order = F.xxhash64("x", "kind", "label")
    # The most frequent kind of example must not crowd out the others.
    share = settings.sample_rows // (2 * len(KINDS))
    ranked = stage(labelled.withColumn("h", order).distinct(), "pii-examples")
    parts = [
        ranked.filter((F.col("kind") == k) & (F.col("label") == y)).orderBy("h").limit(share)
        for k in KINDS
        for y in (0, 1)
    ]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    table = sample.toArrow()
    width = len(features("ip", "", "", ""))
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, width)
    y = table.column("label").to_numpy().astype(float)
    kind = np.array(table.column("kind").to_pylist(), dtype=object)
    aside = table.column("h").to_numpy() % 4 == 0
    model = boosting.fit(x[~aside], y[~aside], trees=200)
    limits = {}
    for k in KINDS:
        own = aside & (kind == k)
        calibrated = boosting.threshold(model.probability(x[own]), y[own], settings.precision)
        limits[k] = max(calibrated, settings.least_threshold)
    return Detector(model, limits)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def with_spans(df: DataFrame, text: str, detector: Detector, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, and ``base_spans`` and ``all_spans`` as arrays of (kind, start, end)."""
    shared = df.sparkSession.sparkContext.broadcast(detector)
    plain = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    added = [T.StructField(n, T.ArrayType(SPAN)) for n in ("base_spans", "all_spans")]
    schema = T.StructType([*plain.schema.fields[:-1], *added])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            some = np.flatnonzero(suspicious(texts))
            own = part.column("text").take(pa.array(some)).to_pylist()
            found = dict(zip(some.tolist(), shared.value.find_all(own), strict=True))
            lists = []
            for which in (0, 1):
                own = [found[i][which] if i in found else [] for i in range(part.num_rows)]
                flat = [dict(zip(("kind", "start", "end"), s, strict=True)) for spans in own for s in spans]
                offsets = pa.array(offsets_of(np.array([len(s) for s in own], np.int64)), pa.int32())
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat, kind)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=schema.names)

    return plain.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one mark of the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str, detector: Detector) -> DataFrame:
    """All columns of ``df``, with personal data in ``text`` replaced; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(detector)
    names = df.columns
    at = names.index(text)
    plain = df.toDF(*[f"k{i}" for i in range(len(names))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, f"k{at}"):
            column = part.column(at)
            some = np.flatnonzero(suspicious(texts)).tolist()
            if some:
                whole = column.to_pylist()
                for i, (_, spans) in zip(some, shared.value.find_all([whole[i] for i in some]), strict=True):
                    whole[i] = redacted(whole[i], spans)
                column = pa.array(whole, column.type)
            yield pa.RecordBatch.from_arrays(
                [column if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names
            )

    return plain.mapInArrow(run, plain.schema).toDF(*names)
