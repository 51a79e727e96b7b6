"""The training-data operators against brute force, on small tables with nulls, ties and odd columns."""

from __future__ import annotations

import collections
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import check_oracle
import corpus_pipeline
from evalweave.llm import (
    batches,
    boosting,
    components,
    mixing,
    near_dedup,
    packing,
    perfect_hash,
    pii,
    queries,
    repetition,
    sharding,
    token_counts,
    token_store,
    topk,
    toxicity,
)
from evalweave.llm.tokens import WORD_VOCABULARY, WordEncoder, tokenizer, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string"
PARTS = [*"aB.,!'-s2 \n\t<|>", "é", "»", "́", "\x1c", "—", "漢", "\x85", " "]
PARTS += ["<|endoftext|>", "it's", "don't.", " word", "  ", "'ve", "Über", "ñandú"]


def odd_texts(count: int, longest: int = 14) -> list[str]:
    picks = random.Random(7)
    return ["".join(picks.choices(PARTS, k=picks.randint(0, longest))) for _ in range(count)]


def sentence(picks: random.Random, words: int) -> list[str]:
    return ["".join(picks.choices("abcdefgh", k=4)) for _ in range(words)]


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls in every column, empty and long texts, copies and repeated rows."""
    picks = random.Random(3)
    texts: list[str | None] = [None, "", " \n", "one", "Two words", *odd_texts(20)]
    for size in (60, 80, 300):
        base = sentence(picks, size)
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 8):
            copy = list(base)
            for at in picks.sample(range(size), edits):
                copy[at] = "changed"
            texts.append(" ".join(copy).upper() if edits == 0 else " ".join(copy))
    texts.append(" ".join(sentence(picks, 9000)))
    texts.append(" ".join(sentence(picks, 30)) + "\n" + "same line here\n" * 12)
    out = [
        (i, t, None if i % 7 == 0 else "en", [None, "b", "a", "é"][i % 4], None, "x", "y")
        for i, t in enumerate(texts)
    ]
    return [*out, out[30], out[30]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    """A table folder for the registered queries."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def words(text):
    return WORD.findall(text or "")


def library_ids(text):
    return tokenizer(vocabulary_path(WORD_VOCABULARY)).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Tokens


def test_word_encoder_equals_the_library():
    texts = odd_texts(3000)
    ids, bounds = WordEncoder(vocabulary_path(WORD_VOCABULARY)).encode(batches.texts_of(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library_ids(text), repr(text)


def test_words_are_cut_at_signs_as_the_library_cuts():
    latin = [chr(c) for c in range(0xA1, 0x100)]
    signs = [chr(c) for c in range(0x21, 0x7F)]
    others = ["\u0301", "\u0338", "\u0130"]
    texts = [f"a{x}b {x}a{y} a{y}{x} {x}{y}." for x in [*latin, *signs, *others] for y in "éÊ'&s7"]
    picks = random.Random(11)
    texts += ["".join(picks.choices([*latin, *signs, *others, "'s", " "], k=12)) for _ in range(3000)]
    encoder = WordEncoder(vocabulary_path(WORD_VOCABULARY))
    ids, bounds = encoder.encode(batches.texts_of(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library_ids(text), repr(text)


def test_few_words_take_the_library_s_whole_way():
    """Signs beside letters make no new words, and plain letters, capitals too, are merged directly."""
    library = tokenizer(vocabulary_path(WORD_VOCABULARY))
    whole = []

    class Counted:
        model = library.model

        @staticmethod
        def encode(word, **how):
            whole.append(word)
            return library.encode(word, **how)

        @staticmethod
        def encode_batch_fast(words, **how):
            whole.extend(words)
            return library.encode_batch_fast(words, **how)

    encoder = WordEncoder(vocabulary_path(WORD_VOCABULARY))
    encoder.tokenizer = Counted
    text = "wordy Wordy&&& (wordy,%%% été Été. don't"
    ids, _ = encoder.encode(batches.texts_of(pa.array([text])))
    assert ids.tolist() == library_ids(text)
    assert set(encoder.known) == {w.encode() for w in ("wordy", "&&&", "(", ",%%%", "été", "Été", ".", "don't")}
    assert sorted(whole) == sorted(["&&&", "(", ",%%%", ".", "don't"])


def test_token_counts_equal_the_library(folder, spark, rows):
    path = vocabulary_path(token_counts.BYTE_VOCABULARY)
    library = tokenizer(path)
    proven = token_counts.prove_whole_tokens(path)
    assert all(len(library.encode(p, add_special_tokens=False)) == 1 for p in proven[::997])
    texts = odd_texts(3000)
    found = token_counts.TokenCounter(path, proven).count(batches.texts_of(pa.array(texts)))
    assert found.tolist() == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    got = queries.op5_whole_token_counts(spark, folder).collect()
    want = collections.Counter()
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False))
        want[(r[0], len((r[1] or "").encode()), n, n > 1024)] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = token_store.key_hashes(list(range(5000)), 0)
    index = perfect_hash.build(keys)
    assert sorted(perfect_hash.find(index, keys).tolist()) == list(range(5000))
    assert (perfect_hash.find(index, token_store.key_hashes(["x", "y", None], 0)) == -1).all()
    assert len(perfect_hash.find(perfect_hash.build(keys[:0]), keys[:3])) == 3


def test_token_store_round_trip(spark, docs, empty, rows, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(
        docs, "doc_id", "text", path, vocabulary=vocabulary_path(WORD_VOCABULARY), end_id=2, shard_ids=700
    )
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted(r[0] for r in rows)
    want = {r[0]: [*library_ids(r[1]), 2] for r in rows}
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.key]), crc(want[r.key]))
        start += r.n_tokens
    assert token_store.open_store(spark, path).count() > 3
    fetched = token_store.fetch(spark, path, [3, 30, 10_000]).collect()
    assert sorted((r.key, r.ids) for r in fetched) == sorted([(3, want[3]), *[(30, want[30])] * 3])
    none = str(tmp_path / "none")
    token_store.write_store(empty, "doc_id", "text", none, vocabulary=vocabulary_path(WORD_VOCABULARY), end_id=2)
    assert token_store.read_documents(spark, none).count() == 0


# Sharding


def test_shards_follow_weights_and_grow_only_into_the_new_one(spark, empty):
    df = spark.range(20_000).withColumn("kept", F.lit("x"))
    placed = sharding.with_shard(df, "id", [1.0, 2.0, 3.0], grown_by=[1.0])
    shares = {r["shard"]: r["count"] / 20_000 for r in placed.groupBy("shard").count().collect()}
    assert shares == pytest.approx({0: 1 / 6, 1: 2 / 6, 2: 3 / 6}, abs=0.02)
    moved = placed.filter("shard <> grown_shard").groupBy("grown_shard").count().collect()
    assert [r["grown_shard"] for r in moved] == [3] and abs(moved[0]["count"] / 20_000 - 1 / 7) < 0.02
    again = sharding.with_shard(df, "id", [1.0, 2.0, 3.0, 1.0])
    assert again.select("id", "shard").exceptAll(placed.select("id", "grown_shard")).isEmpty()
    hot = spark.range(3000).select(F.lit(None).cast("string").alias("k"))
    slots = sharding.with_slots(sharding.with_shard(hot, "k", [1.0] * 4), "shard").collect()
    assert sorted(r["slot"] for r in slots) == list(range(3000))
    assert sharding.with_slots(sharding.with_shard(empty, "doc_id", [1.0]), "shard").count() == 0
    with pytest.raises(ValueError):
        sharding.with_shard(df, "id", [1.0, 0.0])


def test_op1(spark, folder, rows):
    got = queries.op1_rendezvous_shards(spark, folder).collect()
    raw = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == raw
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


# Near duplicates


def shingles(text, size):
    own = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def brute_components(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(ids[i]), top(ids[j])
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {r[0]: len(s) for r, s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, rows, size, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 3)
    near = near_dedup.Near(words=size, percent=percent)
    got = near_dedup.near_duplicates(docs, "doc_id", "text", near).collect()
    comps, sizes = brute_components(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        own = comps[r["doc_id"]]
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (own, sizes[r["doc_id"]], own == r["doc_id"])
    kept = near_dedup.deduplicate(docs, "doc_id", "text", near)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comps.values()))


def test_dedup_keeps_one_row_whatever_the_ids_hold(spark):
    picks = random.Random(8)
    a, b, c, d = (" ".join(sentence(picks, 60)) for _ in range(4))
    rows = [(None, a), (None, a), (None, a.upper()), (5, b), (5, c), (6, b), (None, c), (7, None), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = near_dedup.deduplicate(df, "doc_id", "text").collect()
    got = collections.Counter((r["doc_id"], r["text"] and r["text"].lower()) for r in kept)
    assert got == {(None, a): 1, (5, b): 1, (5, c): 1, (7, None): 1, (None, d): 1}


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty, "doc_id", "text").count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(29, 3)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == {i: 100 for i in range(100, 141)} | {i: 3 for i in [3, *range(7, 30)]}


# Repetition


def brute_repetition(text, minimum):
    own = words(text)
    n = len(own)
    windows = collections.Counter(tuple(own[i : i + 3]) for i in range(n - 2))
    twice, covered, longest = set(), set(), 0
    for i in range(n - 2):
        if windows[tuple(own[i : i + 3])] > 1:
            twice |= {i, i + 1, i + 2}
    for i in range(n):
        for j in range(n):
            length = 0
            while i != j and max(i, j) + length < n and own[i + length] == own[j + length]:
                length += 1
            if length >= minimum:
                longest = max(longest, length)
                covered |= set(range(i, i + length))
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in repetition.SYMBOLS)
    return [n, sum(map(len, own)), symbols, lines, len(twice), len(covered), longest]


@pytest.mark.parametrize("minimum", [1, 3, 5, 8])
def test_repetition_equals_brute_force(minimum):
    picks = random.Random(minimum)
    texts = [None, "", "  ", "\n\n"] + [
        "".join(picks.choice(["a", "b", "cé"]) + picks.choice([" ", " ", "\n", " # "]) for _ in range(picks.randint(0, 30)))
        for _ in range(150)
    ]
    found = repetition.measure(batches.texts_of(pa.array(texts)), repetition.Rules(repeat_words=minimum))
    for i, text in enumerate(texts):
        assert [found[n][i] for n in repetition.LONGS] == brute_repetition(text, minimum), repr(text)


def test_texts_without_any_repeat():
    for texts in (["one two three four"], ["a b", "a b"], ["x y", "a b a b"], [None], []):
        found = repetition.measure(batches.texts_of(pa.array(texts, pa.string())), repetition.Rules())
        assert [[int(found[n][i]) for n in repetition.LONGS] for i in range(len(texts))] == [brute_repetition(t, 8) for t in texts]


def test_op4_verdicts_and_spans(spark, folder, docs, empty, rows):
    got = {r["doc_id"]: r for r in queries.op4_suffix_repetition(spark, folder).collect()}
    rules = repetition.Rules()
    for r in rows:
        if len(words(r[1])) > 400:
            continue
        n, chars, symbols, lines, twice, covered, longest = brute_repetition(r[1], rules.repeat_words)
        failed = n < 50 or 100 * twice > 50 * n
        own = got[r[0]]
        assert (own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"]) == (n, chars, symbols, lines)
        assert (own["n_repeat_words"], own["base_failed"]) == (twice, failed)
        limits = 100 * covered <= rules.covered_percent * n and longest <= rules.longest_words
        assert own["kept"] == (not failed and limits)
    spans = repetition.with_measures(docs, "text", prefix="q_", spans=True).filter("q_covered_words > 0")
    assert all(sum(s["words"] for s in r["q_spans"]) == r["q_covered_words"] for r in spans.collect())
    assert repetition.with_measures(empty, "text", prefix="q_").count() == 0


# Mixing


def test_op6_targets_and_takes(spark, folder, rows):
    got = queries.op6_exponential_mix(spark, folder).collect()
    assert len(got) == len(rows)
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {n: [1, 2, 3][i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while over := [n for n in free if left * weight[n] / sum(weight[m] for m in free) > 3 * sizes[n] + 1e-9]:
        target |= {n: 3 * sizes[n] for n in over}
        free -= set(over)
        left = sum(sizes.values()) - sum(target.values())
    target |= {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
    source = {r[0]: r[3] for r in rows}
    taken, largest = collections.defaultdict(int), collections.defaultdict(int)
    for r in got:
        name = source[r["doc_id"]]
        assert r["source_size"] == sizes[name] and r["target"] == pytest.approx(target[name])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[name] += r["taken"]
        largest[name] = max(largest[name], r["size"] * sum(x[0] == r["doc_id"] for x in rows))
    for name in names:
        assert abs(taken[name] - target[name]) <= largest[name] / 2 + 1
    again = queries.op6_exponential_mix(spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixing_of_rows_without_ids_and_of_equal_rows(spark, tmp_path):
    """Every id null, and a third of a source one repeated row: targets are met all the same."""
    picks = random.Random(13)
    texts = [" ".join(sentence(picks, picks.randint(5, 40))) for _ in range(300)]
    rows = [(None, t, "en", "ab"[i % 2], None, None, None) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", None, None, None)] * 100
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_exponential_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    taken = collections.defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert len(taken) == 2 and all(abs(n - target) <= 40 for (_, target), n in taken.items())
    again = queries.op6_exponential_mix(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixing_prefers_quality(spark, empty):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 2).alias("good"))
    keyed = mixing.with_keys(df, F.lit(10), F.when(F.col("good") == 1, 3.0).otherwise(1.0), [F.col("doc_id")], 0)
    half = mixing.mix_plan(keyed, "source").withColumn("mix_last_key", F.lit(0.3)).withColumn("mix_epochs", F.lit(0))
    taken = mixing.with_copies(keyed, half, "source").groupBy("good").agg(F.sum("mix_copies").alias("n")).collect()
    by = {r["good"]: r["n"] for r in taken}
    assert by[1] > 1.8 * by[0]
    nothing = mixing.with_keys(empty, F.lit(1), F.lit(1.0), [F.col("doc_id")], 0)
    assert mixing.with_copies(nothing, mixing.mix_plan(nothing, "source"), "source").count() == 0


# Personal data


def test_base_spans_equal_the_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    picks = random.Random(5)
    bits = ["a", "b@", "@", ".", "1", "25", "300", "-", " ", "+1", "(5) ", "4111111111111111", "x.y", "00", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(picks.choices(bits, k=picks.randint(0, 16)))
        want = [("email", m.start(), m.end()) for m in email.finditer(text)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(text) if max(map(int, m.group().split("."))) <= 255]
        for m in card.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = [int(d) for d in digits[::-1]]
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(odd))
            if 14 <= len(digits) <= 19 and total % 10 == 0:
                want.append(("card", m.start(), m.end()))
        want += [
            ("phone", m.start(), m.end()) for m in phone.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15
        ]
        assert sorted(want) == sorted(pii.base_spans(text)), text


def test_detector_adds_looser_forms_and_leaves_prose_alone(spark, empty):
    picks = random.Random(2)
    texts = []
    for i in range(300):
        prose = " ".join(sentence(picks, 12))
        number = f"+1 ({picks.randint(200, 999)}) 555-{picks.randint(1000, 9999)}"
        mail = f"{''.join(picks.choices('abcdef', k=6))}.{i}@mail{i % 9}.example.com"
        address = ".".join(str(picks.randint(1, 255)) for _ in range(4))
        texts.append((i, f"{prose} {[number, mail, address, '4111111111111111'][i % 4]} {prose} in 1999 and 2001"))
    df = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string")
    detector = pii.train(df, "text")
    base, every = detector.find("call (384) 555-4374 now")
    assert base == [] and every == [("phone", 5, 19)]
    assert detector.find("in 1999, 2000 and 2001; version 3")[1] == []
    found = {r["doc_id"]: r for r in pii.with_spans(df, "text", detector, keep=("doc_id",)).collect()}
    assert found[1000]["all_spans"] == [] and len(found) == 302
    assert all(len(found[i]["base_spans"]) == 1 and found[i]["base_spans"][0] in found[i]["all_spans"] for i in range(300))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, "text", detector).collect()}
    assert clean[1000] is None and "[PHONE]" in clean[0] and "555" not in clean[0]
    nothing = pii.train(empty, "text")
    assert nothing.find("mail a@b.example now")[1] == [("email", 5, 16)]


@pytest.fixture(scope="module")
def detector(spark):
    """Trained on strict forms of every kind, as given tables hold them."""
    picks = random.Random(11)
    texts = []
    for i in range(800):
        prose = " ".join(sentence(picks, 12))
        number = f"+1 ({picks.randint(200, 999)}) {picks.randint(200, 999)}-{picks.randint(1000, 9999)}"
        first, last, host = ("".join(picks.choices("abcdef", k=picks.randint(3, 9))) for _ in range(3))
        name = picks.choice([f"{first}.{last}", f"{first}_{i}", f"{first}{last}", first])
        mail = f"{name}@{picks.choice(['', 'mail.'])}{host}.{picks.choice(['com', 'org'])}"
        address = ".".join(str(picks.randint(1, 255)) for _ in range(4))
        digits = "4" + "".join(picks.choices("0123456789", k=14))
        card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        four = " ".join(card[k : k + 4] for k in range(0, 16, 4))
        texts.append((i, f"{prose} {[number, mail, address, card, four, number, mail][i % 7]} {prose} in 1999 and 2001"))
    return pii.train(spark.createDataFrame(texts, "doc_id long, text string"), "text")


BESIDE = {
    "paid 4111 1111 1111 1111 12/25 then": [("card", "4111 1111 1111 1111")],
    "call 555-123-4567 555-987-6543 now": [("phone", "555-123-4567"), ("phone", "555-987-6543")],
    "at Suite 1200 (555) 123-4567 today": [("phone", "(555) 123-4567")],
}


def test_numbers_beside_others_are_proposed_and_found(detector):
    for text, want in BESIDE.items():
        proposed = {(k, text[s:e]) for k, s, e in pii.proposals(text)}
        assert set(want) <= proposed, text
        assert [(k, text[s:e]) for k, s, e in detector.find(text)[1]] == want
    line = "12 " * 30_000
    assert len(pii.proposals(line)) < 10 * 30_000 and pii.proposals("1" * 30_000) == []


def test_long_rows_of_numbers_are_looked_at_whole(detector):
    picks = random.Random(5)
    phones = [f"{picks.randint(200, 999)}-{picks.randint(200, 999)}-{picks.randint(1000, 9999)}" for _ in range(9)]
    text = f"call {' '.join(phones)} now"
    assert [text[s:e] for _, s, e in detector.find(text)[1]] == phones
    # Every run of groups that fits a kind is a candidate, however long the row.
    row = " ".join(str(picks.randint(1, 9999)) for _ in range(5000))
    spans = {(s, e) for parts, _ in pii.every_candidate(row) for k, s, e in parts if k == "phone"}
    groups = [m.span() for m in re.finditer("[0-9]+", row)]
    want = {(groups[i][0], groups[j][1]) for i in range(len(groups)) for j in range(i, min(i + 15, len(groups)))
            if 7 <= sum(e - s for s, e in groups[i : j + 1]) <= 15}
    assert spans == want


def test_written_out_addresses_are_candidates_by_their_own_surroundings(detector):
    written = ["jane.doe at example.com", "jane (AT) example (DOT) com", "JANE.DOE AT EXAMPLE.COM", "j_doe [At] mail.example.org"]
    for form in written:
        for text in (f"Write to {form} today", f"Write to {form} today, not a@b.example"):
            assert ("email", 9, 9 + len(form)) in pii.proposals(text), text
            assert ("email", 9, 9 + len(form)) in detector.find(text)[1], text
    texts = [*written, "Look here. Then go", "a@b", "flat, tent", "at", " at", ""]
    assert pii.suspicious(batches.texts_of(pa.array(texts))).tolist() == [True] * 4 + [False, True] + [False] * 4
    for text in ("Look at this. Then we met at noon.", "It was at home. They left"):
        assert detector.find(text)[1] == []


def test_planted_loose_forms_are_found_and_prose_is_left_alone(detector):
    """Forms that no training text holds as such, among prose with dates, prices and counts."""
    picks = random.Random(21)

    def digits(n):
        return "".join(picks.choices("0123456789", k=n))

    def datum(turn):
        a, b, c = f"{picks.randint(200, 999)}", f"{picks.randint(200, 999)}", digits(4)
        name, host = "".join(picks.choices("abcdef", k=5)), "".join(picks.choices("ghijkl", k=6))
        body = "5" + digits(14)
        card = next(body + x for x in "0123456789" if pii.luhn(body + x))
        four = [card[k : k + 4] for k in range(0, 16, 4)]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", ".".join(four), "/".join(four),
                f"{name} at {host} dot com", f"{name}.x (at) {host} (dot) org", f"{name}_{turn}[at]{host}[dot]net"][turn % 8]

    found = wrong = 0
    count = 240
    for turn in range(count):
        form = datum(turn)
        prose = [" ".join(sentence(picks, 9)) for _ in range(3)]
        noise = picks.choice(["in 1999 and 2001", "for $1,250.75", "pages 12-15", "version 3.11", "12 345 678 rows", "at 10:30"])
        text = f"{prose[0]} {noise} {prose[1]} {form}, {prose[2]}"
        got = [text[s:e] for _, s, e in detector.find(text)[1]]
        found += form in got
        wrong += sum(g != form for g in got)
    assert found >= 0.9 * count, found
    assert wrong <= 0.05 * count, wrong


def test_numbers_cost_little_whatever_their_number(detector):
    picks = random.Random(2)
    line = " ".join(str(picks.randint(1, 9999)) for _ in range(60_000))
    assert pii.proposals(line) == []
    table = "\n".join(" ".join(str(picks.randint(1, 9999)) for _ in range(10)) for _ in range(6000))
    spans = pii.proposals(table)
    assert 0 < len(spans) < len(table) / 8
    plain = "4111 1111 1111 1111 12/25 in a row of 12 34 56"
    for kind, start, end in pii.proposals(plain):
        own = pii.span_features(plain, [(kind, start, end)])[0]
        want = pii.features(kind, *pii._context(plain, start, end))
        assert own.tolist() == [float(v) for v in want], plain[start:end]


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).integers(0, 10, (2000, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 4)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    p = model.probability(x[1500:])
    assert ((p >= 0.5) == (y[1500:] == 1)).mean() > 0.97
    assert 0 < boosting.threshold(p, y[1500:], 0.95) < 1
    assert boosting.threshold(np.array([0.9]), np.array([0.0]), 0.5) == 2.0


# Toxicity


def test_toxicity_on_held_out_rows(spark, empty):
    picks = random.Random(4)
    rows = []
    for i in range(900):
        own = sentence(picks, 60) + (picks.choices(["horrid", "vilest", "scummy"], k=3) if i % 6 == 0 else [])
        picks.shuffle(own)
        rows.append((i, " ".join(own), int(i % 6 == 0)))
    df = spark.createDataFrame([*rows, (2000, None, None), (2001, "", 0)], "doc_id long, text string, toxic int")
    seen = df.filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = toxicity.train(df, seen, "doc_id", "text", "toxic")
    scored = {r["doc_id"]: r["score"] for r in toxicity.with_score(df, "text", model, keep=("doc_id",)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = sum((scored[r[0]] >= 0.5) == bool(r[2]) for r in held)
    assert right / len(held) > 0.97 and len(scored) == 902
    assert scored[2000] == scored[2001] < 0.5
    one = toxicity.train(df, seen.filter("toxic = 0"), "doc_id", "text", "toxic")
    assert toxicity.with_score(df.limit(3), "text", one).filter("score > 0.01").isEmpty()
    labels = empty.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.with_score(empty, "text", toxicity.train(empty, labels, "doc_id", "text", "toxic")).count() == 0


# Packing


def test_first_fit_decreasing_equals_the_plain_loop():
    picks = np.random.default_rng(1)
    for _ in range(50):
        lengths = picks.integers(1, 100, picks.integers(1, 80))
        free: list[int] = []
        want = {}
        for place in np.argsort(-lengths, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= lengths[place]), len(free))
            free += [100] * (at == len(free))
            want[int(place)] = (at, 100 - free[at])
            free[at] -= lengths[place]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


def test_packing_keeps_every_id_once(spark, docs, empty, rows):
    path = vocabulary_path(WORD_VOCABULARY)
    pieces = packing.token_pieces(docs, "doc_id", "text", path, end_id=1, length=256)
    packed = packing.pack(pieces, capacity=256, group_size=20)
    own = collections.defaultdict(list)
    for r in packed.collect():
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
        own[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    repeats = collections.Counter(r[0] for r in rows)
    for key, text in {r[0]: r[1] for r in rows}.items():
        parts = sorted(own[key])[:: repeats[key]]
        assert [i for _, p in parts for i in p] == [*library_ids(text), 1]
    filled = packing.sequences(packed).collect()
    assert all(r["used"] <= 256 and len(r["ids"]) == 4 * r["used"] for r in filled)
    assert sum(r["used"] for r in filled) == sum(len(library_ids(r[1])) + 1 for r in rows)
    none = packing.token_pieces(empty, "doc_id", "text", path, end_id=1, length=256)
    assert packing.pack(none, capacity=256).count() == 0


def test_op9_measures_what_was_packed(spark, folder, rows):
    packed = queries.op9_first_fit_packing(spark, folder)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want = collections.Counter()
    for r in rows:
        ids = [*library_ids(r[1]), 1]
        for at in range(0, len(ids), 2048):
            want[(r[0], at, len(ids[at : at + 2048]), crc(ids[at : at + 2048]), len(ids))] += 1
    got = packed.collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    filled = spark.createDataFrame(
        [(1, 3, np.array([5, 6, 7], "<u4").tobytes(), [(0, 9, 0, 77, 77, 2), (2, 8, 0, 77, 77, 1)])],
        "sequence_id long, used long, ids binary, parts array<struct<offset long, doc_id long, start long, "
        "length long, ids_crc32 long, doc_tokens long>>",
    )
    assert sorted(map(tuple, packing.measured_pieces(filled).collect())) == [
        (8, 0, 1, crc([7]), 1, 1, 2),
        (9, 0, 2, crc([5, 6]), 2, 1, 0),
    ]


def test_op9_places_pieces_as_the_plain_loop_does(spark, folder, monkeypatch):
    monkeypatch.setattr(packing, "GROUPS_A_TASK", 0.5)
    pieces = packing.token_pieces(
        spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", vocabulary_path(WORD_VOCABULARY), end_id=1, length=256
    )
    got = packing.measured_pieces(packing.filled_sequences(pieces, capacity=256, group_size=15)).collect()
    groups = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in got:
        groups[r["sequence_id"] >> 32][r["sequence_id"] & 0xFFFFFFFF].append((r["offset"], r["length"]))
    assert len(groups) > 1
    for bins in groups.values():
        want: list[list[int]] = []
        for size in sorted((n for own in bins.values() for _, n in own), reverse=True):
            fits = next((b for b in want if sum(b) + size <= 256), None)
            want.append([size]) if fits is None else fits.append(size)
        for number, own in bins.items():
            own.sort()
            assert [at for at, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            assert sorted((n for _, n in own), reverse=True) == want[number]
        assert len(bins) == len(want)


def test_pipeline_writes_the_packed_ids(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    filled = corpus_pipeline.pack_sequences(spark, docs, folder).collect()
    got = collections.defaultdict(list)
    for r in filled:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["used"] == sum(p["length"] for p in r["parts"]) <= 2048
        for p in r["parts"]:
            got[p["doc_id"]].append((p["start"], ids[p["offset"] : p["offset"] + p["length"]]))
    repeats = collections.Counter(r[0] for r in rows)
    for r in rows:
        parts = sorted(got[r[0]])[:: repeats[r[0]]]
        assert [i for _, p in parts for i in p] == [*library_ids(r[1]), 1]


def test_op1_shards_by_the_highest_score(spark, folder, rows):
    """The winning shard by the definition, with the hash taken from Spark one shard at a time."""
    ids = sorted({r[0] for r in rows})
    hashed = spark.createDataFrame([(i, s) for i in ids for s in range(17)], "k long, s int")
    whole = F.col("k").cast("string")
    base = F.xxhash64(whole.isNull(), whole)
    hashed = hashed.select("k", "s", F.xxhash64(base, F.lit(0), F.col("s")).alias("h")).collect()
    score = {(r["k"], r["s"]): -1 / np.log((((r["h"] % (1 << 64)) >> 11) + 0.5) / (1 << 53)) for r in hashed}
    for r in queries.op1_rendezvous_shards(spark, folder).collect():
        best = max(range(16), key=lambda s: (score[r["doc_id"], s], -s))
        grown = max(range(17), key=lambda s: (score[r["doc_id"], s], -s))
        assert (r["shard"], r["grown_shard"]) == (best, grown)


# Search


def brute_top_k(vectors, queries_, k):
    for own, q in queries_:
        every = sorted((-int(q @ v), i) for i, v in vectors if i != own)
        yield from ((own, rank, i, -s) for rank, (s, i) in enumerate(every[:k], 1))


@pytest.mark.parametrize("dims", [2, 24])
def test_search_equals_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 300)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    picks = np.random.default_rng(dims)
    values = picks.integers(-40, 40, (900, dims)).astype(float)
    values[100:400] = values[100]
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    odd = [(5000, None), (5001, [1.0, None]), (5050, [float("nan")] * dims), (5002, [float("inf")] * dims), (None, [1.0] * dims), (5100, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<double>")
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, "vec_id", "v", 5).collect()
    asked = [(i, v) for i, v in enumerate(values) if i % 50 == 0]
    assert sorted(map(tuple, got)) == sorted(brute_top_k(list(enumerate(values)), asked, 5))
    assert topk.top_k(df.limit(0), df, "vec_id", "v", 5).count() == 0


def test_op10_leaves_out_what_is_not_finite(spark, tmp_path):
    picks = np.random.default_rng(5)
    values = picks.integers(-40, 40, (200, 6)) / 16
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    nan, inf = float("nan"), float("inf")
    for at, bad in enumerate([[nan] * 6, [inf] * 6, [-inf] * 6, [1.0, nan, 0, 0, 0, 0], [inf, 0, 0, 0, 0, 0]]):
        rows += [(1000 + 50 * at, [float(x) for x in bad]), (1001 + 50 * at, [float(x) for x in bad])]
    rows += [(2000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2050, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op10_cover_tree_search(spark, str(tmp_path)).collect()
    whole = [(i, np.floor(256 * v)) for i, v in enumerate(values)]
    assert sorted(map(tuple, got)) == sorted(brute_top_k(whole, [w for w in whole if w[0] % 50 == 0], 5))


def test_cover_tree_covers():
    points = np.random.default_rng(0).normal(size=(2000, 2))
    open_ = [topk.cover_tree(points, 8)]
    assert open_[0].children
    while open_:
        node = open_.pop()
        assert (np.linalg.norm(points[node.rows] - node.centre, axis=1) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        open_ += node.children


# Pipeline


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), T.StructType(out.schema.fields))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > 0 and sizes[-1] > 0
    assert corpus_pipeline.ORACLE_SQL is None


CLASHES = ("mix_size", "mix_key", "mix_copies", "_copy", "_row", "_chunk", "_best", "_before", "_group", "q_kept", "a.b", "k0", "mix_source")


def test_columns_of_any_name_come_through(spark):
    picks = random.Random(17)
    rows = [(i, " ".join(sentence(picks, 60)), "ab"[i % 2], *[f"{c}-{i}" for c in CLASHES]) for i in range(40)]
    names = ["doc_id", "text", "source", *CLASHES]
    docs = spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in names]))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, "")
        assert out.columns == names, name
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in out.collect() for c in CLASHES), name
    slots = sharding.with_slots(sharding.with_shard(docs, "doc_id", [1.0, 1.0], grown_by=[1.0]), "shard")
    assert slots.columns == [*names, "shard", "grown_shard", "slot"]
    assert all(r[c] == f"{c}-{r['doc_id']}" for r in slots.collect() for c in CLASHES)
    pieces = packing.token_pieces(docs, "doc_id", "text", vocabulary_path(WORD_VOCABULARY), end_id=1, length=64)
    wide = pieces.withColumns({"_row": F.lit("r"), "_group": F.lit("g"), "row": F.lit(1), "a.b": F.lit(2)})
    packed = packing.pack(wide, capacity=64, group_size=7)
    assert packed.columns == [*wide.columns, "sequence_id", "offset"] and packed.filter("_row = 'r' and _group = 'g' and row = 1").count() == wide.count()
    parts = packing.filled_sequences(wide, capacity=64, group_size=7).select(F.explode("parts").alias("p")).collect()
    assert len(parts) == wide.count() and all((r["p"]["_row"], r["p"]["_group"], r["p"]["row"], r["p"]["a.b"]) == ("r", "g", 1, 2) for r in parts)


def test_pipeline_rules_and_dedup_equal_brute_force(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, folder).collect()
    good = [r for r in rows if len(words(r[1])) >= 50 and "same line here" not in r[1]]
    assert sorted(r["doc_id"] for r in kept) == sorted(r[0] for r in good)
    comps, _ = brute_components(good, 5, 80)
    once = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, SCHEMA), folder)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(comps.values()))


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    frame = queries.BUILDERS[name](spark, str(DATA))
    cursor = con.execute(queries.ORACLES[name])
    heads = [(d[0], str(d[1])) for d in cursor.description]
    assert sorted((c, check_oracle.KINDS.get(t, t)) for c, t in frame.dtypes) == sorted(heads)
    theirs = check_oracle.rows_of([h[0] for h in heads], cursor.fetchall())
    assert check_oracle.rows_of(frame.columns, frame.collect()) == theirs and theirs


def test_registered_queries_run_on_an_empty_table(spark, empty, tmp_path):
    path = str(tmp_path)
    empty.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    for name, builder in queries.BUILDERS.items():
        assert builder(spark, path).count() == 0, name
