"""Slices of rows that are handed the entries of a large vocabulary."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalweave.operators import tokens
from evalweave.session import stage


@pytest.fixture
def vocab(spark):
    entries = [(i, f"w{i}", i % 4 == 0) for i in range(40)]
    return stage(spark.createDataFrame(entries, "token_id int, token_text string, is_special boolean"), "vocabulary")


def test_entries_of_a_slice_bring_no_null_lists_to_python(spark, monkeypatch, vocab):
    # Spark writes the offsets of all null lists of a batch again behind every row: the square of their number.
    frame, sent = type(vocab), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *given: sent.append(self) or real(self, *given))
    rows = [((f"r{n}", [n], {"a": n}), [n % 40, 3]) for n in range(20)]
    df = spark.createDataFrame(rows, "k struct<name: string, tags: array<int>, marks: map<string, int>>, ids array<int>")
    found = tokens.token_events(df, ["k"], "ids", vocab, 0)
    assert found.count() == 40
    assert {(r["k"]["name"], *r["k"]["tags"], *r["k"]["marks"].values()) for r in found.collect()} == {(f"r{n}", n, n) for n in range(20)}
    (met,) = [d for d in sent if "turn" in d.columns]
    lists = ("ids", "token_id", "token_text", "is_special", "k", "k.k0", "k.k0.tags", "k.k0.marks")
    assert met.filter(" or ".join(f"{c} is null" for c in lists)).isEmpty()
    # Entries of one slice travel as few rows, of a slice and a task each, instead of a row for every entry.
    asked = met.filter(F.size("token_id") > 0).select("turn", F.size("token_id").alias("n")).collect()
    assert sum(r["n"] for r in asked) > len(asked) and all(r["turn"] % 2 == 0 for r in asked)


def test_packed_entries_keep_slices_nulls_and_order_of_columns(spark):
    entries = [(s << 32, i, None if i == 2 else f"w{i}") for s in (0, 1, 7) for i in range(5)]
    df = spark.createDataFrame(entries, "slice bigint, at int, word string").repartition(2)
    packed = tokens._packed(df)
    assert packed.columns == df.columns and packed.count() <= 6
    again = [(r["slice"], *e) for r in packed.collect() for e in zip(r["at"], r["word"], strict=True)]
    assert sorted(map(str, again)) == sorted(map(str, entries))
    assert tokens._packed(df.filter("slice < 0")).collect() == []


def test_words_are_given_once_by_rows_that_lie_together(spark, monkeypatch):
    texts = ["a b a", "a  b", None, "", " c", "\u00e9\tx \u00e9\tx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "`d.n` int, `t.x` string").coalesce(1)
    words = [r["w"] for r in tokens.words_of(df, "t.x", "w").collect()]
    assert sorted(words) == ["", "a", "b", "c", "\u00e9\tx"]
    monkeypatch.setattr(tokens, "PART_BYTES", 1)
    assert {r["w"] for r in tokens.words_of(df, "t.x", "w").collect()} == set(words)
    vocab = tokens.dense_vocabulary(tokens.words_of(df, "t.x"), "word", 2)
    given = [(r["token_id"], r["token_text"], r["is_special"]) for r in vocab.orderBy("token_id").collect()]
    assert given == [(i, w, i % 2 == 0) for i, w in enumerate(sorted(set(words)))]
