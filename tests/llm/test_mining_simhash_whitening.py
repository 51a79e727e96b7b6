"""Hard negatives, the SimHash trie join and whitening against brute force on small odd tables."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evalweave.llm import batches, hard_negatives, queries, simhash, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAN, INF = float("nan"), float("inf")
EMBEDDINGS = "vec_id long, embedding array<float>, label int, anchor string, row string, v string, x string, n string"


def embeddings(count: int, dims: int, seed: int = 0) -> list[tuple]:
    """Vectors with ties, repeated rows, a hot label and rows that take no part."""
    picks = np.random.default_rng(seed)
    values = picks.integers(-30, 60, (count, dims)) / 64
    values[count // 3 : count // 2] = values[count // 3]
    values[5] = 0
    labels = np.where(picks.random(count) < 0.4, 3, picks.integers(0, 10, count))
    rows = [(i, [float(c) for c in v], int(y)) for i, (v, y) in enumerate(zip(values, labels, strict=True))]
    rows += [rows[8], rows[100], rows[100], rows[101]]
    bad = [[NAN] * dims, [INF] + [0.0] * (dims - 1), [None] + [1.0] * (dims - 1), None, []]
    rows += [(1000 + 100 * k, b, 3) for k, b in enumerate(bad)]
    rows += [(None, [1.0] * dims, 3), (2000, [1.0] * dims, None)]
    return [(*r, "a", "b", "c", "d", "e") for r in rows]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rows = embeddings(600, 6)
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, EMBEDDINGS).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def whole_rows(rows: list[tuple]) -> list[tuple]:
    fine = [r for r in rows if r[0] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    return [(r[0], np.floor(256 * np.array(r[1])).astype(np.int64), r[2]) for r in fine]


def brute_negatives(rows: list[tuple], positives: int = 5, negatives: int = 10) -> collections.Counter:
    known = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in whole_rows(rows) if y is not None]
    asked = {(i, tuple(v), y): (i, v, y) for i, v, y in known if i % 100 == 0}
    out = collections.Counter()
    for i, v, y in asked.values():
        ranked = sorted((-int(v @ w), j, z) for j, w, z in known if j != i)
        for p, j, _ in [r for r in ranked if r[2] == y][:positives]:
            inside = [r for r in ranked if r[2] != y and 30 * -p <= 100 * -r[0] <= 90 * -p]
            out.update((i, j, rank, r[1], -p, -r[0]) for rank, r in enumerate(inside[:negatives], 1))
    return out


@pytest.mark.parametrize("blocks", [(8192, 4096, 128), (70, 2, 1), (150, 3, 2)])
def test_op11_equals_brute_force(spark, vectors, monkeypatch, blocks):
    for name, size in zip(("DATA_BLOCK", "ANCHOR_BLOCK", "ANCHORS_HELD"), blocks, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    path, rows = vectors
    want = brute_negatives(rows)
    assert collections.Counter(map(tuple, queries.op11_slot_hard_negatives(spark, path).collect())) == want and want


def test_op11_equals_its_sql(spark, vectors):
    path, _ = vectors
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    theirs = con.execute(queries.ORACLES["op11_slot_hard_negatives"])
    heads = [d[0] for d in theirs.description]
    mine = queries.op11_slot_hard_negatives(spark, path)
    assert sorted(map(tuple, mine.select(*heads).collect())) == sorted(theirs.fetchall())


def test_slots_answer_every_window():
    picks = np.random.default_rng(2)
    for _ in range(30):
        scores = picks.integers(-5, 40, (3, 50))
        ids = picks.permutation(50)
        uppers = [sorted(set(picks.integers(0, 40, picks.integers(1, 6)).tolist())) for _ in range(3)]
        lowers = [[u // 3 for u in row] for row in uppers]
        row, slot, column = hard_negatives.best_of_slots(scores, ids, uppers, lowers, 4)
        for r in range(3):
            kept = sorted((-scores[r, c], ids[c]) for c in column[row == r])
            assert len(set(zip(slot[row == r], column[row == r], strict=True))) == len(kept)
            for u, low in zip(uppers[r], lowers[r], strict=True):
                every = sorted((-s, i) for s, i in zip(scores[r], ids, strict=True) if s <= u)[:4]
                assert [k for k in kept if -k[0] <= u][:4] == every or all(-e[0] < low for e in every[len(kept) :])
                assert [k for k in [k for k in kept if -k[0] <= u][:4] if -k[0] >= low] == [e for e in every if -e[0] >= low]


def test_scores_beyond_exact_doubles_are_refused():
    with pytest.raises(ValueError):
        hard_negatives.exact_scores(np.full((1, 2), 2.0**27), np.full((1, 2), 2.0**26))
    with pytest.raises(ValueError):
        hard_negatives.Mining(low=90, high=30)


def spelled_fingerprint(text: str | None) -> int:
    found = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints: list[int], budget: int) -> list[int]:
    """The least place that each place is connected to."""
    root = list(range(len(prints)))
    values = np.array(prints, np.uint64)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= budget):
            low, high = sorted((find(k), find(k + 1 + int(j))))
            root[high] = low
    return [find(k) for k in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    picks = random.Random(5)
    out: list[str | None] = [None, "", " \n\t", "one", "Two words", "TWO WORDS", "é — 漢\x1cx \x0b three"]
    for size in (40, 400, 900):
        base = ["".join(picks.choices("abcdefgh", k=4)) for _ in range(size)]
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3):
            copy = list(base)
            for at in picks.sample(range(size), edits):
                copy[at] = "Changed"
            out.append("\n".join(copy).upper() if edits == 0 else "  ".join(copy))
    out.append("again and " * 40_000)
    out.append(" ".join("".join(picks.choices("abcdef", k=3)) for _ in range(60_000)))
    return out


def test_fingerprints_equal_the_definition(texts):
    hashes, bounds = simhash.shingle_hashes(batches.texts_of(pa.array(texts)), 3)
    got = simhash.majority(hashes, bounds).tolist()
    assert got[:-2] == [spelled_fingerprint(t) for t in texts[:-2]]
    assert got[-1] == spelled_fingerprint(texts[-1])
    assert simhash.majority(*simhash.shingle_hashes(batches.texts_of(pa.array([], pa.string())), 3)).tolist() == []


def test_op12_equals_brute_force(spark, texts, tmp_path):
    schema = "doc_id long, text string, id long, fp string, comp string, x long, node string"
    rows = [(10 + i, t, 1, "a", "b", 2, "c") for i, t in enumerate(texts[:-2])]
    rows += [rows[9], (11, "clashing id of another text", 1, "", "", 2, ""), (None, texts[8], 1, "", "", 2, ""), (None, "of nobody", 1, "", "", 2, "")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [spelled_fingerprint(r[1]) for r in rows]
    group = brute_groups(prints, 3)
    # Rows of one id are one document.
    for k, r in enumerate(rows):
        same = [j for j, s in enumerate(rows) if s[0] == r[0] and r[0] is not None]
        for j in same:
            old, new = max(group[k], group[j]), min(group[k], group[j])
            group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = collections.Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group, strict=True))
    assert collections.Counter(map(tuple, queries.op12_trie_simhash(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize(("node", "direct", "budget"), [(2048, 64, 3), (60, 4, 3), (60, 1, 2), (60, 4, 1), (60, 4, 0)])
def test_the_trie_join_finds_every_component(spark, monkeypatch, node, direct, budget):
    """Random prints, neighbours at 1 to 4 bits across both halves, a dense ball, zero and all ones."""
    for name, value in (("NODE", node), ("DIRECT", direct), ("WALKED", 100), ("STEP", 12)):
        monkeypatch.setattr(simhash, name, value)
    picks = random.Random(9)
    prints = {picks.getrandbits(64) for _ in range(150)} | {0, 1, 3, 7, 15, (1 << 64) - 1, 0xFFFFFFFF, 0xFFFFFFFF << 32}
    for p in list(prints)[:60]:
        for bits in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in picks.sample(range(64), bits)))
    prints |= {0x0123456789ABCDEF ^ sum(1 << b for b in picks.sample(range(64), picks.randint(0, 3))) for _ in range(200)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(s, s) for s in signed], "fp long, comp long")
    comp = {r["fp"]: r["comp"] for r in simhash.connected(points, budget).collect()}
    want = brute_groups(prints, budget)
    assert len(comp) == len(prints)
    assert len(set(zip([comp[s] for s in signed], want, strict=True))) == len(set(want)) == len(set(comp.values()))


def test_a_budget_that_two_halves_cannot_carry_is_refused(spark):
    points = spark.createDataFrame([(k, k) for k in range(5000)], "fp long, comp long")
    with pytest.raises(ValueError):
        simhash.cells(points.withColumnRenamed("fp", "x"), 4, 5000)


def spelled_whitening(rows: list[tuple], most: int):
    """(ids, x, n, deviations, whitened, explained) in plain NumPy."""
    fine = [r for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    x = np.array([np.floor(64 * np.array(r[1])).astype(np.int64) + 1_000_000 for r in fine])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, int((values > values[0] * 1e-12).sum()))
    projected = (x - sums / n) @ vectors[:, :count] / np.sqrt(values[:count])
    return [r[0] for r in fine], n, ((n * x - sums) ** 2).sum(axis=1), projected, values[:count] / values.sum()


@pytest.mark.parametrize("dims", [6, 24])
def test_op13_equals_numpy(spark, tmp_path, dims):
    rows = embeddings(300, dims, seed=4)
    if dims == 24:
        # Columns of very different size, one constant and one the sum of two others.
        scale = np.linspace(0, 3, dims)
        for k, r in enumerate(rows):
            if r[1] and None not in r[1]:
                v = (np.array(r[1]) * 10**scale).tolist()
                v[4], v[5] = 0.5, v[6] + v[7]
                rows[k] = (r[0], v, *r[2:])
    spark.createDataFrame(rows, EMBEDDINGS).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_cholesky_whitening(spark, str(tmp_path)).collect()
    ids, n, deviation, projected, explained = spelled_whitening(rows, 16)
    count = len(explained)
    assert len(got) == len(ids) * count and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, count + 1))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    mine = collections.defaultdict(list)
    for r in got:
        mine[r["vec_id"]].append(r)
    for i, d, p in zip(ids, deviation, projected, strict=True):
        own = [r for r in mine[i] if r["deviation"] == d]
        for c in range(count):
            assert any(r["component"] == c + 1 and abs(abs(r["whitened"]) - abs(p[c])) < 1e-6 for r in own)
    signs = {c: set() for c in range(count)}
    for i, p in zip(ids, projected, strict=True):
        if ids.count(i) == 1:
            for r in mine[i]:
                at = r["component"] - 1
                assert r["explained"] == pytest.approx(explained[at], rel=1e-9)
                if abs(p[at]) > 1e-3:
                    signs[at].add(np.sign(r["whitened"] * p[at]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_odd_tables(spark):
    def run(rows):
        stored, model = whitening.train(spark.createDataFrame(rows, "k long, `x.y` array<long>"), "x.y")
        return whitening.with_components(stored, "k", "x.y", model).collect(), model

    assert run([]) == ([], None)
    assert run([(1, None), (2, []), (3, [1, None])]) == ([], None)
    assert run([(1, [5, 5]), (2, [5, 5])])[1] is None
    found, model = run([(1, [0, 5]), (2, [4, 5]), (3, [4, 5]), (4, [1, 2, 3])])
    assert model.rows == 2 and sorted((r["k"], abs(round(r["whitened"], 9)), r["deviation"]) for r in found) == [(1, 1, 16), (2, 1, 16), (3, 1, 16)]
    with pytest.raises(Exception, match="does not fit a long"):
        run([(1, [0, 1 << 61]), (2, [3, 7])])


def test_triangular_solves_and_shifted_factors():
    picks = np.random.default_rng(3)
    rows = picks.normal(size=(200, 8)) * 10.0 ** np.arange(0, 16, 2)
    gram = rows.T @ rows
    r = whitening.cholesky(gram, 1e-3 * np.linalg.norm(gram, 2))
    assert np.allclose(np.triu(r), r) and np.allclose(whitening.solved([r], rows) @ r, rows)
    assert np.isfinite(whitening.cholesky(np.zeros((3, 3)) + 1.0, 0.0)).all()


def test_new_queries_do_not_move_whole_tables_to_one_task(spark, vectors):
    path, _ = vectors
    for builder in (queries.op11_slot_hard_negatives, queries.op13_cholesky_whitening):
        plan = builder(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
