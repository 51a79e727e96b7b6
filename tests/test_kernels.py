"""The Arrow kernels over random ragged batches, without Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalweave.functions import vectors

# Few distinct values, so that ties are common.
SCORE = st.sampled_from([-3.0, -1.0, 0.0, 0.25, 0.5, 1.0, 2.0])
ROWS = st.lists(st.lists(SCORE, min_size=1, max_size=9), min_size=1, max_size=12)


def best(row, k):
    return sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]


def soft(row):
    raised = np.exp(np.array(row) - max(row))
    return raised / raised.sum()


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 11), st.integers(0, 3))
def test_logit_columns(rows, k, skip):
    skip = min(skip, len(rows) - 1)
    scores = pa.array(rows, pa.list_(pa.float32()))[skip:]
    rows = rows[skip:]
    chosen = [len(r) // 2 for r in rows]
    p, ids, tops, entropy = vectors.logit_columns(scores, pa.array(chosen, pa.int32()), k)
    assert ids.to_pylist() == [best(r, k) for r in rows]
    for row, at, one, many, h in zip(
        rows, chosen, p.to_pylist(), tops.to_pylist(), entropy.to_pylist(), strict=True
    ):
        want = soft(row)
        assert one == pytest.approx(want[at])
        assert many == pytest.approx([want[i] for i in best(row, k)])
        assert h == pytest.approx(-(want * np.log(want)).sum(), abs=1e-12)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 11))
def test_route_columns(rows, k):
    experts, ids, normal, kept_h, soft_h, kept_m, soft_m = (
        c.to_pylist() for c in vectors.route_columns(pa.array(rows, pa.list_(pa.float64())), k)
    )
    assert experts == [len(r) for r in rows]
    assert ids == [best(r, k) for r in rows]
    assert normal == [min(r) >= 0 and abs(sum(r) - 1) <= 2e-3 for r in rows]
    for at, row in enumerate(rows):
        for p, h, margin in ((np.array(row), kept_h, kept_m), (soft(row), soft_h, soft_m)):
            top = [p[i] for i in ids[at][:2]]
            assert h[at] == pytest.approx(-(np.log(np.maximum(p, 1e-12)) * p).sum())
            assert margin[at] == pytest.approx(top[0] - top[1] if len(top) > 1 else top[0])


def test_blocks_stay_bounded(monkeypatch):
    monkeypatch.setattr(vectors, "_BLOCK_VALUES", 10)
    rows = [[float(i), 1.0, 0.5] for i in range(20)] + [[0.0] * 40]
    blocks = list(vectors._blocks(pa.array(rows)))
    assert all(block.size <= 10 or len(block) == 1 for _, block in blocks)
    assert sorted(int(r) for part, _ in blocks for r in part) == list(range(21))


@pytest.mark.parametrize("chosen", [[None], [-1], [2]])
def test_a_selected_token_must_exist(chosen):
    with pytest.raises(ValueError):
        vectors.logit_columns(pa.array([[0.0, 1.0]]), pa.array(chosen, pa.int32()), 1)
