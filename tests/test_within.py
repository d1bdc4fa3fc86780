"""Distances are taken in full only where nothing bounds them."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import blocks as bl
from tidemark.operators import density as de
from tidemark.operators import neighbors as nb


@pytest.mark.parametrize("dim", [1, 5, 64])
@pytest.mark.parametrize("offset, scale", [(0, 1), (1e4, 1), (3, 1e-30), (0, 1e-200), (0, 1e80), (1e9, 1e-3)])
def test_pairs_within_a_limit(dim, offset, scale):
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(90, dim)) * scale + offset * scale, rng.normal(size=(70, dim)) * scale + offset * scale
    b[:20] = a[:20]
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    limit = np.sort(d, axis=1)[:, 3] * (1 + 1e-12)
    limit[:5], limit[5:8] = 0.0, np.inf
    limit[8:10] = -1.0
    mask = rng.random((90, 70)) < 0.5
    for open_ in (None, mask):
        i, j, got = bl.within(a, b, limit, open_)
        want = (d <= limit[:, None]) & (True if open_ is None else open_)
        assert sorted(zip(i.tolist(), j.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(want))))
        assert np.allclose(got, d[i, j], rtol=1e-9, atol=0)


def test_pairs_within_odd_vectors():
    a, b = np.array([[0.0, 1.0], [np.nan, 0.0]]), np.array([[0.0, 1.0], [np.inf, 0.0]])
    assert [x.tolist() for x in bl.within(a, b, np.array([1.0, 1.0]))] == [[0], [0], [0.0]]
    assert [len(x) for x in bl.within(a[:1], a[:1], np.array([0.0]))] == [1, 1, 1]


def packed(name, ids, x):
    return {f"block_{name}": int(ids[0]), f"ids_{name}": ids.astype("int64").tobytes(), f"tags_{name}": np.zeros(len(ids)).tobytes(), f"mat_{name}": x.tobytes()}


def test_later_blocks_take_few_distances(monkeypatch):
    """only the first right block is compared in full; ties go to the lower id."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 40))
    x[900:950] = x[100:150]
    blocks = [np.arange(at, at + 200) for at in range(0, 1200, 200)]
    rows = [packed("a", blocks[0], x[:200]) | packed("b", ids, x[ids]) for ids in blocks]
    full, taken = bl.squared_distances, []
    monkeypatch.setattr(bl, "squared_distances", lambda a, b: taken.append(len(b)) or full(a, b))
    got = pd.concat(nb._nearest_kernel(6, 40, True)(iter([pd.DataFrame([r]) for r in rows])))
    assert taken == [200]
    d = bl.rounded(((x[:200, None] - x[None]) ** 2).sum(2))
    d[np.arange(200), np.arange(200)] = np.inf
    want = np.lexsort((np.broadcast_to(np.arange(1200), d.shape), d), axis=1)[:, :6]
    assert got["dst"].to_numpy().reshape(200, 6).tolist() == want.tolist()
    # what is known before bounds the first block too
    known = np.sort(d[:, 200:400], axis=1)[:, 5]
    taken.clear()
    later = [r | {"known_a": np.arange(200), "reach_a": known} for r in rows[2:]]
    got = pd.concat(nb._nearest_kernel(6, 40, True)(iter([pd.DataFrame([r]) for r in later])))
    found = {(s, t) for s, t in zip(got["src"], got["dst"])}
    assert not taken and {(i, j) for i in range(200) for j in want[i] if j >= 400} <= found


def test_lightest_edges_take_few_distances(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 40))
    ids = np.arange(400)
    monkeypatch.setattr(bl, "squared_distances", lambda a, b: pytest.fail("all distances taken"))
    limit = np.sqrt(((x[:200, None] - x[None, 200:]) ** 2).sum(2).min(1)) + 1e-6
    row = packed("a", ids[:200], x[:200]) | packed("b", ids[200:], x[200:])
    row |= {"comps_a": list(range(200)), "comps_b": list(range(200, 400)), "limits_a": limit, "limits_b": limit}
    got = pd.concat(de._lightest(40)(iter([pd.DataFrame([row])]))).sort_values("comp")
    assert np.allclose(got["weight"], limit - 1e-6, atol=1e-9) and got["comp"].tolist() == list(range(200))
