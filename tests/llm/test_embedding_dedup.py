import math

import numpy as np
import pytest

from quotelake.llm import embedding_dedup
from quotelake.llm.components import Forest
from quotelake.llm.embedding_dedup import Rotation, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, np.float64), lab) for i, v, lab, _ in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    forest, n = Forest(), {i: 0 for i, *_ in rows}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i] += 1
                n[j] += 1
                forest.link(i, j)
    return {i: (n[i], forest.root(i)) for i, *_ in rows}


def clusters(seed, dims=64, groups=12, size=9, spread=0.02):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(size):
            out.append((len(out) * 3 % 1000, (centre + rng.standard_normal(dims) * spread * g).tolist(), int(rng.integers(2)), "x"))
    return out


@pytest.mark.parametrize("block,small", [(1024, 24), (4, 2)])
def test_against_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_dedup, "SMALL_GROUP", small)
    rows = clusters(1)
    rows += [(5000 + i, rows[0][1], rows[0][2], "copy") for i in range(20)]
    rows += [(2000, None, 1, ""), (2001, [], 1, ""), (2002, [0.0] * 64, 1, ""), (2003, [math.nan] * 64, 1, ""), (2004, [None] * 64, 1, "")]
    rows += [(2005, rows[0][1], None, ""), (2006, rows[0][1][:32], rows[0][2], ""), (2007, [math.inf] + [1.0] * 63, 1, ""), (2008, [1e-30] * 64, 1, ""), (2009, [2e-30] * 64, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    want = brute([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], lab, s) for i, v, lab, s in rows])
    assert set(got) == set(want)
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in want) and missed <= 0.01 * sum(n for n, _ in want.values())
    assert got[5001] == want[5001] and got[2008] == (1, 2008) and got[2009] == (1, 2008) and got[2005] == (0, 2005)


def test_null_ids_and_an_empty_table(spark):
    rows = [(None, [1.0, 2.0], 1, ""), (3, [1.0, 2.0], 1, ""), (4, [1.0, 2.0], 1, ""), (4, [1.0, 2.0], 1, "")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal(x.shape) * 0.06
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turn = Rotation(64)
    codes, factor, _ = turn.encode(x)
    off = (turn.signs(codes) * turn.rotate(y)).sum(axis=1) / factor - (x * y).sum(axis=1)
    assert abs(off.mean()) < 0.01
    assert (np.abs(off) <= embedding_dedup.SIGMAS * turn.error(factor)).all()


@pytest.mark.parametrize("cosine", [0.9301, 0.94])
def test_no_pair_above_the_threshold_is_missed(spark, cosine):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine**2) * y
    rows = [(i, v.tolist(), 1, "") for i, v in enumerate(np.concatenate([x, y]))]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.n_links, r.component_id) == (1, r.vec_id % 2000) for r in got) and len(got) == 4000
