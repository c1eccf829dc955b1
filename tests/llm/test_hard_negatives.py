"""Hard-negative mining against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from shopframe.llm import hard_negatives as hn


def brute(items, is_anchor, n_pos=5, n_neg=3, low=50, high=95):
    """items: (id, label, vector) with one row per id."""
    out = []
    for a, label, v in items:
        if not is_anchor(a):
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(v, w)), i, k == label) for i, k, w in items if i != a and len(w) == len(v))
        )
        for s, p, same in [x for x in scored if x[2]][:n_pos]:
            ps = -s
            hits = [(-t, i) for t, i, k in scored if not k and low * ps <= -100 * t <= high * ps][:n_neg]
            out += [(a, p, r, i, ps, t) for r, (t, i) in enumerate(hits, 1)]
    return sorted(out)


SCHEMA = "id long, label int, vector array<long>, i int, j int, width int, anchor string, x string, key string"


def frame(spark, items):
    return spark.createDataFrame([(*r, 1, 2, 3, "a", "x", "k") for r in items], SCHEMA)


def mine(spark, items, **more):
    return sorted(map(tuple, hn.mine_hard_negatives(frame(spark, items), F.expr("id % 3 = 0"), **more).collect()))


@pytest.mark.parametrize("blocks", [(4096, 2048), (16, 4)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", blocks[1])
    rng = random.Random(4)
    # small whole numbers: many ties, many zero scores; one label holds most rows
    items = [(i - 40, rng.choice([0, 0, 0, 1, 2, 3]), [rng.randint(-2, 3) for _ in range(4)]) for i in range(160)]
    items += [(500 + i, 9, [0, 0, 0, 0]) for i in range(5)] + [(600 + i, 0, [1, 2]) for i in range(6)] + [(700, 77, [3, 3, 3, 3])]
    got = mine(spark, items)
    assert got and got == brute(items, lambda i: i % 3 == 0)


def test_defined_cases(spark):
    sound = [(0, 1, [4]), (1, 1, [4]), (2, 2, [3]), (3, 2, [3]), (4, 2, [2])]
    odd = [(None, 1, [4]), (5, None, [4]), (6, 1, None), (7, 1, [None])]
    want = brute(sound, lambda i: i % 3 == 0)
    assert want == [(0, 1, 1, 2, 16, 12), (0, 1, 2, 3, 16, 12), (0, 1, 3, 4, 16, 8)]
    assert mine(spark, sound + odd + sound[:3]) == want  # repeated rows count once
    assert mine(spark, [*sound, (4, 9, [4])]) == want  # of one id the smallest label counts
    assert mine(spark, []) == []
    with pytest.raises(ValueError):
        mine(spark, sound, high=100)


def test_products_are_exact():
    big = np.array([[1 << 40, 3], [-(1 << 30), 5]], dtype=np.int64)
    small = np.array([[1 << 20, 1], [7, 1 << 35]], dtype=np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in small] for a in big]
    assert hn._products(big, small).tolist() == want
    with pytest.raises(OverflowError):
        hn._products(np.array([[1 << 62]]), np.array([[4]]))


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.tuples(*[st.integers(-(2**63), 2**63 - 1)] * 3), min_size=1, max_size=20))
def test_keys_sort(rows):
    keys = [hn.key_of(*r) for r in rows]
    assert [hn.read_key(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    made = [k for a, s, i in rows for k in hn._keys(a, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64))]
    assert made == keys
