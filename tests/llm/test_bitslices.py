import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm.bitslices import SlicedBlock, top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int, n int, rank int, score double"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 200), st.integers(1, 9), st.integers(0, 3), st.sampled_from([1, 5, 60]), st.integers(0, 12))
def test_block_equals_sorting(seed, n, d, left_out, k, bits):
    r = np.random.default_rng(seed)
    ids = r.permutation(3 * n)[:n].astype(np.int64)
    x = r.integers(-(1 << bits), 1 << bits, (n, d), endpoint=True)
    q = r.integers(-(1 << bits), 1 << bits, d, endpoint=True)
    block = SlicedBlock(ids, x, left_out)
    got = block.top(int(ids[0]), q, k)
    scores = x @ q
    best = sorted((-int(s), int(i)) for s, i in zip(scores[1:], ids[1:], strict=True))[:k]
    assert list(zip(got[1].tolist(), got[0].tolist(), strict=True)) == [(-s, i) for s, i in best]


def test_sum_slices_is_the_weighted_sum():
    r = np.random.default_rng(1)
    x, q = r.integers(-9, 30, (130, 7)), np.array([3, -4, 0, 1, -1, 17, 8])
    block = SlicedBlock(np.arange(130), x, 0)
    low, width = x.min(axis=0), (1 << block.digits) - 1
    expected = (np.where(q < 0, width - (x - low), x - low) * np.abs(q)).sum(axis=1)
    slices = block.sum_slices(q)
    got = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << p for p, s in enumerate(slices)), np.zeros(130, np.int64))
    assert got.tolist() == expected.tolist()


@pytest.mark.parametrize("block_rows", [40, 10**6])
def test_top_inner_products(spark, block_rows):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a large tie
    rows += [(500, None), (520, [1.0, None] * 4), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (580, []), (600, [1.0, 2.0]),
             (601, [3.0, -1.0]), (620, [1e30, -1e30]), (20, rows[20][1]), (640, [])]
    rows += [(641, rows[9][1])] * 3 + [(660, [2.0 ** 21] * 3), (661, [2.0 ** 21 + 5, 2.0 ** 21, -7.5]), (662, [2.0 ** 21, 2.0 ** 20, 2.0 ** 22]), (663, [1.0, 2.0, 3.0])] + [(664, [2.0 ** 24] * 3)] * 2
    df = spark.createDataFrame([(*x, 1, 1, 1, 1.0) for x in rows], SCHEMA).repartition(5)
    scaled = [(i, tuple(math.floor(64 * float(np.float32(v))) for v in x)) for i, x in rows
              if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    expected = []
    whole = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    for i in sorted({i for i, _ in scaled if i % 20 == 0}):  # all rows of a query's id ask, and every row is found for itself
        best = sorted((-whole(sum(a * b for a, b in zip(x, y, strict=True))), j) for q, x in scaled if q == i for j, y in scaled if len(y) == len(x) and j != i)[:20]
        expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, top_inner_products(df, block_rows=block_rows).collect())) == sorted(expected)


def test_no_vectors(spark):
    assert top_inner_products(spark.createDataFrame([], SCHEMA)).count() == 0
