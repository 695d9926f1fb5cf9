"""Whitening against a dense eigen-decomposition in numpy, and the integer parts against whole numbers."""

import math
import random

import numpy as np
import pytest

from corvane.llm import queries, whitening

ODD = "vec_id long, embedding array<float>, label int, x string, dims string, slot int, n string"


def plain(rows, m=4):
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * np.float64(np.float32(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [(i, sum((n * a - b) ** 2 for a, b in zip(v, sums, strict=True))) for i, v in x]
    centred = np.array(fit, float) - np.array(sums) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    y = (np.array([v for _, v in x], float) - np.array(sums) / n) @ q[:, :m] / np.sqrt(e[:m])
    return n, dev, y, e / e.sum(), [i for i, _ in x]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 1, "z") for i, v in rows], ODD)


def same(got, rows, m=4):
    n, dev, y, share, ids = plain(rows, m)
    assert sorted((r.vec_id is not None, r.vec_id or 0, int(r.deviation)) for r in got if r.component == 1) == sorted((i is not None, i or 0, d) for i, d in dev)
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} <= {got[0].identity_error} and got[0].identity_error < 1e-9
    for c in range(m):
        part = [r for r in got if r.component == c + 1]
        assert len(part) == len(ids) and abs(part[0].explained / share[c] - 1) < 1e-9
        want = sorted(zip([i if i is not None else -1 for i in ids], y[:, c], strict=True))
        have = sorted((r.vec_id if r.vec_id is not None else -1, r.whitened) for r in part)
        flipped = sorted((i, -w) for i, w in have)
        assert any(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-8 for a, b in zip(want, other, strict=True)) for other in (have, flipped))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_whitening(spark, sf).collect()
    same(got, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    assert isinstance(got[0].deviation, int)


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.1 * (k + 1)) for k in range(12)]) for i in range(90)]
    rows += [(None, rows[0][1])] * 40 + [rows[5]] * 3 + [(200, None), (201, []), (202, [None, *rows[1][1][1:]]), (203, [math.nan] * 12), (204, [math.inf] + [0.0] * 11), (205, [-0.0] * 12)]
    same(whitening.whiten(table(spark, rows)).collect(), rows)
    more = [*rows, (300, [0.5] * 3), (301, [0.25] * 13)]  # other lengths aren't the usual one
    same(whitening.whiten(table(spark, more)).collect(), rows)
    assert whitening.whiten(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 4, 8])
def test_few_directions_and_equal_eigenvalues(spark, block):
    p = whitening.Lanczos(block=block)
    unit = lambda k, d=10, by=1.0: [by if i == k else 0.0 for i in range(d)]
    rows = [(k, unit(k, by=3.0 if k % 2 else 1.0)) for k in range(10)] + [(k + 10, unit(k, by=-3.0 if k % 2 else -1.0)) for k in range(10)]  # five equal eigenvalues come first
    got = whitening.whiten(table(spark, rows), params=p).collect()
    assert len(got) == 80 and all(abs(r.explained - 0.18) < 1e-9 and r.identity_error < 1e-9 for r in got)
    two = [(i, [i * 0.25, 1.0, i % 3 * 1.0, 2.0, 0.0, 0.0]) for i in range(9)]
    got = whitening.whiten(table(spark, two), params=p).collect()
    assert {r.component for r in got} == {1, 2}
    same(got, two, 2)
    assert whitening.whiten(table(spark, [(i, [0.5, 1.5]) for i in range(5)]), params=p).collect() == []


def test_large_numbers(spark):
    rows = [(i, [(-1) ** i * 1e12 * i, 3e30 if i == 3 else 1.0 * i]) for i in range(6)]
    got = whitening.whiten(table(spark, rows)).collect()
    x = [whitening.integers(np.array([np.float32(c) for c in v], float)) for _, v in rows]
    sums = [sum(int(v[k]) for v in x) for k in range(2)]
    want = {i: sum((6 * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) if r.deviation is not None else None for r in got} == {i: d if d < 10**38 else None for i, d in want.items()}
    assert max(x[3]) == 2**63 - 1
