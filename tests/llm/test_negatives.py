"""Hard negatives against a full search in plain Python, on small trees of many leaves."""

import math
import random

import numpy as np
import pytest

from corvane.llm import negatives, queries
from corvane.llm.whitening import packed_rows

ODD = "vec_id long, embedding array<float>, label int, leaf string, x int, bounds string"
SMALL = negatives.Mining(sample=200, fanout=3, leaf_rows=10, leaves=1000, block_bytes=64 * 8 * 6, lot=3)


def plain(rows, every, p=negatives.Mining()):
    good = {(i, lab, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, lab in rows if None not in (i, lab, v) and v and all(c is not None and math.isfinite(c) for c in v)}
    dot = lambda a, b: max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for a, la, va in good:
        if a % every == 0:
            scored = sorted((-dot(va, v), i, lab) for i, lab, v in good)
            for s, i, _ in [x for x in scored if x[2] == la and x[1] != a][: p.positives]:
                fit = [x for x in scored if x[2] != la and p.low * -s <= 100 * -x[0] <= p.high * -s]
                out += [(a, i, r, x[1], -s, -x[0]) for r, x in enumerate(fit[: p.negatives], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "a", 1, "b") for i, v, lab in rows], ODD)


def clustered(n, dims=6, seed=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [c + r.gauss(0, 0.08) for c in centres[r.randrange(9)]], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("p", [SMALL, negatives.Mining()])
def test_full_search(spark, p):
    rows = clustered(500)
    got = negatives.hard_negatives(table(spark, rows).repartition(3), every=10, params=p).collect()
    assert sorted(map(tuple, got)) == plain(rows, 10) and len(got) > 500


def test_ranges_rule_leaves_out(spark):
    rows = table(spark, clustered(500))
    packed = packed_rows(rows, "vec_id", "embedding", "label").select("vec_id", "label", "x")
    tree, routed = negatives.fit_tree(packed, 6, SMALL)
    assert tree.leaves > 20 and sum(tree.blocks) >= tree.leaves and routed.count() == 500
    x = {r.vec_id: (r.leaf, negatives.unpack([r.x], 6)[0].astype(float)) for r in routed.collect()}
    queries_ = np.array([x[i][1] for i in range(0, 500, 10)])
    best = np.array([sorted((float(a @ v) for _, v in x.values()), reverse=True)[:40] for a in queries_])
    for low, high in ((best[:, 9], best[:, 0]), (best[:, 39], best[:, 20])):
        reach = negatives.reachable(tree, queries_, low, high)
        for a, lo, hi, leaves in zip(queries_, low, high, reach, strict=True):
            assert {leaf for leaf, v in x.values() if lo <= a @ v <= hi} <= set(leaves)
        assert sum(map(len, reach)) < 0.5 * len(queries_) * tree.leaves


def test_odd_rows(spark):
    rows = clustered(120)
    hot = rows[7][1]
    rows += [(i, hot, 1) for i in range(1000, 1090)] + [rows[0]] * 40 + [(300, None, 1), (301, [], 1), (302, [None] * 6, 1), (303, [math.nan] * 6, 1), (304, [math.inf] * 6, 1), (305, hot, None), (None, hot, 1)]
    rows += [(310, rows[3][1], 2), (310, rows[4][1], 2), (311, [-0.0] * 6, 0), (320, [-c for c in hot], 1)]
    want = plain(rows, 10)
    for p in (SMALL, negatives.Mining()):
        assert sorted(map(tuple, negatives.hard_negatives(table(spark, [*rows, (400, [9.0] * 3, 1)]), every=10, params=p).collect())) == want
    assert negatives.hard_negatives(table(spark, rows).limit(0)).collect() == []
    large = [(i, [1e9 * (i + 1), -3e8 * i], i % 2) for i in range(12)]
    assert sorted(map(tuple, negatives.hard_negatives(table(spark, large), every=3).collect())) == plain(large, 3)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == plain(rows, 100)
