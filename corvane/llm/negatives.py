"""Exact mining of hard negatives with a multiway tree of split points and distance ranges.

The tree is fitted on a bounded sample: a node deals its rows to the nearest of its split points, which makes hyperplanes
between them. Then every row of the table is dealt to its leaf, and each split point stores, for every sibling subtree,
the least and the largest distance from it to the rows there. A search asks for rows whose inner product with an anchor
lies in a window; with the norms in a subtree that is an annulus of distances round the anchor. A subtree goes
when, for any split point, its range can't meet the annulus. The rows of what is left are scored one by one,
so results are those of a full search whatever the tree is like.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import _shared as S
from corvane.llm.whitening import packed_rows, unpack, usual_dims


@dataclass(frozen=True)
class Mining:
    """Parameters. A negative's score lies between low and high percent of the positive's score."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    #: Rows that the tree is fitted on, the first in the order of a hash; so many rows reach the driver at most.
    sample: int = 4096
    fanout: int = 16
    #: A node is split while it holds more rows than this and than one in so many of all rows.
    leaf_rows: int = 2048
    leaves: int = 256
    #: A leaf is dealt to blocks of so many bytes of unpacked vectors; a task holds one block, and anchors in small lots.
    block_bytes: int = 32_000_000
    lot: int = 128


@dataclass
class Tree:
    """points[i] and children[i] of node i: a child is another node, or ~leaf. With ranges, once rows are dealt."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    root: int = ~0
    low: list[np.ndarray] = field(default_factory=list)  # [split point, child]: least distance
    high: list[np.ndarray] = field(default_factory=list)
    norms: list[np.ndarray] = field(default_factory=list)  # [child, least and largest squared norm]
    scale: float = 0.0
    blocks: list[int] = field(default_factory=list)  # of each leaf


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(d, 0))


def grow(sample: np.ndarray, rows: int, p: Mining) -> Tree:
    """Split points are chosen one after another among a few rows of a node, each the farthest from those before."""
    tree = Tree()
    share, most = rows / max(1, len(sample)), max(p.leaf_rows, rows // p.leaves)

    def node(x: np.ndarray, depth: int) -> int:
        if len(x) * share <= most or len(x) < 2 or depth > 64:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        few = np.unique(x[: 3 * p.fanout], axis=0)
        chosen, near = [0], distances(few, few[:1])[:, 0]
        while len(chosen) < p.fanout and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(few, few[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        at = len(tree.points)
        tree.points.append(few[chosen])
        tree.children.append([])
        to = distances(x, few[chosen]).argmin(axis=1)
        children = [node(x[to == k], depth + 1) for k in range(len(chosen))]
        tree.children[at] = children
        return at

    tree.root = node(sample, 0)
    return tree


def route(tree: Tree, x: np.ndarray, seen=None) -> np.ndarray:
    """The leaf of each row of x; seen gets each node, its distances and the child of each row."""
    leaf, todo = np.zeros(len(x), np.int64), [(tree.root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            leaf[rows] = ~node
            continue
        d = distances(x[rows], tree.points[node])
        child = d.argmin(axis=1)
        if seen:
            seen(node, d, child)
        todo.extend((c, rows[child == k]) for k, c in enumerate(tree.children[node]) if (child == k).any())
    return leaf


def reachable(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """For each anchor the leaves that may hold rows whose inner product with it is between low and high."""
    out: list[list[int]] = [[] for _ in x]
    own, slack = (x * x).sum(axis=1), 1e-6 * (1 + tree.scale)
    todo = [(tree.root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            for r in rows:
                out[r].append(~node)
            continue
        d = distances(x[rows], tree.points[node])
        norms = tree.norms[node]
        outer = np.sqrt(np.maximum(own[rows, None] + norms[:, 1] - 2 * low[rows, None], 0)) + slack  # [anchor, child]
        inner = np.sqrt(np.maximum(own[rows, None] + norms[:, 0] - 2 * high[rows, None], 0)) - slack
        near, far = tree.low[node][None], tree.high[node][None]  # [1, split point, child]
        meets = (d[:, :, None] - outer[:, None] <= far) & (d[:, :, None] + outer[:, None] >= near) & (d[:, :, None] + far >= inner[:, None])
        alive = meets.all(axis=1) & (own[rows, None] + norms[:, 1] - 2 * low[rows, None] >= -slack * (1 + tree.scale)) & (norms[:, 0] <= norms[:, 1])
        todo.extend((c, rows[alive[:, k]]) for k, c in enumerate(tree.children[node]) if alive[:, k].any())
    return out


_ROUTED = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])


def _routed(tree: Tree, dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                leaf = route(tree, unpack(t.column(2).to_pylist(), dims).astype(float))
                yield S.batch(_ROUTED.names, [leaf, *t.columns], _ROUTED)

    return run


_SEEN = pa.schema([("slot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())])


def _ranges(tree: Tree, dims: int):
    """What a task saw: for each node, split point and child the range of distances; for each leaf the squared norms and the rows."""
    base = np.cumsum([0, *(len(c) ** 2 for c in tree.children)])

    def run(batches):
        low, high = np.full(base[-1] + tree.leaves, np.inf), np.full(base[-1] + tree.leaves, -np.inf)
        count = np.zeros(len(low), np.int64)

        def seen(node, d, child):
            m = d.shape[1]
            for k in np.unique(child):
                at, part = base[node] + np.arange(m) * m + k, d[child == k]
                low[at], high[at] = np.minimum(low[at], part.min(axis=0)), np.maximum(high[at], part.max(axis=0))

        for t in batches:
            if t.num_rows:
                x = unpack(t.column(0).to_pylist(), dims).astype(float)
                leaf, norm = base[-1] + route(tree, x, seen), (x * x).sum(axis=1)
                np.minimum.at(low, leaf, norm)
                np.maximum.at(high, leaf, norm)
                np.add.at(count, leaf, 1)
        used = np.flatnonzero(low <= high)
        yield S.batch(_SEEN.names, [used, low[used], high[used], count[used]], _SEEN)

    return run


def fit_tree(rows: DataFrame, dims: int, p: Mining) -> tuple[Tree, DataFrame]:
    """The tree with its ranges over all rows (vec_id, label, x), and rows with their leaf, stored."""
    n = rows.count()
    first = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(p.sample).select("x").collect()
    tree = grow(unpack([r["x"] for r in first], dims).astype(float), n, p)
    routed = S.materialise(rows.mapInArrow(_routed(tree, dims), "leaf int, vec_id long, label long, x binary"), "leaves")
    seen = routed.select("x").mapInArrow(_ranges(tree, dims), "slot int, low double, high double, n long")
    got = {r["slot"]: r for r in seen.groupBy("slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()}  # a row for each range of the tree
    value = lambda slot, k, none: got[slot][k] if slot in got else none
    base = np.cumsum([0, *(len(c) ** 2 for c in tree.children)])
    for node, c in enumerate(tree.children):
        m = len(c)
        tree.low.append(np.array([value(s, "low", np.inf) for s in range(base[node], base[node + 1])]).reshape(m, m))
        tree.high.append(np.array([value(s, "high", -np.inf) for s in range(base[node], base[node + 1])]).reshape(m, m))
    leaf_norms = [(value(base[-1] + i, "low", np.inf), value(base[-1] + i, "high", -np.inf)) for i in range(tree.leaves)]

    def norms(node: int) -> tuple[float, float]:
        if node < 0:
            return leaf_norms[~node]
        each = [norms(c) for c in tree.children[node]]
        tree.norms[node] = np.array(each)
        return min(a for a, _ in each), max(b for _, b in each)

    tree.norms = [np.zeros((0, 2))] * len(tree.children)
    tree.scale = float(np.sqrt(max(0.0, norms(tree.root)[1])))
    per_block = max(64, p.block_bytes // (8 * dims))
    tree.blocks = [-(-value(base[-1] + i, "n", 0) // per_block) for i in range(tree.leaves)]
    return tree, routed


_UNIT = pa.schema([("leaf", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("bounds", pa.list_(pa.int64()))])
_UNIT_DDL = "leaf int, block int, kind int, vec_id long, label long, x binary, bounds array<long>"


def _visits(tree: Tree, dims: int, p: Mining, own: bool, annulus: bool):
    """Anchors (leaf, vec_id, label, x, bounds) -> one row for each block that the anchor must visit.

    own: the blocks of its leaf. Otherwise the leaves in reach: with annulus those of scores from low percent of the least
    bound to high percent of the largest, else those of scores from the bound up, without its own leaf.
    """

    def run(batches):
        for t in batches:
            leaf, bounds = t.column(0).to_pylist(), t.column(4).to_pylist()
            if own:
                reach = [[i] for i in leaf]
            else:
                x = unpack(t.column(3).to_pylist(), dims).astype(float) if t.num_rows else np.zeros((0, dims))
                share = p.low / 100 if annulus else 1.0
                low = np.array([share * min(b) if b else -np.inf for b in bounds], float)
                high = np.array([p.high / 100 * max(b) if annulus and p.high * max(b) < 100 * _LONG else np.inf for b in bounds], float)
                reach = reachable(tree, x, low, high)
            pairs = [(row, i, k) for row, leaves in enumerate(reach) for i in leaves if annulus or own or i != leaf[row] for k in range(tree.blocks[i])]
            for at in range(0, len(pairs), 5000):
                part = pairs[at : at + 5000]
                rows = pa.array([r for r, _, _ in part], pa.int64())
                yield S.batch(_UNIT.names, [[i for _, i, _ in part], [k for _, _, k in part], [1] * len(part), *(t.column(c).take(rows) for c in range(1, 5))], _UNIT)

    return run


_LONG = 2**63 - 1


def inner(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay below 2^53, else in whole numbers of any size, cut to the range of a long."""
    if a.shape[1] * max(1.0, np.abs(a.astype(float)).max(initial=0)) * max(1.0, np.abs(x.astype(float)).max(initial=0)) < 2.0**53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ x.astype(object).T, -_LONG, _LONG).astype(np.int64)


def best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows (places in the order of ids) the k with the highest scores, ties by place."""
    s = scores[rows]
    if len(rows) > 4 * k:
        rows = rows[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[rows]
    return rows[np.argsort(-s, kind="stable")[:k]]


_HIT = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("at", pa.int32()), ("other", pa.int64()), ("score", pa.int64())])
_HIT_DDL = "anchor_id long, anchor_key long, at int, other long, score long"


def _scored(dims: int, p: Mining, annulus: bool):
    """Units sorted by leaf, block, kind and id: the rows of a block, then the anchors that visit it -> the block's best rows for each."""

    def run(batches):
        key, ids, labels, packed, x, lot, out = None, [], [], [], None, [], []

        def flush():
            nonlocal x, ids, labels
            if x is None:
                x, ids, labels = unpack(packed, dims), np.array(ids, np.int64), np.array(labels, np.int64)
            scores = inner(unpack([a[2] for a in lot], dims), x)
            for (vec_id, label, _, bounds, anchor_key), s in zip(lot, scores, strict=True):
                if not annulus:
                    rows = np.flatnonzero((labels == label) & (ids != vec_id) & (s >= bounds[0] if bounds else True))
                    found = [(0, best(s, rows, p.positives))]
                else:
                    hundred = (s if np.abs(s).max(initial=0) < 2**55 else s.astype(object)) * 100
                    rows = np.flatnonzero((labels != label) & (hundred >= p.low * min(bounds)) & (hundred <= p.high * max(bounds)))
                    found = [(at, best(s, rows[(hundred[rows] >= p.low * b) & (hundred[rows] <= p.high * b)], p.negatives)) for at, b in enumerate(bounds, 1)]
                out.extend((vec_id, anchor_key, at, int(ids[r]), int(s[r])) for at, rows in found for r in rows)
            lot.clear()

        for t in batches:
            for leaf, block, kind, vec_id, label, v, bounds, anchor_key in zip(*(c.to_pylist() for c in t.columns), strict=True):
                if (leaf, block) != key:
                    if lot:
                        flush()
                    key, ids, labels, packed, x = (leaf, block), [], [], [], None
                if kind == 0:
                    if not ids or (ids[-1], labels[-1], packed[-1]) != (vec_id, label, v):  # repeated rows stand together
                        ids.append(vec_id)
                        labels.append(label)
                        packed.append(v)
                elif len(ids):
                    lot.append((vec_id, label, v, bounds, anchor_key))
                    if len(lot) == p.lot:
                        flush()
            if len(out) > 10_000:
                yield S.batch(_HIT.names, list(zip(*out, strict=True)), _HIT)
                out = []
        if lot:
            flush()
        if out:
            yield S.batch(_HIT.names, list(zip(*out, strict=True)), _HIT)

    return run


def _search(routed: DataFrame, anchors: DataFrame, tree: Tree, dims: int, p: Mining, own: bool = False, annulus: bool = False) -> DataFrame:
    blocks = F.broadcast(routed.sparkSession.createDataFrame(list(enumerate(tree.blocks)), "leaf int, blocks int"))  # a row for each leaf
    rows = routed.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "x", F.lit(None).cast("array<long>").alias("bounds"))
    visits = anchors.select("leaf", "vec_id", "label", "x", "bounds").mapInArrow(_visits(tree, dims, p, own, annulus), _UNIT_DDL)
    units = rows.unionByName(visits).withColumn("anchor_key", _anchor_key()).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "vec_id", "label", "x")
    return units.mapInArrow(_scored(dims, p, annulus), _HIT_DDL)


def _anchor_key():
    return F.xxhash64("label", "x")


def _top(hits: DataFrame, k: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "other")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, params: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: a row for each hard negative of each anchor and positive.

    Anchors are rows whose id is divisible by `every`. Scores are inner products of entries times 256, rounded down. An
    anchor's positives are the best other rows of its label, ties by id; a positive's negatives the best rows of
    other labels whose score lies in the window below the positive's, ranked from 1. Positives with fewer
    negatives have fewer rows, those without any have none.

    Rows with a null id, label or vector, an entry that is null or isn't finite, an empty vector or a number of entries that isn't the most
    frequent one take no part. Equal rows count once; rows that share an id but differ are rows of their own, but none is
    a positive of an anchor of its id. Scores beyond a long become the nearest long. Further columns aren't read; an empty table gives
    an empty result. Anchors and rows meet by leaf: a leaf of many rows, even equal ones, is dealt to blocks, and anchors pass through a block in lots.
    """
    p, spark = params, table.sparkSession
    S.prepare(spark)
    rows = S.materialise(packed_rows(table, id_col, vector_col, label_col).filter("vec_id is not null and label is not null"), "vectors")
    if (dims := usual_dims(rows)) is None:
        return S.empty(spark, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    tree, routed = fit_tree(rows.filter(F.col("dims") == dims).select("vec_id", "label", "x"), dims, p)
    anchors = S.materialise(routed.filter(F.col("vec_id") % every == 0).distinct().withColumn("anchor_key", _anchor_key()), "anchors")
    key = ["anchor_id", "anchor_key"]

    near = S.materialise(_search(routed, anchors.withColumn("bounds", F.lit(None).cast("array<long>")), tree, dims, p, own=True), "near")
    bound = _top(near, p.positives, *key).filter(F.col("rank") == p.positives).select(*key, F.array("score").alias("bounds"))
    bounded = anchors.withColumnRenamed("vec_id", "anchor_id").join(bound, key, "left").withColumnRenamed("anchor_id", "vec_id")
    positives = _top(near.unionByName(_search(routed, bounded, tree, dims, p)), p.positives, *key)
    positives = S.materialise(positives.select(*key, F.col("rank").alias("at"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).filter("positive_score >= 0"), "positives")  # below 0 no score is in the window

    windows = positives.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "positive_score"))), lambda s: s["positive_score"]).alias("bounds"))
    hunters = anchors.withColumnRenamed("vec_id", "anchor_id").join(windows, key).withColumnRenamed("anchor_id", "vec_id")
    negatives = _top(_search(routed, hunters, tree, dims, p, annulus=True), p.negatives, *key, "at")
    out = negatives.join(positives, [*key, "at"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
