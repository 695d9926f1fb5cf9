"""Repeated passages by merging Burrows-Wheeler transforms.

A byte goes when a string of `length` bytes over it starts anywhere else too. Only a small part of a corpus can
hold such strings, so first a fixed rule picks anchors: in every `length` bytes the gram with the least hash. Equal
strings have equal anchors at equal places, hence a string whose anchor is unique is unique. The strings with one
anchor cover a segment; equal segments count as one with a multiplicity. An anchor with one segment is settled by that.
What is left - the ends of passages, whose surroundings differ - is gathered by ranges of anchors. In each range every
shard of texts has a Burrows-Wheeler transform of its own; its symbols are blocks of bytes, so that strings of
`length` bytes are a few symbols long. Transforms are merged two by two, round after round, by refining their interleaving,
one symbol a step, without sorting suffixes again. The step at which two neighbours of the merged order part is their common
prefix; intervals whose common prefixes reach `length` bytes are the repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import _shared as S


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    #: Bytes of an anchor; up to length - gram + 1 strings can share one.
    gram: int = 64
    #: Bytes of a symbol of the transforms; divides length.
    block: int = 25
    #: Rows of the transforms of a range of anchors; a single anchor's segments may be more.
    rows: int = 60_000
    #: Shards of texts, each with a transform of its own in a range of anchors.
    shards: int = 8
    #: String starts of a run; a text is taken in runs.
    run: int = 1 << 19
    #: Anchors with more different segments than this are dealt out string by string.
    group: int = 2048


#: Tasks that the places of a frequent segment are dealt to.
_SALTS = 16

_TABLE = S.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash gives the hash of any span."""
    up, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return S.mix((sums[stop] - sums[start]) * down[start])


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least value of every w consecutive ones: blocks of w, with running minima from either end."""
    n = len(h) - w + 1
    full = np.concatenate([h, np.full(-len(h) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, hash, seg) of each anchor of a run of at most 2**20 bytes.

    place: where its gram starts; of every string that starts at first..last it is the anchor: the gram with the least
    hash, of equal ones the leftmost. hash: of the gram; seg: of the bytes that these strings cover.
    """
    n = len(data) - p.length + 1
    sums = prefix_sums(data)
    grams = np.arange(len(data) - p.gram + 1)
    h = span_hash(sums, grams, grams + p.gram)
    low = np.uint64((1 << 20) - 1)
    least = _window_least((h & ~low) | grams.astype(np.uint64), p.length - p.gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    place = (least[first] & low).astype(np.int64)
    return place, first, last, h[place], span_hash(sums, first, last + p.length) ^ np.uint64(1)


def text_anchors(data: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash, seg) of all anchors of a text, in order."""
    found = []
    for at in range(0, len(data) - p.length + 1, p.run):
        _, first, last, h, seg = anchors(data[at : at + p.run + p.length - 1], p)
        found.append((first + at, last + at, h, seg))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Transform:
    """A Burrows-Wheeler transform of block sequences: the symbol before each row, and each row's place, in sorted order."""

    before: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, after: np.ndarray, prior: np.ndarray, rows: np.ndarray, depth: int) -> Transform:
        """Sorts rows by their first depth symbols: from the last symbol to the first, each a stable sort."""
        keys, at = [], rows
        for _ in range(depth):
            keys.append(names[at])
            at = after[at]
        order = np.arange(len(rows))
        for k in reversed(keys):
            order = order[np.argsort(k[order], kind="stable")]
        place = rows[order]
        return cls(names[prior[place]], place)

    def merge(self, other: Transform, depth: int) -> tuple[Transform, np.ndarray]:
        """The transform of both collections, and how many symbols, up to depth, each of its rows shares with the row before.

        `second` says which side each row comes from. If it is right for orders by h symbols, a stable sort by the
        symbols before the rows makes it right for h + 1. Where neighbours part at that step they share h symbols; the place where
        they part stays where it is in all later steps.
        """
        n = len(self.place) + len(other.place)
        second = np.zeros(n, bool)
        second[len(self.place) :] = True
        interval, shared = np.zeros(n, np.int32), np.full(n, depth, np.int32)
        shared[:1] = 0
        symbols = np.empty(n, self.before.dtype)
        for h in range(depth):
            symbols[~second], symbols[second] = self.before, other.before
            order = np.argsort(symbols, kind="stable")
            symbols, second, interval = symbols[order], second[order], interval[order]
            parts = np.concatenate([[False], (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])])
            shared[parts & (shared == depth)] = h
            interval = np.cumsum(parts, dtype=np.int32)
        place = np.empty(n, self.place.dtype)
        place[~second], place[second] = self.place, other.place
        before = np.empty(n, self.before.dtype)
        before[~second], before[second] = self.before, other.before
        return Transform(before, place), shared


def repeated(segments: list[bytes], p: Repeats, shard: list[int] | None = None, times: list[int] | None = None) -> list[np.ndarray]:
    """For each segment, whether each of its strings of p.length bytes starts anywhere else in the segments too.

    shard: the shard of each segment, by default dealt in turn; times: how often each segment is there, by default once.
    """
    depth, sizes = p.length // p.block, np.array([len(x) for x in segments])
    shard = np.arange(len(segments)) % 2 if shard is None else np.array(shard)
    times = np.ones(len(segments), np.int64) if times is None else np.array(times)
    data = np.frombuffer(b"".join(segments), np.uint8)
    grams = sizes - p.block + 1
    rows = grams + p.block  # each of the interleaved block sequences of a segment ends with a row of its own
    base, origin = np.cumsum(rows) - rows, np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), rows)
    local = np.arange(len(owner)) - base[owner]
    text = local < grams[owner]
    names = np.zeros(len(owner), np.int64)
    starts = (origin[owner] + local)[text]
    _, inverse = np.unique(span_hash(prefix_sums(data), starts, starts + p.block), return_inverse=True)
    names[text] = inverse + 1
    names = names.astype(np.uint16 if names.max() < 65536 else np.int32)
    at = np.arange(len(owner))
    after = np.where(text, at + p.block, base[owner] + local % p.block)
    prior = np.where(local >= p.block, at - p.block, 0)
    ends = np.flatnonzero(~text)
    prior[after[ends]] = ends
    of = shard[owner]
    level = [Transform.of(names, after, prior, at[of == s], depth) for s in np.unique(of)]
    if len(level) == 1:
        level.append(Transform(names[:0], at[:0]))
    while len(level) > 1:
        merged = [level[i].merge(level[i + 1], depth) for i in range(0, len(level) - 1, 2)]
        level, shared = [x for x, _ in merged] + level[len(merged) * 2 :], merged[0][1]
    last = level[0]
    interval = np.cumsum(shared < depth) - 1
    twice = np.bincount(interval, weights=times[owner[last.place]])[interval] > 1
    found = np.zeros(len(owner), bool)
    found[last.place] = twice
    return [found[b : b + n - p.length + 1] for b, n in zip(base.tolist(), sizes.tolist(), strict=True)]


_ANCHOR = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("hash", pa.int64()), ("seg", pa.int64())])
_PIECE = pa.schema([("hash", pa.int64()), ("more", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("times", pa.int64()), ("data", pa.binary())])
_RUN = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _anchor_rows(p: Repeats):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ks, hashes, segs = [], [], [], []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, _, h, seg = text_anchors(_bytes(text), p)
                rows.append(np.full(len(h), row, np.int64))
                ks.append(np.arange(len(h), dtype=np.int32))
                hashes.append(h)
                segs.append(seg)
            if rows:
                yield S.batch(_ANCHOR.names, [np.concatenate(rows), np.concatenate(ks), np.concatenate(hashes).view(np.int64), np.concatenate(segs).view(np.int64)], _ANCHOR)

    return run


def _cut(p: Repeats):
    """(text, [(k, large, times)], row) -> segments of anchors, or for large groups a row for each of their strings."""

    def run(batches):
        for b in batches:
            out = []
            for text, chosen, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _bytes(text)
                raw, (first, last, h, _) = data.tobytes(), text_anchors(data, p)
                sums = None
                for c in chosen:
                    i, j = int(first[c["k"]]), int(last[c["k"]])
                    if c["large"]:
                        sums = prefix_sums(data) if sums is None else sums
                        at = np.arange(i, j + 1)
                        one = span_hash(sums, at, at + p.length)
                        more = span_hash(sums, at, at + p.length // 2)
                        out += [(x, y, row, s, c["times"], None) for x, y, s in zip(one.view(np.int64).tolist(), more.view(np.int64).tolist(), at.tolist(), strict=True)]
                    else:
                        out.append((int(h[c["k"]].view(np.int64)), 0, row, i, c["times"], raw[i : j + p.length]))
                if len(out) > 20_000:
                    yield S.batch(_PIECE.names, list(zip(*out, strict=True)), _PIECE)
                    out = []
            if out:
                yield S.batch(_PIECE.names, list(zip(*out, strict=True)), _PIECE)

    return run


def _merge(p: Repeats):
    """(hash, row, at, times, data) sorted by hash -> runs of repeated strings."""

    def settle(rows, at, times, data):
        out = []
        for r, a, hit in zip(rows, at, repeated(data, p, [r % p.shards for r in rows], times), strict=True):
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            out += [(r, a + i, a + j - 1) for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        return S.batch(_RUN.names, list(zip(*out, strict=True)) if out else [[], [], []], _RUN)

    def run(batches):
        held, size = [[], [], [], []], 0
        for _, columns in S.groups(batches, 1):
            if len(columns[0]) < 2:
                continue
            more = sum(map(len, columns[3]))
            if held[0] and size + more > p.rows:
                yield settle(*held)
                held, size = [[], [], [], []], 0
            held, size = [x + list(y) for x, y in zip(held, columns, strict=True)], size + more
        if held[0]:
            yield settle(*held)

    return run


def _finish(p: Repeats):
    """(doc_id, text, whole anchors, runs) -> what is removed and what stays."""

    def run(batches):
        for b in batches:
            out = []
            for doc, text, whole, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _bytes(text)
                step = np.zeros(len(data) + 1, np.int64)
                if whole:
                    first, last, _, _ = text_anchors(data, p)
                    np.add.at(step, first[whole], 1)
                    np.add.at(step, last[whole] + p.length, -1)
                for r in runs or []:
                    step[r["first"]] += 1
                    step[r["last"] + p.length] -= 1
                gone = np.cumsum(step)[:-1] > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = [{"start": i, "end": j} for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                out.append((doc, len(data), spans, data[~gone].tobytes() if spans else data.tobytes()))
            if out:
                yield S.batch(_KEPT.names, list(zip(*out, strict=True)), _KEPT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Repeats = Repeats()) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, spans (removed bytes, ends exclusive), kept (the remaining bytes).

    Bytes are UTF-8 of the whole text, however long; strings are judged on the input and never cross texts. A null, empty or short text
    holds no string. Ids must be integers or cast to them. Rows with equal or null ids are texts of their own, so
    repeated rows remove each other; an empty table gives an empty result; other columns of docs are not read. A segment
    that many texts share moves as one row for each place; only different segments of an anchor meet in one task, and of
    an anchor with over params.group of them the single strings are counted by hash instead. Grams, segments and blocks are
    told apart by 64 bits of hashes, two together for each segment and each counted string.
    """
    p, spark = params, docs.sparkSession
    S.prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        rows = rows.select(F.col("doc_id").alias("row"), "doc_id", "text")
    else:
        rows = S.materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")

    found = rows.select("row", "text").mapInArrow(_anchor_rows(p), "row long, k int, hash long, seg long")
    each = found.groupBy("hash", "seg").agg(F.count("*").alias("n"))
    anchor = W.partitionBy("hash")
    kinds = each.select("hash", "seg", "n", F.count("*").over(anchor).alias("segments"), F.sum("n").over(anchor).alias("total")).filter("total > 1").drop("total")
    kinds = S.materialise(kinds, "kinds")
    S.release(spark)
    # a segment of over one place in 2,000 is frequent: there are fewer than 2,000 such, whose places are dealt to several tasks
    places = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    frequent = kinds.filter(F.col("n") > max(1000, places // 2000)).select("hash", "seg", F.lit(_SALTS).alias("salts"))
    dealt = found.join(F.broadcast(frequent), ["hash", "seg"], "left").withColumn("salt", F.pmod(F.xxhash64("row", "k"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > max(1000, places // 2000), F.lit(_SALTS - 1)).otherwise(0))).alias("salt")
    again = S.materialise(dealt.join(kinds.select("*", salts), ["hash", "seg", "salt"]).drop("salt"), "again")
    S.release(spark)

    open_ = again.filter("segments > 1").select("row", "k", "hash", "seg", (F.col("segments") > p.group).alias("large"), F.col("n").alias("times"))
    one = open_.filter("times > 1").groupBy("hash", "seg").agg(F.min(F.struct("row", "k", "large", "times")).alias("x")).select("x.*")
    chosen = open_.filter("times = 1").select("row", "k", "large", "times").unionByName(one).groupBy("row").agg(F.collect_list(F.struct("k", "large", "times")).alias("chosen"))
    pieces = S.materialise(rows.join(chosen.hint("merge"), "row").select("text", "chosen", "row").mapInArrow(_cut(p), "hash long, more long, row long, at long, times long, data binary"), "pieces")
    S.release(spark)
    small = pieces.filter("data is not null").select("hash", "row", "at", "times", "data")
    runs = small.repartition("hash").sortWithinPartitions("hash").mapInArrow(_merge(p), "row long, first long, last long")
    strings = pieces.filter("data is null")
    twice = strings.groupBy("hash", "more").agg(F.sum("times").alias("n")).filter("n > 1").select("hash", "more")
    runs = runs.unionByName(strings.join(twice, ["hash", "more"]).select("row", F.col("at").alias("first"), F.col("at").alias("last")))

    runs = runs.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    whole = again.filter("n > 1").groupBy("row").agg(F.collect_list("k").alias("whole"))
    gone = S.materialise(whole.join(runs, "row", "full"), "gone")
    S.release(spark)
    out = rows.join(gone.hint("merge"), "row", "left").select("doc_id", "text", "whole", "runs")
    return out.mapInArrow(_finish(p), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
