"""b-bit MinHash near-duplicate detection.

Every text becomes the set of its distinct word shingles. A text keeps the low bits of each of its
minima, packed, and a key for each band of full minima. Texts that share a band key are compared by
the bits of their packed signatures; the share of equal fields, corrected for chance collisions,
estimates their similarity. What passes that wide gate is gathered into families, and inside a family
links are confirmed on the full sets. Links make components; the smallest id of each stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S


@dataclass(frozen=True)
class MinHash:
    """Parameters. Texts link when 100 * intersection >= percent * union of their shingle sets."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 4
    #: Estimates this far under the similarity still count: five standard errors of the estimate.
    slack: float = 0.2
    #: A band's bucket over this size isn't compared by signatures, but joins one family as a whole.
    bucket: int = 2048
    #: A family is dealt to blocks of so many texts and so many shingles; each pair of blocks is one unit of work.
    block_texts: int = 512
    block_shingles: int = 1_000_000

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(20240501)
        return r.integers(1, 2**32, self.slots, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, self.slots, dtype=np.uint32)


def shingles(text: str | None, hashes: S.WordHashes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; all its words as one when they are fewer; none without words.

    A-Z is lower-cased; words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    return np.unique(S.windows(h, size)) if len(h) >= size else S.windows(h, len(h)) ^ np.uint64(len(h))


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        h = a[:, None] * x[None, i : i + 512]
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def packed(low: np.ndarray, p: MinHash) -> np.ndarray:
    """The low bits of the (texts, slots) minima as uint64 words, slots of p.bits bits."""
    m = low.astype(np.uint32)
    m ^= m >> np.uint32(16)
    m *= np.uint32(0x85EBCA6B)
    m ^= m >> np.uint32(13)
    m = (m & np.uint32((1 << p.bits) - 1)).astype(np.uint64)
    per = 64 // p.bits
    m = m.reshape(len(m), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(p.bits))
    return np.bitwise_or.reduce(m, axis=2)


def estimates(one: np.ndarray, many: np.ndarray, p: MinHash) -> np.ndarray:
    """Collision-corrected similarity of one packed signature to many, by counting differing fields."""
    x = many ^ one
    y = x.copy()
    for i in range(1, p.bits):
        y |= x >> np.uint64(i)
    mask = sum(1 << i for i in range(0, 64, p.bits))
    differ = np.bitwise_count(y & np.uint64(mask)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-p.bits
    return ((1 - differ / p.slots) - chance) / (1 - chance)


_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def _signatures(p: MinHash):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = S.WordHashes(), p.coefficients()
        odd = np.uint64(0xD6E8FEB86659FD93)
        for t in batches:
            n, h1, h2, mins = [], [], [], []
            for text in t.column(1).to_pylist():
                s = shingles(text, hashes, p.words)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                h2.append(int(S.mix(s * odd).sum(dtype=np.uint64)) if len(s) else 0)
                mins.append(minima(s, a, b))
            if not n:
                continue
            m = np.stack(mins)
            keys = np.zeros((len(m), p.bands), np.uint64)
            for i in range(p.rows):
                keys = S.mix(keys * odd + m.reshape(len(m), p.bands, p.rows)[:, :, i].astype(np.uint64) + np.arange(p.bands, dtype=np.uint64))
            bits = packed(m, p)
            signed = lambda x: np.array(x, np.uint64).astype(np.int64)
            bands = [k if c else None for k, c in zip(list(keys.astype(np.int64)), n, strict=True)]
            schema = _SIG.append(pa.field("row", pa.int64())) if t.num_columns > 2 else _SIG
            yield S.batch(schema.names, [t.column(0), np.array(n), signed(h1), signed(h2), bands, [x.tobytes() for x in bits], *t.columns[2:]], schema)

    return run


class _Union(dict):
    def find(self, x):
        while (y := self.setdefault(x, x)) != x:
            self[x] = self[y] if y in self else y
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self[max(x, y)] = min(x, y)
        return True


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return S.batch(["u", "v"], [[x for x, _ in links], [y for _, y in links]], _EDGE)


def _bucket_families(p: MinHash):
    """(key, rep, sig) sorted by key -> edges that connect what the signatures of a bucket hold similar enough."""

    def run(batches):
        gate, out = p.percent / 100 - p.slack, []
        for _, (ids, sigs) in S.groups(batches, 1):
            m = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(ids), -1)
            left = np.arange(len(ids))
            while len(left) > 1:  # flood from one text to all that are near it, directly or by others
                todo, rest = [left[0]], left[1:]
                while todo and len(rest):
                    at = todo.pop()
                    near = estimates(m[at], m[rest], p) >= gate
                    todo.extend(rest[near])
                    out.extend((ids[x], ids[at]) for x in rest[near] if ids[x] != ids[at])
                    rest = rest[~near]
                left = rest
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _confirm(p: MinHash):
    """(root, i, j, rep, block, text) sorted by root, i, j -> links that hold on the full sets, enough of them to connect all that is linked."""

    def run(batches):
        hashes, (a, b), gate, out = S.WordHashes(), p.coefficients(), p.percent / 100 - p.slack, []
        for (_, i, j), (ids, blocks, texts) in S.groups(batches, 3):
            sets = [shingles(t, hashes, p.words) for t in texts]
            del texts
            sizes, side, joined = np.array([len(s) for s in sets]), np.array(blocks), _Union()
            order = np.argsort(sizes, kind="stable")
            bits = packed(np.stack([minima(s, a, b) for s in sets]), p) if len(ids) > 32 else None
            for at, x in enumerate(order[:-1]):
                rest = order[at + 1 :]
                rest = rest[100 * sizes[x] >= p.percent * sizes[rest]]
                if i != j:
                    rest = rest[side[rest] != side[x]]
                if bits is not None and len(rest):
                    e = estimates(bits[x], bits[rest], p)
                    rest = rest[np.argsort(-e, kind="stable")][: int((e >= gate).sum())]
                for y in rest:
                    if joined.find(ids[x]) != joined.find(ids[y]):
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= p.percent * (sizes[x] + sizes[y] - both) and joined.join(ids[x], ids[y]):
                            out.append((ids[x], ids[y]))
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHash = MinHash(), row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; with row_col (an integer) also that column, as `row`.

    Texts of equal sets collapse to their smallest id before any comparison. A bucket over params.bucket texts is not
    compared but becomes part of one family as a whole, so that nothing is left out; families are confirmed in pairs
    of blocks of bounded size. The cost of a family grows with the square of its *different* texts only.

    Texts count as equal when size and two 64-bit sums over their shingles' hashes are. Null or wordless texts have no
    shingles and link with nothing; texts of any length are read whole. Ids must be integers or cast to them. Rows that share an id are one document. A null id
    cannot stand for its class: such a row points at the smallest id of its class and is kept only when no id is there.
    Other columns of docs are not read. An empty table gives an empty result.
    """
    p, spark = params, docs.sparkSession
    S.prepare(spark)
    row = [F.col(row_col).cast("long").alias("row")] if row_col else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row)
    sig = S.materialise(docs.mapInArrow(_signatures(p), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary" + ", row long" * len(row)), "sig")
    key = ["h1", "h2", "n_shingles"]
    classes = sig.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    reps = S.materialise(sig.join(classes, key).filter("doc_id = rep").groupBy(*key, "rep").agg(*(F.first(c).alias(c) for c in ("bands", "sig"))).drop("h1", "h2"), "reps")

    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
    members = banded.join(shared, "key")
    large = members.filter(F.col("n") > p.bucket).select(F.col("rep").alias("u"), F.col("hub").alias("v")).filter("u <> v")
    small = members.filter(F.col("n") <= p.bucket).select("key", "rep").join(reps.select("rep", "sig"), "rep").select("key", "rep", "sig")
    small = small.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_families(p), "u long, v long")
    family = S.components(large.unionByName(small), "family")

    family = S.materialise(family.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node"), "members")
    blocks = family.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / p.block_texts), F.ceil(F.sum("n_shingles") / p.block_shingles)).cast("int").alias("n_blocks"))
    dealt = family.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    # texts move by id at every size: members grow with the input, so they are never the broadcast side
    texts = dealt.hint("merge").join(docs, F.col("node") == F.col("doc_id")).select("root", "node", "block", "n_blocks", "text")
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "text")
    links = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_confirm(p), "u long, v long")
    linked = S.components(links, "linked")

    classes = classes.join(linked, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("root", "rep").alias("root"))
    rest = ["row"] if row_col else []
    out = sig.select("doc_id", *key, *rest).join(classes, key, "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), *rest)
