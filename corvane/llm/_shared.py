"""Helpers that the text operators share: scratch tables, grouped batches, word hashes, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import shared_folder, ship, store

#: Words of a text that a worker remembers before it starts its memory anew; bounds a worker's memory, not its results.
CACHE_WORDS = 200_000

_ODD = 0x9E3779B97F4A7C15

materialise = store


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/corvane/{name}-{uuid.uuid4().hex}"


#: Bytes and rows of an Arrow batch at most; a longer text is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 500


def prepare(spark: SparkSession) -> None:
    """Ships the package to the workers and keeps the session's Arrow batches small, as single texts can be very long.

    The plans built here are run by the caller, so the session keeps these limits unless it had smaller ones.
    """
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def batch(names: list[str], columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=schema.field(n).type) for n, c in zip(names, columns, strict=True)], schema=schema)


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of equal keys, for rows sorted by their first n_keys columns."""
    key, held = None, None
    for b in batches:
        rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
        for row in rows:
            if (k := row[:n_keys]) != key or held is None:
                if held is not None:
                    yield key, held
                key, held = k, [[] for _ in row[n_keys:]]
            for to, value in zip(held, row[n_keys:], strict=True):
                to.append(value)
    if held is not None:
        yield key, held


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= np.uint64(_ODD)
        out += hashes[i : i + n]
    return mix(out)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


#: A node with over one in so many of all edges is a hub: there are fewer than twice as many hubs, so they are broadcast; their edges are dealt to several tasks.
_HUBS, _SALTS = 2000, 16


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (u, v) with m, the least neighbour of u in `least` (u, m, n: how many neighbours)."""
    hub = F.col("n") > max(100, n // _HUBS)
    hubs = F.broadcast(least.filter(hub).select("u", F.lit(_SALTS).alias("salts")))
    dealt = rows.join(hubs, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.when(hub, F.lit(_SALTS - 1)).otherwise(0))).alias("salt")
    return dealt.join(least.select("u", "m", salts), ["u", "salt"])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): each node of the undirected edges (u, v) with the smallest node that it reaches.

    Alternating large-star and small-star steps: every step keeps the components, points nodes at smaller
    ones and is a grouped minimum plus a join over which hubs are spread, so no component and no hub ever meets in one task. Edges of every half step are written to the shared folder, as
    the small star reads those of the large one four times and its plan would hold them as often; only counts and a checksum reach the driver.
    """

    def lean(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return r["n"], r["x"]

    now = materialise(lean(edges), name)
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.filter("v > u"), least, 2 * was[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(lean(large), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, was[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialise(lean(small), name)
        if (new := state(now)) == was:
            break
        was = new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
