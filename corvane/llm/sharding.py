"""Reproducible shuffle into shards by a keyed permutation of global row numbers, in DataFrame functions only.

Rows are numbered by a global sort of a thin projection. A Feistel network with cycle walking maps the numbers 0 to n-1
onto themselves; the number that a row is mapped to gives its shard (remainder) and its slot (quotient), so anyone who
knows a row's number, n, the seed and the count of shards can work both out, and shard sizes differ by one at most.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

SHARDS, SEED, ROUNDS = 16, 20261, 6


def radices(n: int) -> tuple[int, int]:
    """Two numbers near the root of n whose product is n or more, by less than the root: the halves of the network."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _mixed(seed: int, step: int, half: int) -> int:
    return int(hashlib.md5(f"{seed}:{step}:{half}".encode()).hexdigest()[:12], 16)


def network(x: int, n: int, seed: int = SEED) -> int:
    """One pass through the network: a permutation of 0 to radices(n)'s product less one."""
    a, b = radices(n)
    left, right = x % a, x // a
    for i in range(0, ROUNDS, 2):
        left = (left + _mixed(seed, i, right)) % a
        right = (right + _mixed(seed, i + 1, left)) % b
    return a * right + left


def walks(n: int, seed: int = SEED) -> int:
    """How many further passes a number below n needs at most until it is below n again.

    Only numbers of n and above are walked through, fewer than the root of n; each is followed once, from where a walk
    enters them. Cycles that lie beyond n as a whole are never entered.
    """
    a, b = radices(n)
    after = {x: network(x, n, seed) for x in range(n, a * b)}
    most = 0
    for x in after.keys() - set(after.values()):
        steps = 0
        while x >= n:
            x, steps = after[x], steps + 1
        most = max(most, steps)
    return most


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number of n, worked out without any data."""
    x = network(row, n, seed)
    while x >= n:
        x = network(x, n, seed)
    return x % shards, x // shards


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """The permutation of 0 to n-1 as a column expression."""
    a, b = radices(n)
    mixed = lambda step, half: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), step.cast("string"), half.cast("string"))), 1, 12), 16, 10).cast("long")

    def two_rounds(state: Column, i: Column) -> Column:
        left = (state["l"] + mixed(i, state["r"])) % F.lit(a).cast("long")
        right = (state["r"] + mixed(i + 1, left)) % F.lit(b).cast("long")
        return F.struct(left.alias("l"), right.alias("r"))

    def once(x: Column) -> Column:
        start = F.struct((x % F.lit(a).cast("long")).alias("l"), ((x - x % a) / a).cast("long").alias("r"))
        return F.aggregate(F.array(*(F.lit(i) for i in range(0, ROUNDS, 2))), start, two_rounds, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])

    x = once(row)
    steps = walks(n, seed)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda y, _: F.when(y < n, y).otherwise(once(y))) if steps else x


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with row_number, long, from 0 in the sorted order of the given columns, nulls first.

    A global sort deals the rows to ranges; each is numbered by itself, and the ranges' first numbers are sums over one
    row a range. Rows that tie in all of order are numbered in any order.
    """
    kept = S.materialise(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    span = lambda c: F.shiftright(c, 33)  # noqa: E731  a partition's number stands above the 33 bits of its rows
    sizes = kept.groupBy(span(F.col("at")).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()  # a row for each range
    firsts, total = [], 0
    for r in sizes:
        firsts.append((r["range"], total))
        total += r["n"]
    first = F.broadcast(rows.sparkSession.createDataFrame(firsts, "range long, first long"))
    return kept.withColumn("range", span(F.col("at"))).join(first, "range").withColumn("row_number", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("range", "first", "at")


def _placed(thin: DataFrame, shards: int, seed: int) -> DataFrame:
    rows = numbered(thin, "doc_id", "size", "text_crc32", "row")
    n = rows.count()
    p = rows.withColumn("to", permuted(F.col("row_number"), n, seed)) if n else rows.withColumn("to", F.lit(0).cast("long"))
    return p.withColumn("shard", (F.col("to") % shards).cast("int")).withColumn("slot", F.floor(F.col("to") / shards).cast("long")).drop("to")


def _thin(id_: Column, text: Column, row: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [id_.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row.alias("row")]


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number.

    The law is `rows`: shards' counts are at most one apart, each shard's slots run from 0 without gaps. Rows are numbered by
    id, size and checksum of the text (nulls first), so neither files nor partitions matter; rows that tie in all three
    are alike in all that is returned. Null texts count as empty, null and repeated ids are rows like any other,
    texts of any length are read whole, equal texts are dealt out like different ones, other columns of docs are not read
    and an empty table gives an empty result. A third of all rows may be equal: the sort splits them by their place in the input.
    """
    rows = S.materialise(docs.select(*_thin(F.col(id_col), F.col(text_col), F.monotonically_increasing_id())), "thin")
    return _placed(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes docs to path as Parquet, a folder shard=<n> for each shard, rows and files in the order of slots.

    Each row stands in a column `doc` with all its columns whatever their names, beside `slot`. A shard may have many
    files, so no task holds a whole shard. An empty table writes an empty one.
    """
    kept = S.materialise(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs")
    plan = _placed(kept.select(*_thin(F.col(f"doc.{id_col}"), F.col(f"doc.{text_col}"), F.col("row"))), shards, seed)
    out = kept.join(plan.select("row", "shard", "slot"), "row").select("doc", "shard", "slot")
    out.orderBy("shard", "slot").write.partitionBy("shard").parquet(path)
