"""Sharding against its definition: a plain sort, the permutation worked out row by row, and files read back."""

import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, sharding

ODD = "doc_id long, text string, row int, shard string, at long, doc string"


def plain(rows, shards):
    keys = sorted(((i is not None, i or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    return sorted((k[0], k[1], k[2], *sharding.place(at, len(keys), shards)) for at, k in enumerate(keys))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1001])
def test_the_network_permutes(spark, n):
    want = [sharding.place(i, n, 16) for i in range(n)]
    assert sorted(s + 16 * k for s, k in want) == list(range(n))
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()
    assert all((r.p % 16, r.p // 16) == want[r.id] for r in got)
    assert n < 100 or want != [sharding.place(i, n, 16, seed=7) for i in range(n)]


def test_rows_on_odd_tables(spark):
    rows = [(i, f"text {i} é😀") for i in range(40)] + [(None, None)] * 50 + [(3, "text 3 é😀")] * 30 + [(41, ""), (42, None), (43, "long " * 100_000)]
    for parts in (1, 7):
        docs = spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], ODD).repartition(parts)
        got = sharding.assign(docs, shards=6).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain(rows, 6)
        assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign(docs.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op11_sharding(spark, sf).collect()
    assert sorted(((True, r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain(docs, 16)


def test_written_shards(spark, tmp_path):
    rows = [(i % 9 if i % 4 else None, f"t{i % 5}" if i % 3 else None, i, "x", 1, "y") for i in range(60)]
    docs = spark.createDataFrame(rows, ODD)
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=7)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r.doc.row for r in back) == list(range(60))
    assert sorted((r.shard, r.slot) for r in back) == sorted((p % 7, p // 7) for p in range(60))
    sharding.write_shards(docs.limit(0), f"file://{tmp_path}/none", shards=7)
