"""One query for each operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _shared as S
from corvane.llm.bpe import encode_and_decode
from corvane.llm.decontaminate import contamination
from corvane.llm.line_dedup import host_of, html_lines, mark_lines
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.negatives import hard_negatives
from corvane.llm.quality import quality
from corvane.llm.repeats import remove_repeats
from corvane.llm.credentials import find_secrets
from corvane.llm.sharding import ROUNDS, SEED, SHARDS, assign
from corvane.llm.token_counts import token_counts
from corvane.llm.toxicity import toxicity
from corvane.llm.warc import read_warc, resolve_revisits, write_warc
from corvane.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, place), ",")
    base = F.filter("spans", lambda s: s["score"].isNull())
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("format"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch_path(spark, "warc")
    write_warc(resolve_revisits(_table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(_table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "probability")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encode_and_decode(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host: the lines of each page's text that stay and those that go as their host's boilerplate."""
    pages = _table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    m = mark_lines(pages, "host", "lines")
    text = F.array_join("kept", "\n")
    return m.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whiten(_table(spark, sf_dir, "embeddings"))
    return w.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are moved on by one where the id is divisible by 7."""
    e = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", "embedding", label.alias("label")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_minhash, op3_toxicity, op4_repeats, op5_warc, op6_quality, op7_bpe, op8_token_counts, op9_decontaminate, op10_line_dedup, op11_sharding, op12_whitening, op13_hard_negatives)
}

_HTML_LINES = r"""
SELECT page_id, host, list_filter(list_transform(regexp_split_to_array(bare, '<[^>]*>|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines
FROM (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
             regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b[^>]*>.*?</script\s*>', chr(10), 'gis'), '<style\b[^>]*>.*?</style\s*>', chr(10), 'gis') AS bare FROM pages)
"""

def _network_sql(source: str) -> str:
    """SQL for one pass of (row_number, x) of source through the network of sharding.py."""
    mixed = lambda i, half: f"('0x' || substr(md5('{SEED}:{i}:' || {half}), 1, 12))::BIGINT"
    sql = f"SELECT row_number, n, a, b, x % a AS l, x // a AS r FROM {source}"
    for i in range(0, ROUNDS, 2):
        sql = f"SELECT row_number, n, a, b, (l + {mixed(i, 'r')}) % a AS l, r FROM ({sql})"
        sql = f"SELECT row_number, n, a, b, l, (r + {mixed(i + 1, 'l')}) % b AS r FROM ({sql})"
    return f"SELECT row_number, n, a, b, a * r + l AS x FROM ({sql})"


ORACLE: dict[str, str] = {
    "op11_sharding": f"""
WITH RECURSIVE c0 AS (SELECT i, i AS c FROM range(256) t(i)),
c8 AS (SELECT i, list_reduce([c] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM c0),
crc AS (SELECT list(c ORDER BY i) AS t FROM c8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
             xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM d),
s AS (SELECT row_number, row_number AS x, n, a, (n + a - 1) // a AS b FROM (SELECT row_number, count(*) OVER () AS n, ceil(sqrt(count(*) OVER ()))::BIGINT AS a FROM o)),
w AS (({_network_sql("s")}) UNION ALL ({_network_sql("(SELECT * FROM w WHERE x >= n)")}))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard, row_number FROM o JOIN w USING (row_number) WHERE x < n""",
    "op10_line_dedup": f"""
WITH p AS ({_HTML_LINES}),
e AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p),
f AS (SELECT host, line, count(*) AS n FROM e GROUP BY host, line HAVING count(*) >= 2),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT f.host, list(f.line) AS gone FROM f JOIN t ON f.host IS NOT DISTINCT FROM t.host WHERE f.n > 0.05 * t.pages GROUP BY f.host)
SELECT p.page_id, p.host, len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: coalesce(list_contains(gone, x), false)))::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)), chr(10)), '')) AS kept_sha256
FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host""",
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
sizes AS (SELECT DISTINCT n FROM g),
r AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r.doc_id, r.i, r.n, g.item_id FROM r JOIN g USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
b AS (SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS h, o.first FROM p JOIN o USING (html)),
l AS (SELECT page_id, payload_bytes, first, list_transform(range(0, 8), lambda i: ('0x' || h[5 * i + 1:5 * i + 5])::BIGINT) AS v FROM b)
SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> s) & 31) + 1]))), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM l""",
}
