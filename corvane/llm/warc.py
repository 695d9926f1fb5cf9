"""WARC archives with revisits: equal payloads are stored once, later ones point at the first.

Only headers (id, digest, length) are shuffled: they are aggregated by payload digest to find each payload's original,
and what is known of repeated payloads comes back to the pages, which stay where they are. Each page becomes a
response or a revisit record with headers of its own, a gzip member of an archive. Reading streams records by
Content-Length and checks every stored payload against its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _shared as S

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1: 40 hex digits as eight groups of five, each of four letters."""
    h = F.sha1(data)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


#: What is known of repeated payloads is broadcast up to so many bytes; beyond, it meets the headers in a join and comes back by page.
BROADCAST_BYTES = 64_000_000
#: A payload's header rows are dealt to so many tasks in that join, as one payload may be that of a third of all pages.
SALTS = 16


def resolve_revisits(pages: DataFrame, min_payload: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, refers_to_uri.

    page_id: an integer. Of records with equal payloads of at least min_payload bytes the smallest page_id is the response
    and the others revisit it; smaller payloads are all responses. A null or empty html is an empty payload; long ones are taken whole. Rows
    that repeat the smallest id are all responses; a null page_id is never an original. An empty table gives an empty
    result. Other columns of pages are not read. Pages are moved only where repeated payloads are so many that
    their headers exceed broadcast_bytes, and then by page_id and payload, which no hot key has.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": sha1_base32(F.encode("html", "UTF-8"))})
    key = ["payload_digest", "payload_bytes"]
    heads = rows.filter(F.col("payload_bytes") >= min_payload).select("page_id", "url", *key)
    named = F.col("page_id").isNotNull()
    repeated = heads.groupBy(*key).agg(F.min("page_id").alias("refers_to"), F.min_by("url", F.when(named, F.col("page_id"))).alias("refers_to_uri"), F.count("*").alias("n"))
    repeated = S.materialise(repeated.filter("n > 1 and refers_to is not null").drop("n"), "repeated")
    size = repeated.agg(F.coalesce(F.sum(80 + F.coalesce(F.octet_length("refers_to_uri"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(repeated), key, "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        dealt = heads.select("page_id", *key).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        again = dealt.join(repeated.select("*", salt), [*key, "salt"]).filter(other).select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), F.col("payload_bytes").alias("again_bytes"), "refers_to", "refers_to_uri").distinct()
        same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")) & (F.col("payload_bytes") == F.col("again_bytes"))
        joined = rows.join(S.materialise(again, "again"), same, "left")
    again = F.col("refers_to").isNotNull() & other
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_to_uri")).alias("refers_to_uri"),
    )


def _record_id(page_id: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), url))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


_ARCHIVE = pa.schema([("data", pa.binary())])


def _archives(most: int):
    """Records, each as a gzip member, gathered into archives of about `most` bytes; an archive lacks its last byte, a zero, which the writer adds."""

    def closed(members: list[bytes]) -> bytes:
        if members[-1][-1]:  # the size of a record over 16 MB ends with another byte: an empty member follows
            members.append(gzip.compress(b"", mtime=0))
        return b"".join(members)[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for record in b.column(0):
                member = gzip.compress(record.as_py().encode("utf-8", "surrogatepass"), 6, mtime=0)
                if held and size + len(member) > most:
                    yield S.batch(["data"], [[closed(held)]], _ARCHIVE)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield S.batch(["data"], [[closed(held)]], _ARCHIVE)

    return run


def write_warc(resolved: DataFrame, path: str, date: str | None = None, file_bytes: int = 32_000_000) -> None:
    """Writes what resolve_revisits gives as archives of about file_bytes each, one or more from each task; a longer record has its own.

    Each record is a gzip member of its own. date: of the new records, now if not given. Rows without a url have no
    target; repeated rows give repeated records; an empty table gives a folder without archives.
    """
    S.prepare(resolved.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7F]", "%20")
    text = lambda c: F.col(c).cast("string")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text("payload_bytes"), F.lit(_END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Profile", F.when(revisit, _PROFILE)),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("refers_to_uri")))), line("WARC-Refers-To-Target-URI", clean(F.col("refers_to_uri"))),
        line("WARC-Refers-To-Date", F.when(revisit, date)),
        line("X-Page-ID", text("page_id")), line("X-Refers-To-Page-ID", text("refers_to")), line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"),
    )
    records = resolved.withColumn("block", block).select(F.concat(head, F.lit(_END), F.col("block"), F.lit(_END)).alias("record"))
    archives = records.mapInArrow(_archives(file_bytes), "data binary").select(F.col("data").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_records(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive that is open for reading; one record is held at a time."""
    n = 0
    while first := archive.readline():
        n += 1
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at the place of record {n}: {first[:40]!r}")
        headers = {}
        while line := archive.readline().rstrip(b"\r\n"):
            k, _, v = line.decode("utf-8").partition(": ")
            headers[k.lower()] = v
        size = int(headers["content-length"])
        block = archive.read(size)
        if len(block) != size or archive.read(4) != _END.encode():
            raise ValueError(f"record {n} doesn't end where its headers say")
        yield headers, block


_RECORD = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _parse(payloads: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for h, block in parse_records(io.BufferedReader(gzip.open(io.BytesIO(data.as_buffer())))):
                    http, _, body = block.partition(_END.encode())
                    size = int(http.rpartition(b": ")[2])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"the payload of {h['warc-record-id']} isn't the one its headers tell of")
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    if len(rows) == 500:
                        yield S.batch(_RECORD.names, list(zip(*rows, strict=True)), _RECORD)
                        rows = []
                    rows.append((number("x-page-id"), h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), size, digest, number("x-refers-to-page-id"), body if payloads and h["warc-type"] == "response" else None))
                yield S.batch(_RECORD.names, list(zip(*rows, strict=True)) if rows else [[] for _ in _RECORD.names], _RECORD)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in a folder: page_id, record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    An archive is read whole and its records one by one; a folder without archives gives no rows.
    """
    S.prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse(payloads), "page_id long, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary")
