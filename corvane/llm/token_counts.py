"""Token counts of a sentencepiece BPE model by a two-tier lookup, without shuffling pre-tokens.

No piece of such a model holds a space after another letter, nor a line feed (that is checked when a model is read), so a text's tokens are those of its
pre-tokens: a run of spaces with the word after it, or a line feed. A sketch over all texts finds the frequent
words; their lengths in tokens are broadcast as a compact hash table. What that table misses is encoded once by
a worker and remembered in its bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

CACHE = 1_000_000
LONG = 64
_ODD_SPACES = re.compile(r" *[^ ]+| +")


class Lengths(dict):
    """pre-token after one space -> number of tokens; frequent ones are there from the start, others as they come."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.frequent = frequent
        self.feed = len(self.sp.encode("\n"))
        self.starts: dict[str, int] = {}
        self.update(frequent)

    def __missing__(self, word: str) -> int:
        # encode() puts one space before what it gets
        n = len(self.sp.encode(word)) if word else 1
        if len(word) <= LONG:
            self[word] = n
        return n

    def start(self, word: str) -> int:
        """Tokens of a word at the start of a line, without a space before it."""
        n = self.starts.get(word)
        if n is None:
            n = len(self.sp.encode("\n" + word)) - self.feed
            if len(word) <= LONG:
                self.starts[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) + len(self.starts) > CACHE:
            self.clear()
            self.starts.clear()
            self.update(self.frequent)
        lines = (" " + text.replace("▁", " ")).split("\n")
        n = (len(lines) - 1) * (self.feed - 1)
        get = self.__getitem__
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i and words[0]:
                n += self.start(words[0])
            rest = words[1:]
            if "" in rest or (not words[0] and i and len(words) == 1):
                if line:
                    own = _ODD_SPACES.findall(line)
                    n += sum(get(w[1:]) for w in own if w[0] == " ")
            else:
                n += sum(map(get, rest))
        return n


def check_pieces(sp: sentencepiece.SentencePieceProcessor) -> None:
    """Raises ValueError if a piece goes over the end of a pre-token, so that texts couldn't be counted by pre-tokens."""
    for i in range(sp.get_piece_size()):
        if not re.fullmatch("▁*[^▁\n]*", sp.id_to_piece(i)):
            raise ValueError(f"piece {i}, {sp.id_to_piece(i)!r}, holds a space after another letter or a line feed")


_LENGTHS: dict[bytes, Lengths] = {}


def lengths(model: bytes, frequent: tuple[np.ndarray, bytes]) -> Lengths:
    """The worker's lookup; the table comes as token counts (8 bits each) beside the words, joined by line feeds."""
    key = hashlib.sha256(model + frequent[1]).digest()
    if key not in _LENGTHS:
        _LENGTHS.clear()
        words = frequent[1].decode().split("\n") if len(frequent[0]) else []
        _LENGTHS[key] = Lengths(model, dict(zip(words, frequent[0].tolist(), strict=True)))
    return _LENGTHS[key]


def frequent_words(docs: DataFrame, text_col: str, k: int, tracked: int) -> list[str]:
    """About the k most frequent words of all texts, from mergeable sketches of bounded size: one for each task, then merged in two steps."""
    words = docs.select(F.spark_partition_id().alias("p"), F.explode(F.split(F.col(text_col), "[ \n]")).alias("w")).filter("length(w) between 1 and 64")
    if words.isEmpty():
        return []
    part = words.groupBy((F.col("p") % 64).alias("b")).agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"))
    # at most 64 sketches, combined eight at a time; grouped, as combining doesn't stand partitions without any
    combine = F.expr(f"approx_top_k_combine(s, {tracked})").alias("s")
    some = part.groupBy((F.col("b") % 8).alias("c")).agg(combine)
    top = some.groupBy(F.lit(0).alias("all")).agg(combine).selectExpr(f"approx_top_k_estimate(s, {k}) AS top").first()
    return [x["item"] for x in (top["top"] or [])] if top and top["top"] is not None else []


def _run(model, frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, schema = lengths(model.value, frequent.value), pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            yield S.batch(schema.names, [b.column(0), b.column(2), [look.count(t or "") for t in b.column(1).to_pylist()]], schema)

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 5000, tracked: int = 16384) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of each row's whole text.

    model: path of a sentencepiece BPE model with byte fallback and no normalisation, read by the driver and broadcast,
    as is the table of at most `frequent` words. The table changes speed only, never a count. A null text counts as
    empty and has no tokens; texts of any length are counted whole. Ids must be integers or cast to them. Rows come out
    as they come in, repeated ones too; an empty table gives an empty result; other columns of docs are not read.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    with open(model, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    check_pieces(sp)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = sorted({w for w in frequent_words(rows, "text", frequent, tracked) if "▁" not in w})
    counts = [len(x) for x in sp.encode(words)] if words else []
    small = [(w, n) for w, n in zip(words, counts, strict=True) if n < 256]
    table = (np.array([n for _, n in small], np.uint8), "\n".join(w for w, _ in small).encode())
    send = spark.sparkContext.broadcast
    return rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(_run(send(raw), send(table)), "doc_id long, n_bytes long, n_tokens long")
