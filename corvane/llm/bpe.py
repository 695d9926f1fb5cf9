"""Byte-level BPE by backtracking, and decoding by an offset table.

A pre-token is encoded without replaying merges. One Aho-Corasick pass finds every vocabulary token at every
position; from the left the longest token is taken that is compatible with the token before it, and when none
is, the last choice is undone for the next shorter one. A prefix has one BPE encoding only, so a position that
fails once fails for good and the work is linear in the text. Two tokens are compatible when BPE, given their
joined bytes, would leave them as they are; that is decided once for each pair and kept in a table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens over this many characters are encoded each time anew, so a cache entry stays small.
LONG = 64
#: Entries after which a worker's cache of pre-tokens becomes its old one, and of pairs starts anew: some 100 MB.
CACHE = 200_000
PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """letter -> byte: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder(dict):
    """pre-token -> its ids as little-endian 32-bit integers, remembered; `table` and `decode` go the other way."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.joined = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        made = {vocab[a + b]: (i, vocab[a], vocab[b]) for i, (a, b) in reversed(list(enumerate(merges)))}
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()}
        # the tokens that stand at a token's right (left) edge while it forms, each with the merge that ends it
        never = len(merges)
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        for t in self.bytes_of:
            for spine, side in ((self.right, 2), (self.left, 1)):
                edge, at, until = [], t, never
                while True:
                    edge.append((at, until))
                    if at not in made:
                        break
                    until, at = made[at][0], made[at][side]
                spine[t] = edge
        self.pairs: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find, self.whole = ahocorasick.Automaton(), {}
        sound = {t for t in self.bytes_of if t not in made}
        for t in sorted(made, key=lambda t: made[t][0]):
            rank, a, b = made[t]
            if a in sound and b in sound and not self._crossed(a, b, rank):
                sound.add(t)
        for t in sound:
            self.find.add_word(self.bytes_of[t].decode("latin-1"), (len(self.bytes_of[t]), t))
            self.whole[self.bytes_of[t]] = np.uint32(t).tobytes()
        self.find.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.old: dict = {}
        texts = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        parts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _crossed(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge of a rank under limit would join a's right edge with b's left edge before both have formed."""
        joined = self.joined
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                rank = joined.get((x, y))
                # of equal pairs the left one merges first: it wins against b's own merge, and loses against a's
                if rank is not None and rank < limit and rank < x_until and rank <= y_until:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get(a << 32 | b)
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            ok = self.pairs[a << 32 | b] = not self._crossed(a, b, len(self.joined))
        return ok

    def pieces(self, data: bytes) -> list[int]:
        """The ids of the bytes of one pre-token."""
        n = len(data)
        at: list[list] = [[] for _ in range(n)]
        for end, (size, t) in self.find.iter(data.decode("latin-1")):
            at[end - size + 1].append((size, t))  # shorter tokens end first
        dead, out, left, pos = bytearray(n + 1), [], [], 0
        options = list(at[0])
        while pos < n:
            prev = out[-1][1] if out else None
            while options:
                size, t = options.pop()
                if not dead[pos + size] and (prev is None or self.compatible(prev, t)):
                    break
            else:
                dead[pos] = 1
                size, _ = out.pop()
                options, pos = left.pop(), pos - size
                continue
            out.append((size, t))
            left.append(options)
            pos += size
            options = list(at[pos]) if pos < n else []
        return [t for _, t in out]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            ids = self.whole.get(data) or np.array(self.pieces(data), "<u4").tobytes()
        if len(piece) <= LONG:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        if self.split and any(s in text for s in self.special):
            parts = self.split.split(text)
            return b"".join(np.uint32(self.special[x]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the place where the bytes of each id end."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[take], ends


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (key := hashlib.sha256(raw).digest()) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _run(raw):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(raw.value)
        for b in batches:
            packed = [e.encode(t or "") for t in b.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(packed), "<u4")
            data, ends = e.decode(ids)
            data = data.tobytes()
            stops = np.cumsum([len(p) // 4 for p in packed])
            cuts = [0, *(int(ends[k - 1]) if k else 0 for k in stops)]
            texts = [data[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:], strict=False)]
            yield S.batch(_OUT.names, [b.column(0), packed, texts], _OUT)

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian 32-bit ids in order), n_tokens, decoded (the text that the ids give).

    tokenizer: path of a tokenizer file of the byte-level BPE kind, read by the driver and broadcast; its size is that
    of the vocabulary and doesn't grow with the data. Added special tokens inside a text become their ids, as that
    library does by default. A null text counts as empty; an empty text has no ids. Rows come out as they come in,
    repeated or not; texts of any length are encoded whole; an empty table gives an empty result; other columns of docs are
    not read. Ids must be integers or cast to them.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    with open(tokenizer, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(raw), "doc_id long, ids binary, decoded string").select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decoded")
