"""Quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Each rule looks at one measure of a text and votes good (+1), bad (-1) or abstains (0). All texts with the same
votes are alike to the model, so the votes of the whole corpus are one small table of patterns with counts (at most
three to the power of the number of rules). Expectation-maximisation over that table estimates how often each rule
votes bad, abstains or votes good on good texts and on each kind of other texts; how many kinds there are is settled by
likelihood. A pattern's posterior probability of being good replaces the filter that wants every rule passed: a rule that
errs on good texts is outvoted, and weak votes that agree can reject.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = string.punctuation.encode()
BLANKS = " \t\n\v\f\r"
WINDOW = 5

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_ends", "n_punctuation"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in _MEASURES)])


def measure(text: str, hashes: S.WordHashes) -> tuple[int, ...]:
    """The counts of one text, in the order of _MEASURES."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    h = hashes.of(words)
    repeat = 0
    if n > WINDOW:
        w = S.windows(h, WINDOW)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            repeat = int((np.cumsum(step)[:n] > 0).sum())
    size = len(data)
    blank = size - len(data.translate(None, BLANKS.encode()))
    upper = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + size - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    ends = data.count(b". ") + data.count(b".\n") + data.count(b", ") + data.endswith(b".")
    return n, len(text) - blank, size - len(data.translate(None, SYMBOLS)), dup, repeat, lines, upper, letters, data.count(b"!") + data.count(b"?"), len(np.unique(h)), ends, size - len(data.translate(None, PUNCTUATION))


def _measures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = S.WordHashes()
    for b in batches:
        rows = [measure(t or "", hashes) for t in b.column(1).to_pylist()]
        yield S.batch(_SCHEMA.names, [b.column(0), *(list(c) for c in zip(*rows, strict=True))], _SCHEMA) if rows else S.batch(_SCHEMA.names, [[] for _ in _SCHEMA.names], _SCHEMA)


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def rules() -> list[Rule]:
    c = F.col
    words, share = F.greatest(c("n_words"), F.lit(1)), lambda x, y: c(x) / F.greatest(c(y), F.lit(1))
    long = c("n_words") >= 30
    mean = c("word_chars") / words
    ends = share("n_ends", "n_words")
    return [
        Rule("length", c("n_words") < 10, c("n_words") >= 40),
        Rule("repeats", share("n_repeat_words", "n_words") > 0.2, share("n_repeat_words", "n_words") < 0.05),
        Rule("symbols", share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") < 0.02),
        Rule("punctuation", share("n_punctuation", "word_chars") > 0.1, share("n_punctuation", "word_chars") <= 0.1),
        Rule("shouting", (c("n_letters") >= 20) & (share("n_upper", "n_letters") > 0.5), (c("n_letters") >= 20) & (share("n_upper", "n_letters") < 0.2)),
        Rule("marks", share("n_marks", "n_words") > 0.2, share("n_marks", "n_words") < 0.05),
        Rule("duplicate_lines", share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") < 0.05),
        Rule("word_length", (mean < 2) | (mean > 30), mean.between(3.5, 9)),
        Rule("variety", long & (share("n_distinct", "n_words") < 0.05), (c("n_words") < 400) & (share("n_distinct", "n_words") > 0.4)),
        Rule("sentences", (c("n_words") >= 100) & (ends < 0.002), ends.between(0.02, 0.5)),
    ]


#: Pseudo-votes (bad, abstain, good) of a rule: one in all, so texts decide.
_PRIOR = np.array([0.1, 0.1, 0.8])


def fit(patterns: np.ndarray, counts: np.ndarray, gain: float = 0.01, steps: int = 500) -> dict:
    """EM over vote patterns (rows) with their counts, for kinds of texts.

    votes[k, j]: how often rule j votes bad, abstains and votes good on texts of kind k, free but for one pseudo-vote. A kind
    is added as long as that raises the mean log likelihood of a text by `gain`; each rule in turn says where it might
    start (texts that the rule holds bad, all else as in the most frequent kind), and the start that ends likeliest counts. bad[k]: texts
    of the kind draw half a bad vote or more each; a kind with fewer is another kind of good texts, and so is that with the fewest.
    """
    x, m = _one_hot(patterns), patterns.shape[1]
    best = _em(x, counts, np.tile([0.02, 0.1, 0.88], (1, m, 1)), np.ones(1), steps)
    while len(best["share"]) <= m:
        tries = []
        for j in range(m):
            start = best["votes"][best["share"].argmax()].copy()
            start[j] = [0.9, 0.05, 0.05]
            tries.append(_em(x, counts, np.concatenate([best["votes"], start[None]]), np.append(0.95 * best["share"], 0.05), steps))
        new = max(tries, key=lambda t: t["likelihood"])
        if new["likelihood"] - best["likelihood"] < gain:
            break
        best = new
    drawn = best["votes"][:, :, 0].sum(axis=1)
    best["bad"] = (drawn >= 0.5) & (drawn > drawn.min())
    return best


def _one_hot(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)


def _kinds(x: np.ndarray, votes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each kind, given a pattern, and the log likelihood of each pattern."""
    z = np.log(share) + np.einsum("pjv,kjv->pk", x, np.log(votes))
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _em(x: np.ndarray, counts: np.ndarray, votes: np.ndarray, share: np.ndarray, steps: int) -> dict:
    was = -np.inf
    for _ in range(steps):
        p, log = _kinds(x, votes, share)
        now = float(counts @ log) / counts.sum()
        if now - was < 1e-9:
            break
        was, n = now, p * counts[:, None]
        cast = np.einsum("pk,pjv->kjv", n, x) + _PRIOR
        votes = cast / cast.sum(axis=2, keepdims=True)
        share = (n.sum(axis=0) + 1) / (counts.sum() + len(share))
    return {"votes": votes, "share": share, "likelihood": was}


def posterior(patterns: np.ndarray, model: dict) -> np.ndarray:
    """The probability of good, given a pattern of votes."""
    p, _ = _kinds(_one_hot(patterns), model["votes"], model["share"])
    return p[:, ~model["bad"]].sum(axis=1)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """A row per row of docs: doc_id, the measures, base_failed, votes (one letter per rule), probability, kept.

    base_failed: fewer than 10 words, or more than 20 in 100 of them in five-word windows found twice or more.
    kept: false if base_failed, else whether the probability of good is at least `keep`. A null or empty text has no words.
    Texts are measured whole, however long; windows are compared by 64-bit hashes of their words, so n_repeat_words is
    exact but for a collision. Ids must be integers or cast to them. Rows come out as they come in, repeated ones too; an
    empty table gives an empty result. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(_measures, ", ".join(["doc_id long", *(f"{m} long" for m in _MEASURES)]))
    vote = lambda r: F.when(r.bad, "b").when(r.good, "g").otherwise("-")
    measured = S.materialise(measured.withColumn("votes", F.concat(*(vote(r) for r in rules()))), "quality")
    table = measured.groupBy("votes").count().collect()  # at most 3 ** len(rules()) rows, whatever the input
    schema = "votes string, probability double"
    if table:
        patterns = np.array([[{"b": -1, "g": 1, "-": 0}[v] for v in r["votes"]] for r in table])
        p = posterior(patterns, fit(patterns, np.array([r["count"] for r in table], float)))
        scores = spark.createDataFrame([(r["votes"], float(x)) for r, x in zip(table, p, strict=True)], schema)
    else:
        scores = S.empty(spark, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.join(F.broadcast(scores), "votes").select("doc_id", *_MEASURES, failed.alias("base_failed"), "votes", "probability", (~failed & (F.col("probability") >= keep)).alias("kept"))
