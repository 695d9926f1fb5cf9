"""Toxicity by weak supervision.

Lexicon voters are word parts that labelled rows show far more in toxic texts than chance allows; pattern voters look at how much
evidence of such parts a text holds in all and by word, at shouting and at strings of symbols. They vote on labelled and
unlabelled texts alike. A generative label model estimates by EM how often each voter fires on toxic and on clean texts
and how votes go together: texts of one truth are of several kinds, each with rates of its own, so that ten spellings of one fact
don't count ten times. Labels only weigh on the rates, like a bounded number of rows; what a text is comes from its votes
alone. A linear classifier is fitted to these posteriors and scores every text. Labels, languages, sources and ids
never enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”…"
#: Evidence (log likelihood ratios of a text's entries) in all, and by hundred words, from which a pattern voter fires.
IN_ALL, BY_WORDS = (4.0, 8.0, 16.0), (1.0, 3.0)
PATTERNS = ["some", "much", "most", "dense", "packed", "none", "shouting", "swearing"]


def parts(word: str) -> set[str]:
    """What a lexicon entry may be: the word, its first four to seven letters, its last four or five."""
    out = {f"={word}"}
    out.update(f"^{word[:n]}" for n in range(4, min(8, len(word))))
    out.update(f"{word[-n:]}$" for n in (4, 5) if len(word) > n)
    return out


def implied(part: str, chosen: set[str]) -> bool:
    """Whether a text with this part always has a chosen one too."""
    word = part.strip("=^$")
    if part[0] in "=^" and any(f"^{word[:n]}" in chosen for n in range(4, min(8, len(word) + 1))):
        return True
    return (part[0] == "=" or part[-1] == "$") and any(f"{word[-n:]}$" in chosen for n in (4, 5) if len(word) >= n)


def evidence(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """The log likelihood ratio (twice, in nats) that a part is in more of the toxic texts (t of them) than of the clean ones (c); 0 if it isn't."""
    term = lambda x, n, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    have = (t + c) / (toxic + clean)
    g = term(t, toxic, have) + term(c, clean, have) + term(toxic - t, toxic, 1 - have) + term(clean - c, clean, 1 - have)
    return F.when(t / toxic > c / clean, 2 * g).otherwise(0.0)


def word_set(text: str) -> set[str]:
    return {w.strip(_EDGES) for w in set(text.lower().split())} - {""}


def held_out(id_col: Column) -> Column:
    """Whether a row's label must not be learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _part_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    seen = {1: Counter(), 0: Counter()}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found: set[str] = set()
            for w in word_set(text or ""):
                found |= parts(w)
            seen[toxic].update(found)
    rows = [(p, n, seen[0][p]) for p, n in seen[1].items()]  # parts of clean texts only can't be entries
    rows += [(p, 0, n) for p, n in seen[0].items() if p not in seen[1]]
    for i in range(0, len(rows), 50_000):
        yield S.batch(schema.names, list(zip(*rows[i : i + 50_000], strict=True)), schema)


EXTRA = 2


def inputs(features: list[tuple[list[int], list[int], list[float], int]], strength: np.ndarray) -> np.ndarray:
    """What the classifier sees of each text's (entries, counts, patterns, words): how often each entry occurs, the patterns, and the entries' evidence in all and by word."""
    x = np.zeros((len(features), len(strength) + len(PATTERNS) + EXTRA))
    for i, (entries, counts, patterns, words) in enumerate(features):
        x[i, len(strength) : -EXTRA] = patterns
        if entries:
            n = np.array(counts, float)
            x[i, entries] = np.log1p(n)
            evidence = float(n @ strength[entries])
            x[i, -2:] = np.log1p(evidence), min(3.0, 30 * evidence / max(1, words))
    return x


@dataclass
class Model:
    lexicon: dict[str, int] = field(default_factory=dict)
    strength: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS) + EXTRA))
    bias: float = -3.0
    voters: list[dict] = field(default_factory=list)

    def reader(self) -> _Reader:
        return _Reader(self.lexicon, self.strength)

    def scores(self, texts: list[str | None], reader: _Reader) -> np.ndarray:
        """The scores of a batch: one matrix product."""
        found = [reader.features(t or "") for t in texts]
        x = inputs([(list(e), list(e.values()), p, n) for e, p, n in found], self.strength)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


class _Reader(dict):
    """raw word -> the lexicon entries in it, remembered."""

    def __init__(self, lexicon: dict[str, int], strength: np.ndarray):
        self.lexicon, self.strength = lexicon, strength.tolist()

    def __missing__(self, raw: str) -> tuple[int, ...]:
        word = raw.strip(_EDGES)
        found = tuple(sorted(self.lexicon[p] for p in parts(word) if p in self.lexicon)) if word else ()
        if len(raw) <= 64:
            self[raw] = found
        return found

    def features(self, text: str) -> tuple[dict[int, int], list[float], int]:
        """Entries that the text holds with their counts, the pattern voters (1 fires, 0 abstains), and the number of words."""
        if len(self) > S.CACHE_WORDS:
            self.clear()
        words = text.lower().split()
        entries = Counter(e for f in map(self.__getitem__, words) if f for e in f)
        evidence = sum(n * self.strength[e] for e, n in entries.items())
        by_words = 100 * evidence / max(1, len(words))
        capitals = sum(map(str.isupper, text[:1] and text.split()))
        swear = sum(text.count(x) for x in ("#$", "$%", "%&", "&!", "@#", "!@"))
        fires = [*(evidence >= x for x in IN_ALL), *(by_words >= x for x in BY_WORDS), not entries, capitals > 0.5 * len(words), swear >= 3]
        return entries, [float(x) for x in fires], len(words)


def _features(sent):
    schema = pa.schema([("toxic", pa.int32()), ("entries", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("patterns", pa.list_(pa.float64())), ("words", pa.int64())])

    def run(batches):
        reader = _Reader(*sent.value)
        for b in batches:
            rows = [reader.features(t or "") for t in b.column(0).to_pylist()]
            yield S.batch(schema.names, [b.column(1), [list(e) for e, _, _ in rows], [list(e.values()) for e, _, _ in rows], [p for _, p, _ in rows], [n for _, _, n in rows]], schema)

    return run


@dataclass
class LabelModel:
    """Kinds of texts: truth[k] (0 clean, 1 toxic), share[k], rates[k, j]: how often voter j fires on texts of kind k."""

    truth: np.ndarray
    share: np.ndarray
    rates: np.ndarray

    def kinds(self, votes: np.ndarray, truth: int | None = None) -> np.ndarray:
        """The probability of each kind of each row of votes, of kinds of one truth only if that is given."""
        z = np.log(self.share) + votes @ np.log(self.rates).T + (1 - votes) @ np.log1p(-self.rates).T
        if truth is not None:
            z = np.where(self.truth == truth, z, -np.inf)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.kinds(votes)[:, self.truth == 1].sum(axis=1)

    def marginal(self, truth: int) -> np.ndarray:
        """How often each voter fires on texts of that truth."""
        own = self.truth == truth
        return self.share[own] @ self.rates[own] / self.share[own].sum()

    def correlation(self, truth: int) -> np.ndarray:
        """How votes of two voters go together on texts of that truth."""
        own = self.truth == truth
        w, mean = self.share[own] / self.share[own].sum(), self.marginal(truth)
        off = self.rates[own] - mean
        scale = np.sqrt(mean * (1 - mean))
        out = (off * w[:, None]).T @ off / np.outer(scale, scale)
        np.fill_diagonal(out, 1)
        return out


def label_model(votes: np.ndarray, labels: np.ndarray, kinds: int = 2, anchor: float = 200.0, steps: int = 300) -> tuple[np.ndarray, LabelModel]:
    """The probability of toxic of each row of votes (1 fires), and the model.

    labels: 1 toxic, 0 clean, -1 unknown. Labelled rows start the rates and then weigh on them like `anchor` rows of each
    truth; a row's own label has no part in its probability. Without labels every voter starts as one that tells of
    toxic texts. There are `kinds` kinds of texts of each truth: they start alike but for firing less or more, and differ as far as votes do.
    """
    n, m = votes.shape
    votes = votes.astype(float)
    anchors = [votes[labels == y] for y in (0, 1)]
    known = min(map(len, anchors)) > 0
    start = [(v.sum(axis=0) + 0.5) / (len(v) + 1) for v in anchors] if known else [np.full(m, 0.1), np.full(m, 0.4)]
    truth, tilt = np.repeat([0, 1], kinds), np.linspace(0.5, 1.5, kinds) if kinds > 1 else np.ones(1)
    model = LabelModel(truth, np.where(truth == 1, 0.2, 0.8) / kinds, np.clip(np.concatenate([np.outer(tilt, s) for s in start]), 1e-4, 1 - 1e-4))
    q, mean = model.posterior(votes), votes.mean(axis=0) if n else np.zeros(m)
    for _ in range(steps):
        p = model.kinds(votes)
        size, fired = p.sum(axis=0), p.T @ votes
        share = (size + 1) / (n + len(truth))
        for y, rows in enumerate(anchors):
            if len(rows):
                own = min(1.0, anchor / len(rows)) * model.kinds(rows, y)
                size, fired = size + own.sum(axis=0), fired + own.T @ rows
        of_truth = np.stack([(fired[truth == y].sum(axis=0) + mean) / (size[truth == y].sum() + 1) for y in (0, 1)])[truth]
        rates = np.clip((fired + 2 * of_truth) / (size[:, None] + 2), 1e-4, 1 - 1e-4)
        model = LabelModel(truth, share, rates)
        new = model.posterior(votes)
        change, q = np.abs(new - q).max(initial=0), new
        if change < 1e-6:
            break
    return q, model


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 3000, clean_rows: int = 6000, unlabelled_rows: int = 6000, entries: int = 256) -> Model:
    """Fits a model to at most toxic_rows + clean_rows labelled rows that aren't held out and to unlabelled_rows others, those with the smallest id hashes.

    These samples are bounded by the parameters and so is all that reaches the driver: a table of word parts counted on
    the executors, of which 20 * entries at most return, and a row of votes for each sampled id (of several texts of one
    id the first in order counts). Held-out rows are in neither sample. Rows without a label are no labels; of conflicting labels of
    one id, toxic counts. Without labels of both kinds nothing is learned, and every text scores low.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    known = S.materialise(known, "labels")
    chosen = known.filter("label = 1").orderBy(*order).limit(toxic_rows).unionByName(known.filter("label = 0").orderBy(*order).limit(clean_rows))
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct().join(known, "id", "left_anti")
    chosen = S.materialise(chosen.unionByName(ids.orderBy(*order).limit(unlabelled_rows).withColumn("label", F.lit(-1))), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    texts = S.materialise(texts.select("text", "label"), "sampled")
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Model()
    counted = texts.filter("label >= 0").mapInArrow(_part_counts, "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counted = S.materialise(counted, "parts")
    t, c = F.col("t") / sizes[1], F.col("c") / sizes[0]
    # of so many parts that tell nothing, the one that chance favours most is expected to have this much evidence
    chance = 2 * np.log(max(2, counted.count()))
    scored = counted.withColumn("g", evidence(F.col("t"), F.col("c"), sizes[1], sizes[0])).filter((F.col("g") > chance) & (t >= 4 * c))
    top = scored.orderBy(F.desc("g"), F.desc(F.length("part")), "part").limit(20 * entries).collect()
    lexicon: dict[str, int] = {}
    strength, counts = [], {}
    for r in top:
        same = counts.setdefault((r["t"], r["c"]), [])
        stem = r["part"].strip("=^$")
        if len(lexicon) < entries and not implied(r["part"], lexicon.keys()) and not any(stem in x or x in stem for x in same):
            lexicon[r["part"]] = len(lexicon)
            strength.append(np.log((r["t"] + 0.1) / sizes[1]) - np.log((r["c"] + 0.1) / sizes[0]))
            same.append(stem)
    strength = np.array(strength)
    rows = texts.mapInArrow(_features(spark.sparkContext.broadcast((lexicon, strength))), "toxic int, entries array<int>, counts array<int>, patterns array<double>, words long").collect()  # as many as the sample's ids
    votes = np.zeros((len(rows), len(lexicon) + len(PATTERNS)))
    for i, r in enumerate(rows):
        votes[i, r["entries"]] = 1
        votes[i, len(lexicon) :] = r["patterns"]
    soft, model = label_model(votes, np.array([r["toxic"] for r in rows]))
    weights, bias = logistic(inputs([(r["entries"], r["counts"], r["patterns"], r["words"]) for r in rows], strength), soft, l2=0.3)
    names = [*lexicon, *PATTERNS]
    with_ = model.correlation(1) - np.eye(len(names))
    voters = [{"voter": x, "toxic": float(a), "clean": float(b), "goes_with": names[w.argmax()]} for x, a, b, w in zip(names, model.marginal(1), model.marginal(0), with_, strict=True)]
    return Model(lexicon, strength, weights, bias, voters)


def _score(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = sent.value
        reader = model.reader()
        for b in batches:
            yield S.batch(schema.names, [b.column(0), model.scores(b.column(1).to_pylist(), reader)], schema)

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **settings) -> DataFrame:
    """docs without the rows that score threshold or more; their columns and all other rows stay as they are.

    A null or empty text scores as one on which no voter fires and stays; rows with null or repeated ids are scored by their
    own text; texts of any length are scored whole; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, **settings))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = None
        for t in texts:
            reader = reader or sent.value.reader()
            yield pd.Series(sent.value.scores(list(t), reader), dtype=float)

    return docs.filter(score(F.col(text_col).cast("string")) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **settings) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score (0 to 1, of the whole text alone), predicted (1 if score >= threshold).

    A null or empty text scores as one on which no voter fires. Ids must be integers or cast to them. settings go to fit. Repeated rows give repeated rows;
    other columns of docs and labels are not read; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, **settings)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
