"""Secrets by rules and by inferred grammars.

Three patterns give the base spans and, with them, labelled credentials. From the credentials of each kind a
prefix tree over character classes is built, and states whose futures are statistically compatible are merged
(Hoeffding bound), which leaves a small probabilistic automaton of that kind's format. Every other token of a text,
from the shortest length of a labelled credential on, is then scored by the likelihood that an automaton gives it,
against that of ordinary tokens: a trigram model of all tokens that aren't labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import _shared as S

#: The patterns of the base spans, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "format"]

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min(LEAST.values()))
#: Where a token may be a credential with something else beside it: full stops round it, then its parts, coarse and fine.
_PARTS = (re.compile(r"^\.+|\.+$"), re.compile(r"[.=/]"), re.compile(r"[+_-]"))
#: Words, numbers and names made of them, as code has them, teach what is ordinary as often as they occur, tokens of any other shape once
#: however many copies there are. It keeps no token from being scored.
WORDS = re.compile(r"(?:[+/_.=-]|[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[A-Za-z](?![A-Za-z0-9])|[0-9]++(?![A-Za-z]))++")
#: Longer tokens are not remembered.
_REMEMBERED = 64
_KEYWORDS = ("passw", "secret", "token", "api")
_SYMBOLS = str.maketrans({c: k for k, cs in {"h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "d": "0123456789"}.items() for c in cs})
_ALPHABET = "hlHUd+/_.=-"
#: Log of the characters that a symbol stands for.
_WIDTH = {c: math.log(n) for c, n in zip(_ALPHABET, (6, 20, 6, 20, 10, 1, 1, 1, 1, 1, 1), strict=True)}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, per kind leftmost and without overlaps; short matches are dropped."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


class Automaton:
    """A probabilistic automaton inferred from counted words by merging compatible states of their prefix tree.

    Two passes. States of one depth are merged first, wherever the Hoeffding bound doesn't tell their futures apart: that
    pools the evidence of a level and keeps how long words are. How many symbols are left is a part of a state's future
    that is counted at the state itself, as deep in the tree hardly a word follows another. Then a state may be merged with one of another depth, which
    makes a loop, but only when at least `evidence` words passed either of them: too few words can't show that length is free.
    """

    def __init__(self, words: dict[str, int], alpha: float = 0.05, evidence: int = 30):
        self.next: list[dict[str, int]] = [{}]
        self.passed, self.ended, self.taken, self.left = [0], [0], [Counter()], [Counter()]
        for word, n in words.items():
            at = 0
            for i, c in enumerate(word):
                self.passed[at] += n
                self.taken[at][c] += n
                self.left[at][len(word) - i] += n
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.passed.append(0)
                    self.ended.append(0)
                    self.taken.append(Counter())
                    self.left.append(Counter())
                at = self.next[at][c]
            self.passed[at] += n
            self.ended[at] += n
            self.left[at][0] += n
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merged_into = list(range(len(self.next)))
        level = [0]
        while level := self._heads(level):
            self._settle([], level, 0)
        self.red = [0]
        while blue := [s for s in self._heads(self.red) if s not in self.red]:
            self._settle(self.red, blue[:1], evidence)
            self.red = list(dict.fromkeys(map(self._find, self.red)))

    def _find(self, s: int) -> int:
        while (t := self.merged_into[s]) != s:
            self.merged_into[s] = s = self.merged_into[t]
        return s

    def _heads(self, states: list[int]) -> list[int]:
        """States that one symbol leads to, those that most words pass first."""
        found = {self._find(t) for s in states for t in self.next[s].values()}
        return sorted(found, key=lambda s: (-self.passed[s], s))

    def _settle(self, settled: list[int], states: list[int], evidence: int) -> None:
        """Merges each state into a settled one that is compatible with it; where there is none, it is settled too."""
        for s in states:
            s = self._find(s)
            for r in settled:
                if min(self.passed[r], self.passed[s]) >= evidence and self._compatible(r, s):
                    self._merge(r, s)
                    break
            else:
                settled.append(s)

    def _apart(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, r: int, b: int) -> bool:
        todo, seen = [(r, b)], set()
        while todo:
            x, y = todo.pop()
            x, y = self._find(x), self._find(y)
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            n, m = self.passed[x], self.passed[y]
            for f, g in ((self.left[x], self.left[y]), (self.taken[x], self.taken[y])):
                if any(self._apart(f[k], n, g[k], m) for k in f.keys() | g.keys()):
                    return False
            todo += [(self.next[x][c], t) for c, t in self.next[y].items() if c in self.next[x]]
        return True

    def _merge(self, r: int, b: int) -> None:
        """Makes one state of two and, as a symbol leads to one state only, of the states behind them."""
        todo = [(r, b)]
        while todo:
            x, y = map(self._find, todo.pop())
            if x == y:
                continue
            self.merged_into[y] = x
            self.passed[x] += self.passed[y]
            self.ended[x] += self.ended[y]
            self.taken[x] += self.taken[y]
            self.left[x] += self.left[y]
            for c, t in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], t))
                else:
                    self.next[x][c] = t

    def table(self) -> list[dict[str, tuple[int, float]]]:
        """Of each state, symbol -> (state, log probability); '' is the end. Unseen symbols have a small share."""
        index = {s: i for i, s in enumerate(self.red)}
        rows = []
        for s in self.red:
            total = self.passed[s] + 0.5 * (len(_ALPHABET) + 1)
            row = {c: (index[self._find(t)], math.log((self.taken[s][c] + 0.5) / total)) for c, t in self.next[s].items()}
            row[""] = (index[s], math.log((self.ended[s] + 0.5) / total))
            row["?"] = (index[s], math.log(0.5 / total))
            rows.append(row)
        return rows


def likelihood(table: list[dict], symbols: str, least: float = -math.inf) -> float:
    """Log likelihood of a word of symbols; minus infinity as soon as it is below least."""
    at, total = 0, 0.0
    for c in symbols:
        at, p = table[at].get(c) or table[at]["?"]
        total += p
        if total < least:
            return -math.inf
    return total + table[at][""][1]


def trigrams(word: str) -> list[str]:
    """Three characters each: a word's with its two starts (^) and its end ($), which no token holds."""
    w = f"^^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Ordinary:
    """A trigram model of the characters of ordinary tokens; what is rare leans on bigrams and single characters.

    `lean` is high so that a word's own few trigrams, which are counted too, don't make it ordinary.
    """

    def __init__(self, counts: dict[str, int], lean: float = 50.0):
        self.lean, self.n, self.heads = lean, Counter(), Counter()
        for t, n in counts.items():
            for k in (1, 2, 3):
                self.n[t[3 - k :]] += n
                self.heads[t[3 - k : 2], k] += n
        self.known = {t: self._log(t) for t in counts}

    def _log(self, t: str) -> float:
        p = 1 / 69  # characters of TOKEN and the end
        for k in (1, 2, 3):
            p = (self.n[t[3 - k :]] + self.lean * p) / (self.heads[t[3 - k : 2], k] + self.lean)
        return math.log(p)

    def likelihood(self, word: str) -> float:
        known = self.known
        return sum(p if (p := known.get(t)) is not None else self._log(t) for t in trigrams(word))


def _classes(value: str) -> str:
    """Which of lower case, upper case, digits and other characters a value has."""
    return "".join(sorted({"h": "l", "l": "l", "H": "U", "U": "U", "d": "d"}.get(c, ".") for c in set(value.translate(_SYMBOLS))))


class Grammars:
    """Automata by kind, a model of ordinary words, and floors: the log of how many ordinary tokens there are for a credential.

    A kind has an automaton of all its credentials and one for each set of character classes that five or more have, as
    one kind can hold several formats. A token is of a kind when an automaton's likelihood is over that of ordinary words by the
    floor, so words taken for credentials are expected to be no more than credentials. recall: by kind, the share of credentials
    that reach a floor when every fifth is left out of the fit and only those are tried.
    """

    def __init__(self, credentials: dict[str, list[str]], counts: dict[str, int], distinct: dict[str, int] | None = None):
        self.plain, self.kinds, self.recall = Ordinary(counts), {}, {}
        self.tokens = sum(n for t, n in counts.items() if t[2] == "$")
        for kind, values in credentials.items():
            if len(values) >= 5:
                times, rest = (distinct or {}).get(kind, len(values)) / len(values), values[::5]
                part = self._fit([v for i, v in enumerate(values) if i % 5], times * 1.25, 4)
                self.recall[kind] = sum(self._over(v, part, self.plain.likelihood(v)) > -math.inf for v in rest) / len(rest)
                self.kinds[kind] = self._fit(values, times)

    def _fit(self, values: list[str], times: float, least: int = 5) -> list[tuple[list[dict], float]]:
        """(automaton, floor) of values and of each large enough group of them; there are `times` as many credentials as values."""
        groups = {}
        for v in values:
            groups.setdefault(_classes(v), []).append(v)
        sets = [values] + [g for _, g in sorted(groups.items()) if least <= len(g) < len(values)]
        return [(Automaton(Counter(v.translate(_SYMBOLS) for v in g)).table(), max(0.0, math.log(max(self.tokens, 1) / (times * len(g))))) for g in sets]

    def _over(self, value: str, automata: list[tuple[list[dict], float]], plain: float) -> float:
        """The most that a log likelihood of value is over that of ordinary words (plain); minus infinity if no floor is reached."""
        symbols = value.translate(_SYMBOLS)
        less = plain + sum(map(_WIDTH.__getitem__, symbols))
        return max((g for t, floor in automata if (g := likelihood(t, symbols, less + floor) - less) >= floor), default=-math.inf)

    def best(self, value: str) -> tuple[float, str | None]:
        """The best log likelihood over ordinary words among kinds of which a floor is reached, and that kind."""
        plain = self.plain.likelihood(value)
        return max(((g, k) for k, automata in self.kinds.items() if (g := self._over(value, automata, plain)) > -math.inf), default=(0.0, None))

    def find(self, token: str, at: int = 0, level: int = 0) -> list[tuple[float, int, int, str]]:
        """(log likelihood over ordinary words, start, end, kind) of a token: it as a whole unless a part of it is likelier, else its parts.

        Full stops round a token are the sentence's if what they enclose is found without them.
        """
        if len(token) < min(LEAST.values()):
            return []
        parts, was = [], 0
        while level < len(_PARTS) and not parts:
            cuts = [m.span() for m in _PARTS[level].finditer(token)]
            level += 1
            if cuts:
                for s, e in cuts + [(len(token), len(token))]:
                    parts.append((was, s))
                    was = e
        inner = [x for s, e in parts for x in self.find(token[s:e], at + s, level)]
        if inner and (token[0] == "." or token[-1] == "."):
            return inner
        gain, kind = self.best(token)
        return [(gain, at, at + len(token), kind)] if kind and all(gain >= x[0] for x in inner) else inner


def tokens(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, str]]:
    """(start, token) of what may be a credential: runs of the credential alphabet, without what base spans cover."""
    spans = sorted((s, e) for s, e, _, _ in base)
    for m in TOKEN.finditer(text):
        at, end = m.span()
        if not spans:
            yield at, m[0]
            continue
        for s, e in spans + [(end, end)]:
            if s <= end and e >= at:
                if s - at >= min(LEAST.values()):
                    yield at, text[at:s]
                at = max(at, e)


_LABELS = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credentials that the base patterns find with their kind; tokens that aren't words (kind odd); the trigrams of words with counts (kind plain)."""
    plain = Counter()
    for b in batches:
        out, others = set(), Counter()
        for text in b.column(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            out.update((k, v) for _, _, k, v in spans)
            others.update(t for _, t in tokens(text, spans))
        for token, n in others.items():
            if WORDS.fullmatch(token):
                for t in trigrams(token):
                    plain[t] += n
            else:
                out.add(("odd", token))
        yield S.batch(_LABELS.names, [[k for k, _ in out], [v for _, v in out], [1] * len(out)], _LABELS)
    yield S.batch(_LABELS.names, [["plain"] * len(plain), list(plain), list(plain.values())], _LABELS)


def _odd_trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = Counter()
    for b in batches:
        for token in b.column(0).to_pylist():
            n.update(trigrams(token))
    yield S.batch(_LABELS.names, [["odd"] * len(n), list(n), list(n.values())], _LABELS)


_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def _scan(sent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars, rank, known = sent.value, {k: i for i, k in enumerate(KINDS)}, {}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(s, e, k, None) for s, e, k, _ in base]
                if grammars.kinds:
                    for at, token in tokens(text, base):
                        hits = known.get(token)
                        if hits is None:
                            hits = grammars.find(token)
                            if len(token) <= _REMEMBERED:
                                if len(known) > S.CACHE_WORDS:
                                    known.clear()
                                known[token] = hits
                        spans += [(at + s, at + e, "format", g / (e - s)) for g, s, e, _ in hits]
                out.append([{"kind": k, "start": s, "end": e, "score": g} for s, e, k, g in sorted(spans, key=lambda x: (x[0], rank[x[2]]))])
            yield S.batch(_FOUND.names, [b.column(0), out], _FOUND)

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, sample_chars: int = 200_000) -> DataFrame:
    """A row per row of docs: doc_id, spans (kind, start, end, score; ends exclusive, in code points, by start, then kind).

    Kinds assign, access and hex are the base patterns' and have no score; format is an inferred grammar's, with its
    gain per character over ordinary tokens; tokens from the shortest labelled length on are tried, as wholes and in parts,
    and likelihood alone decides. The trigrams of all ordinary tokens are counted over the whole table. Grammars are fitted to
    at most `sample` distinct credentials of each kind and `sample_chars` characters of them, those with the smallest
    hashes among all that the whole table holds, so they are the same however the table is dealt; a credential of any
    length may be among them. A kind of which the table holds fewer than five gets no grammar. Texts are scanned whole, however long. A null text is empty and has no spans; without credentials there
    are base spans only. Ids must be integers or cast to them. Repeated rows give repeated rows; an empty table gives
    an empty result; other columns of docs are not read.
    """
    spark = docs.sparkSession
    S.prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "kind string, value string, n long"
    seen = S.materialise(rows.select("text").mapInArrow(_candidates, shape).groupBy("kind", "value").agg(F.sum("n").alias("n")), "candidates")
    labelled = seen.filter(F.col("kind").isin(*LEAST)).withColumn("h", F.xxhash64("value"))
    kinds = {}
    for kind in LEAST:
        # the window runs over at most `sample` rows
        some = labelled.filter(F.col("kind") == kind).orderBy("h", "value").limit(sample)
        upto = F.sum(F.length("value")).over(W.partitionBy("kind").orderBy("h", "value"))
        kinds[kind] = [r["value"] for r in some.withColumn("upto", upto).filter(F.col("upto") <= sample_chars).orderBy("h", "value").select("value").collect()]
    distinct = {r["kind"]: r["count"] for r in labelled.groupBy("kind").count().collect()}
    odd = seen.filter("kind = 'odd'").select("value").mapInArrow(_odd_trigrams, shape).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    # one less of each, so that no odd token speaks for itself
    ordinary = seen.filter("kind = 'plain'").unionByName(odd.withColumn("n", F.col("n") - 1).filter("n > 0"))
    counts = {r["value"]: r["n"] for r in ordinary.groupBy("value").agg(F.sum("n").alias("n")).collect()}  # at most the alphabet to the power of three
    grammars = Grammars(kinds, counts, distinct)
    found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(grammars)), "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return found
