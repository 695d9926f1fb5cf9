"""The interface of a pack, and the audit that all packs share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.operators import words
from corvane.runtime import ship, store


@dataclass(frozen=True)
class Unit:
    """A declared name: lines start..end, the scope in which uses count (file, package, repo or public), how often its own text holds it, why it must stay, or what joins over the repository should look at."""

    kind: str
    name: str
    start: int
    end: int
    scope: str = "repo"
    show: str = ""
    own: int = 1
    keep: str = ""
    hint: str = ""


class Pack:
    """A pack reads one file's text; `languages` are those it handles, `token` tells whether its names may hold hyphens."""

    languages: tuple[str, ...] = ()
    token = "ident"

    def entry(self, rel: str) -> bool:
        """Whether a file is called from outside: its public units are used then."""
        return False

    def units(self, rel: str, text: str) -> Iterator[Unit]:
        """Yields the file's units; raises ValueError when the text can't be read, and nothing of the file is judged then."""
        raise NotImplementedError


_OUT = pa.schema([
    ("repo", pa.string()), ("rel", pa.string()), ("lang", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("show", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
    ("scope", pa.string()), ("keep", pa.bool_()), ("reason", pa.string()), ("own", pa.int32()), ("token", pa.string()), ("error", pa.string()),
])
SCHEMA = "repo string, rel string, lang string, kind string, name string, show string, start int, end int, scope string, keep boolean, reason string, own int, token string, error string"


def _units(packs: dict[str, Pack]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for repo, rel, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = packs[lang]
                try:
                    found = [u for u in p.units(rel, text or "") if u.scope != "public" or not p.entry(rel)]
                except Exception as e:  # one odd file must not stop the audit: it is listed and not judged
                    out.append((repo, rel, lang, *[None] * 10, f"{type(e).__name__}: {e}"[:200]))
                    continue
                out += [(repo, rel, lang, u.kind, u.name, u.show or u.name, u.start, u.end, u.scope, bool(u.keep), u.keep or u.hint, u.own, p.token, None) for u in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)

    return run


def extract(files: DataFrame, packs: list[Pack], most: int = L.PARSE_BYTES) -> DataFrame:
    """Units (SCHEMA) of files (repo, rel, lang, text) that a pack handles and that aren't too long; rows with an error name files that weren't judged."""
    ship(files.sparkSession)
    by = {lang: p for p in packs if not hasattr(p, "frame") for lang in p.languages}
    f = files.filter(F.col("lang").isin(list(by)) & (F.octet_length("text") <= most))
    return f.select("repo", "rel", "lang", "text").mapInArrow(_units(by), SCHEMA)


def audit(files: DataFrame, packs: list[Pack], everything: DataFrame | None = None) -> DataFrame:
    """Findings on units that nothing in their scope mentions. everything (repo, rel, text): all text files whose words count, the judged ones among them."""
    from corvane.packs.nested import DOLLARS, outermost
    from corvane.packs.styles import keep_styles
    from corvane.packs.web import keep_scripts

    every = everything if everything is not None else files
    units = extract(files, packs).filter("error is null")
    for p in packs:
        if hasattr(p, "frame") and not (own := files.filter(F.col("lang").isin(list(p.languages)) & (F.octet_length("text") <= L.PARSE_BYTES))).isEmpty():
            units = units.unionByName(p.frame(own, every))
    units = store(units, "units")
    for p in packs:
        own = F.col("lang").isin(list(p.languages))
        if hasattr(p, "widen") and not units.filter(own).isEmpty():
            units = units.filter(~own).unionByName(p.widen(units.filter(own), every))
    text = F.when(F.col("lang").isin(DOLLARS), F.replace("text", F.lit("$"), F.lit(" "))).otherwise(F.col("text")) if "lang" in every.columns else F.col("text")
    plain_text = every.select("repo", "rel", text.alias("text"))
    idents = units.filter("token = 'ident'").drop("token", "error")
    counts = store(words.named_counts(plain_text, idents), "counts")
    idents = outermost(keep_scripts(store(words.unused_units(idents, counts), "unused"), idents, words.word_counts(plain_text).select("repo", "rel", "word")))
    hyphens = F.contains("name", F.lit("-"))
    css = units.filter("token = 'css'").drop("token", "error")
    if css.isEmpty():
        return idents
    plain, marked = css.filter(~hyphens), css.filter(hyphens).withColumn("name", F.regexp_replace("name", "^-+", ""))
    plain = words.unused_units(plain, store(words.named_counts(every, plain), "counts"))
    marked = words.unused_units(marked, store(words.named_counts(every, marked, css=True), "counts"))
    return idents.unionByName(keep_styles(store(plain.unionByName(marked), "styles"), css, every.select("repo", "rel", "text")))


def too_long(files: DataFrame, packs: list[Pack], most: int = L.PARSE_BYTES) -> DataFrame:
    """repo, rel, lang, bytes of files that a pack handles but whose length keeps them from being read."""
    langs = [lang for p in packs for lang in p.languages]
    size = F.octet_length("text")
    return files.filter(F.col("lang").isin(langs) & (size > most)).select("repo", "rel", "lang", size.cast("long").alias("bytes"))
