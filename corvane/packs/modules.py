"""The export and import graph of JavaScript and TypeScript: an imported name is followed over re-exports to its declaration.

Statements of one file become rows; all that spans files is joins on written tables: specifiers are resolved by path,
re-exports are followed a step a round from what the last round found, over names, defaults, namespaces and stars.
All sides of these joins grow with the files, so none is broadcast through the driver.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import usage
from corvane.runtime import ship, store

SCRIPT = r"\.([cm]?[jt]sx?|vue|svelte|json)$"
_SUFFIX = re.compile(r"\.([cm]?[jt]sx?|vue|svelte|json)$")
_SKIPPED = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_FROM = r"""\s*from\s*(?:'([^'\n]*)'|"([^"\n]*)")"""
_NAME = r"[A-Za-z_$][\w$]*"
_IMPORT = re.compile(r"""^[ \t]*import\s+(?:type\s+(?!from\b))?([^'"`;()]*?)""" + _FROM, re.M)
_RE_EXPORT = re.compile(r"^[ \t]*export\s+(?:type\s+)?\{([^}]*)\}" + _FROM, re.M)
_STAR = re.compile(rf"^[ \t]*export\s+(?:type\s+)?\*\s*(?:as\s+({_NAME})\s*)?" + _FROM, re.M)
_LIST = re.compile(r"^[ \t]*export\s+(?:type\s+)?\{([^}]*)\}(?!\s*from\b)", re.M)
_DEFAULT = re.compile(rf"^[ \t]*export\s+default\s+(?:(?:async\s+)?function\b\s*\*?\s*({_NAME})?|(?:abstract\s+)?class\b(?:\s+(?!extends\b)({_NAME}))?|({_NAME})[ \t]*;?[ \t]*$)?", re.M)
_DECLARED = re.compile(rf"^[ \t]*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\b\s*\*?|class|interface|type|const\s+enum|enum|namespace|const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}}\s*=)", re.M)
_REQUIRE = re.compile(rf"""(?:\b(?:const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}})\s*=\s*)?\b(?:require|import)\s*\(\s*(?:'([^'\n]*)'|"([^"\n]*)")\s*\)""")
_CJS_NAME = re.compile(rf"^[ \t]*(?:module\.)?exports\.({_NAME})\s*=(?!=)", re.M)
_CJS_ALL = re.compile(rf"^[ \t]*module\.exports\s*=(?!=)\s*(?:\{{([^}}]*)\}}|({_NAME}))?", re.M)


def bare(text: str) -> str:
    """text with a space, or a line's end where it holds one, for each comment and template; other strings stay, as specifiers are strings."""
    return _SKIPPED.sub(lambda m: m[0] if m[0][0] in "'\"" else "\n" if "\n" in m[0] else " ", text)


def _pairs(inner: str, word: str = "as") -> Iterator[tuple[str, str]]:
    """(name there, name here) of the items in braces: `a`, `a as b`, `type a`; with ':' for destructured ones."""
    joint = r"\s+as\s+" if word == "as" else r"\s*:\s*"
    for item in inner.split(","):
        item = re.sub(r"=.*$", "", item, flags=re.S).strip() if word == ":" else re.sub(r"^type\s+(?!as\b)", "", item.strip())
        parts = re.split(joint, item)
        if all(re.fullmatch(_NAME, p) for p in parts) and len(parts) <= 2:
            yield parts[0], parts[-1]


def statements(text: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """(kind, name, source, specifier) of a file's imports and exports.

    import: name is bound to what `source` is there (default, * or a name). export: name is the local `source`, null for one
    without a name. from: name is what `source` is there. star: all names but default. whole: a module taken as it is.
    """
    text = bare(text)
    for m in _IMPORT.finditer(text):
        spec, clause = m[2] or m[3] or "", m[1]
        for inner in re.findall(r"\{([^}]*)\}", clause):
            yield from (("import", here, there, spec) for there, here in _pairs(inner))
        for part in re.sub(r"\{[^}]*\}", "", clause).split(","):
            if p := re.fullmatch(rf"\s*(\*\s*as\s+)?({_NAME})\s*", part):
                yield "import", p[2], "*" if p[1] else "default", spec
    for m in _RE_EXPORT.finditer(text):
        yield from (("from", here, there, m[2] or m[3] or "") for there, here in _pairs(m[1]))
    for m in _STAR.finditer(text):
        yield ("from", m[1], "*", m[2] or m[3] or "") if m[1] else ("star", None, None, m[2] or m[3] or "")
    for m in _LIST.finditer(text):
        yield from (("export", here, there, None) for there, here in _pairs(m[1]))
    for m in _DEFAULT.finditer(text):
        yield "export", "default", m[1] or m[2] or m[3], None
    for m in _DECLARED.finditer(text):
        if m[1] and m[1] != "default":
            yield "export", m[1], m[1], None
        elif m[2]:
            yield from (("export", here, here, None) for _, here in _pairs(m[2], ":"))
    for m in _REQUIRE.finditer(text):
        spec = m[3] or m[4] or ""
        if m[2] is not None:
            yield from (("import", here, there, spec) for there, here in _pairs(m[2], ":"))
        else:
            yield "whole", m[1], "*", spec
    for m in _CJS_NAME.finditer(text):
        yield "export", m[1], m[1], None
    for m in _CJS_ALL.finditer(text):
        yield "export", "default", m[2], None
        if m[1]:
            yield from (("export", name, here, None) for name, here in _pairs(m[1], ":"))


def _path(rel: str, spec: str | None) -> tuple[str | None, bool]:
    """The path that a specifier means, without suffix, and whether only its end is known (aliases of a root)."""
    if not spec:
        return None, False
    plain = _SUFFIX.sub("", spec.partition("?")[0])
    if spec.startswith("."):
        return posixpath.normpath(posixpath.join(posixpath.dirname(rel), plain)), False
    if m := re.match(r"(?:[@~#]/|/)(.+)", plain):
        return m[1], True
    return None, False


_FACTS = pa.schema([("repo", pa.string()), ("rel", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("source", pa.string()), ("spec", pa.string()), ("path", pa.string()), ("tail", pa.bool_())])
_DDL = "repo string, rel string, kind string, name string, source string, spec string, path string, tail boolean"


def _facts(batches):
    for b in batches:
        out = []
        for repo, rel, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out += [(repo, rel, *s, *_path(rel, s[3])) for s in dict.fromkeys(statements(text or ""))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FACTS.types, strict=True)], schema=_FACTS)


def facts(files: DataFrame) -> DataFrame:
    """repo, rel, kind, name, source, spec, to: each statement, with the file that its specifier means (null: none here). files: repo, rel, text.

    A file is meant by its path without suffix or, for an index file, by its folder; a file comes before a folder. Of an alias only the
    end is known, so it counts where exactly one file ends like that.
    """
    ship(files.sparkSession)
    said = store(files.filter(F.col("rel").rlike(SCRIPT)).select("repo", "rel", "text").mapInArrow(_facts, _DDL), "statements")
    plain = F.regexp_replace("rel", r"(\.d)?" + SCRIPT, "")
    index = plain.rlike(r"(^|/)index$")
    keys = files.filter(F.col("rel").rlike(SCRIPT)).select("repo", F.col("rel").alias("to"), F.explode(F.array(F.struct(plain.alias("path"), F.lit(0).alias("turn")), F.struct(F.when(index, F.coalesce(F.nullif(F.regexp_replace(plain, "/?index$", ""), F.lit("")), F.lit("."))).alias("path"), F.lit(1).alias("turn")))).alias("k"))
    keys = keys.select("repo", "to", "k.path", "k.turn").filter("path is not null")
    one = keys.groupBy("repo", "path").agg(F.min(F.struct("turn", F.length("to").alias("n"), "to")).alias("first")).select("repo", "path", F.col("first.to").alias("to"))
    parts = F.split("path", "/")
    tails = keys.select("repo", "to", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("path"))
    ends = tails.groupBy("repo", "path").agg(F.min("to").alias("to"), F.count_distinct("to").alias("n")).filter("n = 1").drop("n")
    full = said.filter("path is not null and not tail").join(one.hint("merge"), ["repo", "path"], "left")
    alias = said.filter("path is not null and tail").join(ends.hint("merge"), ["repo", "path"], "left")
    rest = said.filter("path is null").withColumn("to", F.lit(None).cast("string"))
    return store(full.unionByName(alias).unionByName(rest).select("repo", "rel", "kind", "name", "source", "spec", "to"), "facts")


def _steps(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ends: exports declared where they are; links: exports that are another file's; stars: files all of whose names are passed on."""
    local = known.filter("kind = 'export'").select("repo", "rel", "name", "source")
    bound = known.filter("kind in ('import', 'whole')").select("repo", "rel", F.col("name").alias("source"), F.col("source").alias("to_name"), "to", F.lit(True).alias("bound"))
    local = local.join(bound.hint("merge"), ["repo", "rel", "source"], "left")
    ends = local.filter("bound is null").select("repo", "rel", "name", F.coalesce("source", "name").alias("declared"))
    links = local.filter("bound and `to` is not null").select("repo", "rel", "name", "to", "to_name")
    links = links.unionByName(known.filter("kind = 'from' and `to` is not null").select("repo", "rel", "name", "to", F.col("source").alias("to_name")))
    return ends, links, known.filter("kind = 'star' and `to` is not null").select("repo", "rel", "to").distinct()


def exported(known: DataFrame) -> DataFrame:
    """repo, rel, name: every name that can be imported from a file, those that stars pass on among them."""
    own = known.filter("kind in ('export', 'from')").select("repo", "rel", "name").distinct()
    stars = _steps(known)[2]
    behind = usage.reach(stars.select("repo", F.col("rel").alias("start")).distinct(), stars.select("repo", F.col("rel").alias("a"), F.col("to").alias("z")))
    passed = behind.select("repo", F.col("start").alias("to"), F.col("node").alias("rel")).join(own.filter("name <> 'default'").hint("merge"), ["repo", "rel"]).select("repo", F.col("to").alias("rel"), "name")
    return own.unionByName(passed).distinct()


def follow(asked: DataFrame, known: DataFrame) -> DataFrame:
    """repo, rel, name, in_rel, declared, steps: where a name of a file is declared, in how many steps. asked: repo, rel, name.

    A name that a file exports itself hides those that its stars pass on; stars never pass on a default. A namespace ends at its
    file, as *. Two stars may both pass on a name: both are given. Circles end, as a place that was seen isn't asked again.
    """
    ends, links, stars = _steps(known)
    ends, links = store(ends, "ends"), store(links, "links")
    explicit = ends.select("repo", F.col("rel").alias("at"), F.col("name").alias("as")).unionByName(links.select("repo", F.col("rel").alias("at"), F.col("name").alias("as"))).distinct()
    ahead, spread = links.select("repo", F.col("rel").alias("at"), F.col("name").alias("as"), "to", "to_name"), stars.select("repo", F.col("rel").alias("at"), "to")
    place = ["repo", "rel", "name", "at", "as"]
    new = store(asked.select("repo", "rel", "name", F.col("rel").alias("at"), F.col("name").alias("as")).distinct().withColumn("steps", F.lit(0)), "asked")
    seen = new
    while not new.isEmpty():
        go = lambda df, name: df.select("repo", "rel", "name", F.col("to").alias("at"), name.alias("as"), (F.col("steps") + 1).alias("steps"))
        named = go(new.join(ahead.hint("merge"), ["repo", "at", "as"]), F.col("to_name"))
        passed = go(new.filter("`as` not in ('default', '*')").join(explicit.hint("merge"), ["repo", "at", "as"], "left_anti").join(spread.hint("merge"), ["repo", "at"]), F.col("as"))
        found = named.unionByName(passed).groupBy(*place).agg(F.min("steps").alias("steps"))
        new = store(found.join(seen.hint("merge"), place, "left_anti"), "followed")
        seen = seen.unionByName(new)
    here = seen.join(ends.select("repo", F.col("rel").alias("at"), F.col("name").alias("as"), "declared").hint("merge"), ["repo", "at", "as"])
    spaces = seen.filter("`as` = '*'").withColumn("declared", F.lit("*"))
    out = here.unionByName(spaces).select("repo", "rel", "name", F.col("at").alias("in_rel"), "declared", "steps")
    return out.groupBy("repo", "rel", "name", "in_rel", "declared").agg(F.min("steps").alias("steps"))


def imported(known: DataFrame) -> DataFrame:
    """repo, by, name, in_rel, declared: every import of a file, followed to its declaration; a namespace or a module taken whole means all its names."""
    asked = known.filter("kind in ('import', 'whole', 'from') and `to` is not null").select("repo", F.col("rel").alias("by"), F.col("to").alias("rel"), F.col("source").alias("name"))
    every = exported(known)
    whole = asked.filter("name = '*'").drop("name").join(every.hint("merge"), ["repo", "rel"])
    asked = asked.filter("name <> '*'").unionByName(whole).distinct()
    return asked.join(follow(asked.select("repo", "rel", "name").distinct(), known).hint("merge"), ["repo", "rel", "name"]).select("repo", "by", "name", "in_rel", "declared").distinct()


def unused_exports(known: DataFrame, entry: Column | None = None) -> DataFrame:
    """repo, rel, name, declared: exported declarations that no other file imports by any way, files that tools call by their place (entry) aside."""
    ends = _steps(known)[0]
    used = imported(known).filter("by <> in_rel").select("repo", F.col("in_rel").alias("rel"), "declared").distinct()
    return (ends.filter(~entry) if entry is not None else ends).join(used.hint("merge"), ["repo", "rel", "declared"], "left_anti").select("repo", "rel", "name", "declared")
