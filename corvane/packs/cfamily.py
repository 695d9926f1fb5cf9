"""C and C++: static functions and variables of source files, judged over what the preprocessor joins: includes, includers and pasted names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import usage, words
from corvane.packs.base import Pack, Unit
from corvane.packs.web import blank
from corvane.runtime import store

SOURCE = r"(?i)\.(c|cc|cpp|cxx)$"
# --- fixed values: names that a run time or C++ calls unnamed, attributes and macros that keep, files that the preprocessor or a script reads
ENTRY = {"main", "wmain", "WinMain", "wWinMain", "DllMain", "_start", "LLVMFuzzerTestOneInput", "LLVMFuzzerInitialize"}
BY_ARGUMENT = {"begin", "end", "cbegin", "cend", "rbegin", "rend", "size", "data", "empty", "swap", "get", "hash_value", "to_json", "from_json", "serialize", "save", "load", "tag_invoke", "format_as", "PrintTo", "AbslHashValue", "AbslStringify"}
KEEPING = r"(?:__attribute__\s*\(\(|\[\[|__declspec\s*\()[^)\]]*\b_{0,2}(?:used|unused|maybe_unused|constructor|destructor|section|alias|ifunc|weak|weakref|externally_visible|visibility|retain|dllexport|allocate)\b"
KEEPING_NAME = r"\b(?:__unused|_unused|__maybe_unused|__used|__visible|asmlinkage|[A-Z0-9_]*(?:EXPORT|UNUSED|KEEPALIVE)[A-Z0-9_]*|(?:[A-Z0-9]+_)*(?:API|USED)(?:_[A-Z0-9]+)*)\b"
PREPROCESSED = r"(?i)\.(c|h|cc|cpp|cxx|hpp|hh|hxx|c\+\+|h\+\+|inc|inl|ipp|tpp|tcc|def|x|tbl|y|yy|ypp|l|ll|lex|cu|cuh|m|mm|ino|pde|s|sx|rc|pc|ec|cl|metal)$"
SCRIPTS = r"(?i)\.(sh|bash|zsh|py|pl|pm|t|rb|tcl|exp|js|mjs|ts|lua|ps1|bat|cmd)$"
PARSED = r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$"

_SECTIONS = re.compile(r"(?m)^[ \t]*#[ \t]*pragma[ \t]+(data_seg|const_seg|bss_seg|section|init_seg|clang[ \t]+section)\b")
_COMPUTED = r"(?m)^[ \t]*#[ \t]*include[ \t]+[A-Za-z_]"
_FUNCTION = re.compile(r"^(?!\s|#|typedef\b|return\b|else\b|using\b|namespace\b|class\b|enum\b)((?:template\s*<[^{};]*>\s*)?[\w<>:,*&\s\[\]()]*?)[\s*&]([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*(?:const\s*|noexcept\s*|override\s*|->[^{;]*)*\{", re.M)
_VARIABLE = re.compile(r"^(static\b[^;{}()=]*?)[\s*&]([A-Za-z_]\w*)\s*((?:\[[^\]]*\]\s*)*)(=[^;]*|\{[^;]*)?;", re.M)
_PLAIN_TYPE = re.compile(r"\b(?:void|bool|char|short|int|long|float|double|signed|unsigned|size_t|u?int\d*_t)\b")


class CFamilyPack(Pack):
    """Static functions and file variables; functions of external linkage are judged, not removed. Headers belong to whoever includes them.

    What spans files is widen()'s: a static is looked for in all that its file includes, in the whole repository if another file includes its file.
    """

    languages = ("C", "C++")

    def units(self, rel, text):
        if not re.search(SOURCE, rel):
            return
        clean = blank(text, r"""(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")
        code = blank(clean, r"(?m)^[ \t]*#(?:[^\n]*\\\r?\n)*[^\n]*")
        if code.count("{") != code.count("}"):
            raise ValueError("braces don't match")
        line = lambda at: text.count("\n", 0, at) + 1
        plain_c = rel.endswith(".c")
        hidden = self._unnamed(code)
        whole = "a pragma places its file's names in a section" if _SECTIONS.search(text) else "an include is computed" if re.search(_COMPUTED, clean) else ""
        for m in _FUNCTION.finditer(code):
            head, name = m[1], m[2]
            if name in ENTRY or (not plain_c and name in BY_ARGUMENT) or re.search(r"[:~]\s*$|\boperator\b|\b(?:if|for|while|switch)\s*$", head) or name in ("if", "for", "while", "switch", "return", "sizeof"):
                continue
            end = self._close(code, m.end() - 1)
            static = bool(re.search(r"\bstatic\b", head)) or any(a <= m.start() < b for a, b in hidden)
            keep = whole or self._kept(text[m.start() : m.end()])
            yield Unit("function", name, line(m.start()), line(end), "file" if static else "public", own=self._times(name, text[m.start() : end + 1]), keep=keep, hint="" if keep else "head:" + " ".join(sorted(set(re.findall(r"[A-Za-z_]\w*", head)))))
        for m in _VARIABLE.finditer(code):
            head, name, value = m[1], m[2], m[4] or ""
            if re.search(r"\b(?:struct|union|enum|class)\b[^;]*\{", m[0]) or "," in re.sub(r"\{[^{}]*\}|\([^()]*\)|<[^<>]*>", "", m[0]):
                continue
            keep = whole or self._kept(m[0])
            if not keep and re.search(r'"\s*(@\(#\)|\$(Id|Header|Revision)\b)', text[m.start() : m.end()]):
                keep = "a version string that tools look for"
            if not keep and not plain_c and "*" not in text[m.start() : m.start(2)] and (not _PLAIN_TYPE.search(head) or re.search(r"\w\s*\(|\bnew\b", value)):
                keep = "building its value may run code"
            yield Unit("variable", name, line(m.start()), line(m.end()), "file", own=self._times(name, text[m.start() : m.end()]), keep=keep, hint="" if keep else "head:" + " ".join(sorted(set(re.findall(r"[A-Za-z_]\w*", head)))))

    @staticmethod
    def _times(name: str, text: str) -> int:
        return len(re.findall(rf"(?<![\w$]){re.escape(name)}(?![\w$])", text))

    @staticmethod
    def _close(code: str, at: int) -> int:
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, at):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.start()
        return len(code) - 1

    def _unnamed(self, code: str) -> list[tuple[int, int]]:
        return [(m.start(), self._close(code, m.end() - 1)) for m in re.finditer(r"\bnamespace\s*\{", code)]

    @staticmethod
    def _kept(said: str) -> str:
        return "an attribute keeps it" if re.search(KEEPING, said, re.S) else "a macro exports or keeps it" if re.search(KEEPING_NAME, said.partition("{")[0].partition("=")[0]) else ""

    def widen(self, units: DataFrame, everything: DataFrame) -> DataFrame:
        return widen(units, everything)


def includes(files: DataFrame) -> DataFrame:
    """repo, rel, target, quoted, to: each include and every file of the repository that it may mean - any whose path ends with it (null: none). files: repo, rel, text."""
    lines = S.all_matches(F.col("text"), r"""(?m)^[ \t]*#[ \t]*include(?:_next)?[ \t]*[<"][^>"\n]+[>"]""")
    said = files.filter(F.col("rel").rlike(PARSED)).select("repo", "rel", F.explode(F.array_distinct(lines)).alias("line"))
    parts = F.filter(F.split(F.replace(F.regexp_extract("line", r"""[<"]([^>"\n]+)""", 1), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    said = store(said.select("repo", "rel", F.array_join(parts, "/").alias("target"), F.contains("line", F.lit('"')).alias("quoted")).filter("target <> ''"), "said").withColumn("base", S.base_name(F.col("target")))
    known = files.select("repo", F.col("rel").alias("to"), S.base_name(F.col("rel")).alias("base"))
    found = said.join(known, ["repo", "base"]).filter(F.endswith(F.concat(F.lit("/"), "to"), F.concat(F.lit("/"), "target")))
    return said.drop("base").join(found.select("repo", "rel", "target", "quoted", "to"), ["repo", "rel", "target", "quoted"], "left")


def translation_units(files: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, rel, part: every file that a source file includes, directly or by others. edges: includes with a file."""
    sources = files.filter(F.col("rel").rlike(SOURCE)).select("repo", F.col("rel").alias("start"))
    parts = usage.reach(sources, edges.select("repo", F.col("rel").alias("a"), F.col("to").alias("z")))
    return parts.filter("start <> node").select("repo", F.col("start").alias("rel"), F.col("node").alias("part"))


_DEFINE = r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\()?((?:[^\n]*\\\r?\n)*[^\n]*)"


def macros(files: DataFrame) -> DataFrame:
    """repo, rel, name, takes (whether it has parameters), body of each macro that is defined."""
    d = files.filter(F.col("rel").rlike(PARSED)).select("repo", "rel", F.explode(S.all_matches(F.col("text"), _DEFINE)).alias("d"))
    return d.select("repo", "rel", F.regexp_extract("d", _DEFINE, 1).alias("name"), (F.regexp_extract("d", _DEFINE, 2) != "").alias("takes"), F.regexp_extract("d", _DEFINE, 3).alias("body"))


def spreading(known: DataFrame, first: Column, by: Column) -> DataFrame:
    """repo, name: macros for which first holds, and those for which `by` holds and whose bodies name one of these, to the end.

    A flood over the graph from macros to the bodies that name them: a round follows only what the last one found, and only reached names are kept.
    """
    body = F.array_distinct(S.all_matches(F.col("body"), r"[A-Za-z_]\w*"))
    edges = known.filter(by).select("repo", F.explode(body).alias("a"), F.col("name").alias("z")).filter("a <> z")
    edges = edges.join(known.select("repo", F.col("name").alias("a")).distinct(), ["repo", "a"], "left_semi")
    return usage.flood(known.filter(first).select("repo", F.col("name").alias("node")).distinct(), edges).select("repo", F.col("node").alias("name"))


_CALL = r"\b([A-Za-z_]\w*)\s*\((?=((?:[^()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))*+))"


def pasted(files: DataFrame, known: DataFrame) -> DataFrame:
    """repo, rel, word: words that a file hands to a macro that pastes, or to an unknown one in capitals at a line's start; calls inside macros' bodies aside.

    Of a file that isn't parsed, a list for such macros perhaps, every word counts where the repository pastes at all.
    """
    pasting = store(spreading(known, F.col("takes") & F.col("body").contains("##"), F.col("takes")), "pasting")
    code = files.filter(F.col("rel").rlike(PARSED)).select("repo", "rel", F.regexp_replace("text", r"(?m)^[ \t]*#[ \t]*define[ \t]+[A-Za-z_]\w*\((?:[^\n]*\\\r?\n)*[^\n]*", "").alias("text"))
    calls = lambda pattern: code.select("repo", "rel", F.explode(F.arrays_zip(S.all_matches(F.col("text"), pattern, 1).alias("name"), S.all_matches(F.col("text"), pattern, 2).alias("args"))).alias("c")).select("repo", "rel", F.col("c.name").alias("name"), F.col("c.args").alias("args"))
    own = calls(_CALL).join(pasting, ["repo", "name"], "left_semi")
    foreign = calls(r"(?m)^([A-Z][A-Z0-9_]*)[ \t]*\((?=((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+))").join(known.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    handed = own.unionByName(foreign).select("repo", "rel", F.explode(S.all_matches(F.col("args"), r"[A-Za-z_]\w+")).alias("word"))
    lists = files.filter(~F.col("rel").rlike(PARSED) & F.col("rel").rlike(PREPROCESSED)).join(pasting.select("repo").distinct(), "repo", "left_semi")
    return handed.unionByName(lists.select("repo", "rel", F.explode(S.all_matches(F.col("text"), r"[A-Za-z_]\w+")).alias("word"))).distinct()


def includers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, rel, by: files that include a source file, directly or not; files that aren't parsed but say `include` and its name; with computed includes any that names it."""
    sources = files.filter(F.col("rel").rlike(SOURCE)).select("repo", F.col("rel").alias("start"))
    back = usage.reach(sources, edges.select("repo", F.col("to").alias("a"), F.col("rel").alias("z")).filter("a <> z")).filter("start <> node").select("repo", F.col("start").alias("rel"), F.col("node").alias("by"))
    computed = files.filter(F.col("rel").rlike(PARSED) & F.col("text").rlike(_COMPUTED)).select("repo").distinct().withColumn("computed", F.lit(True))
    spelled = files.join(computed, "repo", "left").filter(F.col("computed") | (~F.col("rel").rlike(PARSED) & F.col("rel").rlike(PREPROCESSED) & F.col("text").rlike(r"\binclude\b")))
    spelled = spelled.select("repo", F.col("rel").alias("by"), F.explode(F.array_distinct(S.all_matches(F.col("text"), r"(?i)(?<![\w.-])[\w.+-]+\.(?:c|cc|cpp|cxx)(?![\w-])"))).alias("base"))
    named = sources.withColumn("base", S.base_name(F.col("start"))).join(spelled, ["repo", "base"]).filter("by <> start").select("repo", F.col("start").alias("rel"), "by")
    return back.unionByName(named).distinct()


def widen(units: DataFrame, everything: DataFrame) -> DataFrame:
    """Units of C files with what the preprocessor adds: those that an included file names go; a file that is included, read by a
    script or includes a header made later shares its statics with the repository; pasted names and those behind a keeping macro are kept."""
    files = everything.select("repo", "rel", "text")
    known, edges = store(macros(files), "macros"), store(includes(files), "includes")
    to = edges.filter("`to` is not null and `to` <> rel")
    sources = files.filter(F.col("rel").rlike(SOURCE)).select("repo", F.col("rel").alias("start"))
    unit_files = store(translation_units(files, to), "translation-units")
    by = store(includers(files, to), "includers")

    counts = words.word_counts(files).select("repo", F.col("rel").alias("part"), F.col("word").alias("name"))
    named = unit_files.join(counts, ["repo", "part"]).join(units.select("repo", "rel", "name").distinct(), ["repo", "rel", "name"], "left_semi").select("repo", "rel", "name").distinct()
    u = units.join(named.withColumn("scope", F.lit("file")), ["repo", "rel", "name", "scope"], "left_anti")

    scripts = files.filter(F.col("rel").rlike(SCRIPTS)).select("repo", F.explode(S.all_matches(F.col("text"), r"(?i)(?<![\w.-])[\w.+-]+\.(?:c|cc|cpp|cxx)(?![\w-])")).alias("base")).distinct()
    read = sources.withColumn("base", S.base_name(F.col("start"))).join(scripts, ["repo", "base"], "left_semi").select("repo", F.col("start").alias("rel"))
    made = edges.filter("quoted and `to` is null").filter(~F.lower(S.base_name(F.col("target"))).contains("conf")).select("repo", "rel")
    shared = by.select("repo", "rel").unionByName(read).unionByName(made).distinct().withColumn("shared", F.lit(True))

    keeping = spreading(known, F.col("body").rlike("(?s)" + KEEPING) | F.col("body").rlike(KEEPING_NAME), F.lit(True)).withColumnRenamed("name", "macro")
    heads = u.filter("not keep and startswith(reason, 'head:')").select("repo", "rel", "name", "start", F.explode(F.split(F.substring("reason", 6, 100_000), " ")).alias("macro"))
    kept = heads.join(keeping, ["repo", "macro"]).groupBy("repo", "rel", "name", "start").agg(F.min("macro").alias("macro"))

    through = sources.select("repo", F.col("start").alias("rel"), F.col("start").alias("part")).unionByName(unit_files)
    up = by.select("repo", "rel", F.col("by").alias("part"))
    over = up.select("repo", "rel", F.col("part").alias("mid")).join(unit_files.select("repo", F.col("rel").alias("mid"), "part"), ["repo", "mid"]).select("repo", "rel", "part")
    through = through.unionByName(up).unionByName(over).distinct()
    handed = pasted(files, known).select("repo", F.col("rel").alias("part"), "word")
    n = F.length("name")
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(n - i + 1, F.lit(2))), lambda k: F.substr("name", i, k)))))
    names = u.filter("length(name) > 2").select("repo", "rel", "name").distinct().withColumn("word", F.explode(pieces)).filter("word <> name and length(word) > 1")
    glued = names.join(handed, ["repo", "word"]).join(through, ["repo", "rel", "part"], "left_semi").groupBy("repo", "rel", "name").agg(F.max_by("word", F.length("word")).alias("glued"))

    u = u.join(shared, ["repo", "rel"], "left").join(kept, ["repo", "rel", "name", "start"], "left").join(glued, ["repo", "rel", "name"], "left")
    why = F.when(F.col("keep"), F.col("reason")).when(F.col("macro").isNotNull(), F.concat("macro", F.lit(" stands for an attribute that keeps it"))).when(F.col("glued").isNotNull(), F.concat(F.lit("a macro pastes names from "), "glued"))
    u = u.withColumn("scope", F.when((F.col("scope") == "file") & F.col("shared"), "repo").otherwise(F.col("scope")))
    return u.withColumn("keep", F.col("keep") | why.isNotNull()).withColumn("reason", F.coalesce(why, F.lit(""))).select(*units.columns)


PACKS = [CFamilyPack()]
