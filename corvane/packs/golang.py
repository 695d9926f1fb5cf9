"""Go: unexported functions, types, variables and constants of a package, which is a folder with all its files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.packs.base import Pack, Unit
from corvane.packs.web import blank

# --- fixed values: names never judged, calls that only build a value
SKIPPED = {"init", "main", "_"}
PURE = {"errors.New", "fmt.Errorf", "fmt.Sprintf", "fmt.Sprint", "regexp.MustCompile", "strings.NewReplacer", "time.Duration", "big.NewInt", "reflect.TypeOf", "template.HTML", "filepath.Join", "path.Join"}
BUILTINS = set("make new len cap append complex real imag min max string byte rune bool int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 any error func".split())

_DIRECTIVES = (("//export ", "C code calls it by name"), ("//go:wasmexport", "the host calls it by name"), ("//go:linkname", "it is linked by name"), ("//go:generate", "a directive sits on it"))
_NAME = r"(?P<name>[a-z_]\w*)"


class GoPack(Pack):
    """Kept: what a directive above exports or links, functions without a body, values whose making may run code, constants that count.

    What another package links to by name is widen()'s.
    """

    languages = ("Go",)

    def units(self, rel, text):
        clean = blank(text, r"""(?s)/\*.*?\*/|//[^\n]*|`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")
        clean = re.sub(r"\b(?:interface|struct)\s*\{\s*\}", lambda m: re.sub(r"[{}]", "_", m[0]), clean)
        if clean.count("{") != clean.count("}"):
            raise ValueError("braces don't match")
        lines, said = clean.split("\n"), text.split("\n")
        i = 0
        while i < len(lines):
            head = lines[i]
            if m := re.match(rf"func\s+{_NAME}\s*[\[(]", head):
                end = self._end(lines, i)
                body = any("{" in x for x in lines[i : end + 1])
                yield from self._unit("function", m["name"], i, end, lines, said, "" if body else "it has no body: it is written or linked elsewhere")
                i = end
            elif m := re.match(r"(var|const|type)\s*\(\s*$", head):
                close = next((k for k in range(i + 1, len(lines)) if lines[k].startswith(")")), len(lines) - 1)
                group = "\n".join(lines[i + 1 : close])
                counts = m[1] == "const" and bool(re.search(r"\biota\b", group) or re.search(r"(?m)^\s+[\w, ]+$", group))
                k = i + 1
                while k < close:
                    end = min(self._end(lines, k), close - 1)
                    if s := re.match(rf"\s+{_NAME}(?!\s*,)\b", lines[k]):
                        yield from self._spec(m[1], s["name"], k, end, lines, said, "a place in a group that counts" if counts else "")
                    k = end + 1
                i = close
            elif m := re.match(rf"(var|const|type)\s+{_NAME}(?!\s*,)\b", head):
                end = self._end(lines, i)
                yield from self._spec(m[1], m["name"], i, end, lines, said, "")
                i = end
            i += 1

    def _spec(self, what, name, i, end, lines, said, keep):
        value = "\n".join(lines[i : end + 1]).partition("=")[2]
        value = re.sub(r"(?s)\bfunc\b.*", "", value)
        calls = {c for c in re.findall(r"([\w.]+)\s*(?:\[[^\]]*\])?\(", value)} - PURE - BUILTINS
        if what == "var" and calls and not keep:
            keep = "its value is made by a call, which may register something"
        yield from self._unit("type" if what == "type" else "variable", name, i, end, lines, said, keep)

    @staticmethod
    def _unit(kind, name, i, end, lines, said, keep):
        if name in SKIPPED:
            return
        above = i
        while above and said[above - 1].lstrip().startswith("//"):
            above -= 1
            keep = keep or next((why for d, why in _DIRECTIVES if said[above].lstrip().startswith(d)), "")
        body = "\n".join(said[above : end + 1])  # a comment above names what it is about
        yield Unit(kind, name, i + 1, end + 1, "package", own=len(re.findall(rf"(?<![\w$]){re.escape(name)}(?![\w$])", body)), keep=keep)

    @staticmethod
    def _end(lines: list[str], i: int) -> int:
        depth = 0
        for k in range(i, len(lines)):
            depth += sum(map(lines[k].count, "{([")) - sum(map(lines[k].count, "})]"))
            if depth <= 0:
                return k
        return len(lines) - 1

    def widen(self, units: DataFrame, everything: DataFrame) -> DataFrame:
        """Units that a directive of any Go file links to by name are kept, with the file that does."""
        by = linked(everything).groupBy("repo", "name").agg(F.min("rel").alias("by"))
        u = units.join(by, ["repo", "name"], "left")
        why = F.when(~F.col("keep") & F.col("by").isNotNull(), F.concat("by", F.lit(" links to it by name")))
        return u.withColumn("keep", F.col("keep") | F.col("by").isNotNull()).withColumn("reason", F.coalesce(why, "reason")).select(*units.columns)


def linked(files: DataFrame) -> DataFrame:
    """repo, rel, path, name: what the link directives of Go files reach - an import path and a name in that package."""
    said = S.all_matches(F.col("text"), r"(?m)^//go:linkname[ \t]+\S+[ \t]+(\S+)", 1)
    t = files.filter(F.col("rel").endswith(".go")).select("repo", "rel", F.explode(F.array_distinct(said)).alias("target"))
    return t.select("repo", "rel", F.regexp_extract("target", r"^(.*)[./]\w+$", 1).alias("path"), F.regexp_extract("target", r"[./](\w+)$", 1).alias("name")).filter("name <> ''")


PACKS = [GoPack()]
