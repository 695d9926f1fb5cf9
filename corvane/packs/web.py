"""Packs for style sheets, pages and scripts: rules with one compound selector, keyframes, custom properties, imports, declarations at the margin."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.packs.base import Pack, Unit

_NAME = re.compile(r"-?[A-Za-z_][A-Za-z0-9_-]*")
_COMPOUND = re.compile(r"^[A-Za-z*]?[A-Za-z0-9]*(?:[.#]-?[A-Za-z_][A-Za-z0-9_-]*|:{1,2}[a-z-]+(?:\([^()]*\))?|\[[^\]]*\])+$")
_LICENCE, _VERSION = re.compile(r"licen[cs]e|copyright|\(c\)|\u00a9", re.I), re.compile(r"\bv?\d+\.\d+(\.\d+)?\b")


def released(text: str) -> bool:
    """A first comment with a licence and a version: a library's sheet that was copied here."""
    m = re.match(r"(?s)(?:\s*@charset[^;]*;)?\s*/\*.{0,800}?\*/", text[:2000])
    return bool(m and _LICENCE.search(m[0]) and _VERSION.search(m[0]))


def blank(text: str, pattern: str) -> str:
    """text with matches blanked, line ends kept."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def blocks(text: str, base: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(prelude, body, start, end) of the blocks of a sheet at one level; raises ValueError if braces don't match."""
    depth = start = 0
    open_at = 0
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                open_at = i
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                raise ValueError("unmatched brace")
            if depth == 0:
                head = text[start:open_at]
                lead = len(head) - len(head.lstrip())
                yield head.strip(), text[open_at + 1 : i], base + start + lead, base + i
                start = i + 1
        elif c == ";" and depth == 0:
            start = i + 1
    if depth:
        raise ValueError("unmatched brace")


def sheet(text: str, base: int = 0, whole: str | None = None) -> Iterator[Unit]:
    whole = text if whole is None else whole
    line = lambda at: whole.count("\n", 0, at) + 1
    for head, body, start, end in blocks(text, base):
        if re.match(r"@(media|supports|layer|container)\b", head):
            yield from sheet(body, base + text.index(body, start - base), whole)
            continue
        if m := re.match(r"@(?:-[a-z]+-)?keyframes\s+(\S+)$", head):
            if _NAME.fullmatch(m[1]):
                yield Unit("style", m[1], line(start), line(end), show=f"@keyframes {m[1]}")
            continue
        if head.startswith("@"):
            continue
        if "," not in head and _COMPOUND.match(head) and not re.search(r"[&{}]|@at-root\b", re.sub(r"@font-face\s*\{[^{}]*\}", "@font-face", body)):
            outer = re.sub(r"\([^()]*\)", "", head)
            names = re.findall(r"\.(-?[A-Za-z_][A-Za-z0-9_-]*)", outer) or re.findall(r"#(-?[A-Za-z_][A-Za-z0-9_-]*)", outer)
            if names:
                name = names[0]
                keep = "a mixin or at-rule inside may emit more" if re.search(r"@(include|font-face)", body) else ""
                yield Unit("style", name, line(start), line(end), show=("." if f".{name}" in outer else "#") + name, own=len(re.findall(rf"(?<![\w-]){re.escape(name)}(?![\w-])", whole[start : end + 1])), keep=keep)
                continue
        at = base + text.index(body, start - base)
        for m in re.finditer(r"(?:^|[;\s])(--[A-Za-z_][A-Za-z0-9_-]*)\s*:[^;]*", body):
            yield Unit("variable", m[1], line(at + m.start(1)), line(at + m.end()))


class CssPack(Pack):
    languages = ("CSS", "SCSS")
    token = "css"

    def units(self, rel, text):
        if "vendor" in rel.split("/")[:-1] or rel.endswith(".min.css") or released(text):
            return  # somebody else's code
        yield from sheet(blank(text, r"(?s)/\*.*?\*/" if rel.endswith(".css") else r"(?s)/\*.*?\*/|(?<![:\w\"'(])//[^\n]*"))


class HtmlPack(Pack):
    """Rules of <style> elements; declarations of inline module scripts, whose uses lie in the same file."""

    languages = ("HTML",)
    token = "css"

    def units(self, rel, text):
        clean = blank(text, r"(?s)<!--.*?-->")
        for m in re.finditer(r"(?is)<style\b([^>]*)>(.*?)</style\s*>", clean):
            kind = re.search(r"""type\s*=\s*["']?([^"'\s>]+)""", m[1])
            if not kind or kind[1].lower() == "text/css":
                yield from sheet(blank(m[2], r"(?s)/\*.*?\*/"), m.start(2), clean)


_IMPORT = re.compile(r"""^import\s+(type\s+(?!from\b))?([^'"`;]*?)\s*\bfrom\s*['"]([^'"]*)['"][ \t]*;?""", re.M)
_REQUIRE = re.compile(r"""^(?:const|let|var)\s+(?:([A-Za-z_$][\w$]*)|\{([^}]*)\})\s*=\s*require\s*\(\s*['"]([^'"\n]*)['"]\s*\)[ \t]*;?""", re.M)
_DECLARED = re.compile(r"^(export\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\b\s*\*?|class|interface|type|(?:const\s+)?enum|const|let|var)\s*([A-Za-z_$][\w$]*)(?=[^\w$])(?!\s*=\s*require\b)")
_FUNCTION_VALUE = re.compile(r"^[^=]*(?<![=!<>])=(?![=>])\s*(?:(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)|(class)\b)")
# --- fixed values: places whose exports a framework or tool calls; suffixes of modules; what marks a file as loaded by another module system; modules of the runtime; configuration words
ENTRY = re.compile(
    r"(^|/)(pages|app|routes|api|bin|scripts|e2e|cypress|playwright|__tests__|__mocks__|test|tests)/|\.(config|conf|test|spec|stories|story|setup|d)\.[cm]?[jt]sx?$"
    r"|(^|/)(index|main|server|app|cli|worker|sw|service-worker|vite-env|setupTests)\.[cm]?[jt]sx?$"
)
MODULE_SUFFIX = (".mjs", ".cjs", ".mts", ".cts")
_UMD = re.compile(r"\btypeof\s+(?:module|exports|define|require)\b|\bdefine\.amd\b|^\s*define\s*\(", re.M)
_CJS = re.compile(r"^(?:module\.exports|exports)\s*[.\[=]|\bObject\.(?:defineProperty|assign)\(\s*(?:module\.)?exports\b", re.M)
_PRAGMA = re.compile(r"@jsx(?:Frag)?\s+([A-Za-z_$][\w$]*)")
BUILTIN = frozenset(
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring "
    "readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
)
FACTORY_WORDS = ["pragma", "pragmaFrag", "jsxPragma", "jsxPragmaFrag", "jsxFactory", "jsxFragmentFactory", "jsxFragment", "jsxInject"]
VERBATIM_WORDS = ["verbatimModuleSyntax", "preserveValueImports", "importsNotUsedAsValues", "onlyRemoveTypeImports"]

#: What a unit that isn't kept says in its reason for keep_scripts: JSX may need it by a project's setting, or a project may want its load.
JSX_HINT, LOAD_HINT = "hint: a name in a file with JSX", "hint: a statement that loads a module"


def _bindings(clause: str) -> Iterator[str]:
    """The names that an import clause binds: default, namespace, and those in braces by their new names."""
    outer = re.sub(r"\{[^}]*\}", "", clause)
    for part in outer.split(","):
        if m := re.fullmatch(r"\s*(?:\*\s*as\s+)?([A-Za-z_$][\w$]*)\s*", part):
            yield m[1]
    for inner in re.findall(r"\{([^}]*)\}", clause):
        for part in inner.split(","):
            if m := re.fullmatch(r"\s*(?:type\s+)?(?:[A-Za-z_$][\w$]*\s+as\s+)?([A-Za-z_$][\w$]*)\s*", part):
                yield m[1]


def _times(name: str, text: str) -> int:
    return len(re.findall(rf"(?<![\w$]){re.escape(name)}(?![\w$])", text))


def builtin(spec: str) -> bool:
    return spec.startswith("node:") or spec.split("/")[0] in BUILTIN


class ScriptPack(Pack):
    """Imports, and declarations at the margin, of JavaScript and TypeScript files.

    A module's names and those of a file with CommonJS exports reach that file; of a script that calls require() they reach the
    repository; of any other script, and of a file made for several module systems, anywhere: those are judged, not removed, like
    exports. Defaults and values that aren't functions are no units. Kept: what JSX may need, an import without which the file may
    be no module, classes and enums whose definition runs code, names beside a rest pattern, statements whose going joins the
    lines around them, every name where eval is called. Without a syntax tree members and nested names aren't judged.
    """

    languages = ("JavaScript", "TypeScript")

    def entry(self, rel):
        return bool(ENTRY.search(rel))

    def units(self, rel, text):
        if re.search(r"\.d\.[cm]?ts$", rel):
            return
        clean = blank(text, r"(?s)/\*.*?\*/|(?<![:\"'`\\\\])//[^\n]*")
        lines = clean.split("\n")
        line = lambda at: clean.count("\n", 0, at) + 1
        all_keep = "eval may read any name" if re.search(r"\beval\s*\(", clean) else ""
        exports = bool(re.search(r"(?m)^export\b", clean))
        module = rel.endswith(MODULE_SUFFIX) or exports or bool(re.search(r"""(?m)^import\b\s*["'{*A-Za-z_$]""", clean))
        reach = "file" if module else "public" if _UMD.search(clean) else "file" if _CJS.search(clean) else "repo" if re.search(r"\brequire\s*\(", clean) else "public"
        jsx = bool(re.search(r"<(?:[A-Za-z][\w.]*[\s/>]|>)", clean)) and rel.endswith((".jsx", ".tsx", ".js"))
        pragmas = set(_PRAGMA.findall(text))
        factory = lambda n: n in pragmas or (jsx and n in ("React", "h"))
        imports = [(m, list(_bindings(m[2])), bool(m[1]), m[3]) for m in _IMPORT.finditer(clean)]
        stays = rel.endswith(MODULE_SUFFIX) or exports or bool(re.search(r"""(?m)^import\s*["']""", clean)) or any(not names or any(_times(n, clean) > _times(n, m[0]) for n in names) for m, names, *_ in imports)
        for m, names, type_only, spec in imports:
            drops = rel.endswith((".ts", ".tsx", ".mts", ".cts")) or type_only or builtin(spec)
            together = len(names) > 1 and drops and not any(map(factory, names)) and all(_times(n, clean) == _times(n, m[0]) for n in names)
            whole = len(names) == 1 or together
            for n in names:
                keep = hint = ""
                if factory(n):
                    keep = "JSX may need it without naming it"
                elif whole and drops and not stays:
                    keep = "without it the file may be no module"
                elif whole and drops and (joined := self.joins(lines, line(m.start()) - 1, line(m.end()) - 1)):
                    keep = joined
                elif jsx:
                    hint = JSX_HINT
                elif whole and drops and not type_only and not builtin(spec):
                    hint = LOAD_HINT
                yield Unit("import", n, line(m.start()), line(m.end()), scope="file", own=_times(n, m[0]), keep=all_keep or keep, hint=hint)
        for m in _REQUIRE.finditer(clean):
            items = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
            rest = any(x.startswith("...") for x in items)
            for n, default in [(m[1], "")] if m[1] else [(p[1] or p[2], p[3] or "") for x in items if (p := re.fullmatch(r"(?:[A-Za-z_$][\w$]*\s*:\s*([A-Za-z_$][\w$]*)|([A-Za-z_$][\w$]*))\s*(?:=\s*(.*))?", x, re.S))]:
                alone = len(items) < 2 and builtin(m[3])
                keep = "the rest pattern beside it would collect it" if rest else "its default runs code" if re.search(r"[(`]|\bnew\b", default) else self.joins(lines, line(m.start()) - 1, line(m.end()) - 1) if alone else ""
                yield Unit("import", n, line(m.start()), line(m.end()), scope=reach, own=_times(n, m[0]), keep=all_keep or keep)
        for i, head in enumerate(lines):
            m = _DECLARED.match(head)
            if not m or re.match(r"export\s+default\b", head):
                continue
            depth, end, what = 0, i, m[2].split()[-1].rstrip("*")
            block = what in ("function", "class", "interface", "enum")
            for end in range(i, len(lines)):
                depth += sum(map(lines[end].count, "{([")) - sum(map(lines[end].count, "})]"))
                if depth <= 0 and (not block or "{" in "".join(lines[i : end + 1])):
                    break
            body = "\n".join(lines[i : end + 1])
            kind = {"interface": "type", "enum": "type"}.get(what, what)
            keep = ""
            if what in ("const", "let", "var"):
                if not (value := _FUNCTION_VALUE.search(body)):
                    continue  # its value may run code
                kind = "class" if value[1] else "function"
            if kind == "class":
                before = "".join(lines[max(0, i - 1) : i]).strip()
                if before.startswith("@") or re.search(r"(?m)^\s*@[A-Za-z]", body):
                    keep = "a decorator may register it"
                elif re.search(r"\bextends\s+[\w$.]+\s*\(", body.partition("{")[0]) or re.search(r"(?m)^\s*static\s*(?:\{|[\w$#]+\s*=\s*[^;\n]*\()|^\s*(?:static\s+)?\[[^\]\n]*\(", body):
                    keep = "defining it runs code"
            elif what == "enum" and re.search(r"=\s*[^,\n]*\(", body):
                keep = "a member's value runs code"
            scope = "public" if m[1] else reach
            yield Unit(kind, m[3], i + 1, end + 1, scope=scope, own=_times(m[3], body), keep=all_keep or keep or (self.joins(lines, i, end) if scope != "public" else ""))

    @staticmethod
    def joins(lines: list[str], first: int, last: int) -> str:
        """Why a statement's lines must stay: without them and without semicolons the line below would go on with the one above."""
        above = next((x.rstrip() for x in reversed(lines[:first]) if x.strip()), "")
        below = next((x.lstrip() for x in lines[last + 1 :] if x.strip()), "")
        return "its going would join the lines around it" if above and below[:1] in tuple("([`+-/") and below and not above.endswith((";", "}", "{")) and not re.match(r"import\b", above) else ""


def keep_scripts(found: DataFrame, units: DataFrame, counts: DataFrame) -> DataFrame:
    """found (findings on scripts) with verdict AMBIGUOUS where a setting of the project asks for an import: its JSX factory by name, or every module's load.

    units: repo, rel, kind, name, start, reason (with the hints of ScriptPack); counts: repo, rel, word.
    """
    hints = units.filter(F.col("reason").isin(JSX_HINT, LOAD_HINT)).select("repo", "rel", "kind", "name", "start", F.col("reason").alias("hint")).distinct()
    if hints.isEmpty():
        return found
    settings = counts.filter(F.col("word").isin(FACTORY_WORDS)).select("repo", F.col("rel").alias("by")).distinct()
    factories = counts.join(settings.withColumnRenamed("by", "rel"), ["repo", "rel"]).select("repo", F.col("rel").alias("by"), F.col("word").alias("name"))
    named = hints.filter(F.col("hint") == JSX_HINT).join(factories, ["repo", "name"]).filter("by <> rel").select("repo", "rel", "kind", "name", "start", F.lit("the project's JSX factory").alias("why")).distinct()
    loads = counts.filter(F.col("word").isin(VERBATIM_WORDS)).select("repo").distinct()
    loads = hints.filter(F.col("hint") == LOAD_HINT).join(loads, "repo", "left_semi").select("repo", "rel", "kind", "name", "start", F.lit("the project keeps every import's load").alias("why"))
    f = found.join(named.unionByName(loads), ["repo", "rel", "kind", "name", "start"], "left")
    kept = F.col("why").isNotNull() & (F.col("verdict") == "REMOVE")
    return f.withColumn("reason", F.when(kept, F.col("why")).otherwise(F.col("reason"))).withColumn("verdict", F.when(kept, "AMBIGUOUS").otherwise(F.col("verdict"))).select(*found.columns)


PACKS = [CssPack(), HtmlPack(), ScriptPack()]
