"""Packs for languages with braces, from declarations that one line shows: what is private by the language's own words.

Without a syntax tree these packs judge less than a parser would, and keep more: only declarations whose form leaves no
doubt are units, and anything that may be reached by name - an annotation, an attribute, a directive, a native or
initialising declaration - keeps its unit for a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from corvane.packs.base import Pack, Unit
from corvane.packs.cfamily import CFamilyPack
from corvane.packs.golang import GoPack
from corvane.packs.nested import NestedPack
from corvane.packs.web import blank

_COMMENTS = r"/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*"
_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''


@dataclass(frozen=True)
class Form:
    """A declaration: its kind, a pattern with the group `name`, the scope in which uses count, and whether its value may run code."""

    kind: str
    pattern: str
    scope: str
    value: bool = False


class DeclaredPack(Pack):
    """forms are tried on each line in order; `marked` is what, on the line before or at the start of the line, keeps a unit; `whole` keeps all units of a file."""

    forms: tuple[Form, ...] = ()
    marked = r"^\s*(@|#\[|\[)"
    modifiers = r"\b(native|external|extern|override|virtual|abstract)\b"
    whole: dict[str, str] = {}
    skipped_names = frozenset({"main", "init"})

    def units(self, rel: str, text: str) -> Iterator[Unit]:
        bare = blank(text, f"{_COMMENTS}|{_STRINGS}")
        if bare.count("{") != bare.count("}"):
            raise ValueError("braces don't match")
        lines = bare.split("\n")
        reason = next((why for p, why in self.whole.items() if re.search(p, text)), "")
        for i, line in enumerate(lines):
            for f in self.forms:
                m = re.match(f.pattern, line)
                if not m or m["name"] in self.skipped_names:
                    continue
                end = self.end(lines, i) if f.kind != "import" else i
                body = "\n".join(lines[i : end + 1])
                before = next((x for x in reversed(lines[:i]) if x.strip()), "")
                keep = reason
                if f.kind != "import":
                    keep = keep or ("an annotation or attribute may use it" if re.search(self.marked, before) or re.search(self.marked, line) else "")
                    keep = keep or ("called from outside by its modifier" if re.search(self.modifiers, line) else "")
                    keep = keep or ("its initial value runs code" if f.value and re.search(r"=[^=].*\(", line) else "")
                yield Unit(f.kind, m["name"], i + 1, end + 1, f.scope, m["name"], len(re.findall(rf"(?<![\w$]){re.escape(m['name'])}(?![\w$])", body)), keep)
                break

    @staticmethod
    def end(lines: list[str], i: int) -> int:
        """The last line of the declaration that starts at line i: where its braces close, or its first line that ends it."""
        depth = 0
        for j in range(i, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            if depth <= 0 and ("{" in "".join(lines[i : j + 1]) or re.search(r"[;)\w\"]\s*$", lines[j])):
                return j
        return len(lines) - 1


class JavaPack(DeclaredPack):
    """Imports; members are NestedPack's, as for the next two and for PHP and Swift."""

    languages = ("Java",)
    forms = (Form("import", r"import\s+(?:static\s+)?[\w.]+\.(?P<name>[A-Za-z_]\w*)\s*;", "file"),)


class KotlinPack(DeclaredPack):
    languages = ("Kotlin",)
    forms = (Form("import", r"import\s+[\w.]+\.(?P<name>[A-Za-z_]\w*)\s*$", "file"),)
    skipped_names = frozenset({"getValue", "setValue", "provideDelegate"})


class CSharpPack(DeclaredPack):
    languages = ("C#",)
    forms = (Form("import", r"\s*using\s+(?P<name>\w+)\s*=\s*[\w.<>, ]+;", "file"),)


class RustPack(DeclaredPack):
    languages = ("Rust",)
    forms = (Form("function", r"(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>\w+)", "repo"), Form("variable", r"(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:", "repo", True))
    whole = {r"\b(paste|concat_idents)!": "a macro builds names in this file"}


class PhpPack(DeclaredPack):
    languages = ("PHP",)
    forms = (Form("import", r"use\s+[\w\\]*\\(?P<name>\w+)\s*;", "file"),)


PACKS = [JavaPack(), KotlinPack(), CSharpPack(), GoPack(), RustPack(), PhpPack(), CFamilyPack(), NestedPack()]
