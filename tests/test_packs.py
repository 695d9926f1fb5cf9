"""Packs of declared names: in each file something dead, and something that only looks dead."""

from corvane.packs import base, declared, web

FILES = [
    ("Java", "A.java", "import java.util.List;\nimport java.util.Map;\n\npublic class A {\n    private int dead = 1;\n    private int used = 2;\n    private Runnable runs = make();\n\n    private void gone() {\n        gone();\n    }\n\n    @Inject\n    private void wired() {\n    }\n\n    // words of comments count as uses\n    public Map go() {\n        return used;\n    }\n}\n", {"List": "REMOVE", "dead": "REMOVE", "gone": "REMOVE", "runs": "AMBIGUOUS", "wired": "AMBIGUOUS"}),
    ("Kotlin", "a.kt", "import a.b.Gone\nimport a.b.Here\n\nprivate fun dead() {\n}\n\nprivate fun live() = Here()\n\nfun open() = live()\n", {"Gone": "REMOVE", "dead": "REMOVE"}),
    ("C#", "a.cs", "using X = System.Int32;\n\nclass A {\n    private int dead;\n    private int live;\n    private void Gone() {\n    }\n    [Test]\n    private void Marked() {\n    }\n    public int Get() { return live; }\n}\n", {"X": "REMOVE", "dead": "REMOVE", "Gone": "REMOVE", "Marked": "AMBIGUOUS"}),
    ("Go", "p/a.go", "package p\n\nfunc dead() {\n}\n\nfunc live() int {\n\treturn 1\n}\n\nfunc Public() {\n}\n\ntype lost struct {\n}\n\nvar runs = compute()\n", {"dead": "REMOVE", "lost": "REMOVE", "runs": "AMBIGUOUS"}),
    ("Go", "p/b.go", "package p\n\nfunc Other() int {\n\treturn live()\n}\n", {}),
    ("Go", "q/c.go", "package q\n\n// dead is elsewhere\nfunc Use() {\n\tdead()\n}\n", {}),
    ("Rust", "a.rs", "fn dead() {\n}\n\npub fn open() {\n    live();\n}\n\nfn live() {\n}\n\n#[test]\nfn marked() {\n}\n", {"dead": "REMOVE", "marked": "AMBIGUOUS"}),
    ("PHP", "a.php", "<?php\nuse A\\B\\Gone;\nuse A\\B\\Here;\nclass C {\n    private function dead() {\n    }\n    private $lost;\n    public function go() {\n        return new Here();\n    }\n}\n", {"Gone": "REMOVE", "dead": "REMOVE", "lost": "REMOVE"}),
    ("PHP", "magic.php", "<?php\nclass D {\n    private function hidden() {\n    }\n    public function __call($n, $a) {\n    }\n}\n", {"hidden": "AMBIGUOUS"}),
    ("Swift", "a.swift", "private func dead() {\n}\n\nfileprivate let live = 1\n\nfunc open() -> Int {\n    return live\n}\n", {"dead": "REMOVE"}),
    ("C", "a.c", "static int dead(int x) {\n    return dead(x);\n}\n\nstatic int live(int x) {\n    return x;\n}\n\nstatic int count;\n\nint open(void) {\n    return live(1);\n}\n", {"dead": "REMOVE", "count": "REMOVE", "open": "AMBIGUOUS"}),
    ("C", "pasted.c", "#define F(x) call_##x()\nstatic void call_me(void) {\n}\nint go = F(me);\n", {"call_me": "AMBIGUOUS"}),
    ("Java", "Broken.java", "class B {\n    private int x;\n", {}),
]


def test_declared_packs(spark):
    rows = [(f"r{i}" if rel[1] != "/" else "go", rel, lang, text) for i, (lang, rel, text, _) in enumerate(FILES)]
    df = spark.createDataFrame(rows, "repo string, rel string, lang string, text string")
    got = {}
    for r in base.audit(df, declared.PACKS).collect():
        got.setdefault(r.rel, {})[r.name] = r.verdict
    for _, rel, _, want in FILES:
        assert got.get(rel, {}) == want, rel
    assert [r.rel for r in base.extract(df, declared.PACKS).filter("error is not null").collect()] == ["Broken.java"]


def test_script_pack(spark):
    files = {
        "src/view.tsx": (
            "import { TypeOnly, Gen, Dec, Reexp, Foo, Ns as Space } from './lib'\nimport * as All from './lib'\nimport {\n  DeadOne,\n  live as alive,\n} from './lib'\nexport * from './lib'\nexport { Reexp }\nlet v: TypeOnly\n"
            "const g = new Map<string, Gen>()\n@Dec\nexport class Widget {}\nexport const View = () => <><Foo /><Space.Item /></>\nconsole.log(v, g, alive)\n",
            {"All": ("import", "REMOVE"), "DeadOne": ("import", "REMOVE"), "Widget": ("class", "AMBIGUOUS"), "View": ("function", "AMBIGUOUS")},
        ),
        "src/app.jsx": ("import React from 'react'\nimport { gone } from './util'\nexport default function App() {\n  return <p>hi</p>\n}\n", {"React": ("import", "AMBIGUOUS"), "gone": ("import", "REMOVE")}),
        "src/one.ts": ("import { only } from './util'\nlet x = 1\nx += 1\n", {"only": ("import", "AMBIGUOUS")}),
        "src/types.ts": ("export {}\ntype Dead = string\ninterface Gone {\n  a: Dead2\n}\nenum Plain { A, B }\nenum Runs { A = f() }\ntype Used = number\nlet y: Used = 1\ny += 1\n", {"Dead": ("type", "REMOVE"), "Gone": ("type", "REMOVE"), "Plain": ("type", "REMOVE"), "Runs": ("type", "AMBIGUOUS")}),
        "src/web.ts": ("import a, { b } from './lib'\nimport c from 'fs'\nimport 'x'\n", {"a": ("import", "REMOVE"), "b": ("import", "REMOVE"), "c": ("import", "REMOVE")}),
        "src/asi.js": ("const go = 1\nfunction gone() {\n}\n(go)\nexport { go }\n", {"gone": ("function", "AMBIGUOUS")}),
        "src/index.ts": ("export function served() {\n}\n", {}),
        "lib/umd.js": ("(function (root) { if (typeof module === 'object') x() })(this)\nfunction everywhere() {\n}\n", {"everywhere": ("function", "AMBIGUOUS")}),
        "lib/parts.js": ("const { used1, lost1: lost2, lost3 = f() } = require('./x')\nconst { lost4, ...others } = require('./y')\nexports.a = used1 + others\nclass Static {\n  static x = f()\n}\nconst Plain = class {\n}\n", {"lost2": ("import", "REMOVE"), "lost3": ("import", "AMBIGUOUS"), "lost4": ("import", "AMBIGUOUS"), "Static": ("class", "AMBIGUOUS"), "Plain": ("class", "REMOVE")}),
        "lib/electron.js": ("const fs2 = require('fs')\nfunction byOthers() {\n}\nfunction byNobody() {\n}\nfs2.x()\n", {"byNobody": ("function", "REMOVE")}),
        "lib/other.js": ("byOthers()\n", {}),
        "lib/a.js": ("const fs = require('fs')\nconst path = require('path')\nconst LIMIT = 3\nconst made = build(1)\nconst dead = (a) => a\nclass Base extends mix(Other) {\n}\nmodule.exports = { p: path.sep }\n", {"fs": ("import", "REMOVE"), "dead": ("function", "REMOVE"), "Base": ("class", "AMBIGUOUS")}),
        "page/x.js": ("function shared() {\n}\nfunction lost() {\n  lost()\n}\n", {"lost": ("function", "AMBIGUOUS")}),
        "page/y.js": ("// 'http://a//b'\nshared()\n", {}),
        "page/evil.js": ("function hidden() {\n}\neval('hid' + 'den()')\n", {"hidden": ("function", "AMBIGUOUS")}),
    }
    rows = [("r", rel, "TypeScript" if rel.endswith((".ts", ".tsx")) else "JavaScript", text) for rel, (text, _) in files.items()]
    df = spark.createDataFrame(rows, "repo string, rel string, lang string, text string")
    got = {rel: {} for rel in files}
    for r in base.audit(df, web.PACKS).collect():
        got[r.rel][r.name] = (r.kind, r.verdict)
    assert got == {rel: want for rel, (_, want) in files.items()}


def test_settings_of_a_project(spark):
    """A JSX factory that a configuration names, and a project that keeps every load; the same files without these settings."""
    files = [("v.tsx", "TypeScript", "import { make } from 'tiny'\nexport const V = () => <p />\n"), ("w.ts", "TypeScript", "import { lost } from './v'\nimport type { T } from './v'\nimport { readFile } from 'fs'\nexport const w = () => 1\n")]
    settings = [("tsconfig.json", "JSON", '{"jsxFactory": "make", "verbatimModuleSyntax": true}')]
    df = spark.createDataFrame([(r, *f) for r, fs in (("with", files + settings), ("without", files)) for f in fs], "repo string, rel string, lang string, text string")
    got = {(r.repo, r.name): r.verdict for r in base.audit(df, web.PACKS).collect() if r.kind == "import"}
    names = ("make", "lost", "T", "readFile")
    assert [got["with", n] for n in names] == ["AMBIGUOUS", "AMBIGUOUS", "REMOVE", "REMOVE"] and [got["without", n] for n in names] == ["REMOVE"] * 4


def test_counts_of_names_are_those_of_all_words(spark):
    """Each file's words are counted inside its row: the same counts as by grouping, for names only, and nothing else is shuffled."""
    from pyspark.sql import functions as F

    from corvane.operators import words

    texts = [("r", "a", "x y x $y a-b a-b-c x"), ("r", "b", ""), ("r", "c", None), ("s", "a", "z z"), ("s", "b", "x --x-y 'x-y' x-"), ("r", "d", "y" * 3 + " y")]
    files = spark.createDataFrame(texts, "repo string, rel string, text string")
    names = spark.createDataFrame([("r", "x"), ("r", "x"), ("r", "y"), ("s", "z"), ("r", "a-b"), ("s", "x-y"), ("s", "absent"), ("r", None)], "repo string, name string")
    for css, every in ((False, words.word_counts(files)), (True, words.css_word_counts(files))):
        want = {tuple(r) for r in every.join(names.withColumnRenamed("name", "word"), ["repo", "word"], "left_semi").select("repo", "rel", "word", "n").collect()}
        got = words.named_counts(files, names, css)
        assert want and {tuple(r) for r in got.select("repo", "rel", "word", "n").collect()} == want and got.schema["n"].dataType == every.schema["n"].dataType
