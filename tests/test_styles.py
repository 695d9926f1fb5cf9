"""Reasons that keep a style, each beside a style that nothing keeps: a repository for each case, all judged in one audit."""

from corvane.operators import usage
from corvane.packs import base, sheets, styles, web

PAGE = '<link rel="stylesheet" href="main.css"><main class="frame"><p class="box text">x</p><i class="row cell head foot"></i></main><script src="app.js"></script>'
USED = "".join(f".{c} {{ margin: 0 }}\n" for c in ("frame", "box", "text", "row", "cell", "head", "foot"))
R, A = "REMOVE", "AMBIGUOUS"


def site(css, want, page=PAGE, sheet="main.css", **more):
    files = {"index.html": page.replace("main.css", sheet), sheet: USED + css, "app.js": "export {}\n"}
    return {**files, **{k.replace("__", "/").replace("_DOT_", "."): v for k, v in more.items()}}, {sheet: want}


def files_(files, **want):
    return files, {k.replace("_DOT_", "."): v for k, v in want.items()}


CASES = {
    "dead": site(".stray { a: b }\n#lost-id { a: b }\n@keyframes lost-turn { to { a: b } }\n:root { --lost: 1; --kept: 2 }\n.box { c: var(--kept) }\n", {".stray": R, "#lost-id": R, "@keyframes lost-turn": R, "--lost": R}),
    "compound": site("button.pale.wide:hover { a: b }\n.tip::after { a: b }\n@media (x) { .broad { a: b } }\n", {".pale": R, ".tip": R, ".broad": R}),
    "states": site(".active { a: b }\n.collapsing { a: b }\n.scrolled { a: b }\n.no-js { a: b }\n.is-up { a: b }\n.slide-leave-to { a: b }\n.steady { a: b }\n", {".active": A, ".collapsing": A, ".scrolled": A, ".no-js": A, ".is-up": A, ".slide-leave-to": A, ".steady": R}),
    "libraries": site(".hljs-x { a: b }\n.footnotes { a: b }\n.modal-title { a: b }\n.modal-backdrop { a: b }\n.animated { a: b }\n.animatedly { a: b }\n", {".hljs-x": A, ".footnotes": A, ".modal-title": R, ".modal-backdrop": A, ".animated": A, ".animatedly": R}),
    "built": site(".pin-red { a: b }\n.tab-s-xl { a: b }\n.dot--on { a: b }\n.far-off { a: b }\n", {".pin-red": A, ".tab-s-xl": A, ".dot--on": A, ".far-off": R}, **{"app_DOT_js": "f('pin-' + c, `${s}-xl`, `dot--${v}`)\n"}),
    "format": site(".q-sm { a: b }\n.q-md { a: b }\n", {".q-sm": A, ".q-md": R}, **{"v_DOT_py": "def s(x):\n    return '%s-sm' % x\n"}),
    "array": site(".sign-home { a: b }\n.gone { a: b }\n", {".sign-home": A, ".gone": R}, **{"app_DOT_js": "const c = n => ['sign', n].join('-')\n"}),
    "near": site(".tray__top { a: b }\n.txt-l { a: b }\n.late-one { a: b }\n", {".tray__top": A, ".txt-l": R, ".late-one": R}, **{"app_DOT_js": "const b = 'tray'\nf(e => `${b}__${e}`)\ng((n, d) => `${n}_${d}.` + 'txt')\n" + "// more\n" * 60 + "h('late')\n"}),
    "helper": site(".key__sign { a: b }\n.key_big { a: b }\n.lock { a: b }\n", {".key__sign": A, ".key_big": A, ".lock": R}, **{"app_DOT_jsx": "import block from 'bem-cn'\nconst b = block('key')\n" + "// more\n" * 60}),
    "prefix": site(".soft-rim { a: b }\n.soft-rim-edge { a: b }\n", {".soft-rim": R}, page=PAGE + '<b class="soft-rim-edge"></b>', **{"app_DOT_js": "['hard', n].join('-')\n"}),
    "unnamed": files_({"index.html": PAGE.replace("main.css", "x.css") + " header", "header-nav.css": USED + ".gone-one { a: b }\n@keyframes turned { to { a: b } }\n"}, **{"header-nav_DOT_css": {".gone-one": A, "@keyframes turned": R}}),
    "own licence": site("", {".dead-one": R}, **{"main_DOT_css": "/* (c) 2024 me */\n" + USED + ".dead-one { a: b }\n"}),
    "library copied": files_({"index.html": PAGE, "main.css": "/*! Lib v5.3.0, MIT licence */\n" + USED + ".dead-one { a: b }\n"}, main_DOT_css={}),
    "vendored": files_({"index.html": PAGE.replace("main.css", "vendor/main.css"), "vendor/main.css": USED + ".dead-one { a: b }\n", "main.min.css": ".dead-two { a: b }"}, **{"vendor/main_DOT_css": {}, "main.min_DOT_css": {}}),
    "elsewhere": files_({"a.html": "main <i class='kept'></i>", "main.css": ".kept { a: b }\n.p1 { a: b }\n.p2 { a: b }\n@keyframes p3 { to { a: b } }\n"}, main_DOT_css={".p1": A, ".p2": A, "@keyframes p3": R}),
    "platform": site(".leaf { a: b }\n#twig { a: b }\n", {".leaf": A, "#twig": A}, **{"theme__header_DOT_php": "<?php wp_head(); ?>"}),
    "published": files_({"pkg/package.json": '{"name": "x", "files": ["*"]}', "pkg/a/main.css": USED + ".leaf { a: b }\n", "index.html": PAGE, "own/package.json": '{"private": true, "files": []}', "own/deep/main.css": USED + ".branch { a: b }\n", "bow/bower.json": "{}", "bow/main.css": ".root { a: b }\n"}, **{"pkg/a/main_DOT_css": {".leaf": A}, "own/deep/main_DOT_css": {".branch": R}, "bow/main_DOT_css": {".root": A}}),
    "far sheet": site("@keyframes fa-turn { to { a: b } }\n.leaf { a: b }\n:root { --mine: 1 }\n", {"@keyframes fa-turn": A, ".leaf": R, "--mine": A}, page=PAGE + '<link rel="stylesheet" href="https://cdn.example.com/i.css">'),
    "fonts": site("@keyframes turn { to { a: b } }\n", {"@keyframes turn": R}, page=PAGE + '<link rel="stylesheet" href="https://fonts.googleapis.com/css?family=X">'),
    "package sheet": site("@keyframes turn { to { a: b } }\n", {"@keyframes turn": A}, **{"app_DOT_js": "import 'grid/dist/grid.css'\nimport './main.css'\n"}),
    "unknown rule": site("@keyframes turn { to { a: b } }\n@import 'nowhere';\n", {"@keyframes turn": A}),
    "known rule": site("@import 'parts';\n@keyframes turn { to { a: b } }\n", {"@keyframes turn": R}, **{"_parts_DOT_scss": USED}),
    "scss": site("@use 'sass:math';\n.block { a: b; &__x { a: b } }\n.plain { a: b } // a note\n.mixed { @include clear; }\n.fonted { @font-face { a: b } }\n.rooted { @at-root .q { a: b } }\n%quiet { a: b }\n@keyframes turn { to { a: b } }\n", {".plain": R, ".mixed": A, ".fonted": A, "@keyframes turn": R}, sheet="main.scss"),
    "properties": site(":root { --gap: 1; --bs-x: 1; --lost: 2; --outer: 3 }\n.box { c: var(--outer, 2); d: var(--gap) }\n", {"--bs-x": A, "--lost": R}),
    "unread properties": site(":root { --a1: 1; --a2: 1; --a3: 1 }\n.box { c: var(--a1) }\n", {"--a2": A, "--a3": A}),
    "built properties": site(":root { --sp1: 1; --sp2: 2 }\n.box { c: var(--sp1) }\n", {"--sp2": A}, **{"app_DOT_js": "el.style.setProperty(`--${k}`, 1)\n"}),
    "module": files_({"B.module.css": ".first { a: b }\n.foo-bar { a: b }\n.dull { a: b }\n", "B.jsx": "import styles from './B.module.css'\nf(styles.first + styles.fooBar)\n"}, **{"B.module_DOT_css": {".dull": R}}),
    "module by key": files_({"D.module.css": ".d1 { a: b }\n.d2 { a: b }\n", "D.jsx": "import s from './D.module.css'\nf(s[k])\n"}, **{"D.module_DOT_css": {".d1": A, ".d2": A}}),
    "module handed on": files_({"C.module.css": ".c1 { a: b }\n.c2 { a: b }\n.c3 { a: b }\n", "C.jsx": "import styles from './C.module.css'\nf(<In classes={styles} a={styles.c1 + styles.c2} />)\n"}, **{"C.module_DOT_css": {".c3": A}}),
    "module by optional key": files_({"O.module.css": ".o1 { a: b }\n.o2 { a: b }\n.o3 { a: b }\n", "O.jsx": "import s from './O.module.css'\nf(s?.[k] + s.o1 + s.o2)\n"}, **{"O.module_DOT_css": {".o3": A}}),
    "module as a prop's name": files_({"P.module.css": ".p1 { a: b }\n.p2 { a: b }\n.p3 { a: b }\n", "P.jsx": "import st from './P.module.css'\nf(({ styles }) => <b styles={styles} c={st.p1 + st.p2} />)\n"}, **{"P.module_DOT_css": {".p3": R}}),
    "page": files_({"i.html": "<style>.lit { a: b }\n.unlit { a: b }</style><style type='text/x'>.no { </style><p class='lit'>"}, i_DOT_html={".unlit": R}),
}
LANG = {"css": "CSS", "scss": "SCSS", "html": "HTML", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "php": "PHP", "json": "JSON"}


def test_each_reason(spark):
    rows = [(case, rel, LANG[rel.rpartition(".")[2]], text) for case, (files, _) in CASES.items() for rel, text in files.items()]
    df = spark.createDataFrame(rows, "repo string, rel string, lang string, text string")
    got = {}
    for r in base.audit(df, web.PACKS).collect():
        if r.kind in ("style", "variable"):
            got.setdefault((r.repo, r.rel), {})[r.show] = r.verdict
    wrong = {(case, rel): (got.get((case, rel), {}), names) for case, (_, want) in CASES.items() for rel, names in want.items() if got.get((case, rel), {}) != names}
    assert not wrong


def test_another_table_of_libraries(spark):
    files = spark.createDataFrame([("r", "index.html", "HTML", PAGE), ("r", "main.css", "CSS", USED + ".hljs-x { a: b }\n.zz-y { a: b }\n")], "repo string, rel string, lang string, text string")
    units = base.extract(files, web.PACKS).filter("error is null")
    found = units.filter("name in ('hljs-x', 'zz-y')").selectExpr("*", "'REMOVE' as verdict")
    got = styles.keep_styles(found, units, files, libraries={"Zz": ("zz-", "zz")})
    assert {r.name: r.verdict for r in got.collect()} == {"hljs-x": R, "zz-y": A}


def test_the_graph_of_sheets(spark):
    files = {
        "a.html": "<link rel=stylesheet href='css/main.css?v=2'><link rel='icon' href='x.png'>", "b.html": "<link href='css/other.css' rel='stylesheet'><script src='b.js'></script>", "css/main.css": "@import url('deep.css');\n@import './parts/p';",
        "css/deep.css": "", "css/parts/_p.scss": "@use 'sass:math';\n@forward '../loop';", "css/loop.scss": "@import 'parts/p';", "css/other.css": "", "View.jsx": "import s from './css/other.css'\nimport 'pkg/x.css'", "css/alone.css": "", "sub/deep.css": "",
    }
    df = spark.createDataFrame([("r", rel, text) for rel, text in files.items()] + [("q", "css/other.css", ""), ("q", "x.html", "<link rel=stylesheet href=//far/y.css>")], "repo string, rel string, text string")
    e = {(r.rel, r.target): r.to for r in sheets.edges(df).filter("repo = 'r'").collect()}
    assert e == {("a.html", "css/main.css?v=2"): "css/main.css", ("b.html", "css/other.css"): "css/other.css", ("css/main.css", "deep.css"): "css/deep.css", ("css/main.css", "./parts/p"): "css/parts/_p.scss", ("css/parts/_p.scss", "sass:math"): None, ("css/parts/_p.scss", "../loop"): "css/loop.scss", ("css/loop.scss", "parts/p"): "css/parts/_p.scss", ("View.jsx", "./css/other.css"): "css/other.css", ("View.jsx", "pkg/x.css"): None}
    got = {(r.page, r.sheet) for r in sheets.styled(df).filter("repo = 'r'").collect()}
    assert got == {("a.html", x) for x in ("css/main.css", "css/deep.css", "css/parts/_p.scss", "css/loop.scss")} | {("b.html", "css/other.css"), ("View.jsx", "css/other.css")}
    assert {r.repo: r.external for r in sheets.external(df).collect()} == {"r": "pkg/x.css", "q": "//far/y.css"}


def test_joined_parts():
    assert styles.joined_parts("['a', n].join('-'); x + '__' + 'b'") == {("-", "a"), ("-", "b"), ("__", "a"), ("__", "b"), ("-", "__"), ("__", "__")}
    assert styles.joined_parts("f('a' + '-b')") == set()
    assert styles.joined_parts("const block = 'a'; f(`${block}--${mod}`)") == {("--", "a")}
    assert styles.joined_parts("'%s-%s' % ('k', v)") == {("-", "k")}
    assert styles.joined_parts("import { withNaming } from 'z'; withNaming({}); f('any', 'two words')") == {("", "z"), ("", "any")}


def test_reach_and_closure(spark):
    e = [("r", f"n{i}", f"n{i + 1}") for i in range(9)] + [("r", "n9", "n3"), ("q", "n0", "n5"), ("r", "x", "n0"), ("r", "x", "n0")]
    df = spark.createDataFrame(e, "repo string, a string, z string")
    pairs = {(a, z) for r, a, z in e if r == "r"}
    while (more := pairs | {(a, z) for a, m in pairs for n, z in pairs if m == n}) != pairs:
        pairs = more
    assert {(r.a, r.z) for r in usage.closure(df).filter("repo = 'r'").collect()} == pairs and usage.closure(df).filter("repo = 'q'").count() == 1
    got = usage.reach(spark.createDataFrame([("r", "n7"), ("q", "n5")], "repo string, start string"), df).collect()
    assert sorted((r.repo, r.start, r.node) for r in got) == sorted(("r", a, z) for a, z in pairs if a == "n7")
    assert usage.closure(df.limit(0)).count() == 0 and usage.reach(df.selectExpr("repo", "a as start").limit(0), df).count() == 0


def test_styled_reads_texts_once(spark):
    from corvane.packs import sheets

    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    files = [("r", "w/a.html", "<link rel='stylesheet' href='../css/s1.css'>")] + [("r", f"css/s{i}.css", f"@import url(\"s{i + 1}.css\");") for i in range(1, 5)] + [("r", "css/s5.css", "")]
    df = spark.createDataFrame(files, "repo string, rel string, text string")
    texts = df.mapInArrow(read, "repo string, rel string, text string")
    assert sorted(r.sheet for r in sheets.styled(texts).collect()) == [f"css/s{i}.css" for i in range(1, 6)]
    assert seen.value <= 2 * len(files)  # once for what they load, once for their names
