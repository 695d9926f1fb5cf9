"""The graph of imports and exports on three repositories: barrels, defaults and namespaces; circles, stars and shadowing; CommonJS and aliases."""

import pytest

from corvane.packs import modules

BARRELS = {
    "src/index.ts": "export * from './parts'\nexport { default as Button, size as buttonSize } from \"./parts/button\"\nexport * as shapes from './shapes'\nexport type { Props } from './types'\n",
    "src/parts/index.ts": "// export * from './old'\nexport * from './card';\nexport {\n  helper,\n  type Kind,\n} from '../util'\n",
    "src/parts/card.tsx": "export class Card {}\nexport default function () {}\nexport const `x` = 1\n",
    "src/parts/button.tsx": "import { size } from '../util'\nexport { size }\nexport default class Button extends Base {}\n",
    "src/parts/old.ts": "export const gone = 1\n",
    "src/util.ts": "export const size = 1, other = 2\nexport async function* helper() {}\nexport enum Kind { A }\nexport const { left, mid: middle, right = 3 } = make()\nexport abstract class Never {}\n",
    "src/shapes.ts": "export function circle() {}\nexport function square() {}\n",
    "src/types.d.ts": "export interface Props {}\nexport declare const hidden: string\n",
    "src/app.ts": "import Main, { Card, helper as aid, buttonSize } from '.'\nimport * as all from './shapes.js'\nimport type { Props } from './index'\nconst s = \"import x from './old'\"\nconst t = `\nimport { gone } from './parts/old'\n`\n",
}
CIRCLES = {
    "a.js": "export * from './b'\nexport * from './c'\nexport const own = 1\nexport default 5\n",
    "b.js": "export * from './a'\nexport const both = 1\nexport const own = 2\nexport { missing } from './nowhere'\n",
    "c.js": "import { lost as found } from './c'\nexport { found as lost }\nexport const both = 2\nexport default class {}\n",
    "use.mjs": "import d, { own, both, lost, nothing } from './a.js'\nimport './b.js'\n",
}
COMMON = {
    "lib/index.js": "const { join: glue, deep = 1 } = require('./join')\nmodule.exports = { glue, made: build, short }\nexports.extra = 1\n",
    "lib/join.js": "exports.join = function () {}\nmodule.exports.deep = 2\nexports.alone = 3\n",
    "app/main.js": "const lib = require('../lib')\nconst fs = require('fs')\nimport('@/lib/lazy').then(run)\n",
    "lib/lazy.js": "module.exports = lazy\nexport const wide = 1\n",
    "pages/index.jsx": "export const served = 1\n",
}


@pytest.fixture(scope="module")
def known(spark):
    rows = [(repo, rel, text) for repo, files in (("barrels", BARRELS), ("circles", CIRCLES), ("common", COMMON)) for rel, text in files.items()]
    return modules.facts(spark.createDataFrame(rows, "repo string, rel string, text string")).cache()


def followed(spark, known, repo, asked):
    df = spark.createDataFrame([(repo, rel, name) for rel, name in asked], "repo string, rel string, name string")
    out = {}
    for r in modules.follow(df, known).collect():
        out.setdefault((r.rel, r.name), set()).add((r.in_rel, r.declared, r.steps))
    return out


def test_statements():
    assert set(modules.statements("import a, { b as c, type D } from 'x'; import * as n from \"y\"\nimport 'z'\n/* import q from 'q' */ const r = require('r').s")) == {("import", "a", "default", "x"), ("import", "c", "b", "x"), ("import", "D", "D", "x"), ("whole", "r", "*", "r")}
    assert set(modules.statements("export default foo;\nexport { a, b as default }\nexport const { p, q: [z] } = y")) == {("export", "default", "foo", None), ("export", "a", "a", None), ("export", "default", "b", None), ("export", "p", "p", None)}
    assert list(modules.statements("")) == [] and list(modules.statements("const x = 'export const y = 1'\n")) == []


def test_barrels(spark, known):
    asked = [("src/index.ts", n) for n in ("Card", "helper", "Button", "buttonSize", "shapes", "Props", "Kind", "default", "none")]
    assert followed(spark, known, "barrels", asked) == {
        ("src/index.ts", "Card"): {("src/parts/card.tsx", "Card", 2)}, ("src/index.ts", "helper"): {("src/util.ts", "helper", 2)}, ("src/index.ts", "Kind"): {("src/util.ts", "Kind", 2)},
        ("src/index.ts", "Button"): {("src/parts/button.tsx", "Button", 1)}, ("src/index.ts", "buttonSize"): {("src/util.ts", "size", 2)}, ("src/index.ts", "shapes"): {("src/shapes.ts", "*", 1)}, ("src/index.ts", "Props"): {("src/types.d.ts", "Props", 1)},
    }
    names = {r.name for r in modules.exported(known).filter("repo = 'barrels' and rel = 'src/index.ts'").collect()}
    assert names == {"Button", "buttonSize", "shapes", "Props", "Card", "helper", "Kind"}
    used = {(r.name, r.in_rel, r.declared) for r in modules.imported(known).filter("repo = 'barrels' and by = 'src/app.ts'").collect()}
    assert used == {("Card", "src/parts/card.tsx", "Card"), ("helper", "src/util.ts", "helper"), ("buttonSize", "src/util.ts", "size"), ("circle", "src/shapes.ts", "circle"), ("square", "src/shapes.ts", "square"), ("Props", "src/types.d.ts", "Props")}
    unused = {(r.rel, r.name) for r in modules.unused_exports(known).filter("repo = 'barrels'").collect()}
    assert unused == {("src/parts/card.tsx", "default"), ("src/parts/old.ts", "gone"), ("src/types.d.ts", "hidden"), ("src/util.ts", "left"), ("src/util.ts", "middle"), ("src/util.ts", "right"), ("src/util.ts", "Never")}


def test_circles_stars_and_shadows(spark, known):
    asked = [("a.js", n) for n in ("own", "both", "lost", "default", "missing")] + [("b.js", "own"), ("b.js", "default")]
    assert followed(spark, known, "circles", asked) == {("a.js", "own"): {("a.js", "own", 0)}, ("a.js", "both"): {("b.js", "both", 1), ("c.js", "both", 1)}, ("a.js", "default"): {("a.js", "default", 0)}, ("b.js", "own"): {("b.js", "own", 0)}}
    assert {r.name for r in modules.exported(known).filter("repo = 'circles' and rel = 'b.js'").collect()} == {"both", "own", "missing", "lost"}
    assert {(r.rel, r.name) for r in modules.unused_exports(known).filter("repo = 'circles'").collect()} == {("b.js", "own"), ("c.js", "default")}


def test_commonjs_and_aliases(spark, known):
    got = {(r.by, r.name, r.in_rel, r.declared) for r in modules.imported(known).filter("repo = 'common'").collect()}
    assert {(n, i, d) for b, n, i, d in got if b == "app/main.js"} == {("glue", "lib/join.js", "join"), ("made", "lib/index.js", "build"), ("short", "lib/index.js", "short"), ("extra", "lib/index.js", "extra"), ("default", "lib/index.js", "default"), ("default", "lib/lazy.js", "lazy"), ("wide", "lib/lazy.js", "wide")}
    entry = modules.F.col("rel").rlike("(^|/)pages/")
    assert {(r.rel, r.name) for r in modules.unused_exports(known, entry).filter("repo = 'common'").collect()} == {("lib/join.js", "alone")}
    assert modules.facts(known.select("repo", "rel", modules.F.lit("").alias("text")).limit(0)).count() == 0


def test_nothing_of_the_graph_goes_through_the_driver(spark, monkeypatch):
    """No join of the graph broadcasts a side, as every side grows with the files; comments shrink to what ends them."""
    from corvane.operators import usage

    plans, put = [], modules.store

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(modules, "store", seen)
    monkeypatch.setattr(usage, "store", seen)
    files = spark.createDataFrame([("r", "a.ts", "export * from './b'\nexport { x as y } from './b'\n"), ("r", "b.ts", "export const x = 1\nexport const z = 2\n"), ("r", "c.ts", "import { x, y } from './a'\n")], "repo string, rel string, text string")
    out = modules.unused_exports(modules.facts(files))
    assert {(r.rel, r.name) for r in out.collect()} == {("b.ts", "z")}
    assert not any("Broadcast" in p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()])
    assert modules.bare("a/* x */b // c\n`t\n`/*\n\n*/'//'") == "a b  \n\n\n'//'"
