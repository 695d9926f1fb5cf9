"""Rules on small repositories: each holds code that must be reported beside code that must not."""

import pytest

from corvane.operators import pyfacts, rules

CASES = {
    "unused_import": ({"a.py": "import os\nimport sys\nprint(sys.argv)\n"}, {("import", "os"): "REMOVE"}),
    "substring": ({"a.py": "import time\nimport datetime\nprint(datetime.date)\n"}, {("import", "time"): "REMOVE"}),
    "data_string": ({"a.py": "from datetime import date\nx = {}.get('date')\nprint(x)\n"}, {("import", "date"): "REMOVE"}),
    "annotation_string": ({"a.py": "from b import Foo\nfrom c import Bar\n\n\ndef f(x: 'Foo'):\n    return x\n\n\nf(cast('Bar', 1))\n"}, {}),
    "reexport": ({"pkg/__init__.py": "", "pkg/a.py": "from json import dumps\n", "pkg/b.py": "from pkg.a import dumps\nprint(dumps)\n"}, {}),
    "reexport_chain": ({"a.py": "from json import dumps, loads\nx = 1\n", "b.py": "import a\nprint(a.dumps)\n"}, {("import", "loads"): "REMOVE"}),
    "optional": ({"a.py": "try:\n    import numpy\nexcept ImportError:\n    pass\nprint(1)\n"}, {("import", "numpy"): "AMBIGUOUS"}),
    "init": ({"p/__init__.py": "from .x import y\n", "p/x.py": "y = 1\n"}, {("import", "y"): "AMBIGUOUS"}),
    "explicit": ({"a.py": "from b import x as x\nfrom b import y  # noqa\nprint(1)\n"}, {}),
    "only_imports": ({"w.py": "from app import application\n", "app.py": "application = 1\n"}, {}),
    "side_effect": ({"a.py": "import readline\nprint(1)\n"}, {("import", "readline"): "AMBIGUOUS"}),
    "lazy": ({"a.py": "def f():\n    import json\n    return 1\n\n\nf()\n"}, {("import", "json"): "AMBIGUOUS"}),
    "recursion": ({"a.py": "def f(n):\n    return f(n - 1)\n\n\ndef g():\n    return 1\n\n\ng()\n"}, {("function", "f"): "REMOVE"}),
    "same_name": ({"a.py": "def h():\n    return h\n", "b.py": "def h():\n    return 2\n\n\nprint(h())\n"}, {}),
    "exported": ({"a.py": "__all__ = ['f']\n\n\ndef f():\n    pass\n\n\ndef k():\n    pass\n"}, {("function", "k"): "REMOVE"}),
    "framework": ({"a.py": "@app.route('/x')\ndef view():\n    pass\n\n\n@wraps(g)\ndef wrapped():\n    pass\n"}, {("function", "wrapped"): "AMBIGUOUS"}),
    "registry": ({"a.py": "class Base:\n    pass\n\n\nclass Plug(Base):\n    pass\n\n\nclass Lone:\n    pass\n\n\nprint(Base.__subclasses__())\n"}, {("class", "Plug"): "AMBIGUOUS", ("class", "Lone"): "REMOVE"}),
    "inherited_hook": ({"a.py": "class Root:\n    def __init_subclass__(cls):\n        pass\n\n\nclass Mid(Root):\n    pass\n\n\nclass Leaf(Mid):\n    pass\n\n\nclass Err(ValueError):\n    pass\n"}, {("class", "Leaf"): "AMBIGUOUS", ("class", "Err"): "REMOVE"}),
    "outside_base": ({"a.py": "from django.db import Model\n\n\nclass Thing(Model):\n    pass\n"}, {("class", "Thing"): "AMBIGUOUS"}),
    "prefix": ({"a.py": "def do_x():\n    pass\n\n\ndef other():\n    pass\n\n\nhandlers['do_' + name]()\n"}, {("function", "do_x"): "AMBIGUOUS", ("function", "other"): "REMOVE"}),
    "getattr_module": ({"a.py": "import plug\n\ngetattr(plug, name)()\n", "plug.py": "def one():\n    pass\n", "free.py": "def two():\n    pass\n"}, {("function", "one"): "AMBIGUOUS", ("function", "two"): "REMOVE"}),
    "package_scan": ({"a.py": "import importlib\n\nimportlib.import_module(f'plugs.{x}')\n", "plugs/__init__.py": "", "plugs/p.py": "def run_it():\n    pass\n"}, {("function", "run_it"): "AMBIGUOUS"}),
    "tests": ({"tests/test_a.py": "def test_x():\n    pass\n\n\ndef helper():\n    pass\n"}, {("function", "helper"): "AMBIGUOUS"}),
    "library": ({"setup.py": "x = 1\n", "lib/m.py": "def public():\n    pass\n\n\ndef _private():\n    pass\n"}, {("function", "public"): "AMBIGUOUS", ("function", "_private"): "REMOVE"}),
    "hook_list": ({"mkdocs.yml": "nav: x\nhooks:\n  - docs/h.py\n", "docs/h.py": "def on_page():\n    pass\n"}, {("function", "on_page"): "AMBIGUOUS"}),
    "prose": ({"README.md": "run `go_now()` please, do not stop\n", "a.py": "def go_now():\n    pass\n\n\ndef stop():\n    pass\n"}, {("function", "stop"): "REMOVE"}),
    "unparsed": ({"a.py": "import os\nprint(1)\n", "bad.py": "def broken(:\n    os.x\n"}, {("import", "os"): "AMBIGUOUS"}),
    "dependency": ({"requirements.txt": "requests>=2\nPillow\nblack\n# c\nunused-thing==1\n", "a.py": "import requests\nimport PIL\nprint(requests, PIL)\n"}, {("dependency", "unused-thing"): "AMBIGUOUS"}),
    "duplicate": ({"a.py": "def one(a, b):\n    t = 0\n    for x in a:\n        if x > b:\n            t = t + x * 2 - 1\n    return helper(t)\n\n\nprint(one)\n", "b.py": "def two(p, q):\n    s = 0\n    for y in p:\n        if y > q:\n            s = s + y * 2 - 1\n    return helper(s)\n\n\ndef three(p, q):\n    s = 0\n    for y in p:\n        if y > q:\n            s = s + y * 2 - 1\n    return assist(s)\n\n\nprint(two, three)\n"}, {("duplicate", "two"): "SIMPLIFY"}),
    "gunicorn": ({"conf/gunicorn.conf.py": "def on_exit(server):\n    pass\n"}, {("function", "on_exit"): "AMBIGUOUS"}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(repo, rel, text) for repo, (files, _) in CASES.items() for rel, text in files.items()]
    every = spark.createDataFrame(rows, "repo string, rel string, text string")
    python = every.filter("rel like '%.py'")
    facts = pyfacts.Facts(pyfacts.python_facts(python).cache())
    out = {}
    for r in rules.python_findings(rules.Repository(facts, every.filter("rel not like '%.py'"), python)).collect():
        out.setdefault(r.repo, {})[r.kind, r.name] = r
    return out


@pytest.mark.parametrize("case", CASES)
def test_case(found, case):
    got = {k: r.verdict for k, r in found.get(case, {}).items()}
    want = CASES[case][1]
    assert {k: v for k, v in got.items() if k in want or v != "AMBIGUOUS"} == want, {k: r.reason for k, r in found.get(case, {}).items()}


def test_duplicate_points_at_the_first(found):
    r = found["duplicate"]["duplicate", "two"]
    assert r.evidence == ["a.py:1"] and r.lines == 6 and r.final == "SIMPLIFY"


def test_body_hash_is_by_shape():
    import ast

    f = lambda s: pyfacts.body_hash(ast.parse(s).body[0])[0]
    assert f("def a(x):\n  'doc'\n  y = x\n  return y") == f("def b(q: int):\n  z = q\n  return z")
    assert f("def a(x):\n  return g(x)") != f("def a(x):\n  return h(x)") and f("def a():\n  'only'") is None


def test_facts_that_are_asked_for_are_those_of_the_whole_read():
    texts = [(rel, text) for files, _ in CASES.values() for rel, text in files.items() if rel.endswith(".py")]
    texts += [("deep.py", "import os\n\n\ndef f():\n    return 1\n\n\nx = " + "a" + ".b" * 3000 + "\n"), ("x.py", "try:\n    from .m import (a as b, c)  # noqa\nexcept (ImportError, OSError):\n    import d.e\n\n\n@dec(1)\nclass K(B[int], metaclass=M):\n    import inner\n")]
    for rel, text in texts:
        whole = pyfacts.read_file(rel, text)
        assert pyfacts.read_file(rel, text, frozenset(["import"])) == [r for r in whole if r[0] == "import"]
        assert pyfacts.read_file(rel, text, frozenset(["def", "body"])) == [r for r in whole if r[0] == "def"]
        bare = [r[:1] + r[1:] if r[2] == "class" else (*r[:3], None, *r[4:6], 0, *r[7:]) for r in whole if r[0] == "def"]
        assert pyfacts.read_file(rel, text, frozenset(["def"])) == bare


def test_each_use_of_a_name_costs_no_row():
    rows = pyfacts.read_file("a.py", "import os\n\n" + "print(os.path, 'os')\n" * 1000)
    assert [r[0] for r in rows] == ["import", "file"]
    names, sets, lo, hi = (rows[-1][i] for i in (8, 10, 11, 12))
    assert dict(zip(names, zip(lo, hi, strict=True), strict=True)) == {"print": (3, 1002), "os": (3, 1002), "path": (3, 1002)}
    assert dict(sets) == {"used": ["print", "os"], "attr": ["path"], "chain": ["os.path"]}


def test_a_relation_reads_its_own_facts_only(spark):
    facts = pyfacts.stored(spark.createDataFrame([("r", "a.py", "import os\n\n\ndef f():\n    return os\n\n\nf()\n")], "repo string, rel string, text string"))
    for relation, fact in ((facts.imports, "import"), (facts.defs, "def"), (facts.files, "file"), (facts.names("used"), "file"), (facts.refs, "file")):
        scans = [s for s in relation._jdf.queryExecution().executedPlan().toString().split("FileScan")[1:]]
        assert scans and all(f"(fact#" in s and f"= {fact})" in s.split("PartitionFilters", 1)[1].split("]", 1)[0] for s in scans)
    assert sorted(map(tuple, facts.refs.select("name", "lo", "hi").collect())) == [("f", 8, 8), ("os", 5, 5)]


def test_relations_of_many_rows_are_not_broadcast(spark):
    rows = [(f"r{i}", "a.py", "import os\nimport sys\n\n\ndef f():\n    return sys\n\n\nclass K(os.x):\n    pass\n") for i in range(3)]
    python = spark.createDataFrame(rows, "repo string, rel string, text string")
    r = rules.Repository(pyfacts.stored(python), python.limit(0), python.select("repo", "rel"))
    for found, kinds in ((rules.import_findings(r), []), (rules.definition_findings(r), ["class K", "function f"])):
        assert sorted(f"{x.kind} {x.name}" for x in found.collect() if x.repo == "r1") == kinds
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_uses_by_name_tell_what_one_file_holds(spark):
    from corvane.operators import usage

    defs = spark.createDataFrame([("r", "a.py", n, 2, 4) for n in "uvwxyz"] + [("r", None, "n", 2, 4)], "repo string, rel string, name string, start int, end int")
    uses = [("v", "a.py", 3), ("w", "a.py", 3), ("w", "a.py", 5), ("x", "b.py", 3), ("y", "a.py", 2), ("y", "b.py", 2), ("z", None, 3), ("z", "a.py", 3), ("n", "a.py", 3)]
    refs = spark.createDataFrame([("r", *u) for u in uses], "repo string, name string, rel string, line int")
    assert sorted(x.name for x in usage.unused_definitions(defs, refs).collect()) == ["u", "v"]
