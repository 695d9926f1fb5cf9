"""The audit end to end on a repository with a history, its sources, ledger, streams and packs."""

import io
import re
import os
import stat
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import attribution, copies, jury, usage, words
from corvane.operators.ledger import Ledger
from corvane.packs import base, web
from corvane.plans import audit, report
from corvane.sources import git as git_source
from corvane.sources import tree, uploads
from corvane.streaming import limits


def git(root, *args):
    env = {"GIT_AUTHOR_DATE": git.at, "GIT_COMMITTER_DATE": git.at, "PATH": os.environ["PATH"], "HOME": str(root)}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


def commit(root, files, message, author="Ann <ann@x>", at="2024-01-01T00:00:00Z"):
    git.at = at
    for rel, text in files.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(text if isinstance(text, bytes) else text.encode())
    git(root, "add", "-A")
    name, _, mail = author.partition(" <")
    git(root, "-c", f"user.name={name}", "-c", f"user.email={mail.rstrip('>')}", "commit", "-q", "-m", message)


BLOCK = "".join(f"  total_{i} = compute_something_long({i}, options_{i});\n" for i in range(7))


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("r")
    git.at = "2024-01-01T00:00:00Z"
    git(root, "init", "-q")
    commit(root, {"app.py": "import os\nimport sys\n\n\ndef main():\n    return sys.argv\n\n\nmain()\n", "pkg/__init__.py": "", ".github/ci.yml": "on: x\n"}, "start")
    commit(root, {"gen.py": "def a():\n    return 1\n\n\ndef b():\n    return 2\n\n\na()\n", "js/a.js": "function one() {\n" + BLOCK + "}\none();\n", "js/b.js": "// copy\nfunction two() {\n" + BLOCK.replace("  ", "\t") + "}\ntwo();\n"}, "more\n\nCo-authored-by: Copilot <c@x>", at="2024-02-01T00:00:00Z")
    commit(root, {"gen.py": "def a():\n    return 10\n\n\ndef b():\n    return 2\n\n\na()\n", "latin.py": "# -*- coding: latin-1 -*-\nx = 'é'\n".encode("latin-1"), "site.css": ".used { a: b }\n.gone-by { c: d }\n", "lone.css": ".used { a: b }\n.gone-off { c: d }\n", "index.html": "<link rel='stylesheet' href='site.css'><p class='used'>x</p>\n"}, "fix", at="2024-03-01T00:00:00Z")
    (root / "link.py").symlink_to(root / "app.py")
    (root / "huge.txt").write_text("x" * 512_001)
    (root / "data.py").write_bytes(b"\0\0")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("import json\n")
    return root


def test_tree(spark, repo):
    rows = {r.rel: r for r in tree.read_tree(spark, {"r": str(repo)}).collect()}
    assert {"app.py", "pkg/__init__.py", ".github/ci.yml", "latin.py", "js/a.js"} <= set(rows) and not {"link.py", "data.py", "node_modules/x.py"} & set(rows)
    assert "é" in rows["latin.py"].text and rows["pkg/__init__.py"].lines == 0 and rows["app.py"].lines == 9 and len(rows["app.py"].sha) == 16


def test_git(spark, repo):
    roots = {"r": str(repo)}
    c = attribution.classify(git_source.read_git(spark, roots, "commits"))
    assert sorted((r.kind, r.tool, r.on_head) for r in c.collect()) == [("ai", "GitHub Copilot", True), ("human", None, True), ("human", None, True)]
    lines = attribution.line_kinds(git_source.read_git(spark, roots, "blame"), c)
    assert {(r.kind, r.lines) for r in attribution.lines_by_kind(lines.filter("rel = 'gen.py'")).collect()} == {("ai", 8), ("human", 1)}
    assert git_source.read_git(spark, {"none": "/tmp"}, "commits").count() == 0


def test_run(spark, repo, tmp_path):
    stages = []
    a = audit.run(spark, {"r": str(repo)}, on_stage=stages.append)
    found = {(r.kind, r.file, r.name): r for r in a.findings.collect()}
    assert found["import", "app.py", "os"].verdict == "REMOVE" and found["import", "app.py", "os"].authored_by == "human"
    assert found["function", "gen.py", "b"].authored_by == "ai" and ("function", "gen.py", "a") not in found
    copy = next(r for r in found.values() if r.kind == "duplicate")
    assert (copy.file, copy.evidence) == ("js/b.js", ["js/a.js:2"]) and copy.lines >= 6
    assert found["style", "site.css", "gone-by"].verdict == "REMOVE" and ("style", "site.css", "used") not in found
    assert found["style", "lone.css", "gone-off"].verdict == "AMBIGUOUS" and "names its sheet" in found["style", "lone.css", "gone-off"].reason
    assert [(r.rel, r.size) for r in a.left_out.collect()] == [("huge.txt", 512_001)]
    assert copies.over_ceiling(a.files, 10).first().lines > 10
    p = a.payoff.first()
    assert p.dead_units >= 3 and p.duplicate_lines == copy.lines and 0 < p.jlr_percent < 100
    w = {r.kind: r for r in a.rework.collect()}
    # added counts Python lines only, surviving all audited code, at most as much as was added
    assert (w["ai"].added, w["ai"].surviving, w["ai"].rewritten_percent) == (9, 9, 0.0)
    assert [(r.tool, r.commits) for r in a.tools.collect()] == [("GitHub Copilot", 1)]
    assert stages == ["ingest", "facts", "candidates", "attribution", "payoff"]
    text = report.markdown(a, "r", limit=1)
    assert "## Nothing uses" in text and "more" in text and "<polyline" in report.page(a, "r", [90.0, 95.0, 93.0])
    assert report.compact(a.findings)["counts"]["REMOVE"] >= 3
    report.write_documents(a, str(tmp_path / "docs"))
    assert report.read_documents(spark, str(tmp_path / "docs")).selectExpr("variant_get(document, '$.payoff.dead_units', 'int') d").first().d == p.dead_units
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.changed(a.hashes).count() == a.hashes.count() and a.record(ledger) == 1
    other = a.hashes.withColumn("sha", F.when(F.col("rel") == "app.py", "new").otherwise(F.col("sha")))
    assert [r.rel for r in ledger.changed(other).collect()] == ["app.py"] and a.record(ledger) == 2
    assert [r.run_id for r in ledger.history("r", 1).collect()] == [2] and ledger.history("none").count() == 0
    proofs = spark.createDataFrame([("r", "import", "app.py", "os", "passed"), ("r", "function", "gen.py", "b", "failed: tests")], "repo string, kind string, file string, name string, proof string")
    b = audit.run(spark, {"r": str(repo)}, proofs=proofs)
    final = {(r.kind, r.name): r.final for r in b.findings.collect()}
    assert final["import", "os"] == "REMOVE" and final["function", "b"] == "KEEP" and b.payoff.first().proved == 1
    d = report.diff(a.findings, a.findings.filter("name <> 'os'"))
    assert d["gone"]["total"] == 1 and d["new"]["total"] == 0


def test_votes_and_proofs_stay_in_their_repository(spark, tmp_path):
    """Two repositories with the same file: what is said of one finding says nothing of its twin, nor of a namesake on another line."""
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "utils.py").write_text("import os\nimport sys\n\n\ndef f():\n    return 1\n\n\nif f():\n    pass\nelse:\n    import os\n")
    roots = {n: str(tmp_path / n) for n in ("one", "two")}
    vote = lambda finding, verdict: [(finding, m, "import", verdict, 0.9, False, None, False) for m in ("a", "b", "c")]
    votes = spark.createDataFrame(vote("one:import:utils.py:2:sys", "keep"), "finding string, model string, kind string, verdict string, confidence double, has_evidence boolean, error string, refuted boolean")
    judged = {(r.repo, r.line, r.name): (r.final, r.judged) for r in audit.run(spark, roots, votes=votes).findings.filter("kind = 'import'").collect()}
    assert judged["one", 2, "sys"] == ("KEEP", True) and judged["two", 2, "sys"] == ("REMOVE", False)
    rows = [("two", "import", "utils.py", 1, "os", "passed"), ("two", "import", "utils.py", 1, "os", "failed: tests"), ("two", "import", "utils.py", 12, "os", "passed"), ("one", "import", "utils.py", 2, "sys", "passed")]
    proofs = spark.createDataFrame(rows, "repo string, kind string, file string, line int, name string, proof string")
    found = audit.run(spark, roots, proofs=proofs).findings.filter("kind = 'import'").collect()
    proved = {(r.repo, r.line, r.name): r.proof for r in found}
    assert len(found) == len(proved) == 6
    assert proved["two", 1, "os"] == "failed: tests" and proved["two", 12, "os"] == proved["one", 2, "sys"] == "passed" and proved["one", 1, "os"] == proved["two", 2, "sys"] == "not run"


def test_long_chains_of_classes_are_marked_to_the_end(spark):
    chain = [("r", "a.py", f"C{i}", [f"C{i - 1}"] if i else [], "Meta" if i == 0 else None, False, []) for i in range(90)] + [("r", "a.py", "Free", ["object"], None, False, [])]
    classes = spark.createDataFrame(chain, "repo string, rel string, name string, bases array<string>, metaclass string, init_subclass boolean, external_roots array<string>")
    got = usage.registered_classes(classes, spark.createDataFrame([], "repo string, name string")).collect()
    assert {r.name for r in got} == {f"C{i}" for i in range(90)} and len({r.why for r in got}) == 1


def test_copies_need_text_and_skip_comments(spark):
    body = [f"value_{i} = transform_input_number_{i}(left, right)" for i in range(6)]
    files = [("r", "a.rb", "Ruby", "\n".join(body)), ("r", "b.rb", "Ruby", "\n".join(["# x", *body[:3], "", "# note", *body[3:]])), ("r", "c.rb", "Ruby", "end\n" * 12), ("q", "d.rb", "Ruby", "\n".join(body)), ("r", "e.c", "C", "/* a\n b */ int main_function_with_name(int x);\n*/\nx /* c */ y\n// z\n#include <x>\n};")]
    lines = copies.significant_lines(spark.createDataFrame(files, "repo string, rel string, lang string, text string"))
    assert [r.text for r in lines.filter("rel = 'e.c'").orderBy("pos").collect()] == ["int main_function_with_name(int x);", "x y"]
    assert [(r.rel, r.line, r.end_line, r.of_rel, r.of_line) for r in copies.copied_blocks(lines).collect()] == [("b.rb", 2, 9, "a.rb", 1)]


def test_block_comments_as_a_loop_would(spark):
    import random

    r = random.Random(2)
    bits = ["/*", "*/", " x ", "y", "/* z */", "//", "*"]
    texts = ["\n".join("".join(r.choice(bits) for _ in range(r.randrange(0, 5))) for _ in range(12)) for _ in range(300)]

    def plain(text):
        inside, out = False, []
        for ln, line in enumerate(text.split("\n"), 1):
            line = line.strip()
            if inside:
                if "*/" not in line:
                    continue
                line = line.split("*/", 1)[1].strip()
            line = re.sub(r"/\*.*?\*/", " ", line).strip()
            inside = "/*" in line
            line = line.split("/*", 1)[0].strip() if inside else line
            if line and re.search("[a-z]", line) and not line.startswith(("//", "*", "<!--")):
                out.append((ln, " ".join(line.split())))
        return out

    df = spark.createDataFrame([("r", f"{i}.c", "C", t) for i, t in enumerate(texts)], "repo string, rel string, lang string, text string")
    got = {}
    for x in copies.significant_lines(df).orderBy("rel", "pos").collect():
        got.setdefault(x.rel, []).append((x.ln, x.text))
    assert got == {f"{i}.c": want for i, t in enumerate(texts) if (want := plain(t))}


def test_uploads(spark):
    def archive(*entries):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, body, mode in entries:
                i = zipfile.ZipInfo(name)
                i.external_attr = mode << 16
                z.writestr(i, body)
        return data.getvalue()

    good = archive(("top/a.py", "x", stat.S_IFREG | 0o644), ("top/l", "a.py", stat.S_IFLNK | 0o777), ("top/.git/config", "x", 0), ("top/.git/HEAD", "ref", 0), ("top/sub/.git/HEAD", "x", 0))
    df = spark.createDataFrame([("g", good), ("b", archive(("../x", "x", 0))), ("n", b"no")], "upload string, content binary")
    rows = {(r.upload, r.rel, r.error) for r in uploads.unzip_uploads(df).collect()}
    assert rows == {("g", "a.py", None), ("g", ".git/HEAD", None), ("b", None, "a path points outside the archive"), ("n", None, "not a zip archive")}
    j = spark.createDataFrame([("a", [("p/x.py", "1"), ("p/q/y.py", "2")]), ("b", [("../z", "1")]), ("c", []), ("d", [("/etc/x", "1")]), ("e", [("a/.git/HEAD", "1")])], "upload string, files array<struct<path:string,content:string>>")
    got = {(r.upload, r.rel, r.error) for r in uploads.json_uploads(j).collect()}
    assert got == {("a", "x.py", None), ("a", "q/y.py", None), ("b", None, "a path is not allowed"), ("c", None, "no files"), ("d", None, "a path is not allowed"), ("e", None, "a path is not allowed")}


def test_token_bucket_batch_and_stream(spark, tmp_path):
    rows = [("k", i, float(t)) for i, t in enumerate([0, 0, 0, 600, 1300, 1801])] + [("j", 9, 5.0)]
    df = spark.createDataFrame(rows, "key string, id long, at double")
    # two an hour: one comes back each 1800 seconds
    assert sorted((r.id, r.allowed) for r in limits.token_bucket(df, 2).collect()) == [(0, True), (1, True), (2, False), (3, False), (4, False), (5, True), (9, True)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.token_bucket_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("at", F.col("at") + 1000), 2).withColumn("at", F.col("at") - 1000)  # at 0 nothing comes after the first watermark
    q = stream.writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("bucket").collect())) == sorted(map(tuple, limits.token_bucket(df, 2).collect()))
    p = spark.createDataFrame([("a", "scan", 1, 1), ("a", "done", 2, 2), ("b", "scan", 1, 1)], "job string, stage string, at int, seq int")
    assert sorted((r.job, r.stage) for r in limits.last_stage(p).collect()) == [("a", "done"), ("b", "scan")]


def test_daily_usage_stream(spark, tmp_path):
    df = spark.sql("select 'u' who, timestamp'2024-01-01 10:00:00' ts union all select 'u', timestamp'2024-01-01 23:00:00' union all select 'u', timestamp'2024-01-02 01:00:00'")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = limits.daily_usage_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limit=2).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((str(r.day), r.n, r.over) for r in spark.table("daily").collect()) == [("2024-01-01", 2, True), ("2024-01-02", 1, False)]


def test_packs(spark):
    files = [
        ("r", "a.css", "CSS", ".hero { color: red }\n.row { a: b }\n.cell { a: b }\n.note { a: b }\n.dead-x{ a: b }\n.is-open { a: b }\n@media print { .late { a: b } }\n@keyframes spin { from { a: b } }\n:root { --main: 1; --side: 1; --lost: 2 }\n.card .inner { x: var(--main); y: var(--side) }\n"),
        ("r", "p.html", "HTML", "<link href='a.css'><style>.own { a: b }\n.nobody { a: b }</style><p class='own hero row cell note'></p>\n"),
        ("r", "bad.css", "CSS", ".open { a: b"),
        ("r", "m.js", "JavaScript", "export function api() {\n}\nfunction helper() {\n  helper();\n}\nfunction used() {}\nused();\n"),
    ]
    df = spark.createDataFrame(files, "repo string, rel string, lang string, text string")
    got = {(r.rel, r.name): r.verdict for r in base.audit(df, web.PACKS).collect()}
    assert got == {("a.css", "dead-x"): "REMOVE", ("a.css", "is-open"): "AMBIGUOUS", ("a.css", "late"): "REMOVE", ("a.css", "spin"): "REMOVE", ("a.css", "lost"): "REMOVE", ("p.html", "nobody"): "REMOVE", ("m.js", "api"): "AMBIGUOUS", ("m.js", "helper"): "REMOVE"}
    assert [r.rel for r in base.extract(df, web.PACKS).filter("error is not null").collect()] == ["bad.css"]
    assert [(r.rel, r.bytes) for r in base.too_long(df, web.PACKS, 100).orderBy("rel").collect()] == [(x[1], len(x[3])) for x in sorted(files, key=lambda x: x[1]) if len(x[3]) > 100]
    c = words.word_counts(df)
    w = spark.createDataFrame([("g", "hero"), ("g", "own")], "group string, word string")
    assert [r.rel for r in words.files_with_all(c, w).collect()] == ["p.html"]


def test_styles_that_may_be_in_use(spark):
    """A sheet for each reason: where it holds the verdict is AMBIGUOUS; one plain dead class of another repository isn't."""
    seen = ".s1 {a:b}\n.s2 {a:b}\n.s3 {a:b}\n.s4 {a:b}\n"
    page = ("x.html", "HTML", "<link href='a.css'><p class='s1 s2 s3 s4'>")
    cases = {
        "plain": ([("a.css", "CSS", seen + ".dead-one {a:b}"), page], {"dead-one": "REMOVE"}),
        "built": ([("a.css", "CSS", seen + ".btn-wide {a:b}\n.pale-card {a:b}"), page, ("b.js", "JavaScript", "x('btn-' + kind)\ny(`${z}-card`)")], {"btn-wide": "AMBIGUOUS", "pale-card": "AMBIGUOUS"}),
        "glue": ([("a.css", "CSS", seen + ".icon-home {a:b}\n.other-home {a:b}"), page, ("b.js", "JavaScript", "['icon', n].join('-')")], {"icon-home": "AMBIGUOUS", "other-home": "REMOVE"}),
        "names": ([("a.css", "CSS", seen + ".fade-enter-active {a:b}\n.hljs-x {a:b}\n.collapsed {a:b}"), page], {"fade-enter-active": "AMBIGUOUS", "hljs-x": "AMBIGUOUS", "collapsed": "AMBIGUOUS"}),
        "banner": ([("a.css", "CSS", "/* My own, MIT License */\n" + seen + ".dead-one {a:b}"), page], {"dead-one": "REMOVE"}),
        "unnamed": ([("zz.css", "CSS", seen + ".dead-one {a:b}"), page], {"dead-one": "AMBIGUOUS"}),
        "unseen": ([("a.css", "CSS", ".s1 {a:b}\n.d1 {a:b}\n.d2 {a:b}"), page], {"d1": "AMBIGUOUS", "d2": "AMBIGUOUS"}),
        "module": ([("a.module.css", "CSS", seen + ".nav-item {a:b}\n.nav-gone {a:b}"), ("c.js", "JavaScript", "import s from './a.module.css'; f(s.navItem, s.s1, s.s2, s.s3, s.s4)")], {"nav-gone": "REMOVE"}),
        "vars": ([("a.css", "CSS", seen + ":root { --a1: 1; --a2: 2; --a3: 3 }\n.s1 {c: var(--a1)}"), page], {"a2": "AMBIGUOUS", "a3": "AMBIGUOUS"}),
    }
    rows = [(repo, rel, lang, text) for repo, (files, _) in cases.items() for rel, lang, text in files]
    df = spark.createDataFrame(rows, "repo string, rel string, lang string, text string")
    got = {}
    for r in base.audit(df, web.PACKS).collect():
        got.setdefault(r.repo, {})[r.name] = r.verdict
    assert got == {repo: want for repo, (_, want) in cases.items()}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    import hashlib
    import hmac

    assert one(S.keyed_hash(lit("salt"), lit("1.2.3.4"))) == hmac.new(b"salt", b"1.2.3.4", hashlib.sha256).hexdigest()[:24]
    assert one(S.client_address(lit("9.9.9.9, 8.8.8.8"), lit("1.1.1.1"))) == "8.8.8.8" and one(S.client_address(lit(None).cast("string"), lit("1.1.1.1"))) == "1.1.1.1"
    assert one(S.repository(lit("https://github.com/a-b/c.d.git"))) == "a-b/c.d" and one(S.repository(lit("https://evil.com/a/b"))) is None and one(S.repository(lit("github.com/a/.."))) is None
    assert one(S.safe_ref(lit("feature/x"))) and not one(S.safe_ref(lit("-x"))) and not one(S.safe_ref(lit("a..b")))
    assert one(S.camel(lit("main-nav-item"))) == "mainNavItem" and one(S.language(lit("src/Dockerfile"))) == "Dockerfile" and one(S.language(lit("a/b.TSX"))) == "TypeScript" and one(S.language(lit(".py"))) is None
    assert one(S.module_of(lit("Python_Dateutil"))) == "dateutil" and one(S.module_of(lit("my-lib"))) == "my_lib"
    assert one(S.fewer_tests(lit("12 passed, 1 skipped"), lit("11 passed, 1 skipped"))) and not one(S.fewer_tests(lit("Ran 3 tests"), lit("Ran 3 tests"))) and one(S.fewer_tests(lit("3 passed"), lit("crash")))
    assert one(S.line_count(lit("a\nb"))) == 2 and one(S.line_count(lit("a\n"))) == 1 and one(S.line_count(lit(""))) == 0
    assert one(S.per_1000(lit(1), lit(0))) is None and one(S.html_escape(lit("<a&'>"))) == "&lt;a&amp;&#x27;&gt;" and one(S.thousands(lit(1234567))) == "1,234,567"
    key = F.unhex(lit("11" * 32))
    sealed = S.seal(lit("secret é"), key, F.unhex(lit("22" * 12)), lit("me"))
    assert one(S.unseal(sealed, key, lit("me"))) == "secret é"


def test_votes_and_evidence(spark):
    raw = [("f", "m1", '{"verdict": "Remove", "confidence": "0.9", "evidence": ["a.py:2"]}'), ("f", "m2", '<think>x</think>{"verdict":"keep","confidence":"hi","evidence":["a.py:1","b.py:1","a.py:9","x"]}'), ("f", "m3", "maybe"), ("f", "m4", None)]
    v = jury.parse_votes(spark.createDataFrame(raw, "finding string, model string, answer string"))
    assert {r.model: (r.verdict, r.confidence, r.error is None) for r in v.collect()} == {"m1": ("remove", 0.9, True), "m2": ("keep", 0.0, True), "m3": (None, None, False), "m4": (None, None, False)}
    f = spark.createDataFrame([("f", "r", "function", "a.py", 1, 1, "go")], "finding string, repo string, kind string, file string, line int, end_line int, name string")
    lines = spark.createDataFrame([("r", "a.py", 1, "def go():"), ("r", "a.py", 2, "go()"), ("r", "b.py", 1, "ago = 1")], "repo string, rel string, line int, text string")
    assert {r.model: r.checked for r in jury.checked_evidence(v.filter("error is null"), f, lines).collect()} == {"m1": ["a.py:2"], "m2": []}


def test_closure_and_spans(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "x", "y")], "repo string, a string, z string")
    assert {(r.a, r.z) for r in usage.closure(e).collect()} == {(p, q) for p in "abc" for q in "abc"} | {("x", "y")}
    s = spark.createDataFrame([("r", "f", 1, 5), ("r", "f", 2, 3), ("r", "f", 5, 7), ("r", "f", 9, 9)], "repo string, rel string, start int, end int")
    assert sorted((r.start, r.end) for r in jury.outermost_spans(s).collect()) == [(1, 7), (9, 9)]


def test_spans_of_many_files_are_dealt_out(spark):
    """The files' spans go to as many tasks as their number asks for, however small they are in bytes."""
    s = spark.range(400).selectExpr("'r' AS repo", "id % 40 AS rel", "id div 40 * 3 AS start", "id div 40 * 3 + id % 2 * 3 AS end")
    out = jury.outermost_spans(s, rows=20)
    assert out.rdd.getNumPartitions() >= 20 and max(out.rdd.glom().map(len).collect()) <= 100
    want = {(k, *x) for k in range(40) for x in ([(0, 30)] if k % 2 else [(3 * i, 3 * i) for i in range(10)])}
    assert {(r.rel, r.start, r.end) for r in out.collect()} == want and out.columns == ["repo", "rel", "start", "end"]


def test_closure_of_a_long_chain_and_a_forest(spark):
    edges = [("a", i, i + 1) for i in range(150)] + [("b", i, i // 3) for i in range(3, 2000)] + [("c", 1, 2), ("c", 2, 1)]
    to, want = {}, set()
    for r, a, z in edges:
        to.setdefault((r, a), []).append(z)
    for r, a in to:
        todo = [a]
        while todo:
            for z in to.get((r, todo.pop()), []):
                if (r, a, z) not in want:
                    want.add((r, a, z))
                    todo.append(z)
    got = usage.closure(spark.createDataFrame(edges, "repo string, a long, z long")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_closure_query_reads_all_orders(spark):
    from corvane.plans import catalogue

    sf = "/root/testdata/sf0.001"
    keys = [x[0] for x in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    have, want = {k for k in keys if k >= 3}, set()
    for k in have:
        z = k
        while z in have:
            z //= 3
            want.add((k, z))
    assert {tuple(x) for x in catalogue.QUERIES["include_closure"](spark, sf).collect()} == want


def test_unused_queries_read_all_references(spark):
    from corvane.plans import catalogue

    sf, q = "/root/testdata/sf0.001", catalogue.QUERIES
    rows = lambda name, *cols: [tuple(x) for x in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
    outside = {k for k, line in rows("lineitem", "l_partkey", "l_orderkey") if not k * 7 <= line <= k * 7 + 120000}
    parts = {k for (k,) in rows("part", "p_partkey")}
    assert {x[0] for x in q["unused_defs_outside_span"](spark, sf).collect()} == parts - outside
    suppliers = {n for (n,) in rows("supplier", "s_name")}
    want = sorted((d, c) for (c,) in rows("customer", "c_custkey") if (d := f"Supplier#{c * 2:09}") not in suppliers)
    assert want and sorted(tuple(x) for x in q["dependency_never_imported"](spark, sf).collect()) == want
    heads = {n.replace(" ", "_") + "_" for (n,) in rows("part", "p_name")}
    names = {n.replace(" ", "_") + "_" + b for n, b in rows("part", "p_name", "p_brand")}
    best = {n: max((h for h in heads if n.startswith(h) and n != h), key=len) for n in names}
    assert dict(map(tuple, q["prefix_lookup"](spark, sf).collect())) == best


def test_rework_rounds_seconds_and_counts_rows_as_its_sql(spark, tmp_path):
    import duckdb

    from corvane.plans import catalogue

    rows = [(1, "00:00:10.6", 1, "error", 5.0), (2, "00:00:10.3", 1, "view", 7.0), (2, "00:00:12.5", 1, "view", 8.0), (2, "00:00:12.5", 1, "view", 8.0), (3, "00:00:20", 2, "error", 4.5), (3, "00:00:21", 2, "view", 9.0), (None, "00:00:22", 2, "view", None)]
    duckdb.execute("CREATE OR REPLACE TEMP TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    duckdb.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", [(i, f"2024-01-01 {t}", *rest) for i, t, *rest in rows])
    duckdb.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = duckdb.execute(catalogue.ORACLE["rework_since_first"].replace("FROM events", "FROM e")).fetchall()
    assert want and {tuple(r) for r in catalogue.QUERIES["rework_since_first"](spark, str(tmp_path)).collect()} == set(want)


def test_points_in_spans_are_counted_without_meeting_them(spark):
    """Spans inside, at and over the edges of blocks, equal ones, reversed ones, null ones; a line with many points; no join sees a row for each point."""
    from pyspark.sql import functions as F

    spans = [(a, b) for a in range(-5, 40, 3) for b in range(a - 1, a + 30, 4)]
    items = [(k, k % 2, a, b) for k, (a, b) in enumerate(spans + spans[:20])] + [(9000, 0, None, 4), (9001, 5, 1, 9)]
    lines = [(k % 2, k * 7 % 50 - 6) for k in range(300)] + [(0, None), (1, 8)]
    i = spark.createDataFrame(items, "k int, rel int, start int, end int")
    p = spark.createDataFrame(lines, "rel int, line int").unionByName(spark.range(200_000).select(F.lit(0).alias("rel"), F.lit(9).alias("line")))
    want = {k: n for k, rel, a, b in items if a is not None and (n := sum(r == rel and x is not None and a <= x <= b for r, x in lines) + 200_000 * (rel == 0 and a <= 9 <= b))}
    for step in (1, 4, 256):
        assert {r.k: r.n for r in usage.count_within(i, p, ["rel"], step=step).collect()} == want


def test_closure_deals_out_nodes_that_many_reach(spark):
    """3,000 leaves under one chain: with a bound of 100 rows the same pairs, and a bound that holds."""
    edges = [("r", f"leaf{i}", "n0") for i in range(3000)] + [("r", f"n{i}", f"n{i + 1}") for i in range(4)]
    got = usage.closure(spark.createDataFrame(edges, "repo string, a string, z string"), most=100).collect()
    want = {("r", f"leaf{i}", f"n{j}") for i in range(3000) for j in range(5)} | {("r", f"n{i}", f"n{j}") for i in range(5) for j in range(i + 1, 5)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
