"""Queries on graphs of languages and on proofs, with their SQL: documents stand for source files, their texts are wrapped in statements made of their ids, or for findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.operators import jury, proofs, pyfacts, rules
from corvane.packs import cfamily, golang, modules, nested, sheets
from corvane.packs.base import audit
from corvane.plans.catalogue import query, table
from corvane.runtime import store


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _modules(spark, sf_dir):
    """Each document as a module: its text as a comment, a declaration, and by its id a star, renamed re-exports and a name that hides one behind the star, all of the module of half its id."""
    i, half = F.col("doc_id"), F.expr("doc_id div 2")
    only = lambda when, *parts: F.when(when & (i > 1), _text(*parts)).otherwise("")
    text = F.concat(
        _text("/* ", F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/", "* /"), " */\nexport const own", i, " = 1\n"),
        only(i % 2 == 1, "export * from './m", half, "'\n"),
        only(i % 4 == 0, "export {\n  own", half, " as via", i, ",\n} from \"./m", half, ".js\"\n"),
        only(i % 5 == 0, "import { own", half, " as x", i, " } from './m", half, "'\nexport { x", i, " as again", i, " }\n"),
        only(i % 6 == 3, "export function own", half, "() {}\n"),
    )
    return table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), _text("m", i, ".ts").alias("rel"), text.alias("text"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS i, doc_id // 2 AS h FROM documents),
x AS (SELECT i, 'own' || i AS name, i AS src, 'own' || i AS declared, 0 AS steps FROM d
      UNION ALL SELECT i, 'own' || h, i, 'own' || h, 0 FROM d WHERE i % 6 = 3 AND i > 1
      UNION ALL SELECT a.i, 'via' || a.i, a.h, 'own' || a.h, 1 FROM d a JOIN d b ON b.i = a.h WHERE a.i % 4 = 0 AND a.i > 1
      UNION ALL SELECT a.i, 'again' || a.i, a.h, 'own' || a.h, 1 FROM d a JOIN d b ON b.i = a.h WHERE a.i % 5 = 0 AND a.i > 1),
n AS (SELECT * FROM x UNION ALL SELECT d.i, n.name, n.src, n.declared, n.steps + 1 FROM n JOIN d ON d.h = n.i WHERE d.i % 2 = 1 AND d.i > 1 AND NOT (d.i % 6 = 3 AND n.name = 'own' || d.h))
SELECT 'm' || i || '.ts' AS rel, name, 'm' || src || '.ts' AS in_rel, declared, steps::INT AS steps FROM n""")
def exports_followed(spark, sf_dir):
    known = modules.facts(_modules(spark, sf_dir))
    return modules.follow(modules.exported(known), known).select("rel", "name", "in_rel", "declared", "steps")


@query("""
WITH d AS (SELECT doc_id AS i, doc_id // 2 AS h FROM documents), u AS (SELECT DISTINCT h FROM d WHERE (i % 4 = 0 OR i % 5 = 0) AND i > 1)
SELECT 'm' || i || '.ts' AS rel, 'own' || i AS name FROM d WHERE i NOT IN (SELECT h FROM u)
UNION ALL SELECT 'm' || i || '.ts', 'own' || h FROM d WHERE i % 6 = 3 AND i > 1""")
def exports_unused(spark, sf_dir):
    return modules.unused_exports(modules.facts(_modules(spark, sf_dir))).select("rel", "name")


def _braced(spark, sf_dir):
    """Each document's text in a class of its own, after as many nested blocks as its id says, with strings and comments that hold braces."""
    i = F.col("doc_id")
    deep = lambda s: F.expr(f"repeat('{s}', cast(doc_id % 4 as int))")
    text = _text("class A", i, " {\n  String s = \"}{\"; // }\n", deep(r"if (x) {\n"), "/* {\n */ go('{');\n", deep(r"}\n"), "}\n", F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), i.cast("string").alias("rel"), F.lit("Java").alias("lang"), text.alias("text"))


_TOKENS_SQL = r"""(?s)//[^\n]*|/\*.*?\*/|"{3}.*?"{3}|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|[{}();\n]|[^{}();\n"''/@]+|."""


@query(rf"""
WITH f AS (SELECT doc_id::VARCHAR AS rel, 'class A' || doc_id || ' {{' || chr(10) || '  String s = "}}{{"; // }}' || chr(10) || repeat('if (x) {{' || chr(10), (doc_id % 4)::INT) || '/* {{' || chr(10) || ' */ go(''{{'');' || chr(10) || repeat('}}' || chr(10), (doc_id % 4)::INT) || '}}' || chr(10) || coalesce(text, '') || chr(10) AS text FROM documents),
l AS (SELECT rel, regexp_extract_all(text, '{_TOKENS_SQL}') AS t FROM f), e AS (SELECT rel, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM l),
s AS (SELECT rel, tok, pos, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER w, 0) AS line, coalesce(sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w, 0) AS depth
      FROM e WINDOW w AS (PARTITION BY rel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
odd AS (SELECT rel FROM s GROUP BY rel HAVING sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) <> 0 OR coalesce(min(CASE WHEN tok = '}}' THEN depth END), 1) < 1),
b AS (SELECT rel, tok, line, CASE WHEN tok = '{{' THEN depth ELSE depth - 1 END AS level, row_number() OVER (PARTITION BY rel, tok, CASE WHEN tok = '{{' THEN depth ELSE depth - 1 END ORDER BY pos) AS nth FROM s WHERE tok IN ('{{', '}}') AND rel NOT IN (SELECT rel FROM odd))
SELECT o.rel, o.level::INT AS depth, o.line::INT AS line, c.line::INT AS end_line FROM b o JOIN b c ON c.rel = o.rel AND c.level = o.level AND c.nth = o.nth AND o.tok = '{{' AND c.tok = '}}'""")
def nested_blocks(spark, sf_dir):
    return nested.blocks(_braced(spark, sf_dir)).select("rel", "depth", "line", "end_line")


@query("""
SELECT doc_id::VARCHAR AS rel, kind, name, owner, private FROM documents, LATERAL (
  SELECT 'class' AS kind, 'A' || doc_id AS name, NULL AS owner, false AS private WHERE false
  UNION ALL SELECT 'field', 'f' || doc_id, 'A' || doc_id, true UNION ALL SELECT 'method', 'm' || doc_id, 'A' || doc_id, doc_id % 2 = 0
  UNION ALL SELECT 'class', 'In' || k, CASE WHEN k = 1 THEN 'A' || doc_id ELSE 'In' || (k - 1) END, k % 2 = 1 FROM range(1, doc_id % 4 + 1) r(k)
  UNION ALL SELECT 'method', 'deep' || k, 'In' || k, true FROM range(1, doc_id % 4 + 1) r(k)) x""")
def nested_members(spark, sf_dir):
    """Each document as the comment of a class with members and, by its id, up to three types one in another."""
    i = F.col("doc_id")
    each = F.transform(F.sequence(F.lit(1), F.greatest((i % 4).cast("int"), F.lit(1))), lambda k: _text(F.when(k % 2 == 1, "private ").otherwise("public "), "static class In", k, " {\nprivate int deep", k, "(int a, String b) {\n  return a;\n}\n"))
    inner = F.when(i % 4 > 0, F.concat(F.array_join(each, ""), F.expr(r"repeat('}\n', cast(doc_id % 4 as int))"))).otherwise("")
    comment = F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/", "* /")
    text = _text("/* ", comment, " */\npublic final class A", i, " extends B<C> {\n  @Mark(x = \"}\")\n  private final Map<K, V> f", i, " = new HashMap<>();\n  ", F.when(i % 2 == 0, "private ").otherwise("protected "), "synchronized <T> List<T> m", i, "(T a) throws E {\n    int local = 1;\n    for (int j = 0; j < 3; j++) { go(\"{\"); }\n  }\n", inner, "}\n")
    files = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), i.cast("string").alias("rel"), F.lit("Java").alias("lang"), text.alias("text"))
    return nested.members(files).select("rel", "kind", "name", F.col("owner_name").alias("owner"), "private")


def _headers(spark, sf_dir):
    """Each document, as a comment, in a header or (every tenth) a source file that includes that of a third of its id and defines a macro by that of half its id."""
    i = F.col("doc_id")
    rel = F.when(i % 10 == 0, _text("src/k", i, ".c")).otherwise(_text("src/d/k", i, ".h"))
    body = F.when(i % 97 == 0, "x##_made").when(i % 5 == 1, "x").otherwise(_text("M", F.expr("doc_id div 2"), "(x)"))
    text = _text("/* ", F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/", "* /"), " */\n#  include \"../d/k", F.expr("doc_id div 3"), ".h\"\n#include <stdio.h>\n#define M", i, "(x) \\\n  ", body, "\n")
    return table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), rel.alias("rel"), text.alias("text"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS i, doc_id // 3 AS p FROM documents), e AS (SELECT d.i, d.p FROM d JOIN d o ON o.i = d.p WHERE d.p % 10 <> 0 AND d.i <> d.p),
r AS (SELECT i, p FROM e WHERE i % 10 = 0 UNION SELECT r.i, e.p FROM r JOIN e ON e.i = r.p)
SELECT 'src/k' || i || '.c' AS rel, 'src/d/k' || p || '.h' AS part FROM r""")
def translation_units(spark, sf_dir):
    files = _headers(spark, sf_dir)
    return cfamily.translation_units(files, cfamily.includes(files).filter("`to` is not null and `to` <> rel")).select("rel", "part")


@query("""
WITH RECURSIVE d AS (SELECT doc_id AS i, doc_id // 2 AS h FROM documents),
p AS (SELECT i FROM d WHERE i % 97 = 0 UNION SELECT d.i FROM d JOIN p ON p.i = d.h WHERE d.i % 97 <> 0 AND d.i % 5 <> 1)
SELECT 'M' || i AS name FROM p""")
def macros_that_paste(spark, sf_dir):
    takes = F.col("takes")
    return cfamily.spreading(cfamily.macros(_headers(spark, sf_dir)), takes & F.col("body").contains("##"), takes).select("name")


def _repository(spark, sf_dir):
    """Each document as a removal in one of forty large or many small repositories: texts of seven's multiples of characters are needed, two of five's multiples clash; every 13th lies in code that can't be tried."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    length = F.coalesce(F.length("text"), F.lit(0))
    return d.select(_text("r", F.when(i % 2 == 0, i % 80).otherwise(i % 300 + 1000)).alias("repo"), F.lpad(i.cast("string"), 12, "0").alias("file"), F.lit(1).alias("line"), F.lit("function").alias("kind"), i.cast("string").alias("name"), F.when(i % 13 == 0, "not provable (test code)").alias("why_not"), (length % 7 == 0).alias("needed"), (length % 5 == 0).alias("clashes"))


_PROOF_SQL = """
WITH t AS (SELECT 'r' || r AS repo, doc_id, doc_id % 13 = 0 AS out_, coalesce(length(text), 0) % 7 = 0 AS needed, coalesce(length(text), 0) % 5 = 0 AS clashes, r % 11 = 4 AS broken FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN doc_id % 80 ELSE doc_id % 300 + 1000 END AS r FROM documents)),
k AS (SELECT *, CASE WHEN NOT out_ THEN row_number() OVER (PARTITION BY repo, out_ ORDER BY doc_id) END AS n FROM t),
s AS (SELECT *, NOT out_ AND n <= 6 AND NOT needed AS alone, bool_or(NOT out_ AND needed) OVER (PARTITION BY repo) OR count(*) FILTER (WHERE NOT out_ AND clashes) OVER (PARTITION BY repo) > 1 AS failed FROM k),
g AS (SELECT *, count(*) FILTER (WHERE alone AND clashes) OVER (PARTITION BY repo) > 1 AS apart, count(*) FILTER (WHERE alone AND clashes) OVER (PARTITION BY repo ORDER BY doc_id) AS nth FROM s),
p AS (SELECT repo, doc_id, n, broken, failed, CASE WHEN out_ THEN 'not provable (test code)' WHEN broken THEN 'not provable (the tests fail before any change)' WHEN NOT failed THEN 'passed' WHEN n > 6 THEN 'not run (isolation limit)' WHEN needed THEN 'failed: it is needed'
      WHEN apart AND clashes AND nth > 1 THEN 'failed together with other removals: two clash' ELSE 'passed' END AS proof FROM g)"""


def _proved(spark, sf_dir):
    c = _repository(spark, sf_dir)
    made = c.select("repo", "file", "needed", "clashes")

    def execute(runs):
        r = runs.join(made, ["repo", "file"], "left").groupBy("repo", "run").agg(F.coalesce(F.max("needed"), F.lit(False)).alias("needed"), F.count_if("clashes").alias("clashes"))
        broken = (F.col("run") == "baseline") & (F.substring("repo", 2, 9).cast("int") % 11 == 4)
        said = F.when(F.col("needed"), "some lines\nit is needed\n").when(F.col("clashes") > 1, "two clash")
        return r.select("repo", "run", (~(broken | F.col("needed") | (F.col("clashes") > 1))).alias("ok"), said.alias("output"))

    return proofs.prove(c.drop("needed", "clashes"), execute, isolate=6)


@query(_PROOF_SQL + " SELECT repo, doc_id::VARCHAR AS name, proof FROM p")
def proofs_by_rounds(spark, sf_dir):
    return proofs.settled(_proved(spark, sf_dir)).select("repo", "name", "proof")


@query(_PROOF_SQL + """
SELECT repo, count(*) AS candidates, count(*) FILTER (WHERE proof = 'passed') AS passed, CASE WHEN bool_or(broken) THEN 0 ELSE count(*) FILTER (WHERE n IS NOT NULL AND proof <> 'passed') END AS failed,
       CASE WHEN bool_or(broken) THEN 'baseline failed' WHEN count(n) = 0 THEN 'nothing the tests can prove' WHEN NOT bool_or(failed) THEN 'passed' ELSE 'failed: each removal was isolated' END AS batch FROM p GROUP BY repo""")
def proof_summaries(spark, sf_dir):
    return proofs.summary(_proved(spark, sf_dir))


@query("""
WITH RECURSIVE c AS (SELECT doc_id % 40 AS repo, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS i, coalesce(length(text), 0) % 4 <> 0 AS ok FROM documents),
w AS (SELECT repo, i, ok, CASE WHEN ok THEN 0 ELSE 1 END AS run, true AS asked FROM c WHERE i = 1
      UNION ALL SELECT c.repo, c.i, c.ok, CASE WHEN w.run >= 2 THEN w.run WHEN c.ok THEN 0 ELSE w.run + 1 END, w.run < 2 FROM w JOIN c ON c.repo = w.repo AND c.i = w.i + 1)
SELECT 'r' || repo AS repo, i::INT AS i, asked FROM w""")
def calls_until_two_failures(spark, sf_dir):
    from pyspark.sql import Window

    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(_text("r", i % 40).alias("repo"), F.row_number().over(Window.partitionBy(i % 40).orderBy(i)).alias("i"), (F.coalesce(F.length("text"), F.lit(0)) % 4 != 0).alias("ok"))
    return jury.stopped(d).select("repo", "i", "asked")


@query("""
SELECT 'p' || (doc_id % 10) || '/f' || doc_id || '.go' AS rel, name, CASE WHEN kept THEN 'AMBIGUOUS' ELSE 'REMOVE' END AS verdict
FROM documents, LATERAL (SELECT 'alone' || doc_id AS name, doc_id % 3 = 1 AS kept UNION ALL SELECT 'linked' || doc_id, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = documents.doc_id * 2 + 1) WHERE doc_id % 4 = 3 AND NOT (doc_id % 10 = 9 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = documents.doc_id * 2 + 1))) x
UNION ALL SELECT 'p' || (doc_id % 10) || '/f' || doc_id || '.go', 'byOther' || doc_id, 'REMOVE' FROM documents WHERE doc_id % 10 = 9 OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = documents.doc_id + 10)""")
def go_packages(spark, sf_dir):
    """Each document, as a comment, in a file of one of ten Go packages: a function alone, one that the file ten further on calls (in its package, but for one package), one that another package may link to."""
    i = F.col("doc_id")
    comment = F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/", "* /")
    text = F.concat(
        _text("/* ", comment, " */\npackage p\n\n"), F.when(i % 3 == 1, _text("//export alone", i, "\n")).otherwise(""), _text("func alone", i, "(a int) interface{} {\n\treturn alone", i, "(1)\n}\n\nfunc byOther", i, "() {\n}\n\nfunc init() {\n"),
        F.when(i % 10 != 9, _text("\tbyOther", i - 10, "()\n")).otherwise(""), F.lit("}\n"), F.when(i % 4 == 3, _text("\nfunc linked", i, "() {\n}\n")).otherwise(""), F.when((i % 2 == 1) & (F.expr("(doc_id - 1) div 2") % 4 == 3), _text("\n//go:linkname mine", i, " example.com/p.linked", F.expr("(doc_id - 1) div 2"), "\nfunc mine", i, "()\n")).otherwise(""),
    )
    files = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), _text("p", i % 10, "/f", i, ".go").alias("rel"), F.lit("Go").alias("lang"), text.alias("text"))
    return audit(files, golang.PACKS).filter("name not like 'mine%'").select("rel", "name", "verdict")


@query("""
WITH RECURSIVE d AS (SELECT page_id AS i, page_id // 3 AS p FROM pages), e AS (SELECT d.i, d.p FROM d JOIN d o ON o.i = d.p WHERE d.i > 0 AND d.p % 4 <> 0),
r AS (SELECT i, p FROM e WHERE i % 4 = 0 UNION SELECT r.i, e.p FROM r JOIN e ON e.i = r.p)
SELECT 'w/page' || i || '.html' AS page, 'css/s' || p || '.css' AS sheet FROM r""")
def styled_pages(spark, sf_dir):
    """Every fourth page links a sheet, the others stand for sheets that import one, each that of a third of its id."""
    i, third = F.col("page_id"), F.expr("page_id div 3")
    page = i % 4 == 0
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)<link|@import|@use|@forward|import|require", " ")
    text = F.concat(bare, F.when(page, _text("<link rel='stylesheet' href='../css/s", third, ".css'>")).otherwise(_text("\n@import url(\"s", third, ".css\");\n")))
    rel = F.when(page, _text("w/page", i, ".html")).otherwise(_text("css/s", i, ".css"))
    files = table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), rel.alias("rel"), text.alias("text"))
    return sheets.styled(files).select("page", "sheet")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id AS who, epoch_us(min(ts)) AS began, epoch_us(max(ts) + INTERVAL 1 DAY) AS ended, count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(spark, sf_dir):
    from corvane.streaming.limits import sessions

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("ts").cast("timestamp").alias("at"))
    return sessions(e, days=1).select("who", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "events")


def _lines(*parts) -> Column:
    """Parts joined; {i} in a string stands for the document's id."""
    out = []
    for p in parts:
        out.append(F.replace(F.lit(p), F.lit("{i}"), F.col("doc_id").cast("string")) if isinstance(p, str) else p)
    return F.concat(*out)


def _python_repositories(spark, sf_dir, python=True):
    """The Python files, or the others, of repositories. Each document as a repository: its text as comments of a module with names that are used, unused, or kept for a reason, beside a package, tests and a list of requirements."""
    i = F.col("doc_id")
    comment = F.concat(F.lit("# "), F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7E\n]", " "), F.lit("\n"), F.lit("\n# ")), F.lit("\n"))
    main = _lines(
        comment, "import os as os{i}\nimport sys\nfrom json import dumps as d{i}, loads\nimport readline\nfrom typing import Any{i}  # noqa\nfrom lib import x{i} as x{i}\nfrom far{i} import Outside{i}, never{i}\n",
        "try:\n    import fast{i}\nexcept ImportError:\n    pass\n\n\ndef used{i}(a):\n    import json as lazy{i}\n    return sys.argv, loads(a)\n\n\ndef dead{i}():\n    return dead{i}\n\n\n@wraps(used{i})\ndef deco{i}():\n    return 1\n\n\n",
        "@app.route('/x')\ndef view{i}():\n    return 1\n\n\nclass Gone{i}:\n    pass\n\n\nclass Kid{i}(Outside{i}):\n    pass\n\n\ndef pytest_thing{i}():\n    return 2\n\n\nused{i}(1)\nhandlers['do_' + str(1)]()\n",
    )
    every = [
        ("a.py", main, None), ("pkg/__init__.py", _lines("from .m import y{i}\n\n\ndef pub{i}():\n    return 3\n"), None), ("pkg/m.py", _lines("import requests\ny{i} = 1\n\n\ndef do_{i}():\n    return requests\n\n\ndef _own{i}():\n    return 4\n"), None),
        ("tests/test_a.py", _lines("def test_x{i}():\n    pass\n\n\ndef helper{i}():\n    return 5\n"), None), ("requirements.txt", _lines("requests>=2\nunused-thing{i}==1\n"), None),
        ("broken.py", _lines("def bad(:\n    os{i}\n    dead{i}\n"), i % 5 == 0), ("notes.md", _lines("Call `_own{i}()` or `Gone{i}`.\n"), i % 3 == 0), ("c.py", _lines("from a import d{i}\nprint(d{i})\n"), i % 2 == 0),
    ]
    f = F.array(*(F.struct(F.lit(rel).alias("rel"), (F.when(when, text) if when is not None else text).alias("text")) for rel, text, when in every if rel.endswith(".py") == python))
    d = table(spark, sf_dir, "documents").select(_text("r", i).alias("repo"), F.explode(f).alias("f"))
    return d.select("repo", "f.rel", "f.text").filter("text is not null")


@query("""
SELECT 'r' || doc_id AS repo, kind, file, prefix || CASE WHEN numbered THEN doc_id::VARCHAR ELSE '' END AS name, verdict FROM documents, LATERAL (VALUES
 ('import', 'a.py', 'os', true, CASE WHEN doc_id % 5 = 0 THEN 'AMBIGUOUS' ELSE 'REMOVE' END), ('import', 'a.py', 'd', true, CASE WHEN doc_id % 2 = 1 THEN 'REMOVE' END), ('import', 'a.py', 'readline', false, 'AMBIGUOUS'), ('import', 'a.py', 'never', true, 'REMOVE'),
 ('import', 'a.py', 'fast', true, 'AMBIGUOUS'), ('import', 'a.py', 'lazy', true, 'AMBIGUOUS'), ('function', 'a.py', 'dead', true, CASE WHEN doc_id % 5 <> 0 THEN 'REMOVE' END), ('function', 'a.py', 'deco', true, 'AMBIGUOUS'),
 ('class', 'a.py', 'Gone', true, CASE WHEN doc_id % 3 <> 0 THEN 'REMOVE' END), ('class', 'a.py', 'Kid', true, 'AMBIGUOUS'), ('function', 'a.py', 'pytest_thing', true, 'AMBIGUOUS'), ('import', 'pkg/__init__.py', 'y', true, 'AMBIGUOUS'), ('function', 'pkg/__init__.py', 'pub', true, 'AMBIGUOUS'),
 ('function', 'pkg/m.py', 'do_', true, 'AMBIGUOUS'), ('function', 'pkg/m.py', '_own', true, CASE WHEN doc_id % 3 <> 0 THEN 'REMOVE' END), ('function', 'tests/test_a.py', 'helper', true, 'AMBIGUOUS'), ('dependency', 'requirements.txt', 'unused-thing', true, 'AMBIGUOUS')) v(kind, file, prefix, numbered, verdict) WHERE verdict IS NOT NULL""")
def python_rules(spark, sf_dir):
    facts = pyfacts.stored(_python_repositories(spark, sf_dir))
    r = rules.Repository(facts, store(_python_repositories(spark, sf_dir, python=False), "others"), facts.files.select("repo", "rel"))
    return rules.python_findings(r).select("repo", "kind", "file", "name", "verdict")


@query("""
SELECT 'r' || doc_id AS repo, rel, module, prefix || CASE WHEN numbered THEN doc_id::VARCHAR ELSE '' END AS bound, top_level, in_try FROM (SELECT doc_id, rel, module || CASE WHEN own THEN doc_id::VARCHAR ELSE '' END AS module, prefix, numbered, top_level, in_try, every FROM documents, LATERAL (VALUES
 ('a.py', 'os', false, 'os', true, true, false, true), ('a.py', 'sys', false, 'sys', false, true, false, true), ('a.py', 'json', false, 'd', true, true, false, true), ('a.py', 'json', false, 'loads', false, true, false, true), ('a.py', 'readline', false, 'readline', false, true, false, true),
 ('a.py', 'typing', false, 'Any', true, true, false, true), ('a.py', 'lib', false, 'x', true, true, false, true), ('a.py', 'far', true, 'Outside', true, true, false, true), ('a.py', 'far', true, 'never', true, true, false, true), ('a.py', 'fast', true, 'fast', true, false, true, true),
 ('a.py', 'json', false, 'lazy', true, false, false, true), ('pkg/__init__.py', '.m', false, 'y', true, true, false, true), ('pkg/m.py', 'requests', false, 'requests', false, true, false, true), ('c.py', 'a', false, 'd', true, true, false, doc_id % 2 = 0)) v(rel, module, own, prefix, numbered, top_level, in_try, every)) WHERE every""")
def python_imports(spark, sf_dir):
    f = pyfacts.Facts(pyfacts.python_facts(_python_repositories(spark, sf_dir), ["import"]))
    return f.imports.select("repo", "rel", "module", "bound", "top_level", "in_try")


@query("""
SELECT 'r' || doc_id AS repo, rel, kind, prefix || doc_id AS name, n_decorators FROM documents, LATERAL (VALUES
 ('a.py', 'function', 'used', 0), ('a.py', 'function', 'dead', 0), ('a.py', 'function', 'deco', 1), ('a.py', 'function', 'view', 1), ('a.py', 'class', 'Gone', 0), ('a.py', 'class', 'Kid', 0), ('a.py', 'function', 'pytest_thing', 0),
 ('pkg/__init__.py', 'function', 'pub', 0), ('pkg/m.py', 'function', 'do_', 0), ('pkg/m.py', 'function', '_own', 0), ('tests/test_a.py', 'function', 'test_x', 0), ('tests/test_a.py', 'function', 'helper', 0)) v(rel, kind, prefix, n_decorators)""")
def python_definitions(spark, sf_dir):
    f = pyfacts.Facts(pyfacts.python_facts(_python_repositories(spark, sf_dir), ["def"]))
    return f.defs.select("repo", "rel", "kind", "name", F.size("decorators").alias("n_decorators"))
