"""More named queries with their SQL, on several repositories each: joins, groups, choices and rules of the audit and its service."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.operators import attribution, copies, jury, metrics, resolve, service, usage, words
from corvane.operators.ledger import Ledger
from corvane.plans.catalogue import query, table
from corvane.runtime import shared_folder


def _code(spark, sf_dir) -> DataFrame:
    """documents as code: some lines become comments, block comments, imports or punctuation, by their number."""
    d = table(spark, sf_dir, "documents")
    marked = F.transform(
        F.split("text", "\n", -1),
        lambda t, i: F.when(i % 7 == 1, F.concat(F.lit("  // "), t)).when(i % 7 == 2, F.concat(F.lit("import "), t)).when(i % 7 == 3, F.concat(F.lit("/* open "), F.lit("note"))).when(i % 7 == 5, F.concat(F.lit("note */ "), t)).when(i % 11 == 0, F.lit(" });")).otherwise(t),
    )
    return d.select(F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string")).alias("repo"), F.col("doc_id").alias("rel"), F.lit("JavaScript").alias("lang"), F.array_join(marked, "\n").alias("text"))


_CODE_SQL = r"""
raw AS (SELECT 'r' || (doc_id % 2) AS repo, doc_id AS rel, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
code AS (SELECT repo, rel, (i + 1)::INT AS ln, CASE WHEN i % 7 = 1 THEN '  // ' || t WHEN i % 7 = 2 THEN 'import ' || t WHEN i % 7 = 3 THEN '/* open note' WHEN i % 7 = 5 THEN 'note */ ' || t WHEN i % 11 = 0 AND i % 7 <> 4 THEN ' });'
  WHEN i % 7 = 4 THEN '' ELSE t END AS t, i FROM raw),
open_ AS (SELECT *, CASE WHEN i % 7 = 5 THEN regexp_replace(t, '^note \*/ ?', '') WHEN i % 7 = 3 THEN '' ELSE t END AS u FROM code),
sig AS (SELECT repo, rel, ln, trim(regexp_replace(u, '\s+', ' ', 'g')) AS text FROM open_ WHERE i % 7 NOT IN (1, 2, 3, 4)),
lines AS (SELECT repo, rel, ln, text, row_number() OVER (PARTITION BY repo, rel ORDER BY ln) - 1 AS pos FROM sig
  WHERE text <> '' AND NOT starts_with(text, '//') AND NOT starts_with(text, '*') AND NOT starts_with(text, '<!--') AND NOT regexp_matches(text, '{punct}') AND NOT regexp_matches(text, '{imports}'))"""


def _code_sql() -> str:
    return _CODE_SQL.replace("{punct}", L.PUNCTUATION_LINE.replace("'", "''")).replace("{imports}", L.IMPORT_LINE.replace("'", "''"))


@query(f"WITH {_code_sql()} SELECT repo, rel, pos::INT AS pos, ln, text FROM lines")
def significant_code_lines(spark, sf_dir):
    return copies.significant_lines(_code(spark, sf_dir)).select("repo", "rel", F.col("pos").cast("int").alias("pos"), F.col("ln").cast("int").alias("ln"), "text")


@query(f"""
WITH {_code_sql()},
w AS (SELECT repo, rel, pos, list(text) OVER (PARTITION BY repo, rel ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS t FROM lines),
win AS (SELECT repo, rel, pos, array_to_string(t, chr(10)) AS key FROM w WHERE len(t) = 6 AND list_sum(list_transform(t, lambda x: length(x))) >= 120),
f AS (SELECT repo, key, min({{'rel': rel, 'pos': pos}}) AS o FROM win GROUP BY repo, key HAVING count(*) > 1)
SELECT win.repo, win.rel, win.pos::INT AS pos, o.rel AS of_rel, o.pos::INT AS of_pos FROM win JOIN f USING (repo, key) WHERE NOT (win.rel = o.rel AND win.pos - o.pos < 6)""")
def copied_code_windows(spark, sf_dir):
    c = copies.copy_windows(copies.windows(copies.significant_lines(_code(spark, sf_dir))))
    return c.select("repo", "rel", F.col("pos").cast("int").alias("pos"), "of_rel", F.col("of_pos").cast("int").alias("of_pos"))


@query("""
WITH i AS (SELECT o_orderstatus AS repo, (o_custkey % 50)::INT AS rel, o_orderkey % 1000 AS bound, o_orderkey AS line FROM orders),
u AS (SELECT DISTINCT l_linestatus AS repo, (l_suppkey % 50)::INT AS rel, l_partkey % 1000 AS bound FROM lineitem),
x AS (SELECT DISTINCT CASE c_nationkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS repo, (c_custkey % 50)::INT AS rel, c_custkey % 1000 AS bound FROM customer)
SELECT repo, rel, bound, line FROM i WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.repo = i.repo AND u.rel = i.rel AND u.bound = i.bound) AND NOT EXISTS (SELECT 1 FROM x WHERE x.repo = i.repo AND x.rel = i.rel AND x.bound = i.bound)""")
def unused_imports_not_exported(spark, sf_dir):
    o, li, c = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    i = o.select(F.col("o_orderstatus").alias("repo"), (F.col("o_custkey") % 50).cast("int").alias("rel"), (F.col("o_orderkey") % 1000).alias("bound"), F.col("o_orderkey").alias("line"))
    used = li.select(F.col("l_linestatus").alias("repo"), (F.col("l_suppkey") % 50).cast("int").alias("rel"), (F.col("l_partkey") % 1000).alias("name"))
    n = F.col("c_nationkey") % 3
    exported = c.select(F.when(n == 0, "O").when(n == 1, "F").otherwise("P").alias("repo"), (F.col("c_custkey") % 50).cast("int").alias("rel"), (F.col("c_custkey") % 1000).alias("name"))
    return usage.unused_imports(i, used, exported)


_MODULES_SQL = """
m AS (SELECT 'r' || (p_partkey % 3) AS repo, CASE WHEN p_partkey % 11 = 0 THEN 'src/pkg' || (p_partkey % 7) || '/__init__.py' WHEN p_partkey % 4 = 0 THEN 'src/pkg' || (p_partkey % 7) || '/m' || p_partkey || '.py' ELSE 'lib' || (p_partkey % 5) || '/m' || p_partkey || '.py' END AS rel FROM part),
files AS (SELECT DISTINCT repo, rel FROM m)"""


def _modules(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda n: (k % n).cast("string")
    package = F.concat(F.lit("src/pkg"), s(7))
    rel = F.when(k % 11 == 0, F.concat(package, F.lit("/__init__.py"))).when(k % 4 == 0, F.concat(package, F.lit("/m"), k.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("lib"), s(5), F.lit("/m"), k.cast("string"), F.lit(".py")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("r"), s(3)).alias("repo"), rel.alias("rel")).distinct()


_INDEX_SQL = """
parts AS (SELECT repo, rel, CASE WHEN ends_with(rel, '/__init__.py') THEN string_split(replace(rel, '/__init__.py', ''), '/') ELSE string_split(replace(rel, '.py', ''), '/') END AS p FROM files),
heads AS (SELECT repo, rel, p, unnest(range(0, len(p))) AS i FROM parts),
packages AS (SELECT repo, replace(rel, '/__init__.py', '') AS above FROM files WHERE ends_with(rel, '/__init__.py')),
idx AS (SELECT repo, rel AS target, array_to_string(p[i + 1:], '.') AS module FROM heads WHERE NOT EXISTS (SELECT 1 FROM packages k WHERE k.repo = heads.repo AND k.above = array_to_string(p[1:i], '/')))"""


@query(f"WITH {_MODULES_SQL}, {_INDEX_SQL} SELECT repo, module, target FROM idx")
def module_names(spark, sf_dir):
    return resolve.module_index(_modules(spark, sf_dir)).select("repo", "module", "target")


_ASKED_SQL = """
asked AS (SELECT 'r' || (o_orderkey % 3) AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'src/pkg' || (o_custkey % 7) || '/m' || (o_custkey % 100 * 4) || '.py' ELSE 'lib' || (o_custkey % 5) || '/x.py' END AS rel,
 CASE o_orderkey % 5 WHEN 0 THEN '.m' || (o_orderkey % 400) WHEN 1 THEN '..pkg' || (o_orderkey % 7) || '.m' || (o_orderkey % 400) WHEN 2 THEN 'pkg' || (o_orderkey % 7) WHEN 3 THEN 'm' || (o_orderkey % 400) ELSE 'json' END AS module FROM orders)"""


@query(f"""
WITH {_MODULES_SQL}, {_INDEX_SQL}, {_ASKED_SQL}, a AS (SELECT DISTINCT * FROM asked),
plain AS (SELECT a.*, idx.target FROM a JOIN idx USING (repo, module) WHERE NOT starts_with(module, '.') AND module <> 'json'),
lead AS (SELECT *, length(module) - length(ltrim(module, '.')) AS level, string_split(rel, '/') AS b FROM a WHERE starts_with(module, '.')),
path AS (SELECT repo, rel, module, array_to_string(list_concat(b[1:greatest(len(b) - level, 0)], string_split(ltrim(module, '.'), '.')), '/') AS p FROM lead),
rel_ AS (SELECT path.repo, path.rel, path.module, files.rel AS target FROM path JOIN files ON files.repo = path.repo AND (files.rel = p || '.py' OR files.rel = p || '/__init__.py'))
SELECT repo, rel, module, target FROM plain UNION ALL SELECT repo, rel, module, target FROM rel_""")
def resolved_modules(spark, sf_dir):
    f = _modules(spark, sf_dir)
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    rel = F.when(k % 2 == 0, F.concat(F.lit("src/pkg"), s(c % 7), F.lit("/m"), s(c % 100 * 4), F.lit(".py"))).otherwise(F.concat(F.lit("lib"), s(c % 5), F.lit("/x.py")))
    module = F.when(k % 5 == 0, F.concat(F.lit(".m"), s(k % 400))).when(k % 5 == 1, F.concat(F.lit("..pkg"), s(k % 7), F.lit(".m"), s(k % 400))).when(k % 5 == 2, F.concat(F.lit("pkg"), s(k % 7))).when(k % 5 == 3, F.concat(F.lit("m"), s(k % 400))).otherwise("json")
    asked = o.select(F.concat(F.lit("r"), s(k % 3)).alias("repo"), rel.alias("rel"), module.alias("module")).distinct()
    return resolve.resolve(asked, f, resolve.module_index(f)).select("repo", "rel", "module", "target")


@query(f"""
WITH {_MODULES_SQL}, p AS (SELECT 'r' || (s_suppkey % 3) AS repo, 'conf' || s_suppkey || '.yml' AS "by", CASE WHEN s_suppkey % 2 = 0 THEN 'm' || (s_suppkey * 4) || '.py' ELSE 'pkg' || (s_suppkey % 7) || '/m' || (s_suppkey * 4) || '.py' END AS path FROM supplier)
SELECT files.repo, rel, min(p.by) AS "by" FROM files JOIN p ON files.repo = p.repo AND (rel = path OR ends_with(rel, '/' || path)) GROUP BY files.repo, rel""")
def config_loaded_files(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("m"), (k * 4).cast("string"), F.lit(".py"))
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), (k % 3).cast("string")).alias("repo"), F.concat(F.lit("conf"), k.cast("string"), F.lit(".yml")).alias("rel"), F.when(k % 2 == 0, name).otherwise(F.concat(F.lit("pkg"), (k % 7).cast("string"), F.lit("/"), name)).alias("path"))
    return resolve.config_loaded(SimpleNamespace(files=_modules(spark, sf_dir)), paths).select("repo", "rel", "by")


@query("""
SELECT DISTINCT 'r' || (s_suppkey % 3) AS repo, CASE WHEN s_suppkey % 2 = 0 THEN 'lib' || s_suppkey ELSE '' END AS root FROM supplier WHERE s_suppkey % 5 IN (0, 1) OR (s_suppkey % 5 = 2 AND s_suppkey % 3 = 0)""")
def library_folders(spark, sf_dir):
    """Manifests of every kind; those of the third kind are a library's only where they hold a project table."""
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "setup.py").when(k % 5 == 1, "setup.cfg").when(k % 5 == 2, "pyproject.toml").otherwise("readme.md")
    rel = F.when(k % 2 == 0, F.concat(F.lit("lib"), k.cast("string"), F.lit("/"), name)).otherwise(name)
    text = F.when(k % 3 == 0, "[project]\nname = 'x'").otherwise("[tool.black]")
    return resolve.library_roots(table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), (k % 3).cast("string")).alias("repo"), rel.alias("rel"), text.alias("text")))


@query("""
WITH RECURSIVE c AS (SELECT 'r' || (c_custkey % 2) AS repo, 'C' || c_custkey AS name, 'C' || (c_custkey // 3 + CASE WHEN (c_custkey // 3) % 2 <> c_custkey % 2 THEN 1 ELSE 0 END) AS parent, c_custkey % 97 = 0 AS hook, c_custkey AS k FROM customer),
e AS (SELECT c.repo, c.name, c.parent, p.hook AS under FROM c JOIN c p ON p.repo = c.repo AND p.name = c.parent WHERE c.name <> c.parent),
b AS (SELECT repo, name, parent || ' defines __init_subclass__' AS why FROM e WHERE under),
m AS (SELECT * FROM b UNION SELECT e.repo, e.name, m.why FROM m JOIN e ON e.repo = m.repo AND e.parent = m.name AND NOT e.under)
SELECT repo, name, why FROM m""")
def classes_under_hooks(spark, sf_dir):
    """A class is marked by its nearest ancestor that sees its subclasses; every class has one base of its own repository."""
    k = F.col("c_custkey")
    third = F.expr("c_custkey div 3")
    base = third + F.when(third % 2 != k % 2, 1).otherwise(0)
    bases = F.when(base != k, F.array(F.concat(F.lit("C"), base.cast("string")))).otherwise(F.array().cast("array<string>"))
    known = table(spark, sf_dir, "customer").select(k)
    c = known.select(F.concat(F.lit("r"), (k % 2).cast("string")).alias("repo"), F.lit("a.py").alias("rel"), F.concat(F.lit("C"), k.cast("string")).alias("name"), bases.alias("bases"), F.lit(None).cast("string").alias("metaclass"), (k % 97 == 0).alias("init_subclass"), F.array().cast("array<string>").alias("external_roots"))
    return usage.registered_classes(c, spark.createDataFrame([], "repo string, name string")).select("repo", "name", "why")


@query("""
WITH b AS (SELECT l_returnflag AS repo, l_orderkey AS rel, l_linenumber AS line, CASE WHEN l_linenumber = 7 THEN '0000' ELSE 's' || (l_orderkey * 2) END AS sha FROM lineitem),
c AS (SELECT DISTINCT 's' || o_orderkey AS sha, CASE o_orderstatus WHEN 'O' THEN 'ai' ELSE 'human' END AS kind FROM orders)
SELECT repo, rel, line::INT AS line, CASE WHEN b.sha = '0000' THEN 'uncommitted' ELSE coalesce(kind, 'unknown') END AS kind FROM b LEFT JOIN c USING (sha)""")
def blamed_line_kinds(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sha = F.when(F.col("l_linenumber") == 7, "0000").otherwise(F.concat(F.lit("s"), (F.col("l_orderkey") * 2).cast("string")))
    blame = li.select(F.col("l_returnflag").alias("repo"), F.col("l_orderkey").alias("rel"), F.col("l_linenumber").cast("int").alias("line"), sha.alias("sha"))
    commits = o.select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sha"), F.when(F.col("o_orderstatus") == "O", "ai").otherwise("human").alias("kind"), F.lit(1).alias("ct"))
    return attribution.line_kinds(blame, commits.crossJoin(F.broadcast(li.select(F.col("l_returnflag").alias("repo")).distinct()))).select("repo", "rel", "line", "kind")


@query("""
WITH l AS (SELECT l_returnflag AS repo, CASE l_linestatus WHEN 'O' THEN 'ai' ELSE 'human' END AS kind, l_comment AS c FROM lineitem)
SELECT repo, kind, count(*) AS lines FROM l GROUP BY repo, kind""".replace(", l_comment AS c", ""))
def lines_by_author_everywhere(spark, sf_dir):
    """All blamed lines, audited or not."""
    li = table(spark, sf_dir, "lineitem")
    return attribution.lines_by_kind(li.select(F.col("l_returnflag").alias("repo"), F.when(F.col("l_linestatus") == "O", "ai").otherwise("human").alias("kind"))).select("repo", "kind", "lines")


_COMMITS_SQL = """
c AS (SELECT 'u' || (user_id % 20) AS repo, event_id AS sha, epoch(ts)::BIGINT AS ct, event_type <> 'view' AS on_head, CASE WHEN event_id % 3 = 0 THEN 'Copilot' WHEN event_id % 7 = 1 THEN 'Cursor' END AS tool FROM events)"""


def _commits(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    tool = F.when(i % 3 == 0, "Copilot").when(i % 7 == 1, "Cursor")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("repo"), i.alias("sha"), S.nearest_second(F.col("ts")).alias("ct"), (F.col("event_type") != "view").alias("on_head"), tool.alias("tool"), F.when(tool.isNull(), "human").otherwise("ai").alias("kind"))


@query(f"WITH {_COMMITS_SQL} SELECT repo, tool, count(*) AS commits FROM c WHERE on_head AND tool IS NOT NULL GROUP BY repo, tool")
def assistant_commits(spark, sf_dir):
    return attribution.tools(_commits(spark, sf_dir))


@query(f"WITH {_COMMITS_SQL} SELECT repo, count(*) FILTER (tool IS NOT NULL) AS ai_commits, count(*) AS commits FROM c WHERE on_head GROUP BY repo")
def ai_commit_share(spark, sf_dir):
    return attribution.ai_commits(_commits(spark, sf_dir))


def _snapshot(spark, sf_dir, change: int) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 == change, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("rel"), S.fingerprint(text).alias("sha"), "doc_id")


def _ledger(spark, sf_dir) -> Ledger:
    """Two runs: all repositories, then those but src1; in the second run other files had changed and only some verdicts were judged."""
    ledger = Ledger(spark, f"{shared_folder(spark)}/corvane/ledger-{uuid.uuid4().hex}")
    for run, change in ((1, 9), (2, 1)):
        h = _snapshot(spark, sf_dir, change).filter(F.lit(run == 1) | (F.col("repo") != "src1"))
        final = F.when(F.col("doc_id") % 3 == run - 1, "KEEP").otherwise("REMOVE")
        v = h.select("repo", F.lit("import").alias("kind"), F.col("rel").alias("file"), (F.col("doc_id") % 40).cast("int").alias("line"), F.lit("x").alias("name"), final.alias("final"), F.when(F.col("doc_id") % 4 != 0, F.lit(f"run {run}")).alias("judgement"))
        ledger.record(h.select("repo").distinct().withColumn("lines", F.lit(run)), v, h.select("repo", "rel", "sha"))
    return ledger


_LEDGER_SQL = """
d AS (SELECT source AS repo, 'f' || doc_id AS rel, doc_id, CASE WHEN source = 'src1' THEN 1 ELSE 2 END AS run FROM documents),
h AS (SELECT *, CASE WHEN run = 2 AND doc_id % 5 = 1 THEN 'changed' ELSE 'same' END AS was FROM d)"""


@query(f"WITH {_LEDGER_SQL} SELECT repo, rel FROM h WHERE was <> CASE WHEN doc_id % 5 = 2 THEN 'other' ELSE 'same' END")
def changed_since_last_run(spark, sf_dir):
    return _ledger(spark, sf_dir).changed(_snapshot(spark, sf_dir, 2).select("repo", "rel", "sha")).select("repo", "rel")


@query(f"""
WITH {_LEDGER_SQL} SELECT repo, rel AS file, CASE WHEN was = CASE WHEN doc_id % 5 = 2 THEN 'other' ELSE 'same' END AND doc_id % 4 <> 0 THEN CASE WHEN doc_id % 3 = run - 1 THEN 'KEEP' ELSE 'REMOVE' END END AS last_final,
 CASE WHEN was = CASE WHEN doc_id % 5 = 2 THEN 'other' ELSE 'same' END AND doc_id % 4 <> 0 THEN 'run ' || run END AS last_judgement FROM h""")
def reused_judgements(spark, sf_dir):
    now = _snapshot(spark, sf_dir, 2)
    f = now.select("repo", F.lit("import").alias("kind"), F.col("rel").alias("file"), (F.col("doc_id") % 40).cast("int").alias("line"), F.lit("x").alias("name"))
    return _ledger(spark, sf_dir).reusable(f, now.select("repo", "rel", "sha")).select("repo", "file", "last_final", "last_judgement")


@query("SELECT source AS repo, CASE WHEN source = 'src1' THEN 1 ELSE 2 END::BIGINT AS run_id FROM documents GROUP BY source")
def last_run_by_repository(spark, sf_dir):
    return _ledger(spark, sf_dir).last_runs().select("repo", "run_id")


@query("SELECT DISTINCT source AS repo, run::BIGINT AS run_id, run::BIGINT AS lines FROM documents, (VALUES (1), (2)) v(run) WHERE NOT (source = 'src1' AND run = 2)")
def run_history(spark, sf_dir):
    return _ledger(spark, sf_dir).histories(30).select("repo", "run_id", "lines")


@query("""
WITH p AS (SELECT upper(s_name) AS full_name FROM supplier), q AS (SELECT 'supplier#' || lpad((c_custkey * 2)::VARCHAR, 9, '0') AS full_name FROM customer)
SELECT full_name, 'private' AS source FROM p UNION ALL SELECT full_name, 'public' FROM q WHERE lower(full_name) NOT IN (SELECT lower(full_name) FROM p)""")
def repository_choices(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.upper("s_name").alias("full_name"))
    q = table(spark, sf_dir, "customer").select(F.concat(F.lit("supplier#"), F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0")).alias("full_name"))
    return service.merged_choices(p, q)


_LANG_SQL = "CASE doc_id % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' WHEN 2 THEN 'Markdown' WHEN 3 THEN 'JSON' WHEN 4 THEN 'Ruby' ELSE 'Other' END"


@query(f"""
SELECT source AS repo, {_LANG_SQL} AS lang, count(*) AS files, sum(n_chars)::BIGINT AS lines,
 CASE {_LANG_SQL} WHEN 'Python' THEN 'full' WHEN 'Go' THEN 'full' WHEN 'Markdown' THEN 'prose' WHEN 'JSON' THEN 'data' WHEN 'Ruby' THEN 'copies' ELSE 'none' END AS audit FROM documents GROUP BY ALL""")
def audit_levels(spark, sf_dir):
    n = F.col("doc_id") % 6
    lang = F.element_at(F.array(*map(F.lit, ("Python", "Go", "Markdown", "JSON", "Ruby", "Other"))), (n + 1).cast("int"))
    return metrics.census(table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), lang.alias("lang"), F.col("n_chars").alias("lines")), ["Go"])


_JOBS_SQL = """
j AS (SELECT event_id AS id, 'U' || (user_id % 300) AS repo, 's' || (event_id % 9) AS sha, '1' AS version, user_id % 50 AS owner, ts AS created, value,
 CASE event_type WHEN 'view' THEN 'queued' WHEN 'error' THEN 'cloning' WHEN 'click' THEN 'scanning' ELSE 'done' END AS status, CASE WHEN event_id % 3 = 0 THEN 'private' ELSE 'public' END AS visibility FROM events)"""


def _jobs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "error", "cloning").when(kind == "click", "scanning").otherwise("done")
    return e.select(i.alias("id"), F.concat(F.lit("U"), (F.col("user_id") % 300).cast("string")).alias("repo"), F.concat(F.lit("s"), (i % 9).cast("string")).alias("sha"), F.lit("1").alias("version"), (F.col("user_id") % 50).alias("owner"), F.col("ts").alias("created"), "value", status.alias("status"), F.when(i % 3 == 0, "private").otherwise("public").alias("visibility"))


@query(f"WITH {_JOBS_SQL} SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status IN ('cloning', 'scanning')) AS running FROM j")
def queue_totals(spark, sf_dir):
    return service.queue_counts(_jobs(spark, sf_dir))


@query(f"WITH {_JOBS_SQL} SELECT id, repo FROM j WHERE visibility = 'public' OR owner = 7")
def visible_jobs(spark, sf_dir):
    return service.visible(_jobs(spark, sf_dir), 7).select("id", "repo")


@query(f"""
WITH {_JOBS_SQL}, h AS (SELECT lower(repo) AS r, sha, version, max(id) AS cached_id FROM j WHERE status = 'done' GROUP BY ALL), a AS (SELECT DISTINCT lower(repo) AS repo, sha, version FROM j)
SELECT a.repo, a.sha, cached_id FROM a LEFT JOIN h ON h.r = a.repo AND h.sha = a.sha AND h.version = a.version""")
def cached_results(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return service.cached(j.select(F.lower("repo").alias("repo"), "sha", "version").distinct(), j).select("repo", "sha", "cached_id")


@query(f"WITH {_JOBS_SQL} SELECT id FROM j WHERE epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(created)) < 2592000")
def live_sessions(spark, sf_dir):
    return service.unexpired(_jobs(spark, sf_dir), "created", "2024-02-05 00:00:00", 30 * 86400).select("id")


@query("""
SELECT user_id % 40 AS client_id, max(n_name) AS name, min(ts) AS since, max(ts) AS last_used FROM events LEFT JOIN nation ON n_nationkey = user_id % 40 GROUP BY 1""")
def apps_connected(spark, sf_dir):
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("client_id"), F.col("ts").alias("created"), F.col("ts").alias("last_used"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("client_id"), F.col("n_name").alias("name"))
    return service.connected_apps(t, c)


_F_SQL = """
f AS (SELECT doc_id, source AS repo, CASE doc_id % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'function' WHEN 2 THEN 'dependency' ELSE 'style' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'tests/test_' ELSE 'src/' END || (doc_id % 60) || '.py' AS file, (doc_id % 50)::INT AS line, 'n' || doc_id AS name,
 CASE doc_id % 5 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'SIMPLIFY' ELSE 'REMOVE' END AS verdict, CASE doc_id % 7 WHEN 0 THEN 'failed: tests' WHEN 1 THEN 'not run' ELSE 'passed' END AS proof FROM documents)"""


def _finds(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("import", "function", "dependency", "style"))), (n % 4 + 1).cast("int"))
    file = F.concat(F.when(n % 3 == 0, "tests/test_").otherwise("src/"), (n % 60).cast("string"), F.lit(".py"))
    verdict = F.when(n % 5 == 0, "AMBIGUOUS").when(n % 5 == 1, "SIMPLIFY").otherwise("REMOVE")
    proof = F.when(n % 7 == 0, "failed: tests").when(n % 7 == 1, "not run").otherwise("passed")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), kind.alias("kind"), file.alias("file"), (n % 50).cast("int").alias("line"), F.concat(F.lit("n"), n.cast("string")).alias("name"), verdict.alias("verdict"), proof.alias("proof"), jury.default_final(verdict).alias("final"))


@query(f"WITH {_F_SQL} SELECT doc_id, CASE WHEN verdict = 'AMBIGUOUS' THEN 'KEEP' WHEN verdict = 'REMOVE' AND kind <> 'dependency' AND proof <> 'passed' THEN 'KEEP' ELSE verdict END AS final FROM f")
def final_after_proof(spark, sf_dir):
    return _finds(spark, sf_dir).select("doc_id", jury.after_proof(F.col("final"), F.col("kind"), F.col("proof")).alias("final"))


@query(f"""
WITH {_F_SQL}, l AS (SELECT DISTINCT 'src' || (s_suppkey % 4) AS repo, 'src/' || (s_suppkey % 45) || '.py' AS rel FROM supplier)
SELECT doc_id, CASE WHEN verdict <> 'REMOVE' THEN 'not a removal' WHEN file LIKE 'tests/%' AND kind <> 'import' THEN 'not provable (test code)' WHEN l.rel IS NULL THEN 'not provable (no test loads the file)' END AS why_not
FROM f LEFT JOIN l ON l.repo = f.repo AND l.rel = f.file""")
def provable_findings(spark, sf_dir):
    k = F.col("s_suppkey")
    loaded = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), (k % 4).cast("string")).alias("repo"), F.concat(F.lit("src/"), (k % 45).cast("string"), F.lit(".py")).alias("rel"))
    return jury.provable(_finds(spark, sf_dir), loaded).select("doc_id", "why_not")


@query(f"WITH {_F_SQL} SELECT doc_id FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file, line, name) <= 40")
def judged_within_budget(spark, sf_dir):
    return jury.judged_first(_finds(spark, sf_dir)).select("doc_id")


@query(f"WITH {_F_SQL} SELECT repo, verdict, count(*) AS n FROM f GROUP BY repo, verdict")
def findings_by_verdict(spark, sf_dir):
    return metrics.verdict_counts(_finds(spark, sf_dir))


@query(f"WITH {_F_SQL} SELECT doc_id FROM f WHERE verdict = 'REMOVE' AND kind = 'import' AND (contains(lower(file), 'test_1') OR contains(lower(name), 'test_1'))")
def found_by_search(spark, sf_dir):
    return service.search(_finds(spark, sf_dir), verdict="REMOVE", kind="import", text="Test_1").select("doc_id")


@query(f"""
WITH {_F_SQL}, v AS (SELECT DISTINCT repo, kind, file, line FROM f WHERE doc_id % 2 = 0),
o AS (SELECT repo, kind, file, line, name, CASE WHEN bool_and(proof = 'passed') THEN 'passed' ELSE min(proof) FILTER (proof <> 'passed') END AS outcome FROM (SELECT repo, kind, file, line, name, proof FROM f WHERE doc_id % 2 = 0 UNION ALL SELECT repo, kind, file, line, name, 'failed: again' FROM f WHERE doc_id % 6 = 0) GROUP BY ALL)
SELECT doc_id, coalesce(outcome, 'not run') AS proof FROM f LEFT JOIN o USING (repo, kind, file, line, name)""")
def findings_with_outcomes(spark, sf_dir):
    """A unit with several outcomes keeps one row, and the outcome that isn't a pass."""
    f = _finds(spark, sf_dir)
    key = ["repo", "kind", "file", "line", "name"]
    proofs = f.filter("doc_id % 2 = 0").select(*key, "proof").unionByName(f.filter("doc_id % 6 = 0").select(*key, F.lit("failed: again").alias("proof")))
    return jury.with_outcomes(f.withColumn("proof", F.lit("not run")), proofs).select("doc_id", "proof")


@query(r"""
WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"verdict": "Remove", "confidence": "0.' || (doc_id % 10) || '"}' WHEN 1 THEN '<think>{"verdict": "remove"}</think> {"verdict": "keep", "confidence": "high"}' WHEN 2 THEN 'maybe' WHEN 3 THEN '{"verdict": "perhaps"}' END AS answer FROM documents)
SELECT doc_id AS finding, CASE doc_id % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'keep' END AS verdict, CASE doc_id % 5 WHEN 0 THEN ('0.' || (doc_id % 10))::DOUBLE WHEN 1 THEN 0.0 END AS confidence, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL WHEN doc_id % 5 = 4 THEN 'no answer' ELSE 'answered off-format: ' || left(answer, 120) END AS error FROM a""")
def votes_from_answers(spark, sf_dir):
    n = F.col("doc_id")
    answer = (
        F.when(n % 5 == 0, F.concat(F.lit('{"verdict": "Remove", "confidence": "0.'), (n % 10).cast("string"), F.lit('"}')))
        .when(n % 5 == 1, '<think>{"verdict": "remove"}</think> {"verdict": "keep", "confidence": "high"}').when(n % 5 == 2, "maybe").when(n % 5 == 3, '{"verdict": "perhaps"}')
    )
    answers = table(spark, sf_dir, "documents").select(n.alias("finding"), F.lit("m").alias("model"), answer.alias("answer"))
    return jury.parse_votes(answers).select("finding", "verdict", "confidence", "error")


@query("""
WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'dependency' ELSE 'import' END AS kind, CASE doc_id % 2 WHEN 0 THEN 'remove' ELSE 'keep' END AS verdict, (n_chars % 10) / 10.0::DOUBLE AS confidence, CASE n_chars % 3 WHEN 0 THEN true WHEN 1 THEN false END AS refuted FROM documents)
SELECT doc_id, CASE WHEN kind <> 'dependency' AND verdict = 'remove' AND confidence >= 0.7 AND NOT coalesce(refuted, true) THEN 'REMOVE' ELSE 'KEEP' END AS decision FROM v""")
def decisions_of_one_model(spark, sf_dir):
    n, c = F.col("doc_id"), F.col("n_chars")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", jury.single_decision(F.when(n % 4 == 3, "dependency").otherwise("import"), F.when(n % 2 == 0, "remove").otherwise("keep"), (c % 10) / 10.0, F.when(c % 3 == 0, True).when(c % 3 == 1, False)).alias("decision"))


@query("""
SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS at FROM events GROUP BY user_id""".replace("arg_max(event_type, (ts, event_id))", "last(event_type ORDER BY ts, event_id)"))
def stage_of_jobs(spark, sf_dir):
    from corvane.streaming.limits import last_stage

    return last_stage(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'Copilot' ELSE 'Cursor' END AS tool, sum(n_chars)::BIGINT AS commits FROM documents GROUP BY 1")
def assistants_over_repositories(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.create_map(F.when(F.col("doc_id") % 2 == 0, "Copilot").otherwise("Cursor"), F.col("n_chars")).alias("tools"))
    return service.assistant_totals(d)


@query("""
WITH n AS (SELECT DISTINCT 'k' || (c_custkey % 500) AS name, 'r' || (c_custkey % 3) AS repo FROM customer), w AS (SELECT 'r' || (o_orderkey % 3) AS repo, 'f' || (o_custkey % 40) AS rel, 'k' || (o_orderkey % 400) AS word, count(*) AS n FROM orders GROUP BY ALL)
SELECT n.repo, n.name, 'f0' AS rel FROM n WHERE EXISTS (SELECT 1 FROM w WHERE w.repo = n.repo AND w.word = n.name AND w.rel <> 'f0')""")
def named_elsewhere(spark, sf_dir):
    """Units of one file whose name another file of the repository holds, as a string may."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    s = lambda x, n: (F.col(x) % n).cast("string")
    units = c.select(F.concat(F.lit("r"), s("c_custkey", 3)).alias("repo"), F.lit("f0").alias("rel"), F.concat(F.lit("k"), s("c_custkey", 500)).alias("name")).distinct()
    counts = o.select(F.concat(F.lit("r"), s("o_orderkey", 3)).alias("repo"), F.concat(F.lit("f"), s("o_custkey", 40)).alias("rel"), F.concat(F.lit("k"), s("o_orderkey", 400)).alias("word")).groupBy("repo", "rel", "word").agg(F.count("*").alias("n"))
    return words.named_elsewhere(units, counts).select("repo", "rel", "name")


@query("""
WITH u AS (SELECT DISTINCT 'r' AS repo, 'btn-' || (c_custkey % 90) || '-' || CASE c_nationkey % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'flat' ELSE 'odd' END AS name FROM customer),
w AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'btn-' || (p_partkey % 60) || '-' ELSE CASE p_size % 2 WHEN 0 THEN '-wide' ELSE '-odd' END END AS word FROM part)
SELECT repo, name FROM u WHERE EXISTS (SELECT 1 FROM w WHERE (ends_with(word, '-') AND starts_with(name, word) AND name <> word) OR (starts_with(word, '-') AND ends_with(name, word) AND name <> word))""")
def style_names_built(spark, sf_dir):
    """Class names of which a literal elsewhere is the start up to a joint, or the end from one."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    tail = F.when(F.col("c_nationkey") % 3 == 0, "wide").when(F.col("c_nationkey") % 3 == 1, "flat").otherwise("odd")
    units = c.select(F.lit("r").alias("repo"), F.concat(F.lit("btn-"), (F.col("c_custkey") % 90).cast("string"), F.lit("-"), tail).alias("name")).distinct()
    piece = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("btn-"), (F.col("p_partkey") % 60).cast("string"), F.lit("-"))).otherwise(F.when(F.col("p_size") % 2 == 0, "-wide").otherwise("-odd"))
    return words.built_styles(units, p.select(F.lit("r").alias("repo"), piece.alias("piece"))).select("repo", "name").distinct()


@query("""
WITH s AS (SELECT DISTINCT 'r' || (l_suppkey % 4) AS repo, 's' || (l_suppkey % 20) AS rel, 'c' || (l_partkey % 300) AS name FROM lineitem), m AS (SELECT DISTINCT 'r' || (o_custkey % 4) AS repo, 'c' || (o_orderkey % 500) AS name FROM orders)
SELECT s.repo, rel, count(*) AS names, count(m.name) AS seen, count(m.name) * 2 < count(*) AS mostly_unseen FROM s LEFT JOIN m ON m.repo = s.repo AND m.name = s.name GROUP BY s.repo, rel""")
def sheets_mostly_unseen(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s = lambda p, x, n: F.concat(F.lit(p), (F.col(x) % n).cast("string"))
    units = li.select(s("r", "l_suppkey", 4).alias("repo"), s("s", "l_suppkey", 20).alias("rel"), s("c", "l_partkey", 300).alias("name"))
    return words.seen_share(units, o.select(s("r", "o_custkey", 4).alias("repo"), s("c", "o_orderkey", 500).alias("name"))).select("repo", "rel", "names", "seen", "mostly_unseen")


@query("""
WITH e AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'AWS_SECRET_' WHEN 1 THEN 'MY_TOKEN_' WHEN 2 THEN 'PATH_' WHEN 3 THEN 'DB_PASSWORD' WHEN 4 THEN 'HOME_' ELSE 'API_KEY' END || p_partkey AS name FROM part)
SELECT name FROM e WHERE NOT regexp_matches(upper(name), 'SECRET|TOKEN|PASSWORD|API_?KEY|^AWS_')""")
def environment_without_secrets(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ("AWS_SECRET_", "MY_TOKEN_", "PATH_", "DB_PASSWORD", "HOME_", "API_KEY"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(head, k.cast("string")).alias("name")).filter(~S.is_secret_setting(F.col("name")))


@query(r"""
WITH d AS (SELECT doc_id, doc_id || ' passed, ' || (doc_id % 3) || ' skipped' AS before, CASE WHEN doc_id % 4 = 0 THEN 'crash' ELSE (doc_id - doc_id % 2) || ' passed, ' || (doc_id % 5) || ' skipped' END AS after FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true ELSE doc_id % 2 > 0 OR doc_id % 5 > doc_id % 3 END AS fewer FROM d""")
def runs_with_fewer_tests(spark, sf_dir):
    n = F.col("doc_id")
    s = lambda x: x.cast("string")
    before = F.concat(s(n), F.lit(" passed, "), s(n % 3), F.lit(" skipped"))
    after = F.when(n % 4 == 0, "crash").otherwise(F.concat(s(n - n % 2), F.lit(" passed, "), s(n % 5), F.lit(" skipped")))
    return table(spark, sf_dir, "documents").select("doc_id", S.fewer_tests(before, after).alias("fewer"))


@query(r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'own' || page_id || '/Repo.' || (page_id % 9) END AS repository, page_id % 3 <> 2 AS safe,
 CASE page_id % 4 WHEN 0 THEN '10.0.0.' || (page_id % 200) ELSE 'peer' END AS client, trim(regexp_replace(regexp_replace('A' || page_id || ' <b>&  c', '[^A-Za-z0-9 ._-]', ' ', 'g'), '\s+', ' ', 'g')) AS name,
 'navItem' || page_id AS camel, left(sha256('t' || page_id), 12) AS short FROM pages""")
def service_scalars(spark, sf_dir):
    k = F.col("page_id")
    s = k.cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://github.com/own"), s, F.lit("/Repo."), (k % 9).cast("string"), F.lit(".git"))).when(k % 3 == 1, "https://example.com/a/b").otherwise("github.com/a/..")
    ref = F.when(k % 3 == 2, "a..b").otherwise(F.concat(F.lit("feature/x"), s))
    hops = F.when(k % 4 == 0, F.concat(F.lit("1.2.3.4, 10.0.0."), (k % 200).cast("string")))
    return table(spark, sf_dir, "pages").select(
        "page_id", S.repository(url).alias("repository"), S.safe_ref(ref).alias("safe"), S.client_address(hops, F.lit("peer")).alias("client"), S.clean_name(F.concat(F.lit("A"), s, F.lit(" <b>&  c"))).alias("name"),
        S.camel(F.concat(F.lit("nav-item"), s)).alias("camel"), F.substring(F.sha2(F.concat(F.lit("t"), s), 256), 1, 12).alias("short"),
    )
