"""What nothing uses: anti-joins of declarations against references, and the joins that give evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.runtime import store


def unused_imports(imports: DataFrame, used: DataFrame, exported: DataFrame) -> DataFrame:
    """Imports (repo, rel, bound, ...) whose name their own file doesn't use and no other file reads from it. used, exported: repo, rel, name."""
    key = lambda d: d.select("repo", "rel", F.col("name").alias("bound"))
    return imports.join(key(used), ["repo", "rel", "bound"], "left_anti").join(key(exported), ["repo", "rel", "bound"], "left_anti")


def name_spans(refs: DataFrame) -> DataFrame:
    """Where each name is used, a row per name: repo, name, first_rel, last_rel, lo, hi, told (some file that lists no requirements holds it). refs: repo, name, rel, lo, hi.

    first_rel and last_rel are the same when one file holds all uses, lo and hi are their first and last line then. Partial
    minima are taken before rows of a name meet, so a frequent name costs a row per task.
    """
    rel = F.coalesce("rel", F.lit(""))  # a use in a file without a name is one outside every span
    told = ~F.startswith("rel", F.lit("requirements")) & (F.col("rel") != "pyproject.toml")
    return refs.groupBy("repo", "name").agg(F.min(rel).alias("first_rel"), F.max(rel).alias("last_rel"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.bool_or(told), F.lit(False)).alias("told"))


def outside_spans(defs: DataFrame, spans: DataFrame) -> DataFrame:
    """Definitions (repo, rel, name, start, end, ...) that name_spans show no use of outside their own lines."""
    d = defs.join(spans, ["repo", "name"], "left")
    inside = (F.col("first_rel") == F.col("rel")) & (F.col("last_rel") == F.col("rel")) & (F.col("lo") >= F.col("start")) & (F.col("hi") <= F.col("end"))
    return d.filter(F.col("first_rel").isNull() | inside).select(*defs.columns)


def unused_definitions(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Definitions (repo, rel, name, start, end, ...) that no reference names outside their own lines. refs: repo, name, rel, line."""
    return outside_spans(defs, name_spans(refs.withColumns({"lo": F.col("line"), "hi": F.col("line")})))


def evidence(units: DataFrame, refs: DataFrame, limit: int = L.EVIDENCE) -> DataFrame:
    """Up to limit references outside each unit's own lines, by file and line: repo, rel, name, start, evidence (file:line each).

    units: repo, rel, name, start, end. Partial top lists are kept before rows of a name meet.
    """
    refs = refs.select("repo", "name", F.col("rel").alias("ref_rel"), "line").distinct()
    u = units.select("repo", "rel", "name", "start", "end")
    hits = u.join(refs, ["repo", "name"]).filter(~((F.col("ref_rel") == F.col("rel")) & F.col("line").between(F.col("start"), F.col("end"))))
    by = W.partitionBy("repo", "rel", "name", "start").orderBy("ref_rel", "line")
    top = hits.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= limit)
    rows = top.groupBy("repo", "rel", "name", "start").agg(F.sort_array(F.collect_list(F.struct("i", F.concat_ws(":", "ref_rel", "line").alias("at")))).alias("x"))
    return rows.select("repo", "rel", "name", "start", F.transform("x", lambda e: e["at"]).alias("evidence"))


def unused_dependencies(deps: DataFrame, imported: DataFrame, refs: DataFrame) -> DataFrame:
    """Required distributions (repo, dist, rel, line) that no file imports and nothing else mentions. imported: repo, root."""
    d = deps.withColumn("module", S.module_of(F.col("dist"))).filter(~S.distribution(F.col("dist")).isin(L.RUN_TOOLS))
    roots = imported.select("repo", F.lower("root").alias("m")).distinct()
    d = d.withColumn("m", F.lower("module")).join(roots, ["repo", "m"], "left_anti")
    told = refs.filter(~F.startswith("rel", F.lit("requirements")) & (F.col("rel") != "pyproject.toml")).select("repo", "name").distinct()
    keyed = d.withColumn("name", F.explode(F.array_distinct(F.array("dist", "module"))))
    mentioned = keyed.join(told, ["repo", "name"], "left_semi").select("repo", "rel", "line", "dist").distinct()
    return d.join(mentioned, ["repo", "rel", "line", "dist"], "left_anti").select("repo", "dist", "module", "rel", "line")


def built_names(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(repo, name, prefix): names that begin with a prefix built elsewhere, the longest one. names: repo, name; prefixes: repo, prefix.

    A prefix ends with an underscore, so a name's own heads up to each underscore are joined by equality.
    """
    at = F.filter(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substr(F.col("name"), i, F.lit(1)) == "_")
    heads = names.filter(F.length("name") > 1).select("repo", "name", F.explode(F.transform(at, lambda i: F.substr(F.col("name"), F.lit(1), i))).alias("prefix"))
    hits = heads.join(prefixes.select("repo", "prefix").distinct(), ["repo", "prefix"])
    return hits.groupBy("repo", "name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def within_span(items: DataFrame, points: DataFrame, by: list[str], at: str = "line", step: int = 256) -> DataFrame:
    """items (by, start, end) with the points (by, at) inside their lines: a range join on equal keys and blocks of lines.

    Each item is copied to the blocks of `step` lines it touches, so the join stays an equi-join however long a file is.
    """
    i = items.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))))
    p = points.withColumn("block", F.floor(F.col(at) / step))
    return i.join(p, [*by, "block"]).filter(F.col(at).between(F.col("start"), F.col("end"))).drop("block")


def count_within(items: DataFrame, points: DataFrame, by: list[str], at: str = "line", step: int = 256) -> DataFrame:
    """items (by, start, end, ...) with n, how many points (by, at) lie inside their lines; items without any give no row.

    Points are counted by line and by block of `step` lines first, and equal spans are looked up once: a span reads the counts of the
    whole blocks inside it and of the lines at its two ends, so no point meets an item and frequent lines cost what rare ones do.
    """
    lines = points.groupBy(*by, F.col(at).cast("long").alias("cell")).agg(F.count("*").alias("n")).filter("cell is not null")
    blocks = lines.groupBy(*by, F.floor(F.col("cell") / step).alias("cell")).agg(F.sum("n").alias("n"))
    known = lines.withColumn("whole", F.lit(False)).unionByName(blocks.withColumn("whole", F.lit(True)))
    spans = items.filter("start <= end").select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    s, e = F.col("start"), F.col("end")
    first, last = F.ceil(s / step), F.floor((e + 1) / step) - 1  # the blocks that lie inside as a whole
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    cells = lambda whole, a: F.transform(a, lambda c: F.struct(F.lit(whole).alias("whole"), c.alias("cell")))
    left, right = run(s, first * step - 1), run((last + 1) * step, e)
    ends = F.when(first <= last, F.concat(left, right)).otherwise(run(s, e))
    asked = spans.withColumn("c", F.explode(F.concat(cells(True, run(first, last)), cells(False, ends)))).select(*by, "start", "end", "c.whole", "c.cell")
    n = asked.join(known, [*by, "whole", "cell"]).groupBy(*by, "start", "end").agg(F.sum("n").alias("n"))
    return items.join(n, [*by, "start", "end"])


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Each dotted path with the longest known module that is a proper prefix of it, and the name read from that module.

    paths: repo, path; modules: repo, module. Every proper prefix is joined by equality and the longest hit stays.
    """
    segs = F.split("path", r"\.")
    heads = paths.select("repo", "path", segs.alias("s")).filter("size(s) > 1")
    heads = heads.select("repo", "path", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("k")).withColumn("module", F.array_join(F.slice("s", F.lit(1), F.col("k")), "."))
    hits = heads.join(modules.select("repo", "module").distinct(), ["repo", "module"])
    best = hits.groupBy("repo", "path").agg(F.max_by(F.struct("module", F.element_at("s", F.col("k") + 1).alias("name")), "k").alias("b"))
    return best.select("repo", "path", "b.module", "b.name")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (repo, rel, sha) that are new or whose content differs from the last run's."""
    return now.join(before.select("repo", "rel", "sha"), ["repo", "rel", "sha"], "left_anti")


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo, kind, file, name, change (new or gone): findings to act on of two runs, by kind, file and name, whatever their lines."""
    key, acts = ["repo", "kind", "file", "name"], F.col("verdict").isin("REMOVE", "SIMPLIFY")
    a, b = (d.filter(acts).select(*key).distinct() for d in (before, after))
    return b.join(a, key, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("gone")))


def registered_classes(classes: DataFrame, scans: DataFrame) -> DataFrame:
    """Classes that may be found without their name: (repo, rel, name, why).

    classes: repo, rel, name, bases (as written), metaclass, init_subclass, external_roots (names that the file imports
    from outside). scans: repo, name of classes whose __subclasses__ are read, '*' for any. Reasons found at a class go
    down to its subclasses, a generation a round, until none is new; cycles end because a class is marked once.
    """
    key = ["repo", "rel", "name"]
    c = classes.withColumn("base", F.explode_outer(F.filter("bases", lambda b: F.element_at(F.split(b, r"\."), -1) != "object")))
    c = c.withColumn("b", F.element_at(F.split("base", r"\."), -1)).withColumn("outside", F.coalesce(F.array_contains("external_roots", F.element_at(F.split("base", r"\."), 1)), F.lit(False)))
    known = classes.select("repo", F.col("name").alias("b")).distinct().withColumn("known", F.lit(True))
    named = scans.select("repo", F.col("name").alias("b")).distinct().withColumn("scanned", F.lit(True))
    any_scan = scans.filter("name = '*'").select("repo").distinct().withColumn("any_scan", F.lit(True))
    c = c.join(known, ["repo", "b"], "left").join(named, ["repo", "b"], "left").join(any_scan, "repo", "left").na.fill(False, ["known", "scanned", "any_scan"])
    meta = F.when(F.col("metaclass").isNotNull() & ~F.col("metaclass").isin(L.PLAIN_METACLASSES), F.concat(F.lit("its metaclass "), "metaclass", F.lit(" may register it")))
    parent = F.col("known") & ~F.col("outside")
    why = F.coalesce(
        meta, F.when(F.col("scanned") | (F.col("any_scan") & F.col("known")), F.concat("b", F.lit(".__subclasses__() is scanned"))),
        F.when(F.col("base").isNotNull() & ~parent & ~F.col("b").isin(L.PLAIN_BASES), F.concat(F.lit("inherits from "), "base", F.lit(", which a framework may discover"))),
    )
    marked = c.select(*key, why.alias("why")).filter("why is not null").groupBy(*key).agg(F.min("why").alias("why"))
    edges = c.filter(parent).select(*key, F.col("b").alias("parent")).distinct()
    hooks = classes.filter("init_subclass").select("repo", F.col("name").alias("parent")).distinct()
    marked = marked.unionByName(edges.join(hooks, ["repo", "parent"]).select(*key, F.concat("parent", F.lit(" defines __init_subclass__")).alias("why"))).groupBy(*key).agg(F.min("why").alias("why"))
    table = lambda df, name: store(df, name).hint("merge")  # noqa: E731  (rows grow with the input, and compress too well for a size to tell)
    edges, marked = table(edges, "edges"), table(marked, "marked")
    n = marked.count()
    while n:
        up = marked.select("repo", F.col("name").alias("parent"), "why").groupBy("repo", "parent").agg(F.min("why").alias("why"))
        down = edges.join(up, ["repo", "parent"]).select(*key, "why").join(marked.select(*key), key, "left_anti").groupBy(*key).agg(F.min("why").alias("why"))
        marked = table(marked.unionByName(down), "marked")
        if (m := marked.count()) == n:
            break
        n = m
    return marked


def closure(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """(repo, a, z): every pair with a path a -> z, as of include graphs; edges: repo, a, z.

    Semi-naive: a round joins only the pairs that the last one found with all that are known, which doubles the length of
    paths, and writes only what is new. The result is as large as the pairs are many: the square of a component's nodes at most.
    Pairs that end at a node that more than `most` new ones reach (a root that all lie under) are dealt to several tasks; such nodes
    are fewer than the new pairs by that factor, so their list is broadcast.
    """
    new = store(edges.select("repo", "a", "z").distinct(), "paths")
    known = new
    while not new.isEmpty():
        hot = store(new.groupBy("repo", "z").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("repo", "z", F.ceil(F.col("n") / most).cast("int").alias("deal")), "hot")
        dealt = lambda df: df.join(F.broadcast(hot), ["repo", "z"], "left").na.fill(1, ["deal"])  # noqa: E731, B023
        ends = dealt(new).withColumn("part", F.pmod(F.xxhash64("a"), F.col("deal")).cast("int")).drop("deal")
        ahead = dealt(known.select("repo", F.col("a").alias("z"), F.col("z").alias("to"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1))).drop("deal")
        longer = ends.join(ahead, ["repo", "z", "part"]).select("repo", "a", F.col("to").alias("z")).distinct()
        new = store(longer.join(known, ["repo", "a", "z"], "left_anti"), "paths")
        known = known.unionByName(new)
    return known


def reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, start, node): the nodes that a path from a start leads to. starts: repo, start; edges: repo, a, z.

    Semi-naive: each round follows the edges of the nodes that the last one found and writes only what is new. Edges are written
    first, so that texts they were read from are read once, not once a round. No side is ever broadcast, as all of them grow with the input.
    """
    new = starts.select("repo", "start", F.col("start").alias("node"))
    step, known = store(edges.select("repo", F.col("a").alias("node"), "z").distinct(), "steps"), None
    while known is None or not new.isEmpty():
        ahead = new.join(step.hint("merge"), ["repo", "node"]).select("repo", "start", F.col("z").alias("node")).distinct()
        new = store(ahead.join(known.hint("merge"), ["repo", "start", "node"], "left_anti") if known is not None else ahead, "reached")
        known = new if known is None else known.unionByName(new)
    return known


def flood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, node): the given nodes and all that paths from them lead to, each once. nodes: repo, node; edges: repo, a, z.

    Semi-naive, and without pairs: a round follows only the nodes that the last one found and writes only new ones.
    """
    new = store(nodes.select("repo", "node").distinct(), "flood")
    step, known = store(edges.select("repo", F.col("a").alias("node"), "z").distinct(), "steps"), new
    while not new.isEmpty():
        ahead = new.join(step, ["repo", "node"]).select("repo", F.col("z").alias("node")).distinct()
        new = store(ahead.join(known, ["repo", "node"], "left_anti"), "flood")
        known = known.unionByName(new)
    return known


def convention(rel: Column, name: Column, kind: Column, is_test: Column, module_vars: Column) -> Column:
    """Why a tool calls a function by its name, null if none does; the first reason counts."""
    base, head = S.base_name(rel), F.element_at(F.split(name, "_"), 1)
    why = (
        F.when(kind != "function", None)
        .when(F.startswith(name, F.lit("pytest_")), "a pytest hook, called by name")
        .when(is_test & name.isin(L.TEST_HOOKS), "a test-module hook, called by name")
        .when(F.array_contains(module_vars, "revision") & F.array_contains(module_vars, "down_revision") & head.isin("upgrade", "downgrade"), "a migration step, called by name")
        .when(F.regexp_like(rel, F.lit(r"(^|/)[^/]*gunicorn[^/]*\.py$")), "the server calls the hooks in its config file by name")
        .when((base == "conf.py") & (name == "setup"), "the documentation builder calls setup()")
        .when((base == "dodo.py") & F.startswith(name, F.lit("task_")), "tasks are found by name")
        .when((base == "fabfile.py") & ~F.startswith(name, F.lit("_")), "public functions of this file are run by name")
        .when(base.isin("noxfile.py", "tasks.py", "conftest.py"), F.concat(base, F.lit(" is loaded by its tool, which calls its functions")))
        .when(name.isin(L.SERVER_NAMES), F.concat(F.lit("'"), name, F.lit("' is a name servers and platforms look up")))
    )
    return why
