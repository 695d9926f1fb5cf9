"""Verdicts on Python code: anti-joins find what nothing uses, ordered conditions say why it may stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.operators import copies, resolve, usage
from corvane.operators.pyfacts import Facts, dotted_mentions, plugin_paths, requirements, text_references
from corvane.runtime import store

COLUMNS = ["repo", "kind", "file", "line", "end_line", "name", "verdict", "reason", "lines", "evidence", "proof", "final"]


@dataclass
class Repository:
    """Facts of Python files beside the other text files (repo, rel, text) of the same repositories; python: repo, rel of the Python files."""

    facts: Facts
    others: DataFrame
    python: DataFrame

    def __post_init__(self):
        self.index = _keep(resolve.module_index(self.facts.files), "modules")
        self.mentions = dotted_mentions(self.others)
        self.exported, self.stars = resolve.exports(self.facts, self.mentions, self.index)
        words = text_references(self.others).select("repo", "name", "rel", F.col("line").alias("lo"), F.col("line").alias("hi"))
        self.spans = _keep(usage.name_spans(self.facts.refs.unionByName(words)), "spans")


def _keep(df: DataFrame, name: str) -> DataFrame:
    """df as a table, for what is read more than once; never broadcast, as its rows grow with the input and its files compress well."""
    return store(df, name).hint("merge")


def _flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(True)).hint("merge"), on, "left").na.fill(False, [name])


def _finding(df: DataFrame, kind: Column | str, reason: Column, verdict: Column, line: str, end: str, name: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(
        "repo", kind.alias("kind"), F.col("rel").alias("file"), F.col(line).alias("line"), F.col(end).alias("end_line"), F.col(name).alias("name"), verdict.alias("verdict"), reason.alias("reason"),
    )


def _complete(df: DataFrame, lines: Column, proof: str = "not run", evidence: Column | None = None) -> DataFrame:
    empty = F.array().cast("array<string>")
    final = F.when(F.col("verdict") == "AMBIGUOUS", "KEEP").otherwise(F.col("verdict"))
    return df.withColumns({"lines": lines, "evidence": evidence if evidence is not None else empty, "proof": F.lit(proof), "final": final}).select(*COLUMNS)


def import_findings(r: Repository) -> DataFrame:
    facts, c = r.facts, F.col
    # what the import's own file says of it, with the file's names as arrays
    i = facts.imports.join(facts.files_with("used", "all", "attr"), ["repo", "rel"])
    i = i.withColumns({"last": F.substring_index("imported", ".", -1), "plain": F.ltrim(F.col("module"), F.lit(".")), "top": F.substring_index(F.ltrim(F.col("module"), F.lit(".")), ".", 1)})
    read = {f"{x}_read": F.array_contains("attr", c(x)) for x in ("last", "imported", "top")}
    i = i.withColumns({"is_used": F.array_contains("used", c("bound")) | F.array_contains("all", c("bound")), **read}).drop("used", "all", "attr")
    # a module's imports are one statement here, and none of its names is used: a statement with 'from' names one module only
    module = W.partitionBy("repo", "rel", "module")
    i = i.withColumn("alone", (F.min("statement").over(module) == F.max("statement").over(module)) & ~F.bool_or("is_used").over(module))
    i = i.filter(~c("is_used") & ~((F.col("asname").isNotNull()) & (F.col("asname") == F.col("last"))) & ~F.col("noqa"))
    i = i.filter(~F.when(F.col("is_from"), F.col("imported_read")).otherwise(F.contains("imported", F.lit(".")) & F.col("last_read")))
    i = i.join(r.exported.withColumnRenamed("name", "bound").hint("merge"), ["repo", "rel", "bound"], "left_anti")
    kept = _keep(i.select("repo", "rel", "line", "end_line", "bound", "module", "imported", "asname", "plain", "top", "is_from", "top_level", "in_try", "alone", "top_read", "is_test", "is_init", "all_unknown", "only_imports", "dynamic_globals"), "imports")
    i = kept
    # what other files say of its name
    params = facts.files_with("param").filter("is_test").select("repo", F.explode("param").alias("bound"), F.lit(True).alias("fixture"), F.lit(False).alias("in_unparsed"))
    words = facts.names("unparsed").select("repo", F.col("name").alias("bound"), F.lit(False).alias("fixture"), F.lit(True).alias("in_unparsed"))
    told = params.unionByName(words).groupBy("repo", "bound").agg(F.bool_or("fixture").alias("fixture"), F.bool_or("in_unparsed").alias("in_unparsed"))
    i = i.join(told.hint("merge"), ["repo", "bound"], "left").na.fill(False, ["fixture", "in_unparsed"]).filter(~(F.col("is_test") & F.col("fixture")))
    stars = r.stars.join(facts.files.select("repo", F.col("rel").alias("importer"), "is_init"), ["repo", "importer"])
    stars = _flag(stars, r.stars.select("repo", F.col("rel").alias("importer")), ["repo", "importer"], "starred").filter("is_init or starred")
    i = i.join(stars.groupBy("repo", "rel").agg(F.min("importer").alias("star")).hint("merge"), ["repo", "rel"], "left")
    roots = facts.files.select("repo", F.regexp_replace(F.substring_index("rel", "/", 1), r"\.py$", "").alias("top"))
    i = _flag(i, roots, ["repo", "top"], "local_top")
    key = ["repo", "rel", "module", "imported"]
    asked = kept.filter("is_from").select(*key).distinct().withColumn("own", F.col("module"))
    both = asked.withColumn("whole", F.lit(True)).unionByName(asked.withColumns({"module": resolve._join_name(F.col("own"), F.col("imported")), "whole": F.lit(False)}))
    found = resolve.resolve(both, facts.files, r.index).groupBy("repo", "rel", F.col("own").alias("module"), "imported").agg(F.bool_or("whole").alias("local_module"), F.bool_or(~F.col("whole")).alias("submodule"))
    i = i.join(found.hint("merge"), key, "left").na.fill(False, ["local_module", "submodule"])
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    why = (
        F.when(c("in_try"), "inside try/except ImportError: probably a check for an optional package")
        .when(c("is_init"), "in __init__.py: may be a public re-export")
        .when(c("star").isNotNull() & ~F.startswith("bound", F.lit("_")), text("re-exported by a star import in ", c("star")))
        .when(c("all_unknown"), "this module builds __all__ in a way that cannot be read")
        .when(c("only_imports"), "this file is nothing but imports")
        .when(c("dynamic_globals"), "this file reads its own names through globals(), eval or vars")
        .when(c("in_unparsed"), "a file that could not be parsed mentions this name")
        .when(S.is_side_effect(c("plain")) | F.startswith("imported", F.lit("enable_")), text("'", c("plain"), "' works by its side effect on import"))
        .when(c("top_read"), text("'", c("top"), "' appears as an attribute here"))
        .when(~c("is_from") & c("local_top"), "imports a module of this repository, whose code may be the point")
        .when(c("submodule"), text("'", c("imported"), "' is a module of this repository"))
        .when(c("local_module") & c("alone"), text("nothing of this statement is used, and only it imports '", c("plain"), "' here"))
        .when(~c("is_from") & F.contains("imported", F.lit(".")) & c("asname").isNull(), "loads a submodule, which may be its purpose")
        .when(~c("top_level"), "imported inside a function or block: may be lazy loading")
    )
    reason = F.coalesce(why, F.lit("no use anywhere in the file, not re-exported"))
    out = _finding(i, "import", reason, F.when(why.isNotNull(), "AMBIGUOUS").otherwise("REMOVE"), "line", "end_line", "bound")
    return _complete(out, F.lit(1))


def definition_findings(r: Repository) -> DataFrame:
    facts = r.facts
    d = facts.defs.filter(~F.col("name").rlike("^__.*__$") & ~F.exists("decorators", lambda x: F.regexp_like(S.strip(x), F.lit(L.FRAMEWORK_DECORATOR))))
    d = usage.outside_spans(d, r.spans).join(facts.files_with("all", "var").withColumnRenamed("var", "module_vars"), ["repo", "rel"])
    d = d.filter(~F.array_contains("all", F.col("name")) & ~(F.col("is_test") & F.col("name").rlike("^[tT]est")))
    d = d.withColumns({"custom": usage.convention(F.col("rel"), F.col("name"), F.col("kind"), F.col("is_test"), F.col("module_vars")), "decorated": F.when(F.size("decorators") > 0, F.substring(F.array_join("decorators", ", "), 1, 80))})
    d = _keep(d.select("repo", "rel", "name", "kind", "start", "end", "custom", "decorated", "is_test", "is_init", "dynamic"), "definitions")
    prefixes = facts.names("prefix").select("repo", F.col("name").alias("prefix"))
    built = usage.built_names(d.select("repo", "name").distinct(), prefixes)
    # what a class inherits: of the imports only those whose name begins one of its bases
    classes = _keep(facts.defs.filter("kind = 'class'"), "classes")
    bases = classes.select("repo", "rel", F.explode("bases").alias("base")).select("repo", "rel", F.substring_index("base", ".", 1).alias("bound")).distinct()
    tops = facts.files.select("repo", F.regexp_replace(F.substring_index("rel", "/", 1), r"\.py$", "").alias("top"))
    roots = facts.imports.filter(~F.startswith("module", F.lit("."))).select("repo", "rel", "bound", F.substring_index("module", ".", 1).alias("top")).join(bases, ["repo", "rel", "bound"], "left_semi")
    outside = roots.join(tops, ["repo", "top"], "left_anti").groupBy("repo", "rel").agg(F.collect_set("bound").alias("external_roots"))
    classes = _keep(classes.join(outside.hint("merge"), ["repo", "rel"], "left").withColumn("external_roots", F.coalesce("external_roots", F.array().cast("array<string>"))), "classes")
    registered = usage.registered_classes(classes, facts.names("scan"))
    d = d.join(registered.withColumnRenamed("why", "registered").hint("merge"), ["repo", "rel", "name"], "left")
    d = d.join(built.hint("merge"), ["repo", "name"], "left")
    # what holds for a file as a whole
    every = r.others.unionByName(r.python.select("repo", "rel", F.lit("").alias("text")))  # of Python files the names tell
    roots = resolve.library_roots(every).withColumn("dir", F.col("root"))
    dirs = facts.files.select("repo", "rel", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("rel", "/")) - 1), lambda i: F.array_join(F.slice(F.split("rel", "/"), F.lit(1), i), "/"))).alias("dir"))
    said = lambda df, by, reached, library: df.select("repo", "rel", by.alias("by"), F.lit(reached).alias("reached"), F.lit(library).alias("in_library"))
    marks = said(resolve.config_loaded(facts, plugin_paths(r.others)), F.col("by"), False, False)
    marks = marks.unionByName(said(resolve.dynamic_files(facts, r.index), F.lit(None).cast("string"), True, False)).unionByName(said(dirs.join(roots, ["repo", "dir"]), F.lit(None).cast("string"), False, True))
    marks = marks.groupBy("repo", "rel").agg(F.min("by").alias("by"), F.bool_or("reached").alias("reached"), F.bool_or("in_library").alias("in_library"))
    d = d.join(marks.hint("merge"), ["repo", "rel"], "left").na.fill(False, ["reached", "in_library"])
    c, text = F.col, lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    why = F.coalesce(
        c("custom"),
        F.when(c("kind") == "class", c("registered")),
        F.when(c("decorated").isNotNull(), text("decorated (", c("decorated"), "): a framework may call it")),
        F.when(c("is_init"), "defined in __init__.py: may be public"),
        F.when(c("by").isNotNull(), text("this file is named in ", c("by"), ", whose tool may call its functions by name")),
        F.when(c("dynamic") | c("reached"), "this module is reached by computed names"),
        F.when(c("prefix").isNotNull(), text("a name is built from '", c("prefix"), "' elsewhere")),
        F.when(c("is_test"), "in test code: tests cannot prove that it is safe to remove"),
        F.when(c("in_library") & ~F.startswith("name", F.lit("_")), "public name in a library: its users may be elsewhere"),
    )
    reason = F.coalesce(why, text("no reference to '", c("name"), "' anywhere in the repository"))
    out = _finding(d, c("kind"), reason, F.when(why.isNotNull(), "AMBIGUOUS").otherwise("REMOVE"), "start", "end", "name")
    return _complete(out, F.col("end_line") - F.col("line") + 1)


def dependency_findings(r: Repository) -> DataFrame:
    roots = r.facts.imports.filter(~F.startswith("module", F.lit("."))).select("repo", F.substring_index("module", ".", 1).alias("root"))
    told = r.spans.filter("told").select("repo", "name", F.lit("").alias("rel"))  # a row per name
    u = usage.unused_dependencies(_keep(requirements(r.others), "requirements"), roots, told)
    reason = F.concat(F.lit("no file imports '"), "module", F.lit("' and nothing else mentions it"))
    return _complete(_finding(u, "dependency", reason, F.lit("AMBIGUOUS"), "line", "line", "dist"), F.lit(1), "not provable")


def duplicate_findings(r: Repository) -> DataFrame:
    d = copies.duplicate_bodies(r.facts.defs)
    where = F.concat_ws(":", "of_rel", "of_line")
    out = _finding(d.withColumn("at", where), "duplicate", F.concat(F.lit("same body as "), where), F.lit("SIMPLIFY"), "line", "end_line", "name")
    return _complete(out.withColumn("at", F.regexp_extract("reason", "same body as (.*)$", 1)), F.col("end_line") - F.col("line") + 1, "not provable", F.array("at"))


def python_findings(r: Repository) -> DataFrame:
    """All findings on Python code, in no order."""
    parts = [import_findings(r), definition_findings(r), dependency_findings(r), duplicate_findings(r)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
