"""Module names to files: suffix index, relative imports, what other files read from a module."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators.pyfacts import Facts
from corvane.runtime import store


def module_index(files: DataFrame) -> DataFrame:
    """(repo, module, target): every dotted name that a Python file (repo, rel) answers to from a folder that is no package."""
    parts = F.split(F.regexp_replace("rel", r"\.pyi?$", ""), "/")
    is_init = F.element_at(parts, -1) == "__init__"
    parts = F.when(is_init, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    f = files.select("repo", "rel", parts.alias("p")).filter("size(p) > 0")
    f = f.select("repo", "rel", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    f = f.select("repo", F.col("rel").alias("target"), F.array_join(F.slice("p", F.col("i") + 1, F.size("p")), ".").alias("module"), F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("above"))
    packages = files.filter(F.col("rel").endswith("/__init__.py")).select("repo", S.folder(F.col("rel")).alias("above"))
    return f.join(packages, ["repo", "above"], "left_anti").select("repo", "module", "target")


def absolute(module: Column, importer: Column) -> Column:
    """The path that a relative module names from its importer's folder; null for an absolute module."""
    level = F.length(module) - F.length(F.ltrim(module, F.lit(".")))
    base = F.split(importer, "/")
    keep = F.greatest(F.size(base) - level, F.lit(0))
    tail = F.filter(F.split(F.ltrim(module, F.lit(".")), r"\."), lambda x: x != "")
    return F.when(level > 0, F.array_join(F.concat(F.slice(base, F.lit(1), keep), tail), "/"))


def resolve(asked: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """asked (repo, rel, module, ...) with target for each file that a module names; names of the standard library name none here."""
    own = asked.columns
    a = asked.withColumn("_path", absolute(F.col("module"), F.col("rel"))).withColumn("_top", F.element_at(F.split("module", r"\."), 1))
    plain = a.filter(F.col("_path").isNull() & ~F.col("_top").isin(sorted(sys.stdlib_module_names)) & (F.col("module") != ""))
    plain = plain.join(index, ["repo", "module"]).select(*own, "target")
    rel = a.filter(F.col("_path").isNotNull()).withColumn("target", F.explode(F.array(F.concat("_path", F.lit(".py")), F.concat("_path", F.lit("/__init__.py")))))
    rel = rel.join(files.select("repo", F.col("rel").alias("target")), ["repo", "target"], "left_semi").select(*own, "target")
    return plain.unionByName(rel)


def _join_name(module: Column, name: Column) -> Column:
    return F.when(module.rlike(r"^\.*$"), F.concat(module, name)).otherwise(F.concat(module, F.lit("."), name))


def read_paths(paths: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, rel, path, target, name): for each dotted path the longest proper prefix that is a module, and the name read from it."""
    lead = F.regexp_extract("path", r"^(\.*)", 1)
    segs = F.filter(F.split(F.ltrim(F.col("path"), F.lit(".")), r"\."), lambda x: x != "")
    p = paths.select("repo", "rel", "path", lead.alias("lead"), segs.alias("s")).distinct().filter("size(s) > 1")
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("k")).withColumn("module", F.concat("lead", F.array_join(F.slice("s", F.lit(1), F.col("k")), ".")))
    hits = resolve(p.withColumn("name", F.element_at("s", F.col("k") + 1)).drop("s", "lead"), files, index)
    best = hits.groupBy("repo", "rel", "path").agg(F.max("k").alias("k"))
    return hits.join(best, ["repo", "rel", "path", "k"]).select("repo", "rel", "path", "target", "name")


def exports(facts: Facts, mentions: DataFrame | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(exported, stars): exported (repo, rel, name) are names that other files read from a module; stars (repo, rel, importer), written, are files imported with *.

    mentions (repo, rel, name, line): dotted names of other text files. index: the files' module_index, where it is known.
    """
    files, imports = facts.files, facts.imports
    index = module_index(files) if index is None else index
    direct = resolve(imports.filter("is_from").select("repo", "rel", "module", F.col("imported").alias("name")), files, index).select("repo", F.col("target").alias("rel"), "name")
    alias = imports.select("repo", "rel", F.col("bound").alias("head"), F.when(F.col("is_from"), _join_name(F.col("module"), F.col("imported"))).when(F.col("asname").isNotNull(), F.col("imported")).otherwise(F.col("bound")).alias("full"))
    chains = facts.names("chain").withColumn("head", F.substring_index("name", ".", 1)).filter("head <> name")
    chains = chains.join(alias, ["repo", "rel", "head"]).select("repo", "rel", F.concat("full", F.expr("substring(name, length(head) + 1)")).alias("path"))
    text = facts.of("dotted").select("repo", "rel", F.replace("name", F.lit(":"), F.lit(".")).alias("path"))
    if mentions is not None:
        text = text.unionByName(mentions.select("repo", F.lit("").alias("rel"), F.replace("name", F.lit(":"), F.lit(".")).alias("path")))
    by_path = read_paths(chains.unionByName(text), files, index).select("repo", F.col("target").alias("rel"), "name")
    stars = resolve(facts.of("star").select("repo", "rel", F.col("a").alias("module")), files, index).select("repo", F.col("target").alias("rel"), F.col("rel").alias("importer")).distinct()
    stars = store(stars, "stars").hint("merge")
    by_star = stars.join(facts.names("used").withColumnRenamed("rel", "importer"), ["repo", "importer"]).select("repo", "rel", "name")
    return direct.unionByName(by_path).unionByName(by_star).distinct(), stars


def dynamic_files(facts: Facts, index: DataFrame | None = None) -> DataFrame:
    """(repo, rel): files that another one reaches through computed names. index: the files' module_index, where it is known."""
    files = facts.files
    index = module_index(files) if index is None else index
    targets = facts.names("target").withColumns({"head": F.substring_index("name", ".", 1), "star": F.contains("name", F.lit(".")) | F.startswith("name", F.lit("pkg:"))})
    alias = facts.imports.select("repo", "rel", F.col("bound").alias("head"), F.when(F.col("is_from"), _join_name(F.col("module"), F.col("imported"))).otherwise(F.col("imported")).alias("module"))
    named = targets.filter(~F.startswith("name", F.lit("pkg:"))).join(alias, ["repo", "rel", "head"]).select("repo", "rel", "module", "star")
    given = targets.filter(F.startswith("name", F.lit("pkg:"))).select("repo", "rel", F.substring("name", 5, 1000).alias("module"), "star")
    hits = resolve(named.unionByName(given), files, index)
    # every file under a package's folder: by equality on the folders above each file
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/")) - 1), lambda i: F.array_join(F.slice(F.split("rel", "/"), F.lit(1), i), "/"))
    below = files.filter(F.contains("rel", F.lit("/"))).select("repo", "rel", F.explode(up).alias("dir"))
    whole = hits.filter("star").select("repo", S.folder(F.col("target")).alias("dir")).filter("dir <> ''").distinct()
    return hits.filter("not star").select("repo", F.col("target").alias("rel")).unionByName(below.join(whole, ["repo", "dir"]).select("repo", "rel")).distinct()


def config_loaded(facts: Facts, paths: DataFrame) -> DataFrame:
    """(repo, rel, by): Python files that a plugin list names; joined by file name, then by the end of the path."""
    f = facts.files.select("repo", "rel", S.base_name(F.col("rel")).alias("base"))
    p = paths.select("repo", F.col("rel").alias("by"), "path", S.base_name(F.col("path")).alias("base"))
    hits = f.join(p, ["repo", "base"]).filter((F.col("rel") == F.col("path")) | F.endswith("rel", F.concat(F.lit("/"), "path")))
    return hits.groupBy("repo", "rel").agg(F.min("by").alias("by"))


def library_roots(files: DataFrame) -> DataFrame:
    """(repo, root): folders that package a library. files: repo, rel, text of all text files."""
    name = S.base_name(F.col("rel"))
    project = (name == "pyproject.toml") & (F.contains("text", F.lit("[project]")) | F.contains("text", F.lit("[tool.poetry]")))
    return files.filter(name.isin("setup.py", "setup.cfg") | project).select("repo", S.folder(F.col("rel")).alias("root")).distinct()
