"""Words of files: counts, where they occur, and which declared names nothing else mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import scalars as S


def word_counts(files: DataFrame, pattern: str = S.IDENT_WEB) -> DataFrame:
    """repo, rel, word, n: how often each file holds each identifier. files: repo, rel, text."""
    return files.select("repo", "rel", F.explode(S.all_matches(F.col("text"), pattern)).alias("word")).groupBy("repo", "rel", "word").agg(F.count("*").alias("n"))


def named_counts(files: DataFrame, names: DataFrame, css: bool = False) -> DataFrame:
    """word_counts, or css_word_counts, of the words that are among names (repo, name) only.

    A file's words are counted inside its own row, so what is shuffled is a row per file and different word, and what is left a row per
    file and name. An array is sorted first: equal words then lie in runs, whose ends tell how many there are.
    """
    found = S.css_tokens(F.col("text")) if css else S.all_matches(F.col("text"), S.IDENT_WEB)
    t = files.select("repo", "rel", F.sort_array(found).alias("w")).filter("size(w) > 0")
    n = F.size("w")
    last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("w", i) != F.get("w", i - 1)))  # places (from 1) at which a run ends
    t = t.select("repo", "rel", "w", last.alias("last"))
    runs = F.transform("last", lambda at, k: F.struct(F.get("w", at - 1).alias("word"), (at - F.coalesce(F.get("last", k - 1), F.lit(0))).cast("long").alias("n")))
    each = t.select("repo", "rel", F.explode(runs).alias("x")).select("repo", "rel", "x.word", "x.n")
    kept = each.join(names.select("repo", F.col("name").alias("word")).distinct(), ["repo", "word"], "left_semi")
    return kept.groupBy("repo", "rel", "word").agg(F.sum("n").alias("n"))


def css_word_counts(files: DataFrame) -> DataFrame:
    return files.select("repo", "rel", F.explode(S.css_tokens(F.col("text"))).alias("word")).groupBy("repo", "rel", "word").agg(F.count("*").alias("n"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """repo, word, n_files, total: the inverted index as counts, which is all that rules ask of it."""
    return counts.groupBy("repo", "word").agg(F.count("*").alias("n_files"), F.sum("n").alias("total"))


def postings(counts: DataFrame) -> DataFrame:
    """repo, word, rels: the files of each word, sorted. A common word's list is as long as its repository has files."""
    return counts.groupBy("repo", "word").agg(F.sort_array(F.collect_set("rel")).alias("rels"))


def files_with_all(counts: DataFrame, words: DataFrame) -> DataFrame:
    """group, repo, rel: files that hold every word of a group. words: group, word."""
    need = words.distinct().groupBy("group").agg(F.count("*").alias("need"))
    held = counts.join(words.distinct(), "word").groupBy("group", "repo", "rel").agg(F.count("*").alias("have"))
    return held.join(need, "group").filter("have = need").select("group", "repo", "rel")


def unused_units(units: DataFrame, counts: DataFrame) -> DataFrame:
    """Units whose name occurs nowhere in their scope beyond their own text: a column used_in says what was looked at.

    units: repo, rel, lang, kind, name, show, start, end, scope (file, package, repo or public), keep, reason, own (how
    often the unit's own text holds the name). Scope package is the file's folder. Public names are judged as those of
    a repository but always kept for a reason.
    """
    here = counts.select("repo", "rel", F.col("word").alias("name"), F.col("n").alias("in_file"))
    by_folder = counts.groupBy("repo", S.folder(F.col("rel")).alias("dir"), F.col("word").alias("name")).agg(F.sum("n").alias("in_package"))
    by_repo = counts.groupBy("repo", F.col("word").alias("name")).agg(F.sum("n").alias("in_repo"))
    u = units.withColumn("dir", S.folder(F.col("rel"))).join(here, ["repo", "rel", "name"], "left").join(by_folder, ["repo", "dir", "name"], "left").join(by_repo, ["repo", "name"], "left")
    seen = F.when(F.col("scope") == "file", F.col("in_file")).when(F.col("scope") == "package", F.col("in_package")).otherwise(F.col("in_repo"))
    unused = u.filter(F.coalesce(seen, F.lit(0)) <= F.col("own"))
    kept = F.coalesce(F.col("keep"), F.lit(False)) | (F.col("scope") == "public")
    reason = F.when(F.coalesce("keep", F.lit(False)), F.col("reason")).when(F.col("scope") == "public", "public: its users may be elsewhere").otherwise(F.concat(F.lit("no use in its "), F.col("scope")))
    return unused.select("repo", "rel", "lang", "kind", "name", "show", "start", "end", F.when(kept, "AMBIGUOUS").otherwise("REMOVE").alias("verdict"), reason.alias("reason"), "scope")


def named_elsewhere(units: DataFrame, counts: DataFrame) -> DataFrame:
    """Units whose name another file of their repository holds as a word: code there may reach them by string. units: repo, rel, name; counts: repo, rel, word.

    A name's files are counted once and its own file is taken off, so a frequent word costs a row for each unit, not for each file.
    """
    held = counts.select("repo", "rel", F.col("word").alias("name")).distinct()
    n = held.groupBy("repo", "name").agg(F.count("*").alias("n"))
    own = held.withColumn("own", F.lit(1))
    u = units.join(n, ["repo", "name"]).join(own, ["repo", "rel", "name"], "left")
    return u.filter(F.col("n") > F.coalesce("own", F.lit(0))).select(*units.columns)


def built_styles(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """Units (repo, name) whose name may be put together: a literal elsewhere is its start up to a joint, or its end from one. pieces: repo, piece.

    A name's own heads (which end with a joint) and tails (which begin with one) are joined with the literals by equality.
    """
    joint = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), i, F.lit(1)).isin("-", "_"))
    size = F.length("name")
    heads = F.transform(F.filter(joint, lambda i: i < size), lambda i: F.substr(F.col("name"), F.lit(1), i))
    tails = F.transform(F.filter(joint, lambda i: i > 1), lambda i: F.substr(F.col("name"), i, size))
    parts = units.withColumn("piece", F.explode(F.array_distinct(F.concat(heads, tails))))
    return parts.join(pieces.select("repo", "piece").distinct(), ["repo", "piece"], "left_semi").drop("piece").distinct()


def seen_share(units: DataFrame, seen: DataFrame) -> DataFrame:
    """repo, rel, names, seen, mostly_unseen: of each file's different names how many are seen elsewhere, and whether fewer than half are. seen: repo, name."""
    u = units.select("repo", "rel", "name").distinct().join(seen.select("repo", "name").distinct().withColumn("hit", F.lit(1)), ["repo", "name"], "left")
    return u.groupBy("repo", "rel").agg(F.count("*").alias("names"), F.count("hit").alias("seen")).withColumn("mostly_unseen", F.col("seen") * 2 < F.col("names"))
