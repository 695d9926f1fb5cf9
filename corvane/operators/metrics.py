"""Payoff of an audit: census, dead and duplicate lines, rates, rows per file, directory totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S

_CODE = ["import", "function", "class", "method", "field", "variable", "type", "style"]


def census(files: DataFrame, full: list[str] | None = None) -> DataFrame:
    """repo, lang, files, lines, audit: languages by size with how deeply they are audited."""
    level = (
        F.when(F.col("lang").isin(["Python", *(full or [])]), "full").when(F.col("lang").isin(L.COPY_LANGUAGES), "copies")
        .when(F.col("lang").isin(L.PROSE_LANGUAGES), "prose").when(F.col("lang").isin(L.DATA_LANGUAGES), "data").otherwise("none")
    )
    rows = files.groupBy("repo", "lang").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return rows.withColumn("audit", level).orderBy("repo", F.desc("lines"), "lang")


def _dead():
    return (F.col("final") == "REMOVE") & F.col("kind").isin(_CODE)


def _sum(when):
    return F.coalesce(F.sum(F.when(when, F.col("lines"))), F.lit(0))


def payoff(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """A row per repository: dead and duplicate weight, what is proved or waits for judgement, and the share of lines that stays.

    findings: repo, kind, verdict, final, proof, judged, lines; totals: repo, total_lines.
    """
    f = findings.groupBy("repo").agg(
        F.count_if(_dead()).alias("dead_units"), _sum(_dead()).alias("dead_lines"), F.count_if(_dead() & (F.col("proof") == "passed")).alias("proved"),
        _sum(F.col("final") == "SIMPLIFY").alias("duplicate_lines"), F.count_if((F.col("verdict") == "AMBIGUOUS") & ~F.col("judged") & (F.col("final") == "KEEP")).alias("pending"),
    )
    out = totals.join(f, "repo", "left").na.fill(0, ["dead_units", "dead_lines", "proved", "duplicate_lines", "pending"])
    t, d = F.col("total_lines"), F.col("dead_lines")
    return out.select("repo", "total_lines", "dead_units", "dead_lines", "proved", "duplicate_lines", "pending", S.ratio(t - d, t, 100.0, 2).alias("jlr_percent"), S.per_1000(d, t).alias("per_1000"))


def rates(findings: DataFrame, lines: DataFrame, sample: int = L.SAMPLE_LINES) -> DataFrame:
    """A row per repository: dead and duplicate Python lines per thousand lines of either author, and their ratio.

    findings: repo, kind, file, final, lines, authored_by; lines: repo, kind, lines (of audited files). A ratio needs
    `sample` lines on both sides and a human rate that isn't zero.
    """
    kind = lines.groupBy("repo").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("lines"))), F.lit(0)).alias(f"{k}_lines") for k in ("ai", "human")))
    dup = (F.col("final") == "SIMPLIFY") & F.col("file").rlike(r"\.pyi?$")
    by = lambda k: F.col("authored_by") == k
    f = findings.groupBy("repo").agg(*(_sum(what & by(k)).alias(f"{k}_{name}") for name, what in (("dead", _dead()), ("dup", dup)) for k in ("ai", "human")))
    out = kind.join(f, "repo", "left").na.fill(0)
    rate = {(k, n): S.per_1000(F.col(f"{k}_{n}"), F.col(f"{k}_lines")) for k in ("ai", "human") for n in ("dead", "dup")}
    enough = (F.col("ai_lines") >= sample) & (F.col("human_lines") >= sample)
    ratio = F.when(enough & (rate["human", "dead"] != 0), F.round(rate["ai", "dead"] / rate["human", "dead"], 2))
    return out.select("repo", "ai_lines", "human_lines", *(rate[k, n].alias(f"{k}_{n}_per_1000") for n in ("dead", "dup") for k in ("ai", "human")), ratio.alias("ratio"))


def files_detail(files: DataFrame, findings: DataFrame, line_kinds: DataFrame, limit: int = L.DETAIL_FILES) -> DataFrame:
    """repo, rel, lang, lines, dead, dup, ai, human: the largest files with what is dead, copied and by whom; null authors where nothing was blamed."""
    f = findings.groupBy("repo", F.col("file").alias("rel")).agg(_sum(_dead()).alias("dead"), _sum(F.col("final") == "SIMPLIFY").alias("dup"))
    k = line_kinds.groupBy("repo", "rel").agg(F.count_if(F.col("kind") == "ai").alias("ai"), F.count_if(F.col("kind") == "human").alias("human"))
    out = files.join(f, ["repo", "rel"], "left").join(k, ["repo", "rel"], "left").na.fill(0, ["dead", "dup"])
    return out.select("repo", "rel", "lang", "lines", "dead", "dup", "ai", "human").orderBy(F.desc("lines"), "repo", "rel").limit(limit)


def directory_weights(files: DataFrame, frame: float = 1.08) -> DataFrame:
    """repo, dir, depth, weight: for every folder the sum over its files of (square root of lines, plus 2), times frame for each level between."""
    parts = F.split("rel", "/")
    up = files.withColumn("p", parts).select("repo", "lines", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("depth"))
    w = (F.sqrt("lines") + 2) * F.pow(F.lit(frame), F.size("p") - 1 - F.col("depth"))
    return up.select("repo", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("dir"), "depth", w.alias("w")).groupBy("repo", "dir", "depth").agg(F.sum("w").alias("weight"))


def fix_plan(findings: DataFrame, changes: int = L.FIX_CHANGES, files: int = L.FIX_FILES) -> DataFrame:
    """repo, file, n, changes: of the files with most to change up to `files`, and of each up to `changes` findings in line order."""
    from pyspark.sql import Window as W

    acts = findings.filter(F.col("verdict").isin("REMOVE", "SIMPLIFY"))
    n = acts.groupBy("repo", "file").agg(F.count("*").alias("n"), F.sum("lines").alias("sum_lines"))
    top = n.withColumn("i", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("n"), "file"))).filter(F.col("i") <= files)
    each = acts.join(top.select("repo", "file", "n"), ["repo", "file"]).withColumn("i", F.row_number().over(W.partitionBy("repo", "file").orderBy("line", "name"))).filter(F.col("i") <= changes)
    rows = each.groupBy("repo", "file", "n").agg(F.sort_array(F.collect_list(F.struct("i", "line", "kind", "name", "verdict"))).alias("x"))
    return rows.select("repo", "file", "n", F.transform("x", lambda c: F.concat_ws(" ", c["line"].cast("string"), c["verdict"], c["kind"], c["name"])).alias("changes"))


def verdict_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "verdict").agg(F.count("*").alias("n"))


def ordered(findings: DataFrame, limit: int = L.TOP_FINDINGS) -> DataFrame:
    """The first findings by what to do, then file and line."""
    rank = S._map(L.VERDICT_RANK)
    return findings.withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("verdict")), F.lit(9))).orderBy("rank", "file", "line", "name").limit(limit).drop("rank")
