"""An audit of any number of repositories, end to end: sources, facts, findings, authors, payoff, ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import attribution, copies, jury, metrics, rules
from corvane.operators.ledger import Ledger
from corvane.operators.pyfacts import stored
from corvane.packs import declared, web
from corvane.packs.base import Pack, audit, too_long
from corvane.runtime import store
from corvane.sources.git import read_git
from corvane.sources.tree import census, read_tree, too_large


PACKS = [*web.PACKS, *declared.PACKS]


@dataclass
class Audit:
    """Frames of one run; each has a repo column. author frames are null where git knows nothing."""

    files: DataFrame
    findings: DataFrame
    languages: DataFrame
    payoff: DataFrame
    rates: DataFrame
    detail: DataFrame
    hashes: DataFrame
    lines: DataFrame
    commits: DataFrame
    rework: DataFrame
    tools: DataFrame
    history: DataFrame
    left_out: DataFrame

    def document(self) -> DataFrame:
        """One JSON document per repository: payoff, rates and findings."""
        f = self.findings.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("file", "line", "name", "kind", "end_line", "verdict", "final", "reason", "lines", "authored_by", "proof", "evidence"))).alias("findings"))
        p = self.payoff.select("repo", F.struct([c for c in self.payoff.columns if c != "repo"]).alias("payoff"))
        r = self.rates.select("repo", F.struct([c for c in self.rates.columns if c != "repo"]).alias("attribution"))
        both = p.join(r, "repo", "left").join(f, "repo", "left")
        return both.select("repo", F.to_json(F.struct("repo", "payoff", "attribution", "findings")).alias("document"))

    def record(self, ledger: Ledger) -> int:
        p = self.payoff.join(self.rates.select("repo", "ai_dead_per_1000", "human_dead_per_1000"), "repo", "left").join(self.hashes.groupBy("repo").agg(F.count("*").alias("files")), "repo", "left")
        runs = p.select("repo", F.current_timestamp().alias("started"), "files", F.col("total_lines").alias("lines"), "dead_units", "dead_lines", F.col("jlr_percent").alias("jlr"), "ai_dead_per_1000", "human_dead_per_1000", F.to_json(F.struct(*self.payoff.columns)).alias("metrics"))
        return ledger.record(runs, self.findings, self.hashes)


def left_out(spark: SparkSession, roots: dict[str, str], tree: DataFrame, files: DataFrame, packs: list[Pack]) -> DataFrame:
    """repo, rel (null: all of it), why, size: what the audit doesn't look at, so that nothing goes missing unsaid."""
    large = too_large(spark, roots).select("repo", "rel", F.lit("too large to be read (bytes)").alias("why"), "size")
    long = too_long(tree.select("repo", "rel", S.language(F.col("rel")).alias("lang"), "text"), packs).select("repo", "rel", F.lit("too long for its language pack (bytes)").alias("why"), F.col("bytes").alias("size"))
    many = copies.over_ceiling(files).select("repo", F.lit(None).cast("string").alias("rel"), F.lit("too many lines for a search of copies").alias("why"), F.col("lines").alias("size"))
    return large.unionByName(long.distinct()).unionByName(many)


def run(spark: SparkSession, roots: dict[str, str], packs: list[Pack] | None = None, proofs: DataFrame | None = None, votes: DataFrame | None = None, patterns: str | None = None, on_stage: Callable[[str], None] = lambda stage: None) -> Audit:
    """Audits repositories (name -> folder).

    proofs (repo, kind, file, name, proof, and line where known): recorded outcomes of test runs; given at all, code whose
    removal didn't pass stays. Of several outcomes of one unit a failed one counts.
    votes: as jury_decision takes them, with finding = jury.finding_key: repo:kind:file:line:name; its decision replaces the default. patterns:
    custom signatures, separated by a double bar. on_stage is told each stage's name.
    """
    on_stage("ingest")
    tree = store(read_tree(spark, roots), "tree")
    python = tree.filter(F.col("rel").endswith(".py")).select("repo", "rel", "text")
    others = tree.filter(~F.col("rel").endswith(".py")).select("repo", "rel", "text")
    on_stage("facts")
    facts = stored(python)
    files = store(census(tree), "files")
    on_stage("candidates")
    found = rules.python_findings(rules.Repository(facts, others, python.select("repo", "rel")))
    found = found.unionByName(copies.audit_copies(files).select(*rules.COLUMNS))
    words = tree.select("repo", "rel", S.language(F.col("rel")).alias("lang"), "text")
    units = audit(words, PACKS if packs is None else packs, words)
    final = jury.default_final(F.col("verdict"))
    found = found.unionByName(units.select("repo", "kind", F.col("rel").alias("file"), F.col("start").alias("line"), F.col("end").alias("end_line"), F.col("name"), "verdict", "reason", (F.col("end") - F.col("start") + 1).alias("lines"), F.array().cast("array<string>").alias("evidence"), F.lit("not run").alias("proof"), final.alias("final")).select(*rules.COLUMNS))
    test = S.is_test_path(F.col("file")) & (F.col("kind") != "import") & (F.col("proof") == "not run")
    found = store(found.withColumn("proof", F.when(test, "not provable (test code)").otherwise(F.col("proof"))), "candidates")
    on_stage("attribution")
    commits = store(attribution.classify(read_git(spark, roots, "commits"), attribution.custom_patterns(patterns)), "commits")
    lines = store(attribution.line_kinds(read_git(spark, roots, "blame"), commits), "lines")
    found = attribution.findings_with_author(found, lines)
    judged = F.lit(False)
    if votes is not None:
        on_stage("judgement")
        d = jury.jury_decision(votes).select(F.col("finding").alias("key"), "decision")
        found = found.withColumn("key", jury.finding_key()).join(d, "key", "left").drop("key")
        judged = F.col("decision").isNotNull()
        found = found.withColumn("final", F.coalesce("decision", "final"))
    found = found.withColumn("judged", judged).drop("decision")
    if proofs is not None:
        on_stage("proof")
        found = jury.with_outcomes(found, proofs)
        found = found.withColumn("final", jury.after_proof(F.col("final"), F.col("kind"), F.col("proof")))
    found = store(found, "findings")
    on_stage("payoff")
    audited = files.filter("lang = 'Python'").unionByName(files.filter(F.col("lang").isin([x for p in (packs or PACKS) for x in p.languages])))
    totals = audited.groupBy("repo").agg(F.sum("lines").alias("total_lines"))
    own = lines.join(audited.select("repo", "rel"), ["repo", "rel"], "left_semi")
    by_kind = own.join(files.filter("lang = 'Python'").select("repo", "rel"), ["repo", "rel"], "left_semi").groupBy("repo", "kind").agg(F.count("*").alias("lines"))
    return Audit(
        files=files, findings=found, languages=metrics.census(files, [x for p in (packs or PACKS) for x in p.languages]), payoff=metrics.payoff(found, totals), rates=metrics.rates(found, by_kind),
        detail=metrics.files_detail(files, found, lines), hashes=tree.select("repo", "rel", "sha"), lines=lines, commits=commits,
        rework=attribution.rework(commits, read_git(spark, roots, "numstat"), own), tools=attribution.tools(commits), history=attribution.history_shape(lines, commits),
        left_out=left_out(spark, roots, tree, files, PACKS if packs is None else packs),
    )
