"""An audit as text and pages: at most a fixed number of rows of each section reaches the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.operators import metrics

SECTIONS = [("REMOVE", "Nothing uses"), ("SIMPLIFY", "Copies"), ("AMBIGUOUS", "Can't be settled")]


def _rows(df: DataFrame, limit: int) -> tuple[list, int]:
    return df.limit(limit).collect(), df.count()


def _number(n, digits: int = 0) -> str:
    return "n/a" if n is None else f"{n:,.{digits}f}"


def markdown(audit, repo: str, limit: int = L.REPORT_ROWS) -> str:
    """A report on one repository: payoff, languages, findings by what to do, each section cut at limit rows with how many more there are."""
    p = audit.payoff.filter(F.col("repo") == repo).first()
    out = [f"# Audit of {repo}", ""]
    if p:
        out += [f"- {_number(p['total_lines'])} audited lines, of which {_number(p['jlr_percent'], 2)} % are used", f"- {_number(p['dead_lines'])} dead lines in {_number(p['dead_units'])} places, {_number(p['proved'])} proved", f"- {_number(p['duplicate_lines'])} copied lines, {_number(p['pending'])} places wait for judgement", ""]
    langs, more = _rows(audit.languages.filter(F.col("repo") == repo), 10)
    out += ["| language | files | lines | audit |", "| --- | ---: | ---: | --- |", *(f"| {x['lang']} | {_number(x['files'])} | {_number(x['lines'])} | {x['audit']} |" for x in langs)]
    out += [f"and {more - len(langs)} more"] if more > len(langs) else []
    found = audit.findings.filter(F.col("repo") == repo)
    for verdict, title in SECTIONS:
        rows, n = _rows(found.filter(F.col("verdict") == verdict).orderBy("file", "line", "name").select("file", "line", "kind", S.markdown_escape(F.col("name")).alias("name"), S.markdown_escape(F.col("reason")).alias("reason")), limit)
        if n:
            out += ["", f"## {title} ({_number(n)})", "", *(f"- `{r['file']}:{r['line']}` {r['kind']} `{r['name']}`: {r['reason']}" for r in rows)]
            out += [f"- … and {n - len(rows)} more"] if n > len(rows) else []
    return "\n".join(out) + "\n"


def page(audit, repo: str, history: list | None = None, limit: int = L.REPORT_ROWS) -> str:
    """The same as one self-contained HTML page, with the line of earlier ratios if there are any."""
    body = "".join(f"<p>{html.escape(x)}</p>" if not x.startswith("#") else f"<h2>{html.escape(x.lstrip('# '))}</h2>" for x in markdown(audit, repo, limit).split("\n") if x)
    points = [h for h in history or [] if h is not None]
    line = ""
    if len(points) > 1:
        low, high = min(points), max(points)
        xy = " ".join(f"{100 * i / (len(points) - 1):.1f},{30 - 28 * (v - low) / ((high - low) or 1):.1f}" for i, v in enumerate(points))
        line = f'<svg viewBox="0 0 100 32" width="300"><polyline fill="none" stroke="currentColor" points="{xy}"/></svg>'
    return f"<!doctype html><meta charset=utf-8><title>Audit of {html.escape(repo)}</title>{line}{body}"


def compact(findings: DataFrame, limit: int = L.TOP_FINDINGS) -> dict:
    """What a tool's answer holds: counts by verdict, the first findings, and the plan by file."""
    counts = {r["verdict"]: r["n"] for r in metrics.verdict_counts(findings).groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    brief = metrics.ordered(findings, limit).select("file", "line", "end_line", "kind", "name", "verdict", "final", "reason", "authored_by").collect()
    plan = metrics.fix_plan(findings).orderBy(F.desc("n"), "file").limit(L.FIX_FILES).collect()
    return {"counts": counts, "findings": [r.asDict() for r in brief], "more": max(0, sum(counts.values()) - len(brief)), "fix_plan": [r.asDict() for r in plan]}


def write_documents(audit, path: str) -> None:
    """The JSON documents, gzipped, one folder for each repository."""
    audit.document().write.mode("overwrite").partitionBy("repo").option("compression", "gzip").text(path)


def read_documents(spark, path: str) -> DataFrame:
    return spark.read.text(path).select("repo", F.parse_json("value").alias("document"))


def diff(before: DataFrame, after: DataFrame, limit: int = 100) -> dict:
    """Findings that are new or gone between two runs: totals and the first of each."""
    from corvane.operators.usage import run_diff

    d = run_diff(before, after)
    totals = {r["change"]: r["n"] for r in d.groupBy("change").agg(F.count("*").alias("n")).collect()}
    return {c: {"total": totals.get(c, 0), "rows": [r.asDict() for r in d.filter(F.col("change") == c).orderBy("file", "kind", "name").limit(limit).collect()]} for c in ("new", "gone")}
