"""Who wrote what: commit signatures, lines by kind, majority of a span, rework, shape of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.operators.usage import within_span


def assistant_in(text: Column) -> Column:
    """The first assistant whose name pattern the text matches, in the order of the table; else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(L.ASSISTANTS):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def signature(message: Column, author: Column, committer: Column, custom: list[str] | None = None) -> Column:
    """struct(kind, tool) of a commit: ai with the assistant that signed it, else human. Only places that an assistant writes are read, in a fixed order."""
    text = lambda c: F.coalesce(c, F.lit(""))
    message, author, committer = text(message), text(author), text(committer)
    pairs = F.arrays_zip(S.all_matches(message, L.TRAILER_LINE, 1).alias("key"), S.all_matches(message, L.TRAILER_LINE, 2).alias("value"))
    own = lambda p: F.when(F.lower(p["key"]).isin(L.OWN_TRAILERS), "Other assistant")
    first = lambda tools: F.try_element_at(F.filter(tools, lambda t: t.isNotNull()), F.lit(1))
    trailer = first(F.transform(pairs, lambda p: F.coalesce(assistant_in(p["value"]), own(p))))
    made_with = first(F.transform(S.all_matches(message, L.GENERATED_WITH, 1), assistant_in))
    account = lambda who: F.when(who.rlike(L.AGENT_IDENTITY), F.coalesce(assistant_in(who), F.lit("Other assistant")))
    tool = F.coalesce(
        trailer, made_with, account(author), account(committer), F.when(message.rlike(L.NO_REPLY), "Claude"), F.when(message.rlike(L.AIDER_LINE), "Aider"),
        F.when(message.rlike(L.GENERATED_WORD), "Other assistant"),
        *(F.when(message.rlike("(?i)" + p) | author.rlike("(?i)" + p) | committer.rlike("(?i)" + p), "Custom pattern") for p in custom or []),
    )
    return F.struct(F.when(tool.isNotNull(), "ai").otherwise("human").alias("kind"), tool.alias("tool"))


def custom_patterns(setting: str | None) -> list[str]:
    return [p for p in (setting or "").split("||") if p.strip()]


def classify(commits: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """commits (message, author, committer, ...) with kind and tool."""
    return commits.withColumn("signed", signature(F.col("message"), F.col("author"), F.col("committer"), custom)).select(*commits.columns, "signed.kind", "signed.tool")


def line_kinds(blame: DataFrame, commits: DataFrame) -> DataFrame:
    """blame (repo, rel, line, sha) with the kind of its commit: uncommitted for the null commit, unknown for lines of none that is known."""
    k = commits.select("repo", "sha", "kind", "ct").dropDuplicates(["repo", "sha"])
    kind = F.when(F.col("sha").rlike("^0+$"), "uncommitted").otherwise(F.coalesce("kind", F.lit("unknown")))
    return blame.join(k, ["repo", "sha"], "left").withColumn("kind", kind)


def lines_by_kind(lines: DataFrame) -> DataFrame:
    return lines.groupBy("repo", "kind").agg(F.count("*").alias("lines"))


def majority(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, value, n: the most frequent value of each group; of equally frequent ones that which comes first by order."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return counts.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("at")).alias("first"))).alias("m")).select(*by, f"m.{value}", "m.n")


def findings_with_author(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings (repo, file, line, end_line, name, ...) with authored_by: the majority kind of their lines, unknown without any."""
    f = findings.withColumns({"rel": F.col("file"), "start": F.col("line"), "end": F.col("end_line")})
    key = ["repo", "file", "line", "end_line", "name"]
    points = lines.select("repo", "rel", F.col("line").alias("at_line"), F.col("kind").alias("line_kind"))
    hits = within_span(f.select(*key, "rel", "start", "end").distinct(), points, ["repo", "rel"], "at_line")
    who = majority(hits, key, "line_kind", "at_line").select(*key, F.col("line_kind").alias("authored_by"))
    return findings.drop("authored_by").join(who, key, "left").withColumn("authored_by", F.coalesce("authored_by", F.lit("unknown")))


def rework(commits: DataFrame, numstat: DataFrame, lines: DataFrame) -> DataFrame:
    """repo, kind, added, surviving, rewritten_percent since the repository's first ai commit that touches Python on its current branch.

    commits: repo, sha, ct, kind, on_head; numstat: repo, sha, rel, added (null for binary files); lines: repo, rel, line, sha, kind, ct.
    A commit that is listed more than once counts once. Surviving lines never exceed added ones. Repositories without such a commit give no row.
    """
    py = numstat.filter(F.col("added").isNotNull() & F.endswith("rel", F.lit(".py")))
    touched = commits.filter("on_head").dropDuplicates(["repo", "sha"]).join(py, ["repo", "sha"])
    since = touched.filter("kind = 'ai'").groupBy("repo").agg(F.min("ct").alias("since"))
    added = touched.join(since, "repo").filter("ct >= since").groupBy("repo", "kind").agg(F.sum("added").alias("added"))
    left = lines.join(since, "repo").filter("ct >= since").groupBy("repo", "kind").agg(F.count("*").alias("left"))
    both = added.join(left, ["repo", "kind"], "left").withColumn("surviving", F.least(F.coalesce("left", F.lit(0)), "added"))
    return both.select("repo", "kind", "added", "surviving", S.ratio(F.col("added") - F.col("surviving"), F.col("added"), 100.0, 1).alias("rewritten_percent"))


def tools(commits: DataFrame) -> DataFrame:
    """repo, tool, commits of the current branch, most first, then the tool seen first."""
    t = commits.filter(F.col("on_head") & F.col("tool").isNotNull()).groupBy("repo", "tool").agg(F.count("*").alias("commits"), F.min("ct").alias("first"))
    return t.orderBy("repo", F.desc("commits"), "first", "tool").drop("first")


def history_shape(lines: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, commits, lines, largest, share (percent, 1 digit), thin: how much of today's lines one commit holds."""
    per = lines.filter(~F.col("sha").rlike("^0+$")).groupBy("repo", "sha").agg(F.count("*").alias("n"))
    s = per.groupBy("repo").agg(F.sum("n").alias("lines"), F.max("n").alias("largest"))
    c = commits.filter("on_head").groupBy("repo").agg(F.count("*").alias("commits"))
    out = c.join(s, "repo", "left")
    thin = (F.col("commits") <= L.THIN_COMMITS) | F.coalesce(F.col("largest") / F.col("lines") >= L.THIN_SHARE, F.lit(False))
    return out.select("repo", "commits", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("largest", F.lit(0)).alias("largest"), S.ratio(F.col("largest"), F.col("lines"), 100.0, 1).alias("share"), thin.alias("thin"))


def ai_commits(commits: DataFrame) -> DataFrame:
    return commits.filter("on_head").groupBy("repo").agg(F.count_if(F.col("kind") == "ai").alias("ai_commits"), F.count("*").alias("commits"))
