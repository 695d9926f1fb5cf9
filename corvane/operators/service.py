"""History, activity and allowances of audits: series, deltas, calendars, quotas, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S


def series(audits: DataFrame, by: list[str], order: list[str], value: str, keep: int = 20) -> DataFrame:
    """by, n, latest, previous, recent: how many audits, the last two values and the last `keep` of them, oldest first."""
    down = W.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    r = audits.withColumn("i", F.row_number().over(down))
    n = audits.groupBy(*by).agg(F.count("*").alias("n"))
    last = r.filter(F.col("i") <= keep).groupBy(*by).agg(F.max(F.when(F.col("i") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("i") == 2, F.col(value))).alias("previous"), F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("o"), F.col(value).alias("v")))).alias("x"))
    return n.join(last, by).select(*by, "n", "latest", "previous", F.transform("x", lambda e: e["v"]).alias("recent"))


def deltas(audits: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """audits with, for each value, its change since the audit before that has one (null without one)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return audits.withColumns({f"{v}_change": F.round(F.col(v) - F.last(v, ignorenulls=True).over(w), 2) for v in values})


def activity(asked: DataFrame, today, at: str = "ts", days: int = 30) -> DataFrame:
    """day, audits: the last `days` days up to today (a date), oldest first, zeros included."""
    spark = asked.sparkSession
    day = spark.range(days).select(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))
    n = asked.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("audits"))
    return day.join(n, "day", "left").na.fill(0, ["audits"]).orderBy("day")


def daily_quota(requests: DataFrame, who: str = "user_id", at: str = "ts", order: str = "event_id", limit: int = L.QUOTA["member"]) -> DataFrame:
    """requests with their number on their UTC day and whether they are within the allowance. Refused ones use nothing up, so the first `limit` pass."""
    w = W.partitionBy(who, F.to_date(at)).orderBy(at, order)
    return requests.withColumn("number", F.row_number().over(w)).withColumn("allowed", F.col("number") <= limit)


def usage_by_day(requests: DataFrame, who: str = "user_id", at: str = "ts", keep_days: int | None = 60) -> DataFrame:
    """who, day, n of the last keep_days days before the latest one."""
    n = requests.groupBy(who, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    if keep_days is None:
        return n
    last = n.agg(F.max("day").alias("last"))
    return n.crossJoin(F.broadcast(last)).filter(F.col("day") >= F.date_sub("last", keep_days)).drop("last")


def concurrent(starts: DataFrame, by: str, start: str, end: str, order: str, cap: int = L.CONCURRENT) -> DataFrame:
    """starts with how many of the owner's earlier jobs still run at each start, and whether that is under the cap.

    Each job is two moments, +1 and -1; a running sum over an owner's moments counts what runs. Ends come before starts of the same moment.
    """
    plus = starts.select("*", F.col(start).alias("_t"), F.lit(1).alias("_d"))
    minus = starts.select("*", F.col(end).alias("_t"), F.lit(-1).alias("_d"))
    w = W.partitionBy(by).orderBy("_t", "_d", order).rowsBetween(W.unboundedPreceding, -1)
    both = plus.unionByName(minus).withColumn("running", F.coalesce(F.sum("_d").over(w), F.lit(0)))
    return both.filter("_d = 1").drop("_t", "_d").withColumn("allowed", F.col("running") < cap)


def recent_distinct(audits: DataFrame, key: str, at: str, order: str, among: int = 200, show: int = 12) -> DataFrame:
    """The newest audit of each key among the newest `among` audits, newest first; null keys are never merged."""
    some = audits.orderBy(F.desc(at), F.desc(order)).limit(among)
    w = W.partitionBy(F.coalesce(F.lower(F.col(key).cast("string")), F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(F.desc(at), F.desc(order))
    return some.withColumn("i", F.row_number().over(w)).filter("i = 1").drop("i").orderBy(F.desc(at), F.desc(order)).limit(show)


def queue_position(jobs: DataFrame, status: str, created: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Queued jobs with how many were queued before them in their queue."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(created, order)
    return jobs.filter(F.col(status) == "queued").withColumn("position", F.row_number().over(w) - 1)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of 1 to 200 rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def statistics(audits: DataFrame) -> DataFrame:
    """One row: audits, finished, repositories, lines, dead, duplicate, mean_jlr and ai_share over each repository's latest finished audit.

    audits: repo, at, id, status, jlr, lines, dead_lines, dup_lines, ai_lines, human_lines.
    """
    done = audits.filter("status = 'done'")
    last = done.groupBy("repo").agg(F.max_by(F.struct("jlr", "lines", "dead_lines", "dup_lines", "ai_lines", "human_lines"), F.struct("at", "id")).alias("x")).select("repo", "x.*")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = last.agg(F.count("*").alias("repositories"), zero("lines").alias("lines"), zero("dead_lines").alias("dead_lines"), zero("dup_lines").alias("dup_lines"), F.round(F.avg("jlr"), 2).alias("mean_jlr"), S.ratio(zero("ai_lines"), zero("ai_lines") + zero("human_lines"), 100.0, 1).alias("ai_share"))
    n = audits.agg(F.count("*").alias("audits"), F.count_if(F.col("status") == "done").alias("finished"))
    return n.crossJoin(totals)


def cached(asked: DataFrame, done: DataFrame) -> DataFrame:
    """asked (repo, sha, version, ...) with the id of a finished audit of the same repository, in any case, commit and version; null without one."""
    key = [F.lower("repo").alias("_r"), "sha", "version"]
    have = done.filter("status = 'done'").groupBy(*key).agg(F.max("id").alias("cached_id"))
    return asked.withColumn("_r", F.lower("repo")).join(have, ["_r", "sha", "version"], "left").drop("_r")


def visible(audits: DataFrame, viewer: str | None) -> DataFrame:
    """Audits that a viewer may see: public ones and their own."""
    own = F.lit(False) if viewer is None else F.col("owner") == viewer
    return audits.filter((F.col("visibility") == "public") | F.coalesce(own, F.lit(False)))


def search(findings: DataFrame, verdict: str | None = None, file: str | None = None, kind: str | None = None, text: str = "") -> DataFrame:
    """The findings box: exact choices, and a text that file or name holds in any case."""
    for column, value in (("verdict", verdict), ("file", file), ("kind", kind)):
        if value:
            findings = findings.filter(F.col(column) == value)
    low = F.lit(text.lower())
    return findings.filter(F.contains(F.lower("file"), low) | F.contains(F.lower("name"), low))


def merged_choices(private: DataFrame, public: DataFrame) -> DataFrame:
    """Repositories to choose from: private ones first, then public ones not among them, by name in any case."""
    key = F.lower("full_name").alias("k")
    rest = public.select("*", key).join(private.select(key).distinct(), "k", "left_anti").drop("k")
    return private.withColumn("source", F.lit("private")).unionByName(rest.withColumn("source", F.lit("public")))


def connected_apps(tokens: DataFrame, clients: DataFrame) -> DataFrame:
    """client_id, name, since, last_used of each app with a live token."""
    return tokens.join(clients, "client_id", "left").groupBy("client_id").agg(F.max("name").alias("name"), F.min("created").alias("since"), F.max("last_used").alias("last_used"))


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status").isin("cloning", "scanning")).alias("running"))


def unexpired(rows: DataFrame, created: str, now, seconds: int) -> DataFrame:
    """Rows (sessions, tokens) younger than their time to live."""
    return rows.filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(created).cast("timestamp")) < seconds)


def assistant_totals(latest: DataFrame) -> DataFrame:
    """tool, commits over the latest audit of each repository. latest: tools (map of tool to commits)."""
    return latest.select(F.explode("tools").alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("commits")).orderBy(F.desc("commits"), "tool")
