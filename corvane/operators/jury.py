"""Judgement and proof as tables: votes, the jury's rule, checked evidence, scoreboards, recorded outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.operators.edits import answer_json, in_code
from corvane.runtime import ship

ANSWER = "verdict string, reason string, confidence string, evidence array<string>, refuted boolean"


def parse_votes(answers: DataFrame) -> DataFrame:
    """finding, model, verdict, confidence, evidence, error of raw answers (finding, model, answer: JSON text or null).

    The last complete JSON object of an answer counts. An answer outside the format is no vote; a confidence that is no number is 0.
    """
    ship(answers.sparkSession)
    a = answers.withColumn("j", F.from_json(answer_json(F.col("answer")), ANSWER))
    verdict = F.lower(S.strip(F.col("j.verdict")))
    error = F.when(F.col("answer").isNull(), "no answer").when(F.coalesce(~verdict.isin("keep", "remove"), F.lit(True)), F.concat(F.lit("answered off-format: "), F.substring("answer", 1, 120)))
    conf = F.coalesce(F.expr("try_cast(j.confidence as double)"), F.lit(0.0))
    return a.select("finding", "model", F.when(error.isNull(), verdict).alias("verdict"), F.when(error.isNull(), conf).alias("confidence"), F.when(error.isNull(), F.coalesce("j.evidence", F.array().cast("array<string>"))).alias("evidence"), error.alias("error"))


def checked_evidence(cited: DataFrame, findings: DataFrame, lines: DataFrame, text_counts: DataFrame | None = None) -> DataFrame:
    """cited (finding, model, evidence) with each finding's evidence that holds: the line exists, names the unit as a whole word, isn't the
    unit's own, and for an import lies in its own file. findings: finding, repo, kind, file, line, end_line, name; lines: repo, rel, line, text. The first ten items count.
    On lines of Python only names in code count, unless the finding's verdict is AMBIGUOUS or text_counts (repo, rel) names the file as one that looks names up.
    """
    ship(cited.sparkSession)
    items = cited.select("finding", "model", F.posexplode(F.slice("evidence", 1, 10)).alias("i", "item"))
    items = items.withColumns({"rel": F.regexp_extract("item", r"^(.*):\s*\d+\s*$", 1), "at": F.expr(r"try_cast(regexp_extract(item, ':\\s*(\\d+)\\s*$', 1) as int)")})
    open_ = (F.col("verdict") == "AMBIGUOUS") if "verdict" in findings.columns else F.lit(False)
    f = findings.select("finding", "repo", "kind", "file", F.col("line").alias("first"), F.col("end_line").alias("last"), "name", open_.alias("by_text"))
    hits = items.join(f, "finding").join(lines.select("repo", "rel", F.col("line").alias("at"), "text"), ["repo", "rel", "at"])
    own = (F.col("rel") == F.col("file")) & F.col("at").between(F.col("first"), F.col("last"))
    elsewhere = (F.col("kind") == "import") & (F.col("rel") != F.col("file"))
    word = F.exists(F.split("text", "[^A-Za-z0-9_]+"), lambda t: t == F.col("name"))
    if text_counts is not None:
        hits = hits.join(text_counts.select("repo", "rel").distinct().withColumn("looks_up", F.lit(True)), ["repo", "rel"], "left").withColumn("by_text", F.col("by_text") | F.coalesce("looks_up", F.lit(False)))
    strict = F.endswith("rel", F.lit(".py")) & ~F.col("by_text")
    hits = hits.filter(~own & ~elsewhere & word)  # few lines are left for the tokenizer, and only those that need it are sent to Python
    ok = hits.filter(~strict | in_code(F.when(F.coalesce(strict, F.lit(True)), F.col("text")), F.col("name"))).groupBy("finding", "model").agg(F.sort_array(F.collect_list(F.struct("i", "item"))).alias("x"))
    return cited.join(ok, ["finding", "model"], "left").select(*cited.columns, F.coalesce(F.transform("x", lambda e: e["item"]), F.array().cast("array<string>")).alias("checked"))


def jury_decision(votes: DataFrame, confidence: float = L.CONFIDENCE) -> DataFrame:
    """finding, answered, removes, vetoes, need, decision of votes (finding, kind, verdict, confidence, has_evidence, error, refuted).

    A removal needs all answering jurors but one, and two at least, to say remove with confidence; a keep with checked
    evidence stops it; so does the challenge (refuted; null counts as refuted). Dependencies are never removed.
    """
    ok = F.col("error").isNull()
    v = votes.groupBy("finding").agg(
        F.max("kind").alias("kind"), F.count_if(ok).alias("answered"), F.count_if(ok & (F.col("verdict") == "remove") & (F.col("confidence") >= confidence)).alias("removes"),
        F.count_if(ok & (F.col("verdict") != "remove") & F.col("has_evidence")).alias("vetoes"), F.bool_or(F.coalesce("refuted", F.lit(True))).alias("refuted"),
    )
    need = F.greatest(F.lit(2), F.col("answered") - 1)
    keep = (F.col("kind") == "dependency") | (F.col("answered") < 2) | (F.col("vetoes") > 0) | (F.col("removes") < need) | F.col("refuted")
    return v.select("finding", "answered", "removes", "vetoes", need.alias("need"), F.when(keep, "KEEP").otherwise("REMOVE").alias("decision"))


def single_decision(kind: Column, verdict: Column, confidence: Column, refuted: Column) -> Column:
    """The rule for one model: remove only with confidence and a challenge that failed."""
    remove = (kind != "dependency") & (F.lower(verdict) == "remove") & (F.coalesce(confidence, F.lit(0.0)) >= L.CONFIDENCE) & ~F.coalesce(refuted, F.lit(True))
    return F.when(F.coalesce(remove, F.lit(False)), "REMOVE").otherwise("KEEP")


def finding_key() -> Column:
    """What votes call a finding: equal names and lines of two repositories are two findings."""
    return F.concat_ws(":", "repo", "kind", "file", "line", "name")


def with_outcomes(findings: DataFrame, proofs: DataFrame) -> DataFrame:
    """findings with proof set to the recorded outcome of their unit, one row each. proofs: repo, kind, file, name, proof, and line where known.

    Of several outcomes of one unit the one that isn't a pass counts.
    """
    key = ["repo", "kind", "file", *(["line"] if "line" in proofs.columns else []), "name"]
    settled = proofs.groupBy(*key).agg(F.min_by("proof", F.struct((F.col("proof") == "passed").alias("ok"), "proof")).alias("outcome"))
    return findings.join(settled, key, "left").withColumn("proof", F.coalesce("outcome", "proof")).drop("outcome")


def default_final(verdict: Column) -> Column:
    """The final verdict where no model judged."""
    return F.when(verdict == "AMBIGUOUS", "KEEP").otherwise(verdict)


def after_proof(final: Column, kind: Column, proof: Column) -> Column:
    """With a proof asked for, code whose removal did not pass stays."""
    code = kind.isin("import", "function", "class", "method", "field", "variable", "type", "style")
    return F.when(code & (final == "REMOVE") & (proof != "passed"), "KEEP").otherwise(final)


def scoreboard(votes: DataFrame, proofs: DataFrame, confidence: float = L.CONFIDENCE) -> DataFrame:
    """model, right, wrong: votes against what the tests settled. votes: finding, model, verdict, confidence, error; proofs: finding, proof."""
    truth = F.when(F.col("proof") == "passed", "remove").when(F.startswith("proof", F.lit("failed")), "keep")
    said = F.when((F.col("verdict") == "remove") & (F.col("confidence") >= confidence), "remove").otherwise("keep")
    v = votes.filter(F.col("error").isNull()).join(proofs, "finding").withColumn("truth", truth).filter("truth is not null")
    return v.groupBy("model").agg(F.count_if(said == F.col("truth")).alias("right"), F.count_if(said != F.col("truth")).alias("wrong"))


def usage_by_model(calls: DataFrame) -> DataFrame:
    """model, calls, tokens_in, tokens_out: each call of a member counts once, however many juries share it. calls: call_id, model, tokens_in, tokens_out."""
    return calls.dropDuplicates(["call_id"]).groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def judged_first(findings: DataFrame, limit: int = 40) -> DataFrame:
    """The findings of each repository within its budget of judgements, in finding order."""
    by = W.partitionBy("repo").orderBy("file", "line", "name")
    return findings.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= limit).drop("i")


def stopped(calls: DataFrame, failures: int = 2) -> DataFrame:
    """calls (repo, i, ok) with asked: false for all that come after so many failures in a row, as a model that is out of reach isn't asked again.

    Failures in a row are an island: their number in the order less their number among failures is the same. The first place where an island is long enough is the cut.
    """
    order = W.partitionBy("repo").orderBy("i")
    among = W.partitionBy("repo", "ok").orderBy("i")
    c = calls.withColumn("island", F.row_number().over(order) - F.row_number().over(among))
    c = c.withColumn("length", F.when(~F.col("ok"), F.row_number().over(W.partitionBy("repo", "ok", "island").orderBy("i"))))
    cut = c.filter(F.col("length") >= failures).groupBy("repo").agg(F.min("i").alias("cut"))
    return calls.join(cut, "repo", "left").withColumn("asked", F.coalesce(F.col("i") <= F.col("cut"), F.lit(True))).drop("cut")


def judged_in_order(findings: DataFrame, answers: DataFrame, limit: int = 40, failures: int = 2) -> DataFrame:
    """findings with final and note: each repository's units are judged in finding order, within a budget and until the model fails so often in a row.

    Copies keep their verdict and cost nothing. answers: repo, file, line, name, decision (null if the call failed). What isn't judged keeps what the graph proved: removals
    go, the rest stays.
    """
    key = ["repo", "file", "line", "name"]
    asked = findings.filter("verdict <> 'SIMPLIFY'").withColumn("i", F.row_number().over(W.partitionBy("repo").orderBy("file", "line", "name")))
    tried = asked.filter(F.col("i") <= limit).join(answers, key, "left")
    cut = stopped(tried.select("repo", "i", F.col("decision").isNotNull().alias("ok")), failures).filter("asked").groupBy("repo").agg(F.max("i").alias("last"), F.count("*").alias("n"))
    whole = tried.groupBy("repo").agg(F.count("*").alias("budgeted"))
    f = findings.join(asked.select(*key, "i"), key, "left").join(cut.drop("n"), "repo", "left").join(whole, "repo", "left").join(answers, key, "left")
    given_up = (F.col("i") > F.col("last")) & (F.col("last") < F.col("budgeted"))
    # failing at the very end of the budget stops the model as well
    ended = tried.select("repo", "i", F.col("decision").isNotNull().alias("ok")).withColumn("back", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("i")))).filter(F.col("back") <= failures).groupBy("repo").agg((F.count_if("ok") == 0).alias("dead"), F.count("*").alias("m")).select("repo", (F.col("dead") & (F.col("m") == failures)).alias("dead"))
    f = f.join(ended, "repo", "left")
    given_up = given_up | (F.col("dead") & (F.col("i") > limit))
    default = F.when(F.col("verdict") == "REMOVE", "REMOVE").otherwise("KEEP")
    judged = (F.col("i") <= limit) & ~given_up
    final = F.when(F.col("i").isNull(), F.col("verdict")).when(judged & F.col("decision").isNotNull(), F.col("decision")).otherwise(default)
    note = F.when(given_up, "not judged: the model failed several times in a row").when((F.col("i") > limit) & (F.col("verdict") == "AMBIGUOUS"), "not judged: the budget is used up").when(judged & F.col("decision").isNull(), "not judged: the call failed")
    return f.withColumn("final", final).withColumn("note", note).drop("i", "last", "budgeted", "decision", "dead")


def provable(findings: DataFrame, loaded: DataFrame | None, isolate: int = L.ISOLATE) -> DataFrame:
    """Findings that a test run can settle, with why not for the others: removed code not in test files, in files that the tests load. loaded: repo, rel."""
    out = findings.withColumn("rel", F.col("file"))
    hit = out.join(loaded.select("repo", "rel").distinct().withColumn("seen", F.lit(True)), ["repo", "rel"], "left") if loaded is not None else out.withColumn("seen", F.lit(True))
    why = F.when(F.col("final") != "REMOVE", "not a removal").when(S.is_test_path(F.col("rel")) & (F.col("kind") != "import"), "not provable (test code)").when(F.col("seen").isNull(), "not provable (no test loads the file)")
    return hit.withColumn("why_not", why).drop("seen", "rel")


def proof_outcomes(proofs: DataFrame) -> DataFrame:
    """outcome, n: outcomes by what stands before the colon."""
    return proofs.groupBy(F.regexp_extract("proof", "^([^:]*)", 1).alias("outcome")).agg(F.count("*").alias("n"))


def outermost_spans(spans: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """repo, rel, start, end: spans merged where they nest or overlap. spans: repo, rel, start, end (lines, inclusive).

    Files are dealt to as many tasks as it takes for some `rows` spans each: rows that compress well would else be put together into few tasks,
    which sort, run over and group all of them in memory. The spans of one file stay in one task.
    """
    tasks = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-spans.count() // rows))
    key = ["key", "repo", "rel"]
    spans = spans.withColumn("key", F.xxhash64("repo", "rel")).repartition(tasks, "key")  # one column, as a constant repo would be folded and the rows dealt again
    by = W.partitionBy(*key).orderBy("start", F.desc("end"))
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    return runs.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("key", "run")
