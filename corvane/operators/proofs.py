"""What test runs prove about removals, as bookkeeping on tables: which runs are needed next, and what follows from those recorded.

All repositories go on side by side. A run is one of: `baseline` (nothing removed), `batch` (everything), `single:<n>`,
`together` (all that passed alone), `grow:<n>` (what was certified so far and the n-th). Whoever executes them returns a row
for each; a round asks for all runs that no other of the round depends on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.runtime import store


def numbered(candidates: DataFrame) -> DataFrame:
    """candidates (repo, file, line, kind, name, why_not) with n, their number among those of their repository that can be tried; null for the others."""
    free = F.col("why_not").isNull()
    by = W.partitionBy("repo", free).orderBy("file", "line", "kind", "name")
    return candidates.withColumn("n", F.when(free, F.row_number().over(by)))


def _last_line(output: Column, most: int) -> Column:
    return F.substring(F.element_at(F.split(F.trim(F.regexp_replace(F.coalesce(output, F.lit("")), r"\s+$", "")), "\n"), -1), 1, most)


def state(tried: DataFrame, outcomes: DataFrame, loaded: DataFrame | None = None, isolate: int = L.ISOLATE) -> DataFrame:
    """numbered candidates with what the recorded outcomes say: base, batch, alone, together, grown (true, false, null: no such run yet), and the runs' outputs.

    outcomes: repo, run, ok, output. loaded: repo, rel of the files that the baseline's tests load, where that could be seen; in a
    repository that it names, candidates of other files can't be proved and are numbered no more.
    """
    whole = outcomes.groupBy("repo").agg(*(F.max(F.when(F.col("run") == r, F.col("ok"))).alias(a) for r, a in (("baseline", "base"), ("batch", "batch"), ("together", "together"))))
    each = outcomes.filter("run like '%:%'").select("repo", F.split("run", ":")[0].alias("how"), F.split("run", ":")[1].cast("int").alias("n"), "ok", "output")
    one = lambda how, ok, said: each.filter(F.col("how") == how).select("repo", "n", F.col("ok").alias(ok), F.col("output").alias(said))
    s = tried.join(whole, "repo", "left")
    if loaded is not None:
        seen = loaded.select("repo", F.col("rel").alias("file"), F.lit(True).alias("seen")).distinct()
        s = s.join(loaded.select("repo").distinct().withColumn("watched", F.lit(True)), "repo", "left").join(seen, ["repo", "file"], "left")
        unseen = F.col("base") & F.col("watched") & F.col("seen").isNull() & F.col("why_not").isNull()
        s = numbered(s.withColumn("why_not", F.when(unseen, "not provable (the tests never load this file)").otherwise(F.col("why_not"))).drop("watched", "seen", "n"))
    s = s.join(one("single", "alone", "said"), ["repo", "n"], "left").join(one("grow", "grown", "grown_said"), ["repo", "n"], "left")
    return s.withColumn("isolated", F.col("n") <= isolate)


def next_runs(s: DataFrame) -> DataFrame:
    """repo, run, file, line, kind, name: the runs that a state needs now, a row for each removal in them (null for a baseline, which has none). No rows: all is settled.

    Singles are asked for at once; growth goes on one removal at a time in the order of numbers.
    """
    r = s.groupBy("repo").agg(
        F.max("base").alias("base"), F.max("batch").alias("batch"), F.max("together").alias("together"), F.count("n").alias("todo"), F.count_if(F.col("isolated") & F.col("alone").isNull()).alias("open"),
        F.count_if("alone").alias("alone_ok"), F.min(F.when(F.col("alone") & F.col("grown").isNull(), F.col("n"))).alias("next"),
    )
    failed, none = ~F.col("batch"), F.col("todo") == 0
    step = (
        F.when(F.col("base").isNull(), "baseline").when(~F.col("base") | none, None).when(F.col("batch").isNull(), "batch").when(failed & (F.col("open") > 0), "single")
        .when(failed & (F.col("alone_ok") > 0) & F.col("together").isNull(), "together").when(failed & ~F.col("together") & F.col("next").isNotNull(), "grow")
    )
    r = r.select("repo", step.alias("step"), "next").filter("step is not null")
    rows = s.filter("n is not null").join(r.filter("step <> 'baseline'"), "repo")
    wanted = (
        (F.col("step") == "batch") | ((F.col("step") == "single") & F.col("isolated") & F.col("alone").isNull()) | ((F.col("step") == "together") & F.col("alone"))
        | ((F.col("step") == "grow") & (F.col("grown") | (F.col("n") == F.col("next"))))
    )
    run = F.when(F.col("step") == "single", F.concat(F.lit("single:"), F.col("n").cast("string"))).when(F.col("step") == "grow", F.concat(F.lit("grow:"), F.col("next").cast("string"))).otherwise(F.col("step"))
    made = rows.filter(wanted).select("repo", run.alias("run"), "file", "line", "kind", "name")
    return made.unionByName(r.filter("step = 'baseline'").select("repo", F.col("step").alias("run")), allowMissingColumns=True)


def settled(s: DataFrame) -> DataFrame:
    """Each candidate with its proof: passed, failed with the last line said, not provable or not run and why."""
    proof = (
        F.when(F.col("why_not").isNotNull(), F.col("why_not")).when(~F.col("base"), "not provable (the tests fail before any change)").when(F.col("batch"), "passed").when(~F.col("isolated"), "not run (isolation limit)")
        .when(~F.col("alone"), F.when(F.startswith("said", F.lit("compile error")), F.col("said")).otherwise(F.concat(F.lit("failed: "), _last_line(F.col("said"), 200)))).when(F.col("alone") & F.col("together"), "passed")
        .when(F.col("grown"), "passed").when(~F.col("grown"), F.concat(F.lit("failed together with other removals: "), _last_line(F.col("grown_said"), 160))).otherwise("not run")
    )
    return s.withColumn("proof", proof).select("repo", "file", "line", "kind", "name", "proof")


def summary(s: DataFrame) -> DataFrame:
    """repo, candidates, passed, failed, batch: how the proof of each repository went; failed counts tried removals that didn't pass."""
    done = settled(s).join(s.select("repo", "file", "line", "kind", "name", "n", "base", "batch"), ["repo", "file", "line", "kind", "name"])
    out = done.groupBy("repo").agg(F.count("*").alias("candidates"), F.count_if(F.col("proof") == "passed").alias("passed"), F.count_if(F.col("n").isNotNull() & (F.col("proof") != "passed")).alias("not_passed"), F.count("n").alias("todo"), F.max("base").alias("base"), F.max("batch").alias("whole"))
    how = F.when(~F.col("base"), "baseline failed").when(F.col("todo") == 0, "nothing the tests can prove").when(F.col("whole"), "passed").otherwise("failed: each removal was isolated")
    return out.select("repo", "candidates", "passed", F.when(F.col("base"), F.col("not_passed")).otherwise(0).alias("failed"), how.alias("batch"))


def counted(got: DataFrame, outcomes: DataFrame) -> DataFrame:
    """got with ok false where fewer tests passed, or more were skipped, than in the repository's baseline."""
    base = outcomes.filter("run = 'baseline'").select("repo", F.col("output").alias("before"))
    fewer = F.col("ok") & F.coalesce(S.fewer_tests(F.col("before"), F.col("output")), F.lit(False))
    g = got.join(base, "repo", "left")
    return g.select("repo", "run", (F.col("ok") & ~fewer).alias("ok"), F.when(fewer, "fewer tests passed than before any change, or more were skipped").otherwise(F.col("output")).alias("output"))


def prove(candidates: DataFrame, execute: Callable[[DataFrame], DataFrame], loaded: DataFrame | None = None, isolate: int = L.ISOLATE) -> DataFrame:
    """The settled state after as many rounds as it takes: execute gets the runs of a round (as next_runs gives them) and returns repo, run, ok, output.

    Outcomes are written after each round, so a round that is lost is asked for again. There are at most isolate + 4 rounds, whatever the number of repositories.
    """
    spark = candidates.sparkSession
    tried = store(numbered(candidates), "candidates")
    outcomes = spark.createDataFrame([], "repo string, run string, ok boolean, output string")
    while True:
        s = state(tried, outcomes, loaded, isolate)
        if (runs := store(next_runs(s), "runs")).isEmpty():
            return store(s, "proofs")
        got = execute(runs).select("repo", "run", "ok", "output")
        outcomes = store(outcomes.unionByName(counted(got, outcomes)), "outcomes")
