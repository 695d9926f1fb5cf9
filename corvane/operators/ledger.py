"""The ledger: append-only runs, verdicts and file hashes, partitioned by repository, and what earlier runs tell a new one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "runs": "run_id long, started timestamp, files long, lines long, dead_units long, dead_lines long, jlr double, ai_dead_per_1000 double, human_dead_per_1000 double, model string, proof string, metrics string, repo string",
    "verdicts": "run_id long, kind string, file string, line int, end_line int, name string, verdict string, final string, proof string, authored_by string, reason string, judgement string, repo string",
    "file_hashes": "run_id long, rel string, sha string, repo string",
}


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        """A table of the ledger; empty before the first run."""
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def record(self, runs: DataFrame, verdicts: DataFrame, hashes: DataFrame) -> int:
        """Appends one run of any number of repositories under the next id. Hashes and verdicts are written before the run's row, which makes them count. One writer at a time: two would take the same id."""
        last = self.table("runs").agg(F.max("run_id").alias("n")).first()["n"]
        run_id = (last or 0) + 1
        for name, df in (("file_hashes", hashes), ("verdicts", verdicts), ("runs", runs)):
            fields = [f.split()[0] for f in TABLES[name].split(", ")]
            have = df.withColumn("run_id", F.lit(run_id))
            cols = [F.col(c) if c in have.columns else F.lit(None).alias(c) for c in fields]
            types = dict(x.split() for x in TABLES[name].split(", "))
            have.select(*(c.cast(types[f]).alias(f) for c, f in zip(cols, fields, strict=True))).write.mode("append").partitionBy("repo").parquet(f"{self.path}/{name}")
        return run_id

    def last_runs(self) -> DataFrame:
        return self.table("runs").groupBy("repo").agg(F.max("run_id").alias("run_id"))

    def last_hashes(self) -> DataFrame:
        return self.table("file_hashes").join(self.last_runs(), ["repo", "run_id"], "left_semi").select("repo", "rel", "sha")

    def changed(self, hashes: DataFrame) -> DataFrame:
        """Files that are new or changed since their repository's last run."""
        return hashes.join(self.last_hashes(), ["repo", "rel", "sha"], "left_anti")

    def reusable(self, findings: DataFrame, hashes: DataFrame) -> DataFrame:
        """findings with the last run's judgement and final verdict where kind, file, line and name are the same and the file hasn't changed."""
        last = self.table("verdicts").join(self.last_runs(), ["repo", "run_id"], "left_semi").filter("judgement is not null")
        same = self.last_hashes().join(hashes, ["repo", "rel", "sha"], "left_semi").select("repo", F.col("rel").alias("file"))
        key = ["repo", "kind", "file", "line", "name"]
        old = last.join(same, ["repo", "file"], "left_semi").select(*key, F.col("final").alias("last_final"), F.col("judgement").alias("last_judgement")).dropDuplicates(key)
        return findings.join(old, key, "left")

    def history(self, repo: str, limit: int = 30) -> DataFrame:
        """The last runs of a repository, oldest first."""
        return self.table("runs").filter(F.col("repo") == repo).orderBy(F.desc("run_id")).limit(limit).orderBy("run_id")

    def histories(self, limit: int = 30) -> DataFrame:
        """The last runs of every repository."""
        newest = Window.partitionBy("repo").orderBy(F.desc("run_id"))
        return self.table("runs").withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= limit).drop("k")
