"""The corpus pipeline: each stage applies one operator to all that the stage before it kept.

Every stage but the last returns the columns of documents; run() writes what a stage returns and reads it again for
the next. Further columns of documents are carried along whatever their names, but for the last stage, which returns its own. SQL can't express the fitted classifier, so run() has no oracle; tests hold it against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from corvane.llm._shared import materialise
from corvane.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.7 or more go; all other rows stay as they are.

    Null and empty texts score as texts on which no voter fires and stay. Rows with null or repeated ids are scored each by its
    own text, ties at the threshold go, an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over one in twenty documents of a source, and at least two, share go; n_chars follows the text.

    Documents stay, even empty ones; a null text stays null and its n_chars becomes null. A null source is a source, repeated rows
    are documents of their own, texts of any length are read whole, an empty table stays empty.
    """
    return line_dedup.drop_boilerplate(docs, "source", "text").withColumn("n_chars", F.length("text").cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Exactly the rows that aren't kept go. Id and text decide on a row, so rows are found again by both: ids may be null
    or repeat. A row without id stays unless one with an id has the same words; null and wordless texts link with nothing
    and stay; equal rows of one id stay together; an empty table stays empty.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", F.xxhash64("text").alias("row"))
    kept = near_dedup.near_duplicates(keyed, row_col="row").filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row")).distinct()
    same = (F.col("row") == F.col("kept_row")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return keyed.join(kept.hint("merge"), same, "left_semi").select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; null and empty texts stay, rows with null or repeated ids are looked up each by itself, an empty table stays empty."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and decoded_sha256, of the text that the ids give back.

    A row for each row, null and repeated ids too; a null text counts as empty; an empty table gives an empty result.
    """
    e = bpe.encode_and_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return e.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
