"""Copied blocks: significant lines, windows of lines, first-seen windows, merged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import lookups as L
from corvane.functions import scalars as S


def _cut(text: Column) -> tuple[Column, Column]:
    """What a line that starts outside a block comment says, and whether it ends inside one."""
    closed = S.strip(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "))
    at = F.instr(closed, "/*")
    return F.when(at > 0, S.strip(F.substr(closed, F.lit(1), at - 1))).otherwise(closed), at > 0


def _without_blocks(rows: DataFrame) -> DataFrame:
    """rows (repo, rel, ln, text, blocks) without what is inside /* */ comments, followed along the lines of files where `blocks` holds.

    A line either settles the state behind it, keeps it or turns it over. So the state before a line is that behind the
    last line that settled it, turned over as often as lines since then do: two running values, whatever a file's length.
    """
    end = F.instr("text", "*/")
    (plain, opens), (rest, reopens) = _cut(F.col("text")), _cut(S.strip(F.substr(F.col("text"), end + 2)))
    r = rows.select("*", plain.alias("plain"), F.when(end > 0, rest).otherwise("").alias("rest"), opens.alias("opens"), ((end == 0) | reopens).alias("stays"))
    by = W.partitionBy("repo", "rel").orderBy("ln")
    turns = (F.col("opens") & ~F.col("stays")).cast("int")
    r = r.withColumn("turned", F.sum(turns).over(by.rowsBetween(W.unboundedPreceding, 0)))
    settled = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("state"), "turned"))
    r = r.withColumn("last", F.last(settled, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    odd = F.pmod(F.col("turned") - turns - F.coalesce("last.turned", F.lit(0)), F.lit(2)) == 1
    inside = F.coalesce("last.state", F.lit(False)) != odd
    text = F.when(~F.col("blocks"), F.col("text")).when(inside, F.col("rest")).otherwise(F.col("plain"))
    return r.select("repo", "rel", "lang", "ln", text.alias("text"))


def significant_lines(files: DataFrame) -> DataFrame:
    """(repo, rel, pos, ln, text) of each line that carries code, with whitespace squeezed; pos counts from 0 in a file.

    files: repo, rel, lang, text. Blank, comment, punctuation-only and import lines carry none. Block comments
    are followed along the lines of files whose language has them.
    """
    has_blocks = F.col("lang").isin(L.BLOCK_COMMENT_LANGUAGES) & F.contains("text", F.lit("/*"))
    rows = files.select("repo", "rel", "lang", has_blocks.alias("blocks"), F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    rows = _without_blocks(rows.select("repo", "rel", "lang", "blocks", (F.col("i") + 1).alias("ln"), S.strip(F.col("t")).alias("text")))
    marks = S._map({k: "|".join(v) for k, v in L.LINE_COMMENTS.items()})
    own = F.coalesce(F.try_element_at(marks, F.col("lang")), F.lit(""))
    comment = F.exists(F.split(own, r"\|"), lambda m: (m != "") & F.startswith(F.col("text"), m)) | F.startswith("text", F.lit("<!--")) | F.startswith("text", F.lit("*"))
    rows = rows.filter((F.col("text") != "") & ~comment & ~F.col("text").rlike(L.PUNCTUATION_LINE) & ~F.col("text").rlike(L.IMPORT_LINE))
    pos = F.row_number().over(W.partitionBy("repo", "rel").orderBy("ln")) - 1
    return rows.select("repo", "rel", pos.alias("pos"), "ln", S.squeeze(F.col("text")).alias("text"))


def windows(lines: DataFrame, size: int = L.COPY_LINES, chars: int = L.COPY_CHARS) -> DataFrame:
    """(repo, rel, pos, key, n_lines) of each run of size significant lines with at least chars characters; n_lines counts the file's lines."""
    w = W.partitionBy("repo", "rel").orderBy("pos").rowsBetween(0, size - 1)
    rows = lines.select("repo", "rel", "pos", F.collect_list("text").over(w).alias("t"))
    total = F.aggregate("t", F.lit(0), lambda a, x: a + F.length(x))
    return rows.filter((F.size("t") == size) & (total >= chars)).select("repo", "rel", "pos", F.sha2(F.array_join("t", "\n"), 256).alias("key"))


def copy_windows(wins: DataFrame, size: int = L.COPY_LINES) -> DataFrame:
    """Windows whose key was seen before, in order of file and place, with the first place; a window that overlaps its own first isn't a copy."""
    firsts = wins.groupBy("repo", "key").agg(F.min(F.struct("rel", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = wins.join(firsts.drop("n"), ["repo", "key"])
    same = F.col("rel") == F.col("first.rel")
    return both.filter(~(same & (F.col("pos") - F.col("first.pos") < size))).select("repo", "rel", "pos", F.col("first.rel").alias("of_rel"), F.col("first.pos").alias("of_pos"))


def copied_blocks(lines: DataFrame, size: int = L.COPY_LINES, chars: int = L.COPY_CHARS) -> DataFrame:
    """repo, rel, line, end_line, lines, of_rel, of_line: maximal copied blocks, each with the place of its first window's original."""
    lines = lines.select("repo", "rel", "pos", "ln", "text")
    copies = copy_windows(windows(lines, size, chars), size)
    by = W.partitionBy("repo", "rel").orderBy("pos")
    gap = F.coalesce((F.col("pos") > F.lag("pos").over(by) + size).cast("int"), F.lit(1))
    runs = copies.withColumn("new", gap).withColumn("run", F.sum("new").over(by))
    runs = runs.groupBy("repo", "rel", "run").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min_by(F.struct("of_rel", "of_pos"), "pos").alias("o"))
    at = lines.select("repo", "rel", "pos", "ln")
    start = at.select("repo", "rel", F.col("pos").alias("a"), F.col("ln").alias("line"))
    end = at.select("repo", "rel", F.col("pos").alias("e"), F.col("ln").alias("end_line"))
    orig = at.select("repo", F.col("rel").alias("of_rel"), F.col("pos").alias("of_pos"), F.col("ln").alias("of_line"))
    runs = runs.withColumn("e", F.col("b") + size - 1).select("repo", "rel", "a", "e", "o.of_rel", "o.of_pos")
    out = runs.join(start, ["repo", "rel", "a"]).join(end, ["repo", "rel", "e"]).join(orig, ["repo", "of_rel", "of_pos"])
    return out.select("repo", "rel", "line", "end_line", (F.col("end_line") - F.col("line") + 1).alias("lines"), "of_rel", "of_line")


def over_ceiling(files: DataFrame, ceiling: int = L.COPY_CEILING) -> DataFrame:
    """repo, lines: repositories in which audit_copies looks for no copies, as they have more significant lines than the ceiling."""
    lines = significant_lines(files.filter(F.col("lang").isin(L.COPY_LANGUAGES) & ~F.col("generated")))
    return lines.groupBy("repo").agg(F.count("*").alias("lines")).filter(F.col("lines") > ceiling)


def audit_copies(files: DataFrame, ceiling: int | None = L.COPY_CEILING) -> DataFrame:
    """SIMPLIFY findings of a census (repo, rel, lang, text, generated): copy languages only, nothing generated.

    Repositories over the ceiling of significant lines are left out as a whole, as the audit defines it; over_ceiling names them, None lifts it.
    """
    lines = significant_lines(files.filter(F.col("lang").isin(L.COPY_LANGUAGES) & ~F.col("generated")))
    if ceiling is not None:
        small = lines.groupBy("repo").count().filter(F.col("count") <= ceiling).select("repo")
        lines = lines.join(small, "repo", "left_semi")
    b = copied_blocks(lines)
    where = F.concat_ws(":", "of_rel", "of_line")
    return b.select(
        "repo", F.lit("duplicate").alias("kind"), F.col("rel").alias("file"), "line", "end_line", F.concat(F.col("lines").cast("string"), F.lit("-line block")).alias("name"),
        F.lit("SIMPLIFY").alias("verdict"), F.concat(F.lit("the same code is already at "), where).alias("reason"), "lines", F.array(where).alias("evidence"), F.lit("not provable").alias("proof"), F.lit("SIMPLIFY").alias("final"),
    )


def duplicate_bodies(defs: DataFrame, nodes: int = L.BODY_NODES) -> DataFrame:
    """Functions whose normalised body was seen before, with the first: repo, rel, name, line, end_line, of_rel, of_line. defs: repo, rel, name, kind, start, end, body_hash, nodes."""
    some = defs.filter((F.col("kind") == "function") & F.col("body_hash").isNotNull() & (F.col("nodes") >= nodes))
    firsts = some.groupBy("repo", "body_hash").agg(F.min(F.struct("rel", "start", "name")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    both = some.join(firsts, ["repo", "body_hash"]).filter(F.struct("rel", "start", "name") != F.col("f"))
    return both.select("repo", "rel", "name", F.col("start").alias("line"), F.col("end").alias("end_line"), F.col("f.rel").alias("of_rel"), F.col("f.start").alias("of_line"))
