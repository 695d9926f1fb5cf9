"""Boilerplate lines by their frequency within a site, in DataFrame functions only.

A line is boilerplate at a site when the share of the site's pages that hold it exceeds a ratio. Counts are by site
and line hash with partial sums before the shuffle. Lines over the ratio are few at any site - at most the mean
number of lines of its pages divided by the ratio - so each site's list is small however many pages the site has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

#: Lists of boilerplate lines of up to so many bytes in all are broadcast; beyond, pages are joined with them by site.
BROADCAST_BYTES = 32_000_000
#: The lines of a site, and beyond BROADCAST_BYTES its pages, are dealt to so many tasks, as one site may have a third of all.
_SALTS = 16


def host_of(url: Column) -> Column:
    """The host of a url, lower-cased, without user and port; null if it has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def html_lines(html: Column) -> Column:
    """The text of a page as lines: one for each run of text between tags; comments, scripts and styles are no text."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "\n")
    return F.filter(F.transform(F.split(bare, r"<[^>]*>|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line, F.length(line)).alias("b"))


def boilerplate(pages: DataFrame, site: str = "site", lines: str = "lines", ratio: float = 0.05) -> DataFrame:
    """site, n_pages, keys: of each site with boilerplate, its number of pages and the keys of its boilerplate lines.

    pages: rows with a site and an array of lines. A line counts once a page. It is boilerplate when more than ratio of the
    site's pages hold it and it is on another page too: a line of one page repeats nothing. Blank lines never are. Pages
    without a site are a site. Lines are told apart by 96 bits of hashes, not by their text.
    """
    each = pages.select(F.col(site).alias("site"), F.explode(F.array_distinct(F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))), _key))).alias("key"))
    often = each.groupBy("site", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("salt", F.pmod(F.col("key.a"), F.lit(_SALTS)).cast("int"))
    total = pages.groupBy(F.col(site).alias("all_site")).agg(F.count("*").alias("n_pages")).withColumn("all_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    same = F.col("site").eqNullSafe(F.col("all_site")) & (F.col("salt") == F.col("all_salt"))
    over = often.join(total, same).filter(F.col("n") > ratio * F.col("n_pages"))
    return over.groupBy("site").agg(F.max("n_pages").alias("n_pages"), F.sort_array(F.collect_list("key")).alias("keys"))


def mark_lines(pages: DataFrame, site: str = "site", lines: str = "lines", ratio: float = 0.05) -> DataFrame:
    """pages with two more columns: kept (the lines that stay, in order) and dropped (those that go).

    Empty line arrays stay empty and a null array counts as one; lines may be of any length. Repeated rows are pages of
    their own. Columns other than the two named are carried along whatever their names; `kept` and `dropped` take the
    place of columns of those names. An empty table gives an empty result.
    """
    lists = S.materialise(boilerplate(pages, site, lines, ratio), "boilerplate")
    size = lists.agg(F.coalesce(F.sum(16 * F.size("keys") + 32 + F.coalesce(F.octet_length("site"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    own, at = _free("site", pages.columns), _free("keys", pages.columns)
    lists = lists.select(F.col("site").alias(own), F.col("keys").alias(at))
    if size <= BROADCAST_BYTES:
        out = pages.join(F.broadcast(lists), F.col(site).eqNullSafe(F.col(own)), "left")
    else:
        salt, other = _free("salt", [*pages.columns, own, at]), _free("other_salt", [*pages.columns, own, at])
        dealt = pages.withColumn(salt, (F.monotonically_increasing_id() % _SALTS).cast("int"))
        copies = lists.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        out = dealt.join(copies, F.col(site).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(other)), "left").drop(salt, other)
    none = F.array().cast("array<string>")
    all_lines = F.coalesce(F.col(lines), none)
    gone = F.coalesce(F.col(at), F.array().cast("array<struct<a:bigint,b:int>>"))
    kept = F.when(F.size(gone) == 0, all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains(gone, _key(x))))
    dropped = F.when(F.size(gone) == 0, none).otherwise(F.filter(all_lines, lambda x: F.array_contains(gone, _key(x))))
    return out.withColumns({"kept": kept, "dropped": dropped}).drop(own, at)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = 0.05) -> DataFrame:
    """docs with boilerplate lines taken from the text, line ends as they were. Columns and rows stay as they are.

    A null text stays null and an empty one empty; texts of any length are taken whole; null sites are one site; repeated
    rows are documents of their own; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(site).alias("site"), F.split(F.col(text), "\n", -1).alias("lines"))
    rest = mark_lines(rows, "site", "lines", ratio)
    new = F.when(F.size("dropped") == 0, F.col(f"doc.{text}")).otherwise(F.array_join("kept", "\n"))
    return rest.select(*(new.alias(c) if c == text else F.col(f"doc.{c}") for c in docs.columns))
