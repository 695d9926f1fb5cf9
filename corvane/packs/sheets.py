"""The graph of style sheets: what loads which sheet, what comes from elsewhere, which pages a sheet can style."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import usage
from corvane.runtime import store

SHEET = r"\.(css|scss|sass|less|styl|pcss|postcss)$"
PAGE = r"\.(html?|xhtml|php|vue|svelte|jsx|tsx|cshtml|razor|erb|ejs|hbs|njk|twig|j2|jinja2?|md|mdx)$"
# --- fixed values: hosts whose sheets hold fonts only
FONT_HOSTS = ["fonts.googleapis.com", "fonts.bunny.net", "use.typekit.net", "fonts.cdnfonts.com", "api.fontshare.com"]

_FAR = r"^(https?:|//)"


def stem(path):
    """A sheet's name as other files say it: up to the first full stop, without the underscores of a partial."""
    return F.regexp_extract(S.base_name(path), r"^_*([^.]*)", 1)


def loads(files: DataFrame) -> DataFrame:
    """repo, rel, how (link, rule or script), target: each sheet that a file says it loads, as written. files: repo, rel, text."""
    sheet, text = F.col("rel").rlike(SHEET), F.col("text")
    links = F.filter(S.all_matches(text, r"(?i)<link\b[^>]*>"), lambda t: F.lower(t).contains("stylesheet"))
    links = F.transform(links, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    rules = F.when(sheet, S.all_matches(text, r"""@(?:import|use|forward)\s+(?:url\(\s*)?["']([^"']+)["']""", 1)).otherwise(F.array().cast("array<string>"))
    scripts = S.all_matches(text, r"""(?:\bimport\s+(?:[\w*{}\s,$]+?\s+from\s+)?|\brequire\s*\(\s*)["']([^"']+\.(?:css|scss|sass|less))["']""", 1)
    each = lambda how, a: F.transform(a, lambda t: F.struct(F.lit(how).alias("how"), t.alias("target")))
    out = files.select("repo", "rel", F.explode(F.concat(each("link", links), each("rule", rules), each("script", scripts))).alias("l"))
    return out.select("repo", "rel", "l.how", "l.target").filter("target <> ''").distinct()


def edges(files: DataFrame) -> DataFrame:
    """loads with `to`, the sheet of the repository that is meant, null for one from elsewhere: that with the name, nearest by folder."""
    said = store(loads(files), "said")  # read twice below, from texts only once
    sheets = files.filter(F.col("rel").rlike(SHEET)).select("repo", F.col("rel").alias("to"), stem(F.col("rel")).alias("stem"))
    here = ~F.col("target").rlike(_FAR + "|^sass:")
    bare = F.regexp_replace("target", r"[?#].*$", "")
    named = said.filter(here).withColumn("stem", stem(bare)).join(sheets, ["repo", "stem"])
    # a path relative to the file, a path from a root that ends alike, any other of that name
    tail = F.regexp_replace(F.regexp_replace(bare, r"^(\.{0,2}/)+|^[~@]/?", ""), r"\.\w+$|(?<=/|^)_", "")
    plain = F.regexp_replace(F.col("to"), r"\.\w+$|(?<=/|^)_", "")
    alike = F.endswith(plain, tail).cast("int") + (S.folder(F.col("to")) == S.folder(F.col("rel"))).cast("int")
    first = Window.partitionBy("repo", "rel", "how", "target").orderBy(F.desc("alike"), "to")
    named = named.filter("to <> rel").withColumn("alike", alike).withColumn("k", F.row_number().over(first)).filter("k = 1")
    return said.join(named.select("repo", "rel", "how", "target", "to"), ["repo", "rel", "how", "target"], "left")


def external(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """repo, external: the first sheet that a repository loads from elsewhere, fonts aside. known: the edges, if at hand."""
    e = (known if known is not None else edges(files)).withColumn("far", F.col("target").rlike(_FAR))
    package = (F.col("how") == "script") & ~F.col("target").rlike(r"^[./]")
    unknown = (F.col("how") == "rule") & F.col("to").isNull() & ~F.col("target").rlike("^sass:")
    e = e.filter((F.col("far") & (F.col("how") != "script")) | package | unknown)
    fonts = F.exists(F.array(*map(F.lit, FONT_HOSTS)), lambda h: F.contains("target", h))
    return e.filter(~fonts).groupBy("repo").agg(F.min(F.struct("rel", "target")).alias("x")).select("repo", F.col("x.target").alias("external"))


def styled(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """repo, page, sheet: the pages (and files with markup) that load a sheet, directly or through sheets and scripts."""
    e = store((known if known is not None else edges(files)).filter("to is not null").select("repo", F.col("rel").alias("a"), F.col("to").alias("z")), "loads")
    pages = e.filter(F.col("a").rlike(PAGE)).select("repo", F.col("a").alias("start")).distinct()
    return usage.reach(pages, e).select("repo", F.col("start").alias("page"), F.col("node").alias("sheet"))


def published(files: DataFrame) -> DataFrame:
    """repo, rel, package: sheets of a package that other projects install, by the nearest description above them.

    A package.json describes one if it isn't private and lists its files or its sheet, or an .npmignore lies beside it; a bower.json always does.
    """
    base, where = S.base_name(F.col("rel")), S.folder(F.col("rel")).alias("dir")
    word = lambda w: rf"(?<![\w$]){w}(?![\w$])"
    ignores = files.filter(base == ".npmignore").select("repo", where, F.lit(True).alias("ignores")).distinct()
    p = files.filter(base.isin("package.json", "bower.json")).select("repo", where, F.col("rel").alias("by"), "text").join(ignores, ["repo", "dir"], "left")
    open_ = ~F.col("text").rlike(word("private")) & (F.col("text").rlike(word("(style|sass|files|unpkg|jsdelivr)")) | F.col("ignores").isNotNull())
    p = p.withColumn("package", F.when(F.col("by").endswith("bower.json") | open_, F.col("by")))
    p = p.groupBy("repo", "dir").agg(F.min("package").alias("package"))  # bower.json comes first
    parts = F.split(S.folder(F.col("rel")), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    s = files.filter(F.col("rel").rlike(SHEET)).select("repo", "rel", F.explode(F.array_distinct(above)).alias("dir")).join(p, ["repo", "dir"])
    near = s.groupBy("repo", "rel").agg(F.max_by("package", F.length("dir")).alias("package"))
    return near.filter("package is not null")
