"""Benchmark decontamination in DataFrame functions only.

Benchmark items become windows of consecutive normalised words. The set of the windows' hashes is checked for its size
and goes to every task: as one literal set, or as a broadcast table, in slices where it is larger than the bound of one. A
document's words are hashed once, hashes of runs are made of hashes of shorter runs, each run is looked up where it is,
and only hits are compared with the windows' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S

WINDOW = 10
#: Benchmarks of up to so many windows are looked up in a literal set in each task, larger ones in broadcast tables of so many windows each.
SET_SIZE = 100_000
SLICE = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = "array<struct<at:int,size:int,words:string>>"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of ASCII letters and digits and anything beyond ASCII. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(plain, _BETWEEN), "")


def _run_hashes(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds run<n>, the hashes of all runs of n words of column w, for each n of sizes: two shorter runs, which may overlap, make a longer one."""
    need = set(sizes) | {1}
    for n in sorted(sizes, reverse=True):
        while n > 1:
            n = 1 << ((n - 1).bit_length() - 1)
            need.add(n)
    for n in sorted(need):
        if n == 1:
            rows = rows.withColumn("run1", F.transform("w", lambda x: F.xxhash64(x)))
            continue
        half = 1 << ((n - 1).bit_length() - 1)
        left = f"greatest(size(w) - {n - 1}, 0)"
        rows = rows.withColumn(f"run{n}", F.expr(f"zip_with(slice(run{half}, 1, {left}), slice(run{half}, {n - half + 1}, {left}), (a, b) -> xxhash64(a, b))"))
    return rows.drop(*(f"run{n}" for n in need - set(sizes)))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, size, words (joined by a space), h: the distinct windows of each item; one of all its words where it has fewer than a window."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0")
    w = w.withColumn("size", F.least(F.size("w"), F.lit(window)))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))
    w = _run_hashes(w.select("item_id", "size", F.explode(each).alias("w")), list(range(1, window + 1)))
    h = F.coalesce(*(F.when(F.col("size") == n, F.element_at(f"run{n}", 1)) for n in range(1, window + 1)))
    return w.select("item_id", "size", F.array_join("w", " ").alias("words"), h.alias("h")).distinct()


def _hits(rows: DataFrame, grams: DataFrame, set_size: int) -> DataFrame:
    """rows (with w, their words) and a column hits: place, size and words of each benchmark window that occurs."""
    distinct = grams.select("size", "words", "h").distinct()
    counts = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each size up to the window
    none = F.expr(f"cast(array() as {_HITS})")
    if not counts:
        return rows.withColumn("hits", none)
    sizes = sorted(counts)
    shape = lambda x, n: F.struct(x.alias("at"), n.alias("size"), F.array_join(F.slice("w", x + 1, n), " ").alias("words"))
    if sum(counts.values()) > set_size:
        rows = S.materialise(rows.withColumn("row", F.expr("uuid()")), "rows")
        hashed = _run_hashes(rows.select("row", "w"), sizes)
        runs = None
        for n in sizes:
            r = hashed.select("row", F.lit(n).alias("size"), F.posexplode(f"run{n}").alias("at", "h"))
            runs = r if runs is None else runs.unionByName(r)
        known = S.materialise(distinct.select("h", "size").distinct(), "known")
        slices = -(-sum(counts.values()) // SLICE)
        found = None
        for k in range(slices):
            part = known.filter(F.pmod("h", F.lit(slices)) == k) if slices > 1 else known
            f = runs.join(F.broadcast(part), ["h", "size"], "left_semi")
            found = f if found is None else found.unionByName(f)
        found = found.join(rows.select("row", "w"), "row").select("row", shape(F.col("at"), F.col("size")).alias("hit"))
        found = found.join(distinct.select("words"), F.col("hit.words") == F.col("words"), "left_semi")
        return rows.join(found.groupBy("row").agg(F.sort_array(F.collect_list("hit")).alias("hits")), "row", "left").withColumn("hits", F.coalesce("hits", none)).drop("row")
    known = distinct.collect()  # at most set_size windows
    rows = _run_hashes(rows, sizes)
    found = []
    for n in sizes:
        hs = ",".join(sorted({f"{r['h']}L" if r["h"] != -(2**63) else f"({-(2**63) + 1}L - 1L)" for r in known if r["size"] == n}))
        found.append(F.expr(f"filter(transform(run{n}, (h, i) -> if(h in ({hs}), i, -1)), i -> i >= 0)"))
    rows = rows.withColumns({f"at{n}": f for n, f in zip(sizes, found, strict=True)}).drop(*(f"run{n}" for n in sizes))
    # words hold no quote and no backslash, so they stand in SQL as they are
    texts = ",".join("'" + t + "'" for t in sorted({r["words"] for r in known}))
    candidates = F.concat(*(F.expr(f"transform(at{n}, x -> named_struct('at', x, 'size', {n}, 'words', array_join(slice(w, x + 1, {n}), ' ')))") for n in sizes))
    rows = rows.withColumn("hits", F.when(F.expr(" + ".join(f"size(at{n})" for n in sizes)) > 0, candidates).otherwise(none))
    return rows.withColumn("hits", F.when(F.size("hits") > 0, F.expr(f"filter(hits, x -> x.words in ({texts}))")).otherwise(none)).drop(*(f"at{n}" for n in sizes))



_PLACES = "array_sort(array_distinct(flatten(transform(hits, x -> sequence(x.at, x.at + x.size - 1)))))"
#: First and last word of each run of the sorted places `at`.
_SPANS = "zip_with(filter(at, (x, i) -> coalesce(get(at, i - 1) < x - 1, true)), filter(at, (x, i) -> coalesce(get(at, i + 1) > x + 1, true)), (f, l) -> named_struct('first', f, 'last', l))"
#: The words between these runs.
_REST = "flatten(transform(sequence(0, size(spans)), i -> slice(w, coalesce(get(spans, i - 1).last, -1) + 2, coalesce(get(spans, i).first, size(w)) - coalesce(get(spans, i - 1).last, -1) - 1)))"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, set_size: int = SET_SIZE) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, item_ids (sorted as strings), spans (first and last word, from 0, of each run of hit words).

    A document word is hit when it lies in any occurrence of a window of the benchmark. Null or wordless texts have no
    words; null item ids hit words but name no item; repeated items count once; an empty benchmark hits nothing. Each
    row is looked up within itself and whole, however long, so repeated or null ids stay apart; an empty table gives an empty result. Other columns of docs are not read.
    """
    grams = S.materialise(benchmark_windows(benchmark, window=window), "grams")
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    rows = _hits(rows, grams, set_size).select(F.expr("uuid()").alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), "hits")
    rows = S.materialise(rows, "hits")
    items = grams.filter("item_id is not null").select("words", "item_id").distinct()
    if items.count() <= set_size:
        items = F.broadcast(items)
    named = rows.filter("size(hits) > 0").select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["words"]))).alias("words"))
    named = named.join(items, "words").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = rows.join(named, "row", "left").withColumn("at", F.expr(_PLACES))
    return out.select("doc_id", "n_words", F.size("at").cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.expr(_SPANS).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, set_size: int = SET_SIZE) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; their columns stay as they are.

    Null and empty texts stay, rows with null or repeated ids are looked up by themselves, texts of any length are looked
    up whole; an empty benchmark drops nothing and an empty table gives an empty result.
    """
    grams = S.materialise(benchmark_windows(benchmark, window=window), "grams")
    own = [F.col(f"doc.{c}") for c in docs.columns]
    rows = docs.select(F.struct(*docs.columns).alias("doc"), words_of(F.col(text_col)).alias("w"))
    # the filter also reads a random number, always 0 or more, of the same projection: it can't be pushed below it, where it would repeat each step of the lookup
    return _hits(rows, grams, set_size).withColumn("fence", F.rand()).filter("size(hits) = 0 and fence >= 0").select(*own)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, set_size: int = SET_SIZE) -> DataFrame:
    """docs with hit words cut from the text of contaminated rows: what stays is their other words, normalised and joined by a space.

    Clean rows, null and empty texts among them, keep their text; repeated rows are cut alike; an empty table gives an empty result.
    """
    grams = S.materialise(benchmark_windows(benchmark, window=window), "grams")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), words_of(F.col(text_col)).alias("w"))
    rows = _hits(rows, grams, set_size).withColumn("at", F.expr(_PLACES)).withColumn("spans", F.expr(_SPANS))
    rest = F.array_join(F.expr(_REST), " ")
    return rows.select(*(F.when(F.size("hits") > 0, rest).otherwise(F.col(f"doc.{c}")).alias(c) if c == text_col else F.col(f"doc.{c}") for c in docs.columns))
