"""Operators on pairs, groups and archives against plain versions of their contracts."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import _shared as S
from corvane.llm import decontaminate, line_dedup, near_dedup, repeats, warc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, hits string, u long, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", s, len(t or ""), 1, "x", 2, "x") for i, t, s in rows], SCHEMA)


def prose(r, n):
    return [r.choice("ab") + "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6))) for _ in range(n)]


# --- near duplicates


def plain_components(rows, size=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus():
    r = random.Random(4)
    texts = []
    for _ in range(12):
        base = prose(r, r.randrange(20, 300))
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = "zz" + str(r.randrange(99))
            texts.append(" ".join(w))
            texts += [texts[-1].upper()] * r.randrange(0, 2)
    texts += ["", None, "  \n", "one two", "ONE\ttwo", "one two three four", "é É", "é é", "x " * 4000]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_are_all_found(spark):
    rows = near_corpus()
    got = {x.doc_id: x for x in near_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    want = plain_components(rows)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_near_duplicates_in_small_blocks_and_buckets(spark):
    """A family over several blocks, and buckets over their size, lose no link."""
    r = random.Random(9)
    base = prose(r, 120)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i // 6):
            w[r.randrange(len(w))] = f"q{i}"
        rows.append((i, " ".join(w)))
    p = near_dedup.MinHash(bucket=8, block_texts=16)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), params=p).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows).items()}


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    twice = near_dedup.near_duplicates(frame(spark, [(7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "solo text of its own here", "s")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in twice) == [(-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True)]


def test_estimates_are_corrected():
    p, r = near_dedup.MinHash(), np.random.default_rng(1)
    a, b = p.coefficients()
    for share in (0.0, 0.5, 0.75, 1.0):
        x = r.integers(0, 2**63, 2000).astype(np.uint64)
        y = np.concatenate([x[: int(2000 * share)], r.integers(0, 2**63, 2000 - int(2000 * share)).astype(np.uint64)])
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        s = near_dedup.packed(np.stack([near_dedup.minima(x, a, b), near_dedup.minima(y, a, b)]), p)
        assert abs(near_dedup.estimates(s[0], s[1:], p)[0] - true) < 0.17


# --- repeated passages


def plain_repeats(texts, size=200):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for b in data:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    gone = []
    for b in data:
        g = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                g[i : i + size] = True
        gone.append(g)
    return data, gone


def repeat_corpus():
    r = random.Random(3)
    passages = [" ".join(prose(r, n)) for n in (40, 60, 90, 200)] + ["é漢" * 120, "a" * 450]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += [" ".join(prose(r, r.randrange(1, 80))), r.choice(passages)[r.randrange(0, 30) :]]
        texts.append("".join(parts[: r.randrange(1, len(parts) + 1)]))
    return texts + [texts[0], "", None, "short", "b" * 199, "c" * 200, "d" * 201, "e" * 900]


def check_repeats(spark, texts, params, run=None):
    rows = repeats.remove_repeats(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), params=params).collect()
    data, gone = plain_repeats(texts)
    assert len(rows) == len(texts)
    for x in rows:
        b, g = data[x.doc_id], gone[x.doc_id]
        assert x.n_bytes == len(b) and bytes(x.kept) == np.frombuffer(b, np.uint8)[~g].tobytes(), x.doc_id
        assert sum(s.end - s.start for s in x.spans) == g.sum()


def test_repeats_are_exact(spark):
    check_repeats(spark, repeat_corpus(), repeats.Repeats())


def test_repeats_in_short_runs_small_merges_and_large_groups(spark):
    check_repeats(spark, repeat_corpus(), repeats.Repeats(run=300, rows=2000, group=3))


def test_repeats_of_rows_without_ids_of_their_own(spark):
    t = " ".join(prose(random.Random(1), 80))
    rows = repeats.remove_repeats(frame(spark, [(1, t, "s"), (1, t, "s"), (None, "zz " + t, "s"), (2, "apart", "s")])).collect()
    assert sorted((x.doc_id or -1, len(x.kept)) for x in rows) == [(-1, 3), (1, 0), (1, 0), (2, 5)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_merged_transforms_agree_with_sorting():
    r = random.Random(8)
    segs = [bytes(r.choice(b"ab") for _ in range(r.randrange(40, 90))) for _ in range(30)]
    p = repeats.Repeats(length=20, block=5)
    for shards in (1, 2, 3, 8, 30):
        times = [r.choice([1, 1, 2, 5]) for _ in segs] if shards > 2 else [1] * len(segs)
        seen = Counter()
        for s, n in zip(segs, times, strict=True):
            for i in range(len(s) - 19):
                seen[s[i : i + 20]] += n
        got = repeats.repeated(segs, p, [i % shards for i in range(len(segs))], times)
        assert [x.tolist() for x in got] == [[seen[s[i : i + 20]] > 1 for i in range(len(s) - 19)] for s in segs]


def test_merged_transforms_know_common_prefixes():
    """Neighbours' common prefixes and the order of three shards are those of sorted sequences."""
    r = random.Random(1)
    words = [[r.randrange(1, 4) for _ in range(r.randrange(3, 9))] for _ in range(24)]
    size = [len(w) + 1 for w in words]
    base = np.cumsum(size) - size
    names = np.array([x for w in words for x in [*w, 0]])
    at = np.arange(len(names))
    owner = np.repeat(np.arange(len(words)), size)
    last = base[owner] + np.array(size)[owner] - 1
    after = np.where(at == last, base[owner], at + 1)
    prior = np.where(at == base[owner], last, at - 1)
    depth = 6
    shards = [repeats.Transform.of(names, after, prior, at[owner % 3 == s], depth) for s in range(3)]
    merged, _ = shards[0].merge(shards[1], depth)
    merged, shared = merged.merge(shards[2], depth)

    def head(x):
        out = []
        for _ in range(depth):
            out.append(int(names[x]))
            x = after[x]
        return out

    heads = [head(x) for x in merged.place]
    assert heads == sorted(heads) and sorted(merged.place.tolist()) == at.tolist()
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), depth)
    assert shared.tolist() == [0] + [common(a, b) for a, b in zip(heads, heads[1:])]


# --- archives


@pytest.mark.parametrize("broadcast_bytes", [10**8, 0])
def test_archives_round_trip(spark, broadcast_bytes):
    pages = [(3, "http://a/b c", "same", 1), (1, "http://x/", "same", 1), (9, "http://x/2", "same", 1), (4, None, None, 1), (5, "http://e/", "", 1), (6, "http://n/", "a\r\n\r\nWARC/1.1\r\né😀", 1), (7, "http://n/", "x" * 300_000, 1), (1, "http://x/", "same", 1), (None, "http://q/", "same", 1), (9, "http://x/2", "other", 1), (None, "u", "alone", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type int")
    path = S.scratch_path(spark, "warc-test")
    warc.write_warc(warc.resolve_revisits(df, broadcast_bytes=broadcast_bytes), path, file_bytes=600)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == len(pages)
    by = {}
    for x in rows:
        by.setdefault((x.page_id, x.payload_digest), []).append(x)
    for i, _, html, _ in pages:
        data = (html or "").encode()
        found = by[i, base64.b32encode(hashlib.sha1(data).digest()).decode()]
        for x in found:
            assert x.payload_bytes == len(data)
            assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == data
    kinds = lambda i, html: [(x.record_type, x.refers_to) for x in by[i, base64.b32encode(hashlib.sha1(html).digest()).decode()]]
    assert kinds(3, b"same") + kinds(9, b"same") + kinds(None, b"same") == [("revisit", 1)] * 3 and kinds(5, b"") == [("revisit", 4)]
    assert kinds(1, b"same") + kinds(4, b"") + kinds(9, b"other") + kinds(None, b"alone") == [("response", None)] * 5
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(files) > 2 and sum(f.count(b"\x1f\x8b\x08") for f in files) >= len(pages)
    for f in files:  # each record is a member: decompressing one member gives one whole record
        while f:
            d = zlib.decompressobj(31)
            head = d.decompress(f)
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.endswith(b"\r\n\r\n") and b"WARC-Record-ID: <urn:uuid:" in head
            assert (b"WARC-Refers-To-Date: " in head) == (b"WARC-Type: revisit" in head)
            f = d.unused_data
    assert warc.resolve_revisits(df, min_payload=5, broadcast_bytes=broadcast_bytes).filter("record_type = 'revisit'").count() == 0
    empty = S.scratch_path(spark, "warc-empty")
    warc.write_warc(warc.resolve_revisits(df.limit(0), broadcast_bytes=broadcast_bytes), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_long_records_close_their_archives():
    long = "WARC/1.1\r\nContent-Length: 17000000\r\n\r\n" + "x" * 17_000_000 + "\r\n\r\n"
    batches = [pa.RecordBatch.from_arrays([pa.array([long, long])], names=["record"])]
    out = [bytes(b.column(0)[0].as_py()) + b"\0" for b in warc._archives(10)(batches)]
    assert len(out) == 2 and all([len(block) for _, block in warc.parse_records(gzip.open(io.BytesIO(f)))] == [17_000_000] for f in out)


# --- decontamination


def plain_hits(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    named |= grams[g]
        out.append((len(w), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize(("set_size", "slice_size"), [(100_000, 1), (2, 1000), (2, 40)])
def test_contamination(spark, monkeypatch, set_size, slice_size):
    monkeypatch.setattr(decontaminate, "SLICE", slice_size)
    r = random.Random(6)
    items = [(i, " ".join(prose(r, r.choice([1, 3, 9, 10, 11, 30]))).title()) for i in range(20)] + [(20, ""), (21, None), (11, "É ÀB cd'ef"), (4, "k2 K2 k2")]
    texts = ["", None, "no hits, here!"] + [" ".join(prose(r, 40) + re.split(r"\W", r.choice(items[:20])[1]) + prose(r, 20)) for _ in range(30)] + ["É - àB... cd ef", "É ÀB cd ef", "K2,k2;k2 k2"]
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items] * 2, "item_id long, text string, w int, h string")
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {x.doc_id: x for x in decontaminate.contamination(docs, bench, set_size=set_size).collect()}
    want = plain_hits(texts, items)
    assert [(got[i].n_words, got[i].n_hit, got[i].item_ids) for i in range(len(texts))] == want
    assert all(sum(s.last - s["first"] + 1 for s in x.spans) == x.n_hit for x in got.values())
    clean = decontaminate.drop_contaminated(docs, bench, set_size=set_size)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {i for i, w in enumerate(want) if not w[1]}
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    cut = {x.doc_id: x.text for x in decontaminate.remove_spans(docs, bench, set_size=set_size).collect()}
    assert cut[2] == texts[2] and len(cut[3].split()) == want[3][0] - want[3][1]


# --- lines


@pytest.mark.parametrize("broadcast_bytes", [10**8, -1])
def test_lines(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast_bytes)
    r = random.Random(2)
    rows = []
    for i in range(90):
        site = r.choice(["a", "b", None])
        lines = [" ".join(prose(r, 4)) for _ in range(r.randrange(0, 4))] + ["", "menu " + str(site), "rare"][: r.randrange(0, 4)]
        rows.append((i, "\n".join(lines) if i else None, site))
    rows.append((100, "menu a\nmenu a", "lonely"))
    docs, total, often = frame(spark, rows), Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        often.update({(s, x) for x in (t or "").split("\n") if x.strip()})
    gone = {k for k, n in often.items() if n >= 2 and n > 0.3 * total[k[0]]}
    assert gone
    out = line_dedup.drop_boilerplate(docs, ratio=0.3)
    got = {x.doc_id: x.text for x in out.collect()}
    assert out.columns == docs.columns and len(got) == len(rows)
    for i, t, s in rows:
        assert got[i] == (None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in gone))
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([("a", ["m", "x" * 400_000], 1, 2, 3), ("a", ["m"], 4, 5, 6), ("a", None, 7, 8, 9)], "site string, lines array<string>, _site int, keys int, page int")
    marked = line_dedup.mark_lines(odd)
    assert marked.columns == [*odd.columns, "kept", "dropped"]
    assert sorted((x["_site"], x["keys"], x["page"], [len(y) for y in x["kept"]], x["dropped"]) for x in marked.collect()) == [(1, 2, 3, [400_000], ["m"]), (4, 5, 6, [], ["m"]), (7, 8, 9, [], [])]
    urls = spark.createDataFrame([("http://User@Ex.com:80/a",), ("nothing",), (None,), ("https://b.org?x",)], "u string")
    assert [x[0] for x in urls.select(line_dedup.host_of(F.col("u"))).collect()] == ["ex.com", None, None, "b.org"]
    assert [x[0] for x in spark.createDataFrame([("<p>a<b>c</b>\n d <!-- x<p>y --><script>z</script>",)], "h string").select(line_dedup.html_lines(F.col("h"))).collect()] == [["a", "c", "d"]]


def test_the_ratio_decides_at_small_sites(spark):
    rows = [(i, f"menu\nown {i}", "small") for i in range(4)] + [(9, "menu\nown", "single")]
    rows += [(100 + i, "pair" if i < 2 else f"text {i}", "middle") for i in range(40)] + [(200 + i, "three" if i < 3 else f"text {i}", "larger") for i in range(40)]
    got = {x.doc_id: x.text for x in line_dedup.drop_boilerplate(frame(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == [f"own {i}" for i in range(4)] and got[9] == "menu\nown"
    assert got[100] == "pair" and got[200] == "" and got[203] == "text 3"


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = S.materialise(stage(spark, docs, SF), name.replace(" ", "-"))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and after
        if not last:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name.startswith("MinHash"):
            assert set(after) == {i for i, (_, c) in plain_components(sorted(before.items())).items() if i == c}
        if name.startswith("benchmark"):
            assert set(after) == {i for (i, t), h in zip(before.items(), plain_hits(before.values(), bench)) if not h[1]}
        if last:
            assert all(r.decoded_sha256 == hashlib.sha256(before[i].encode()).hexdigest() for i, r in after.items())


def test_near_dedup_stage_with_null_and_repeated_ids(spark):
    r = random.Random(6)
    a, b, c, d, e = (" ".join(prose(r, 60)) for _ in range(5))
    rows = [(1, a, "s"), (None, a, "s"), (2, a + " end", "s"), (None, b, "s"), (None, b, "s"), (None, None, "s"), (None, "", "s"), (7, c, "s"), (7, c, "s"), (3, d, "s"), (5, d, "s"), (5, e, "s")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    want = Counter([(1, a), (None, b), (None, b), (None, None), (None, ""), (7, c), (7, c), (5, e)] + [(3, d)])
    assert out.columns == docs.columns and Counter((x.doc_id, x.text) for x in out.collect()) == want
    flags = Counter(x.kept for x in near_dedup.near_duplicates(docs).collect())
    assert flags == Counter({True: 9, False: 3})
