"""The registered queries on tables with nulls, empty and very long texts, repeated rows and columns of clashing names, against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import plain_components, plain_hits, plain_repeats, prose
from test_text_operators import plain_quality

from corvane.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string, site string, keys int, _row int, label string, h string, spans string, id string"
PAGES = "page_id long, url string, html string, lines string, host string, page string, refers_to string, kept string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def documents():
    r = random.Random(12)
    base = [" ".join(prose(r, r.randrange(30, 150))) for _ in range(14)]
    texts = base + [base[0], base[1] + " end", base[2].upper(), "", None, " \n\t", "one two three", "#$% " * 40, "\n".join(["menu", base[3], "menu"]), "\n".join(["menu", base[4]])]
    texts += [f"see token = \"{r.getrandbits(160):040x}\" {base[5]}", "AKIA" + "AB12CD34EF56GH78 and password: hunter2hunter2", base[6][:300] + " é漢😀 " + base[7][:260]]
    texts += [" ".join(prose(r, 60_000)), base[8] + " you idiot trash moron", "tail " + base[9]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tables"), random.Random(13)
    docs = documents()
    docs += [docs[5]]  # a repeated row
    spark.createDataFrame([(i, t, "x", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, "x", "x", 1, 1, "x", "x", "x", "x") for i, t in docs], DOCS).write.parquet(f"{root}/documents.parquet")
    items = [(1, " ".join(documents()[4][1].split()[3:15])), (2, ""), (3, None), (4, "Tail"), (4, "Tail")]
    spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, h string, size int").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in (28, 30)), "x") for i, _ in docs[:-1] if i % 2 == 0], "doc_id long, quality int, toxic int, text string").write.parquet(f"{root}/labels.parquet")
    html = ["<p>nav</p><p>own 1</p>", "<p>nav</p><p>own 2</p>", "<p>nav</p><p>own 1</p>", "", None, "<p>" + "long " * 70_000 + "</p>", "<p>nav</p><p>own 1</p>"]
    pages = [(i, f"http://h{i % 2}.org/{r.randrange(99)}" if i != 3 else None, h, "x", "x", "x", "x", "x") for i, h in enumerate(html)]
    spark.createDataFrame(pages + pages[:1], PAGES).write.parquet(f"{root}/pages.parquet")
    vectors = [(i, [r.gauss(0, 1) for _ in range(6)], i % 3) for i in range(30)] + [(30, None, 1), (31, [float("nan")] * 6, 1), (32, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (None, [0.5] * 6, 1), (33, [0.5] * 6, None)]
    spark.createDataFrame([(*v, "x", "x") for v in vectors + vectors[:1]], "vec_id long, embedding array<float>, label int, x string, leaf string").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def run(spark, folder, name):
    out = {}
    df = queries.QUERIES[name](spark, folder)
    key = df.columns[0]
    for x in df.collect():
        out.setdefault(x[key], []).append(x)
    rows = documents() if key == "doc_id" else list(enumerate(range(7)))
    assert {i: len(v) for i, v in out.items()} == {i: 2 if i == (5 if key == "doc_id" else 0) else 1 for i, _ in rows}
    return {i: v[0] for i, v in out.items()}


def test_op1(spark, folder):
    got = run(spark, folder, "op1_secrets")
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for i, t in documents():
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(assign, t) if m[1].isascii() and len(m[2]) >= 8]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        kinds = ["assign", "access", "hex", "format"]
        text = [f"{k}:{s}:{e}" for k, s, e in sorted(base, key=lambda x: (x[1], kinds.index(x[0])))]
        x = got[i]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b[0] == k for b in base) for k in kinds[:3])
        assert x.base_sha256 == sha(",".join(text))
        spans = [s for s in x.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("format")] == text and len(spans) == len(text) + x.n_format
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), kinds.index(s.split(":")[0])))


def test_op2(spark, folder):
    got, want = run(spark, folder, "op2_minhash"), plain_components(documents())
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_op3(spark, folder):
    got = run(spark, folder, "op3_toxicity")
    for i, x in got.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    assert got[17].score == got[18].score  # empty and null


def test_op4(spark, folder):
    texts = [t for _, t in documents()]
    data, gone = plain_repeats(texts + [texts[5]])
    got = run(spark, folder, "op4_repeats")
    for i, x in got.items():
        g = gone[i].astype(int)
        assert (x.n_bytes, x.n_removed, x.n_spans) == (len(data[i]), g.sum(), (np.diff(np.concatenate([[0], g])) == 1).sum())
        assert x.kept_sha256 == sha(np.frombuffer(data[i], np.uint8)[~gone[i]].tobytes())
    assert got[5].n_removed == len(data[5])


def test_op5(spark, folder):
    got = run(spark, folder, "op5_warc")
    first = {}
    for r in sorted(spark.read.parquet(f"{folder}/pages.parquet").collect(), key=lambda r: r.page_id):
        data = (r.html or "").encode()
        o = first.setdefault(data, r.page_id)
        x = got[r.page_id]
        assert (x.payload_bytes, x.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (x.record_type, x.refers_to) == (("response", None) if o == r.page_id else ("revisit", o))


def test_op6(spark, folder):
    got = run(spark, folder, "op6_quality")
    for i, t in documents():
        x, want = got[i], plain_quality(t or "")
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and x.kept == (not x.base_failed and x.probability >= 0.5)


def test_op7_and_op8(spark, folder):
    import sentencepiece
    from tokenizers import Tokenizer

    lib, sp = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    seven, eight = run(spark, folder, "op7_bpe"), run(spark, folder, "op8_token_counts")
    for i, t in documents():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (seven[i].n_tokens, seven[i].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert seven[i].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))
        n = len(sp.encode(t or ""))
        assert (eight[i].n_bytes, eight[i].n_tokens, eight[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_op9(spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = run(spark, folder, "op9_decontaminate")
    for (i, _), (words, hit, named) in zip(documents(), plain_hits([t for _, t in documents()], items), strict=True):
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (words, hit, len(named), sha(",".join(named)), hit > 0)
    assert got[4].contaminated and got[29].contaminated


def test_op10(spark, folder):
    got = run(spark, folder, "op10_line_dedup")
    assert [got[i].n_lines for i in range(7)] == [2, 2, 2, 0, None, 1, 2] and got[3].host is None
    # host 0 has pages 0 (twice), 2, 4 and 6, host 1 has 1 and 5: what two pages of a host share goes
    assert [got[i].n_dropped for i in range(7)] == [2, 0, 2, 0, 0, 0, 2]
    assert got[1].kept_sha256 == sha("nav\nown 2") and got[0].kept_sha256 == sha("")


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "pages", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in queries.QUERIES.items():
        empty = q(spark, str(tmp_path))
        assert empty.count() == 0 and empty.columns[0] in ("doc_id", "page_id", "vec_id", "anchor_id"), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, folder):
    """Each stage against a plain version, with null and repeated ids, null and empty texts, and no row lost that should stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", "kept", "row", "spans", "site")
    more = spark.createDataFrame([(None, None, "x", None, 0), (None, "alone of its kind here", "x", None, 22), (5, "another text of one id", "x", "s2", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("_id", "_row", "_kept", "doc", "w", "hits", "fence", "keys", "salt", "lines", "kept_id", "kept_row", "component_id", "score", "size")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = lambda df: Counter((x.doc_id, x.text, x.source) for x in df.collect())
    clean = corpus_pipeline.toxicity_stage(spark, docs, folder)
    scored = {x.doc_id: x.predicted for x in toxicity.toxicity(docs, labels).collect()}
    assert rows(clean) == Counter({k: n for k, n in rows(docs).items() if not scored[k[0]]})
    lined = corpus_pipeline.line_stage(spark, docs, folder)
    total, often = Counter(), Counter()
    for (_, t, s), n in rows(docs).items():
        total[s] += n
        for x in {x for x in (t or "").split("\n") if x.strip()}:
            often[s, x] += n
    gone = {k for k, n in often.items() if n > 1 and n > 0.05 * total[k[0]]}
    want = Counter()
    for (i, t, s), n in rows(docs).items():
        want[i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in gone), s] += n
    assert gone and rows(lined) == want
    assert lined.filter(~F.col("n_chars").eqNullSafe(F.length("text").cast("long"))).count() == 0
    near = rows(corpus_pipeline.near_dedup_stage(spark, docs, folder))
    assert sum(near.values()) < docs.count() and near[None, None, None] == 1 and near[None, "alone of its kind here", None] == 1
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    keys = list(rows(docs))
    hit = dict(zip(keys, plain_hits([k[1] for k in keys], bench), strict=True))
    assert rows(corpus_pipeline.decontamination_stage(spark, docs, folder)) == Counter({k: n for k, n in rows(docs).items() if not hit[k][1]})
    last = corpus_pipeline.bpe_stage(spark, docs, folder)
    assert Counter((x.doc_id, x.decoded_sha256) for x in last.collect()) == sum((Counter({(k[0], sha(k[1] or "")): n}) for k, n in rows(docs).items()), Counter())
