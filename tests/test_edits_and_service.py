"""Edits of text, models' answers, and small service rules."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import edits, jury, service

SOURCE = """import os, sys
from a import (
    b,
    c as d,
)


@deco
def gone():
    import json
    return json


class Kept:
    def f(self):
        import re
"""


def test_remove():
    out = edits.remove(SOURCE, [("import", 1, "os"), ("import", 2, "d"), ("function", 8, "gone"), ("import", 10, "json"), ("import", 16, "re")])
    assert "import sys" in out and "os" not in out and "from a import b" in out and "gone" not in out and "@deco" not in out and out.rstrip().endswith("pass") and "class Kept" in out
    assert edits.remove(SOURCE, [("import", 99, "x"), ("function", 9, "gone")]) == SOURCE
    with pytest.raises(edits.SharedLine):
        edits.remove("import os; x = 1\n", [("import", 1, "os")])


def test_each_cut_alone_and_together_compiles(spark):
    files = spark.createDataFrame([("r", "a.py", SOURCE), ("r", "b.py", "import os; x = 1\n")], "repo string, rel string, text string")
    f = spark.createDataFrame([("r", "import", "a.py", 1, "os", "REMOVE"), ("r", "import", "a.py", 1, "sys", "KEEP"), ("r", "import", "b.py", 1, "os", "REMOVE")], "repo string, kind string, file string, line int, name string, final string")
    rows = {r.rel: r for r in edits.apply_removals(files, f).collect()}
    assert rows["a.py"].text.startswith("import sys\n") and rows["a.py"].error is None and "SharedLine" in rows["b.py"].error


def test_answers():
    assert edits.last_object('a {"x": 1} b {"y": {"z": "}"}} {broken') == '{"y": {"z": "}"}}'
    assert edits.last_object('<think>{"x": 1}</think> no') is None and edits.last_object(None) is None
    assert edits.code_names("x = request.get('date')  # date") == {"x", "request", "get"} and "y" in edits.code_names("foo(y, 'open")


def test_python_lines_need_code(spark):
    cited = spark.createDataFrame([(i, "m", ["a.py:5"]) for i in ("code", "text", "open")], "finding string, model string, evidence array<string>")
    f = spark.createDataFrame([("code", "r", "function", "b.py", 1, 1, "get", "REMOVE"), ("text", "r", "function", "b.py", 1, 1, "date", "REMOVE"), ("open", "r", "function", "b.py", 1, 1, "date", "AMBIGUOUS")], "finding string, repo string, kind string, file string, line int, end_line int, name string, verdict string")
    lines = spark.createDataFrame([("r", "a.py", 5, "x = q.get('date')")], "repo string, rel string, line int, text string")
    ok = lambda **k: {r.finding for r in jury.checked_evidence(cited, f, lines, **k).filter(F.size("checked") > 0).collect()}
    assert ok() == {"code", "open"}
    assert ok(text_counts=spark.createDataFrame([("r", "a.py")], "repo string, rel string")) == {"code", "text", "open"}


def test_only_lines_of_python_are_read_as_code(spark, monkeypatch):
    """Lines that no rule asks the tokenizer about aren't sent to Python's workers as text."""
    sent, real = [], jury.in_code
    monkeypatch.setattr(jury, "in_code", lambda line, name: (sent.append(line), real(line, name))[1])
    cited = spark.createDataFrame([(i, "m", [f"{i}:5"]) for i in ("a.py", "b.txt")], "finding string, model string, evidence array<string>")
    f = spark.createDataFrame([(i, "r", "function", "c.py", 1, 1, "date") for i in ("a.py", "b.txt")], "finding string, repo string, kind string, file string, line int, end_line int, name string")
    lines = spark.createDataFrame([("r", i, 5, "x = q.get('date')") for i in ("a.py", "b.txt")], "repo string, rel string, line int, text string")
    assert {r.finding: r.checked for r in jury.checked_evidence(cited, f, lines).collect()} == {"a.py": [], "b.txt": ["b.txt:5"]}
    rows = spark.createDataFrame([("a.py", "x", False), ("b.txt", "y", False), ("a.py", "z", True)], "rel string, text string, by_text boolean")
    assert [r[0] for r in rows.select(sent[0]).collect()] == ["x", None, None]


def test_service(spark):
    a = spark.createDataFrame([(1, "A/b", "s", "1", "done", "public", "u"), (2, "a/B", "s", "1", "done", "private", "u"), (3, "a/b", "t", "1", "queued", "private", "v")], "id int, repo string, sha string, version string, status string, visibility string, owner string")
    asked = spark.createDataFrame([("a/b", "s", "1"), ("a/b", "t", "1")], "repo string, sha string, version string")
    assert [(r.sha, r.cached_id) for r in service.cached(asked, a).orderBy("sha").collect()] == [("s", 2), ("t", None)]
    assert [r.id for r in service.visible(a, "v").orderBy("id").collect()] == [1, 3] and service.visible(a, None).count() == 1
    f = spark.createDataFrame([("src/App.py", "import", "os", "REMOVE"), ("x.py", "function", "application", "KEEP")], "file string, kind string, name string, verdict string")
    assert service.search(f, text="APP").count() == 2 and service.search(f, verdict="KEEP", text="app").count() == 1
    p, q = (spark.createDataFrame(x, "full_name string") for x in ([("A/b",)], [("a/B",), ("c/d",)]))
    assert [(r.full_name, r.source) for r in service.merged_choices(p, q).orderBy("source").collect()] == [("A/b", "private"), ("c/d", "public")]
    assert tuple(service.queue_counts(a).first()) == (1, 0)


def test_prompt(spark):
    f = spark.createDataFrame([("r", "import", "a.py", 3, 3, "os", "REMOVE", "no use")], "repo string, kind string, file string, line int, end_line int, name string, verdict string, reason string")
    lines = spark.createDataFrame([("r", "a.py", i, f"line {i}") for i in range(1, 9)], "repo string, rel string, line int, text string")
    refs = spark.createDataFrame([("r", "a.py", "os", 3, ["b.py:1"])], "repo string, rel string, name string, start int, evidence array<string>")
    text = edits.prompt(f, lines, refs).first().context
    assert "    1  line 1" in text and "    5  line 5" in text and "line 6" not in text and "b.py:1" in text
