"""Statics of C and C++ over includes, includers and macros: a repository for each case, all judged in one audit."""

from corvane.operators import usage
from corvane.packs import base, cfamily, declared

R, A = "REMOVE", "AMBIGUOUS"
CASES = {
    "plain": ({"a.c": "#include <stdio.h>\n/* a note { */\nstatic int dead(int x)\n{\n  return dead(x) + '{';\n}\nstatic int live(void) { return 1; }\nstatic int count;\nstatic const char *name = \"}\";\nint open_one(void) { return live(); }\nint main(void) { return 0; }\nint opened(int a,\n           int b) {\n  return 1;\n}\n"}, {"a.c": {"dead": R, "count": R, "name": R, "open_one": A, "opened": A}}),
    "header names it": ({"a.c": "#include \"lib/use.h\"\nstatic int helper(void) { return 1; }\nstatic int lost(void) { return 1; }\n", "src/lib/use.h": "#define GO() helper()\n", "other/use.h": "lost\n"}, {"a.c": {"lost": R}}),
    "header of a header": ({"a.c": "#include \"one.h\"\nstatic int helper(void) { return 1; }\n", "one.h": "#include \"two.h\"\n", "two.h": "#include \"one.h\"\n#define GO() helper()\n"}, {"a.c": {}}),
    "header not judged": ({"h.h": "static inline int unused(void) { return 1; }\n"}, {"h.h": {}}),
    "included source": ({"impl.c": "static int shared(void) { return 1; }\nstatic int dead(void) { return 1; }\n", "all.c": "#include \"impl.c\"\nint go(void) { return shared(); }\n"}, {"impl.c": {"dead": R}, "all.c": {"go": A}}),
    "not included": ({"impl.c": "static int alone(void) { return 1; }\n", "b.c": "static int alone(void) { return 1; }\nint go(void) { return alone(); }\n"}, {"impl.c": {"alone": R}, "b.c": {"go": A}}),
    "included by a grammar": ({"impl.c": "static int shared(void) { return 1; }\n", "p.y": "%{\n#include \"impl.c\"\n%}\nshared\n"}, {"impl.c": {}}),
    "read by a script": ({"fix.c": "static int shared(void) { return 1; }\n", "t.py": "open('fix.c')\nshared = 1\n"}, {"fix.c": {}}),
    "made later": ({"a.c": "#include \"table.gen.h\"\nstatic int shared(void) { return 1; }\n", "gen.txt": "shared"}, {"a.c": {}}),
    "pasted": ({"a.c": "#include \"m.h\"\nstatic int cmd_start(void) { return 1; }\nstatic int other(void) { return 1; }\nint x = RUN(start);\n", "m.h": "#define CALL(n) cmd_##n()\n#define RUN(n) \\\n  CALL(n)\n#define PLAIN(n) n\n"}, {"a.c": {"cmd_start": A, "other": R}}),
    "not pasted": ({"a.c": "#define PLAIN(n) use(n)\nstatic int cmd_start(void) { return 1; }\nint x = PLAIN(start);\n"}, {"a.c": {"cmd_start": R}}),
    "pasted in an includer": ({"impl.c": "static int cmd_stop(void) { return 1; }\n", "all.c": "#define CALL(n) cmd_##n()\n#include \"impl.c\"\nint x = CALL(stop);\n"}, {"impl.c": {"cmd_stop": A}}),
    "a library's macro": ({"a.c": "G_DEFINE_TYPE (MyThing, my_thing, BASE)\nstatic void my_thing_init(void) { }\nstatic void lonely(void) { }\n"}, {"a.c": {"my_thing_init": A, "lonely": R}}),
    "attributes": ({"a.c": "static void ctor(void) __attribute__((constructor));\n__attribute__((constructor)) static void first(void) { }\nstatic MY_EXPORT void given(void) { }\nstatic KEEP void behind(void) { }\nstatic void gone(void) { }\nstatic const char id[] = \"$Id$\";\n", "k.h": "#define INNER __attribute__((used))\n#define KEEP INNER\n"}, {"a.c": {"first": A, "given": A, "behind": A, "gone": R, "id": A}}),
    "c++": ({"a.cpp": "namespace {\nint hidden(int a) { return a; }\n}\nstatic Registrar reg(1);\nstatic std::string made = build();\nstatic int plain = 1;\nstatic int runs = start();\nvoid swap(A& a, A& b) { }\nint Foo::method() { return 1; }\n"}, {"a.cpp": {"hidden": R, "made": A, "plain": R, "runs": A}}),
    "whole files": ({"s.c": "#pragma section(\".x\")\nstatic int placed = 1;\n", "i.c": "#include IMPL\nstatic int maybe = 1;\n", "broken.c": "static int f(void) {\n"}, {"s.c": {"placed": A}, "i.c": {"maybe": A}, "broken.c": {}}),
}
LANG = {"c": "C", "h": "C/C++ header", "cpp": "C++", "y": "Yacc", "py": "Python", "txt": "Text"}


def test_translation_units(spark):
    rows = [(case, rel, LANG[rel.rpartition(".")[2]], text) for case, (files, _) in CASES.items() for rel, text in files.items()]
    df = spark.createDataFrame(rows, "repo string, rel string, lang string, text string")
    got = {}
    for r in base.audit(df, declared.PACKS).collect():
        got.setdefault((r.repo, r.rel), {})[r.name] = r.verdict
    wrong = {(case, rel): (got.get((case, rel), {}), names) for case, (_, want) in CASES.items() for rel, names in want.items() if got.get((case, rel), {}) != names}
    assert not wrong, str(wrong)


def test_macros_to_a_fixpoint(spark):
    text = "#define A(x) x##_a\n#define B(x) A(x)\n#define C(x) \\\n  B(x) + D\n#define D A\n#define E(x) F(x)\n#define F(x) E(x)\n"
    files = spark.createDataFrame([("r", "m.h", text), ("q", "m.h", "#define B(x) A(x)\n"), ("r", "x.inc", "one two")], "repo string, rel string, text string")
    known = cfamily.macros(files)
    takes = cfamily.F.col("takes")
    assert sorted((r.repo, r.name) for r in cfamily.spreading(known, takes & cfamily.F.col("body").contains("##"), takes).collect()) == [("r", "A"), ("r", "B"), ("r", "C")]
    assert sorted((r.repo, r.rel, r.word) for r in cfamily.pasted(files, known).collect()) == [("r", "x.inc", "one"), ("r", "x.inc", "two")]
    edges = spark.createDataFrame([("r", f"n{i}", f"n{(i * 7) % 50}") for i in range(50)] + [("q", "n1", "n2")], "repo string, a string, z string")
    got = usage.flood(spark.createDataFrame([("r", "n1"), ("r", "n3")], "repo string, node string"), edges).collect()
    want, todo = set(), [1, 3]
    while todo:
        i = todo.pop()
        if i not in want:
            want.add(i)
            todo.append((i * 7) % 50)
    assert sorted((r.repo, r.node) for r in got) == sorted(("r", f"n{i}") for i in want)


def test_reach_reads_its_edges_once(spark):
    """A chain of five includes: five rounds, but the edges (read from texts) are worked out once."""
    from pyspark.sql import functions as F

    from corvane.operators import usage

    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("r", str(i), str(i + 1)) for i in range(5)], "repo string, a string, z string").mapInArrow(read, "repo string, a string, z string")
    starts = spark.createDataFrame([("r", "0")], "repo string, start string")
    assert sorted(r.node for r in usage.reach(starts, edges).collect()) == list("12345")
    assert seen.value == 5
