"""Go packages: what is dead in a folder, and what directives, other packages and groups keep."""

from corvane.packs import base, golang

R, A = "REMOVE", "AMBIGUOUS"
FILES = {
    "p/a.go": "package p\n\nimport \"C\"\n\n// dead does nothing.\nfunc dead(f func(int) string) (interface{}, error) {\n\treturn dead(nil)\n}\n\n//export called\nfunc called() {\n}\n\n//go:linkname pulled runtime.pulled\nfunc pulled()\n\nfunc asm(x int) int\n\nfunc given[T any](x T) {\n}\n\nfunc (r recv) method() {\n}\n\nfunc init() {\n}\n\nfunc linkedTo() {\n}\n",
    "p/b.go": "package p\n\ntype lost struct {\n\ta int\n}\n\ntype recv struct{}\n\nvar made = compute()\nvar plain = errors.New(\"}\")\nvar lazy = func() int { return compute() }\nvar a1, a2 = 1, 2\nconst limit = 3\n\nconst (\n\tone = iota\n\ttwo\n)\n\nvar (\n\tinGroup = map[string]int{\n\t\t\"a\": 1,\n\t}\n\tusedHere = 1\n)\n\nfunc Public() int {\n\treturn usedHere\n}\n",
    "p/a_test.go": "package p_test\n",
    "p/asm.s": "TEXT ·byAsm(SB)\n",
    "p/c.go": "package p\n\nfunc byAsm() {\n}\n",
    "q/d.go": "package q\n\n//go:linkname local example.com/p.linkedTo\nfunc local()\n\nfunc deadToo() {\n\tdead(nil)\n\tlocal()\n}\n",
    "q/broken.go": "package q\nfunc x() {\n",
}


def test_packages(spark):
    df = spark.createDataFrame([("r", rel, "Go" if rel.endswith(".go") else "Assembly", text) for rel, text in FILES.items()], "repo string, rel string, lang string, text string")
    got = {}
    for r in base.audit(df, golang.PACKS).collect():
        got.setdefault(r.rel, {})[r.name] = r.verdict
    assert got == {
        "p/a.go": {"dead": R, "called": A, "pulled": A, "asm": A, "given": R, "linkedTo": A},
        "p/b.go": {"lost": R, "made": A, "plain": R, "lazy": R, "limit": R, "one": A, "two": A, "inGroup": R},
        "q/d.go": {"deadToo": R},
    }
    assert {(r.path, r.name) for r in golang.linked(df).collect()} == {("runtime", "pulled"), ("example.com/p", "linkedTo")}
