"""Members of nested types in five languages: dead ones, and what keeps others; a repository for each case, all judged in one audit."""

from corvane.packs import base, declared, nested

R, A = "REMOVE", "AMBIGUOUS"
JAVA = """package p;
import java.util.List;
import static java.util.Map.entry;
import a.b.Used;
/** {@link Used} and } in a comment */
public class Outer {
    private static final Logger LOG = LoggerFactory.getLogger(Outer.class);
    private final List<String> names = List.of("}", "{");
    private final Map<K, V> kept = new HashMap<>();
    private int started = start();
    private int once = counter++;
    private int alone, together = 2;
    private Runnable later = () -> { go(); };
    private char brace = '{';
    private static class Inner {
        private int deep;
        void used() { kept.get(0); }
        private class Deeper {
            private void deepest() { String s = "x } y"; }
        }
        private enum Level { LOW { private int inLow; }, HIGH; private int rank; }
    }
    private class Gone {
        private int inGone;
    }
    Object anonymous = new Object() {
        private void inAnonymous() { }
    };
    private native void nativeOne();
    @Inject private void injected() { }
    private void alive() { new Inner(); new Deeper(); Level l; }
    private static String text() { return ""; }
    private void readObject(ObjectInputStream in) { }
    private Outer() { alive(); }
    public void api() { int local = 1; for (int i = 0; i < 3; i++) { alive(); } }
}
"""
CASES = {
    "java": ({"Outer.java": JAVA}, {"Outer.java": {"List": None, "entry": R, "LOG": R, "names": R, "started": A, "once": A, "alone": A, "together": A, "later": R, "brace": R, "deep": R, "deepest": R, "inLow": R, "rank": R, "Gone": R, "inAnonymous": R, "nativeOne": A, "injected": A, "text": R}}),
    "java owners": (
        {"D.java": "@Data\nclass D { private int made; }\n", "S.java": "class S implements Serializable { private int kept; private static int dead; }\n", "X.java": "class X extends RuntimeException { private int kept; }\n", "U.java": "class U { private static final long serialVersionUID = 1L; private int kept; private void gone() { } }\n"},
        {"D.java": {"made": A}, "S.java": {"kept": A, "dead": R}, "X.java": {"kept": A}, "U.java": {"kept": A, "gone": R}},
    ),
    "java named": ({"N.java": "class N { private int byString; private void byXml() { } private class Bin { } private int dead; }\n", "T.java": 'class T { void t() { setField(o, "byString", 1); } }\n', "conf.xml": "<a m='byXml' c='N$Bin'/>", "README.md": "dead"}, {"N.java": {"byString": A, "byXml": A, "Bin": A, "dead": R}}),
    "java reflection": ({"G.java": "import com.google.gson.Gson;\nclass G { Gson g; private int field; private static int fixed; private void method() { } }\n"}, {"G.java": {"field": A, "fixed": R, "method": R}}),
    "java odd": ({"O.java": "class O { private int x; \n", "P.java": 'class P { String s = """\n } private int no; \n"""; private int yes; }\n'}, {"O.java": {}, "P.java": {"yes": R}}),
    "c#": (
        {"a.cs": 'using X = System.Int32;\nnamespace N\n{\n  class C\n  {\n    int implicitField;\n    private string path = @"c:\\";\n    private int Prop { get; set; }\n    private int Arrow => 3;\n    void Hidden() { }\n    int Expr(int a) => a;\n    public int Open;\n    protected void Sub() { }\n    [Test] void Marked() { }\n    void Dispose() { }\n    void Update() { }\n    private Timer timer = new Timer(Tick, null);\n    private List<int> list = new List<int>();\n    int IFace.Get() { return 1; }\n    class Nested { private int inner; }\n    class Derived : Base { }\n    private partial void Part();\n    struct Layout { private int la; private static int lb; void M() { } }\n    interface I { void Public(); }\n    void Use() { Layout l; Nested n; Hidden2(); }\n    void Hidden2() { Use(); }\n  }\n}\n'},
        {"a.cs": {"X": R, "implicitField": R, "path": R, "Prop": R, "Arrow": R, "Hidden": R, "Expr": R, "Marked": A, "timer": A, "list": R, "inner": R, "Get": A, "I": R, "Derived": A, "Part": A, "la": A, "lb": R, "M": R}},
    ),
    "c# partial": ({"v.cs": "partial class V { private int shown; private int dead; void Click() { } }\n", "v.part.cs": "partial class V { void Go() { shown = 1; } public void Open() { Go(); } }\n", "v.xaml": "<b c='Click'/>", "form.Designer.cs": "partial class V { private int made; }\n"}, {"v.cs": {"dead": R}, "form.Designer.cs": {}}),
    "c# attributes": ({"s.cs": "[Serializable]\nclass S { private int kept; private void Gone() { } }\n", "r.cs": "class Q { private int hidden; void F() { t.GetField(n, BindingFlags.NonPublic); F(); } }\n"}, {"s.cs": {"kept": A, "Gone": R}, "r.cs": {"hidden": A, "F": A}}),
    "kotlin": ({"a.kt": 'import a.Gone\nprivate fun dead(\n    x: Int,\n) {\n}\nprivate val top = 1\nclass C(private val given: Int) {\n    private val own: List<Int> = listOf(1)\n    private val made by lazy { 1 }\n    private fun gone() = "${1}}"\n    companion object {\n        private const val K = 1\n        private fun inCompanion() { }\n    }\n    @Test private fun marked() { }\n    private class Lost {\n        private fun inLost() { }\n    }\n    fun open() = 1\n}\n'}, {"a.kt": {"Gone": R, "dead": R, "top": R, "own": A, "made": R, "gone": R, "K": R, "inCompanion": R, "marked": A, "Lost": R}}),
    "swift": ({"a.swift": "private func dead() {\n}\nstruct S: Codable {\n    private let coded = 1\n    private func gone() { }\n}\nclass C {\n    private(set) var shown = 1\n    fileprivate var lost = 2\n    @objc private func called() { }\n    enum E { case a; private func inEnum() { } }\n}\n"}, {"a.swift": {"dead": R, "coded": A, "gone": R, "lost": R, "called": A, "inEnum": R}}),
    "php": ({"a.php": "<?php\nuse A\\Gone;\nclass C {\n    private const X = 1;\n    private ?int $lost = null;\n    private static array $kept = [];\n    private function dead() { return \"}\"; }\n    #[Route] private function routed() { }\n    public function go() { return self::$kept; }\n}\n", "t.php": "<?php\n$x = 'maybe';\nclass D {\n    private function maybe() { }\n}\n"}, {"a.php": {"Gone": R, "lost": R, "dead": R, "routed": A}, "t.php": {}}),
}
LANG = {"java": "Java", "cs": "C#", "kt": "Kotlin", "swift": "Swift", "php": "PHP", "xml": "XML", "xaml": "XAML", "md": "Markdown"}


def test_members(spark):
    rows = [(case, rel, LANG[rel.rpartition(".")[2]], text) for case, (files, _) in CASES.items() for rel, text in files.items()]
    df = spark.createDataFrame(rows, "repo string, rel string, lang string, text string")
    got = {}
    for r in base.audit(df, declared.PACKS).collect():
        got.setdefault((r.repo, r.rel), {})[r.name] = r.verdict
    wrong = {(case, rel): {n: (names.get(n), got.get((case, rel), {}).get(n)) for n in names.keys() | got.get((case, rel), {}).keys() if names.get(n) != got.get((case, rel), {}).get(n)} for case, (_, want) in CASES.items() for rel, names in want.items()}
    wrong = {k: v for k, v in wrong.items() if v}
    assert not wrong, str(wrong)


def test_spans_and_owners(spark):
    files = spark.createDataFrame([("r", "Outer.java", "Java", JAVA), ("r", "empty.java", "Java", ""), ("r", "null.java", "Java", None), ("r", "odd.java", "Java", "} {")], "repo string, rel string, lang string, text string")
    got = {r.name: r for r in nested.members(files).collect()}
    lines = JAVA.split("\n")
    for name, first in (("Inner", "private static class Inner"), ("Deeper", "private class Deeper"), ("deepest", "private void deepest"), ("api", "public void api")):
        at = next(i for i, x in enumerate(lines, 1) if first in x)
        assert got[name].line == at and lines[got[name].end_line - 1].endswith("}")
    assert {n: got[n].owner_name for n in ("Inner", "Deeper", "deepest", "rank", "deep")} == {"Inner": "Outer", "Deeper": "Inner", "deepest": "Deeper", "rank": "Level", "deep": "Inner"}
    assert "local" not in got and "i" not in got and got["together" if "together" in got else "alone"].parts == 2
    assert {r.rel for r in nested.blocks(files).select("rel").distinct().collect()} == {"Outer.java"}


def test_tokens_leave_texts_of_comments_and_strings_behind(spark):
    """Their lengths and lines count, but nothing of them is shuffled or written; members come out as before."""
    text = "/* a\nlong } comment */\nclass A { // { end\n  private String s = \"}}{\"; /* x */ private int n;\n}\n"
    files = spark.createDataFrame([("r", "A.java", "Java", text)], "repo string, rel string, lang string, text string")
    t = nested.tokens(files).collect()
    assert {r.what: r.tok for r in t if r.what in ("comment", "string")} == {"comment": "", "string": '""'}
    assert all(text[r["at"] - 1 :].startswith(r.tok) for r in t if r.what != "string") and {r.what: (r.line, text[r["at"] - 1]) for r in t if r.what in ("string", "}")} == {"string": (4, '"'), "}": (5, "}")}
    assert sorted((r.name, r.line, r.end_line) for r in nested.members(files).collect()) == [("n", 4, 4), ("s", 4, 4)]
