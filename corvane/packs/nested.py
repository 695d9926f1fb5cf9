"""Members of types in languages with braces, wherever they are nested: a parser of brace depth in SQL windows.

A text is cut into comments, strings, braces and the rest. Running sums over the tokens of a file give each token's line,
place, depth and the parentheses open round it; what stands between two ends of statements is a head. The n-th opening
brace of a depth closes with the n-th closing one of that depth, so spans are an equi-join, and the last
brace opened a depth above is what a head lies in. What a member is and why it must stay are patterns over heads and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.packs.base import Pack
from corvane.runtime import store

#: Comments, strings (of several lines, verbatim, plain), characters, what gives structure, the rest: every character is in one token.
TOKEN = r"""(?s)//[^\n]*|/\*.*?\*/|\"{3}.*?\"{3}|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[{}();\n]|[^{}();\n"'/@]+|."""


@dataclass(frozen=True)
class Language:
    """newlines: statements end with lines. implicit: members without a word for access are private. hidden: the words that make a name private to its file."""

    name: str
    types: str = r"\b(?:class|interface|enum|record|struct|object|trait|protocol|extension|actor)\s+(\w+)"
    method: str = r"(\w+)\s*(?:<[^<>()]*>\s*)?\(.*\)[^=()]*$"
    newlines: bool = False
    implicit: bool = False
    top: bool = False
    hidden: str = r"(^|\s)private\b"
    marks: str = r"(^|\s)@\w"
    scope: str = "file"


LANGUAGES = {
    x.name: x
    for x in (
        Language("Java"), Language("C#", implicit=True, marks=r"(^|\s)\[[A-Za-z]"), Language("Kotlin", method=r"\bfun\s+(?:<[^<>()]*>\s*)?(?:[\w<>?]+\.)?(\w+)\s*\(", newlines=True, top=True), Language("PHP", method=r"\bfunction\s+&?(\w+)\s*\(", marks=r"#\[", scope="repo"),
        Language("Swift", method=r"\bfunc\s+(\w+)", newlines=True, top=True, hidden=r"(^|\s)(file)?private\b(?!\(set\))"),
    )
}

# --- fixed values: names that a language's run time calls, and calls that only build a value
CALLED = {
    "Java": ["serialVersionUID", "serialPersistentFields", "readObject", "writeObject", "readObjectNoData", "readResolve", "writeReplace"],
    "C#": ["Main", "Dispose", "GetEnumerator", "Deconstruct", "GetAwaiter", "PrintMembers", "Awake", "Start", "Update", "FixedUpdate", "LateUpdate", "OnEnable", "OnDisable", "OnDestroy", "OnGUI", "OnValidate", "Reset", "CreateHostBuilder", "MoveNext"],
    "Kotlin": ["main", "plus", "minus", "times", "div", "rem", "get", "set", "invoke", "contains", "iterator", "compareTo", "getValue", "setValue", "provideDelegate", "inc", "dec", "not", "component1", "component2", "hasNext", "next", "rangeTo", "unaryMinus", "unaryPlus"],
    "PHP": ["__construct", "__destruct", "__clone", "__toString", "__wakeup", "__sleep", "__serialize", "__unserialize", "__call", "__callStatic", "__get", "__set", "__isset", "__unset", "__invoke"],
    "Swift": ["init", "deinit", "subscript", "main"],
}
PURE_CALL = (
    r"(?:\b(?:getLogger|getLog|getAnonymousLogger)|\bPattern\.(?:compile|quote)|\bArrays\.asList|\bMap\.ofEntries|\bDateTimeFormatter\.ofPattern|\b(?:Duration|Period)\.of\w*"
    r"|\b(?:List|Set|Map|EnumSet|Stream|IntStream|LongStream|DoubleStream|Optional|ImmutableList|ImmutableSet|ImmutableMap|ImmutableSortedSet|ImmutableSortedMap|ImmutableMultimap|ImmutableListMultimap|ImmutableSetMultimap|Lists|Sets|Maps)\.(?:of|copyOf)"
    r"|\b(?:String|Integer|Long|Short|Byte|Double|Float|Boolean|Character|BigDecimal|BigInteger)\.valueOf|\bCollections\.(?:empty(?:List|Map|Set)|singleton(?:List|Map)?|unmodifiable\w+|synchronized\w+)"
    r"|\bnew\s+(?:Object|String|StringBuilder|StringBuffer|ArrayList|LinkedList|HashMap|LinkedHashMap|TreeMap|HashSet|LinkedHashSet|TreeSet|ArrayDeque|PriorityQueue|ConcurrentHashMap|ConcurrentLinkedQueue|ConcurrentLinkedDeque|ConcurrentSkipListMap|ConcurrentSkipListSet"
    r"|CopyOnWriteArrayList|CopyOnWriteArraySet|LinkedBlockingQueue|ArrayBlockingQueue|EnumMap|IdentityHashMap|WeakHashMap|Vector|Hashtable|Properties|Atomic(?:Integer|Long|Boolean|Reference|IntegerArray|LongArray)|LongAdder|ReentrantLock|ReentrantReadWriteLock"
    r"|CountDownLatch|Semaphore|ThreadLocal|BigDecimal|BigInteger|Random|SimpleDateFormat|DecimalFormat|Date|List|Dictionary|Queue|Stack)\s*(?:<[^()]*>)?)\s*\("
)
#: Languages in which a dollar before a name is no part of it.
DOLLARS = ["PHP", "Kotlin"]
#: Libraries that read private fields nobody names, and files whose words reach no code.
REFLECTS = r"(?m)^\s*(?:import|using)\s+(?:static\s+)?[\w.]*(?i:gson|jackson|moshi|fastjson|persistence|hibernate|xml\.bind|json\.bind|simpleframework|xstream|mongodb|morphia|springframework\.data|firebase|firestore|androidx\.room|realm|kryo|esotericsoftware|snakeyaml|modelmapper|dozer|avro|protostuff|jsoniter|genson|flexjson|lang3?\.builder)\w*|\b(?:getDeclaredFields|declaredFields|declaredMemberProperties|memberProperties)\b"
NO_USE = r"(?i)\.(md|markdown|mdx|rst|adoc|asciidoc|txt)$|(^|/)(pom\.xml|gradle\.properties|[^/]*\.gradle|LICEN[CS]E[^/]*|NOTICE[^/]*|CHANGELOG[^/]*|CHANGES[^/]*|AUTHORS[^/]*|CONTRIBUTORS[^/]*)$|(^|/)\.github/"
GENERATED = r"(?i)(\.(designer|g|g\.i|generated)\.cs|(^|/)AssemblyInfo\.cs)$"
SPECIAL = r"\b(native|external|extern|partial|virtual|override|abstract|dynamic)\b|@objc\b"


def tokens(files: DataFrame) -> DataFrame:
    """repo, rel, pos, tok, what (comment, string or the token), line, at (first character, from 1), depth, inner, ends: whether a statement ends with it. files: repo, rel, lang, text.

    tok is empty for comments and `""` for strings: their lengths and lines are counted where they are read, so none of their text is shuffled, sorted or written.
    """
    t = files.select("repo", "rel", "lang", F.posexplode(S.all_matches(F.col("text"), TOKEN)).alias("pos", "tok"))
    first = F.substring("tok", 1, 1)
    string = (F.length("tok") > 1) & (first.isin('"', "'") | F.startswith("tok", F.lit('@"')))
    comment = F.startswith("tok", F.lit("//")) | F.startswith("tok", F.lit("/*"))
    breaks = F.length("tok") - F.length(F.replace("tok", F.lit("\n")))
    t = t.select("repo", "rel", "lang", "pos", F.when(comment, "").when(string, '""').otherwise(F.col("tok")).alias("tok"), F.when(comment, "comment").when(string, "string").otherwise(F.col("tok")).alias("what"), F.length("tok").alias("chars"), breaks.alias("breaks"))
    order = Window.partitionBy("repo", "rel").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    change = lambda up, down: F.when(F.col("what") == up, 1).when(F.col("what") == down, -1).otherwise(0)
    t = t.withColumns({"line": (1 + so_far(F.col("breaks"))).cast("int"), "at": 1 + so_far(F.col("chars")), "depth": so_far(change("{", "}")), "open": so_far(change("(", ")"))})
    t = t.withColumn("inner", F.col("depth") + F.when(F.col("what") == "{", 1).otherwise(0))
    # parentheses that were open when the brace round a token opened don't count for it
    own = F.last(F.when(F.col("what") == "{", F.col("open")), ignorenulls=True).over(Window.partitionBy("repo", "rel", "inner").orderBy("pos"))
    flat = F.col("open") == F.coalesce(own, F.lit(0))
    ends = F.col("what").isin("{", "}") | (flat & (F.col("what") == ";")) | (flat & (F.col("what") == "\n") & F.col("lang").isin([x.name for x in LANGUAGES.values() if x.newlines]))
    return t.withColumn("ends", ends).drop("open", "chars", "breaks")


def _pairs(t: DataFrame) -> DataFrame:
    """Each opening brace of tokens with the place of the one that closes it: the n-th of a depth with the n-th."""
    nth = F.row_number().over(Window.partitionBy("repo", "rel", "level").orderBy("pos"))
    opened = t.filter("what = '{'").select("repo", "rel", "pos", "line", F.col("depth").alias("level")).withColumn("nth", nth)
    closed = t.filter("what = '}'").select("repo", "rel", "pos", (F.col("depth") - 1).alias("level"), F.col("line").alias("end_line"), F.col("at").alias("end_at")).withColumn("nth", nth)
    return opened.join(closed.drop("pos"), ["repo", "rel", "level", "nth"])


def _odd(t: DataFrame) -> DataFrame:
    """Files of tokens whose braces don't match."""
    step = F.when(F.col("what") == "{", 1).when(F.col("what") == "}", -1).otherwise(0)
    return t.groupBy("repo", "rel").agg(F.sum(step).alias("left"), F.min(F.when(F.col("what") == "}", F.col("depth"))).alias("least")).filter("left <> 0 or least < 1").select("repo", "rel")


def blocks(files: DataFrame) -> DataFrame:
    """repo, rel, depth, line, end_line: every block of braces outside comments and strings, of files whose braces match."""
    t = store(tokens(files).filter("what in ('{', '}')").select("repo", "rel", "pos", "what", "line", "at", "depth"), "braces")
    return _pairs(t).join(_odd(t), ["repo", "rel"], "left_anti").select("repo", "rel", F.col("level").cast("int").alias("depth"), "line", "end_line")


def heads(files: DataFrame) -> DataFrame:
    """repo, rel, lang, seg, head, by ({ or another end), line, end_line, at, end_at, depth, parent: every statement and block with the seg that it lies in.

    A head is its text without comments, with strings blanked, spaces squeezed; its span goes to the brace that closes it. Files whose braces
    don't match give no rows.
    """
    t = tokens(files)
    order = Window.partitionBy("repo", "rel").orderBy("pos")
    t = store(t.withColumn("seg", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "tokens")
    code = ~F.col("ends") & (F.col("what") != "comment")
    solid = code & (F.trim(F.regexp_replace("tok", r"\s", " ")) != "")
    said = t.groupBy("repo", "rel", "lang", "seg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(code, F.struct("pos", F.col("tok").alias("s"))))), lambda x: x["s"]), "").alias("head"),
        F.min(F.when(solid, F.col("line") + F.length(F.regexp_extract("tok", r"^\s*", 0)) - F.length(F.replace(F.regexp_extract("tok", r"^\s*", 0), F.lit("\n"))))).alias("line"), F.min(F.when(solid, F.col("at"))).alias("at"),
        F.max(F.when(F.col("ends"), F.struct(F.col("pos").alias("pos"), F.col("what").alias("by"), F.col("line").alias("line"), F.col("at").alias("at"), F.col("depth").alias("depth")))).alias("end"),
    )
    said = said.select("repo", "rel", "lang", "seg", S.squeeze(F.col("head")).alias("head"), "line", "at", F.col("end.pos").alias("pos"), F.col("end.by").alias("by"), F.col("end.line").alias("here"), F.col("end.at").alias("here_at"), F.col("end.depth").alias("depth"))
    pairs = _pairs(t).select("repo", "rel", "pos", "end_line", "end_at")
    said = said.join(pairs, ["repo", "rel", "pos"], "left").join(_odd(t), ["repo", "rel"], "left_anti")
    said = said.withColumn("end_line", F.coalesce("end_line", "here")).withColumn("end_at", F.coalesce("end_at", "here_at")).filter("by <> '}' and by is not null")
    # the last brace that was opened into a head's depth is the one it lies in
    asks = said.select("repo", "rel", F.col("depth").alias("within"), "pos", F.col("seg").alias("asks"), F.lit(None).cast("long").alias("opens"))
    opens = said.filter("by = '{'").select("repo", "rel", (F.col("depth") + 1).alias("within"), "pos", F.lit(None).cast("long").alias("asks"), F.col("seg").cast("long").alias("opens"))
    parent = asks.unionByName(opens).withColumn("parent", F.last("opens", ignorenulls=True).over(Window.partitionBy("repo", "rel", "within").orderBy("pos"))).filter("asks is not null")
    parent = parent.select("repo", "rel", F.col("asks").alias("seg"), "parent")
    out = said.join(parent, ["repo", "rel", "seg"], "left")
    return out.select("repo", "rel", "lang", "seg", "head", "by", "line", "end_line", "at", "end_at", "depth", "parent").filter("head <> ''")


def _by_language(value) -> Column:
    """A column that each language says for itself."""
    out = F.lit(None)
    for x in LANGUAGES.values():
        out = F.when(F.col("lang") == x.name, value(x)).otherwise(out)
    return out


def members(files: DataFrame) -> DataFrame:
    """heads that declare a type, method or field of a type (or, where a language has such, of the file), with name, value, private, owner (head), parts: how many names a field declares."""
    h = store(heads(files), "heads")
    head = F.col("head")
    # a type's words stand before its parameters and its body, a method's and a field's before any value; steps of their own, as each is used many times
    h = h.withColumn("plain", F.trim(F.regexp_replace(F.regexp_replace(head, r"(?:@[\w.]+(?:\([^()]*\))?|#?\[[^\]]*\])\s*", ""), r"^<\?php\s*", "")))
    h = h.withColumn("before", F.regexp_extract("plain", r"^((?:[^=]|[=!<>]=)*?)\s*(?:=(?!=)|$)", 1))
    h = h.withColumn("said", F.regexp_replace("before", r"\s*=>.*$", ""))
    plain, left, arrow = F.col("plain"), F.col("before"), F.col("said")
    type_ = F.when(F.col("by") == "{", _by_language(lambda x: F.regexp_extract(F.regexp_extract(plain, r"^[^(=]*", 0), x.types, 1)))
    method = _by_language(lambda x: F.regexp_extract(arrow, x.method, 1))
    shape = lambda x: r"\b(?:val|var|let)\s+(?:\([^)]*\)\s*)?(\w+)" if x.newlines else r"\$(\w+)\s*$" if x.name == "PHP" else r"[\w>\]?]\s+(\w+)(?:\s*\[\])*\s*(?:,.*)?$"
    h = h.withColumns({"type_name": type_, "method_name": method, "field_name": _by_language(lambda x: F.regexp_extract(arrow, shape(x), 1))})
    type_, method, field = F.col("type_name"), F.col("method_name"), F.col("field_name")
    control = arrow.rlike(r"^(return|throw|if|else|for|foreach|while|do|switch|case|default|try|catch|finally|import|package|using|namespace|use|new|yield|goto|await|lock|assert|echo|guard|defer|when|static\s*$)\b")
    kind = F.when(control, None).when(F.length(type_) > 0, "class").when(F.length(method) > 0, "method").when((F.length(field) > 0) & ((F.col("by") != "{") | head.contains("=") | (F.col("lang").isin("C#", "Swift", "Kotlin"))), "field")
    h = h.withColumn("kind", kind).withColumns({"name": F.when(F.col("kind") == "class", type_).when(F.col("kind") == "method", method).otherwise(field), "value": F.regexp_extract(plain, r"^(?:[^=]|[=!<>]=)*?\s*=(?!=)>?\s*(.*)$", 1)})
    commas = F.regexp_replace(left, r"<[^<>]*>|\([^()]*\)", "")
    several = F.transform(F.split(commas, ","), lambda x: F.regexp_extract(x, r"(\w+)(?:\s*\[\])*\s*$", 1))
    several = F.when((F.col("kind") == "field") & F.col("lang").isin("Java", "C#") & commas.contains(","), several).otherwise(F.array("name"))
    h = h.withColumn("parts", F.when(F.col("kind") == "field", F.size(several)).otherwise(1)).withColumn("name", F.explode(several))
    owners = h.select("repo", "rel", F.col("seg").alias("parent"), F.col("head").alias("owner"), F.col("kind").alias("owner_kind"), F.col("name").alias("owner_name"), F.col("plain").alias("owner_plain"))
    h = h.drop("said", "before", "type_name", "method_name", "field_name").filter("kind is not null").join(owners, ["repo", "rel", "parent"], "left")
    body = F.col("owner").rlike(r"\bnew\s+[\w.<>, ]+\(.*\)\s*$") | F.col("owner").rlike(r"^[A-Z_][A-Z0-9_]*(\(.*\))?$") | ((F.col("lang") == "Kotlin") & F.col("owner").rlike(r"\bobject\b"))
    top = _by_language(lambda x: F.lit(x.top)) & F.col("parent").isNull()
    h = h.filter((F.col("owner_kind") == "class") | F.coalesce(body, F.lit(False)) | top)
    said = F.regexp_extract(F.regexp_replace("plain", r"\b(file)?private\(set\)", ""), r"^[^(={]*", 0)
    hidden = _by_language(lambda x: said.rlike(x.hidden))
    open_ = said.rlike(r"\b(public|protected|internal|file)\b")
    bodied = F.coalesce(F.col("owner_plain"), F.lit("")).rlike(r"\b(class|struct|record)\b")
    return h.withColumn("private", F.when(F.col("lang") == "C#", hidden | (~open_ & bodied)).otherwise(hidden))


def private_members(files: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """Private members as units (SCHEMA of packs), with the first reason that keeps each. everything (repo, rel, lang, text): all text files, which may name them.

    Files made by a generator aren't judged. A member of a partial type is looked for in the whole repository, any other in its file.
    """
    every = everything if everything is not None else files
    m = store(members(files.filter(~F.col("rel").rlike(GENERATED))), "members")
    serial = m.filter("name = 'serialVersionUID'").select("repo", "rel", "parent", F.lit(True).alias("uid")).distinct()
    m = m.filter("private").join(serial, ["repo", "rel", "parent"], "left")
    m = m.filter(~F.coalesce(_by_language(lambda x: F.col("name").isin(CALLED[x.name])), F.lit(False))).filter("name <> coalesce(owner_name, '')")
    m = m.join(files.select("repo", "rel", "text"), ["repo", "rel"])
    edge = lambda look: F.when(F.col("lang").isin(DOLLARS), look + r"\w)").otherwise(look + r"[\w$])")
    own_text = F.substr("text", F.col("at"), F.col("end_at") - F.col("at") + 1)
    m = m.withColumn("own", F.size(F.regexp_extract_all(own_text, F.concat(edge("(?<!"), "name", edge("(?!")), F.lit(0)))).drop("text")

    code = F.col("lang").isin(list(LANGUAGES))
    literals = every.filter(code).select("repo", "rel", F.explode(S.all_matches(F.col("text"), r"""["']([^"'\s\\]{1,200})["']""", 1)).alias("s")).select("repo", "rel", F.explode(S.all_matches(F.col("s"), r"[A-Za-z_]\w*")).alias("name"))
    others = every.filter(~code & ~F.col("rel").rlike(NO_USE)).select("repo", "rel", F.explode(S.all_matches(F.col("text"), r"[A-Za-z_]\w*")).alias("name"))
    said = literals.unionByName(others).distinct()
    by = said.groupBy("repo", "name").agg(F.min("rel").alias("first"), F.max("rel").alias("last"))
    m = m.join(by, ["repo", "name"], "left").withColumn("elsewhere", F.when(F.col("first") != F.col("rel"), F.col("first")).when(F.col("last") != F.col("rel"), F.col("last")))
    m = m.join(every.filter(code & F.col("text").rlike(REFLECTS)).groupBy("repo").agg(F.min("rel").alias("reflects")), "repo", "left")
    looks = files.filter(F.col("text").rlike(r"\bBindingFlags\.NonPublic\b|\bSendMessage\s*\(|\bsetAccessible\b|call_user_func|\$this->\$|->\{\s*\$|\bunserialize\(|function\s+__(call|callStatic|get|set)\b")).select("repo", F.col("rel"), F.lit(True).alias("looks"))
    m = m.join(looks, ["repo", "rel"], "left")
    head, value = F.col("head"), F.col("value")
    field, instance = F.col("kind") == "field", ~head.rlike(r"\b(static|transient|const)\b")
    partial = (F.col("lang") == "C#") & F.coalesce(F.col("owner"), F.lit("")).rlike(r"\bpartial\b")
    owner = F.coalesce(F.col("owner"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(value, PURE_CALL, "("), r"^\s*(?:\([^()]*\)|\w+)\s*->.*|^\s*(?:\([^()]*\)|\w+)\s*=>.*|^\s*function\b.*|^\s*fn\b.*", "")
    runs = bare.rlike(r"\w\s*(?:<[^()<>]*>)?\(|\+\+|--|\bnew\b|\bawait\b")
    why = (
        F.when(_by_language(lambda x: head.rlike(x.marks)), "an annotation or attribute may use it")
        .when(head.rlike(SPECIAL), "called from outside by its modifier")
        .when((F.col("lang") == "C#") & (F.col("kind") == "method") & F.col("plain").rlike(r"\b[A-Z]\w*\.\w+\s*(?:<[^<>]*>)?\("), "it implements an interface")
        .when(field & _by_language(lambda x: owner.rlike(x.marks)), "code may be generated from the fields of its annotated type")
        .when(field & instance & owner.rlike(r"\b(Serializable|Externalizable|Codable|Decodable|Encodable)\b|\bextends\s+[\w.]*(Exception|Error|Throwable)\b") | (field & instance & F.col("uid")), "a field of a serialized type")
        .when(field & instance & (F.col("lang") == "C#") & owner.rlike(r"\bstruct\b"), "the layout of a struct")
        .when(field & runs, "its initial value runs code")
        .when((F.col("kind") == "class") & (F.col("lang") == "C#") & F.col("plain").rlike(r"\b(class|struct|record|interface)\s+\w+[^{(]*:"), "a type that derives from another may be found by a scan")
        .when(F.col("looks"), "this file looks up members by name at run time")
        .when(field & instance & F.col("lang").isin("Java", "Kotlin") & F.col("reflects").isNotNull(), F.concat("reflects", F.lit(" serializes objects by reflection")))
        .when(~partial & F.col("elsewhere").isNotNull(), F.concat("elsewhere", F.lit(" names it")))
        .when(field & (F.col("parts") > 1), "declared together with others")
    )
    scope = F.when(partial, "repo").otherwise(_by_language(lambda x: F.lit(x.scope)))
    kind = F.when((F.col("kind") == "field") & (F.col("lang") == "PHP"), "property").when((F.col("kind") == "field") & F.col("lang").isin("Kotlin", "Swift"), "property").when((F.col("kind") == "method") & F.col("lang").isin("Kotlin", "Swift"), "function").otherwise(F.col("kind"))
    return m.select("repo", "rel", "lang", kind.alias("kind"), "name", F.col("name").alias("show"), F.col("line").cast("int").alias("start"), F.col("end_line").cast("int").alias("end"), scope.alias("scope"), why.isNotNull().alias("keep"), F.coalesce(why, F.lit("")).alias("reason"), F.col("own").cast("int").alias("own"), F.lit("ident").alias("token"), F.lit(None).cast("string").alias("error"))


def outermost(found: DataFrame) -> DataFrame:
    """Findings that lie in no other finding that is to be removed: a member of an unused type goes with it."""
    outer = found.filter("verdict = 'REMOVE' and start < end").select("repo", "rel", F.col("start").alias("from"), F.col("end").alias("to"), F.col("name").alias("outer"))
    inside = (F.col("o.repo") == F.col("f.repo")) & (F.col("o.rel") == F.col("f.rel")) & (F.col("o.from") < F.col("f.start")) & (F.col("o.to") >= F.col("f.end"))
    return found.alias("f").join(outer.alias("o"), inside, "left_anti")


class NestedPack(Pack):
    """Private members of the types of all LANGUAGES, at any depth. Its units are made by joins, so it has none of a single text."""

    languages = tuple(LANGUAGES)

    def units(self, rel, text):
        return iter(())

    def frame(self, files: DataFrame, everything: DataFrame) -> DataFrame:
        return private_members(files, everything)


PACKS = [NestedPack()]
