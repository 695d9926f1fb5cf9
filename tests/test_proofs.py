"""Proofs and judgements as tables against the same steps taken one after another in plain Python."""

import random

from corvane.operators import jury, proofs


def plain(items, passes, broken, loaded, limit):
    """file -> proof of one repository's (file, why_not) in order; passes(set of files) -> (ok, output)."""
    out = {f: why for f, why in items if why}
    todo = [f for f, why in items if not why]
    if not broken and loaded is not None:
        out |= {f: "not provable (the tests never load this file)" for f in todo if f not in loaded}
        todo = [f for f in todo if f in loaded]
    if broken:
        return out | {f: "not provable (the tests fail before any change)" for f in todo}
    if not todo or passes(todo)[0]:
        return out | dict.fromkeys(todo, "passed")
    alone = []
    for i, f in enumerate(todo):
        ok, said = passes([f])
        if i >= limit:
            out[f] = "not run (isolation limit)"
        elif ok:
            alone.append(f)
        else:
            out[f] = said if said.startswith("compile error") else "failed: " + said.strip().split("\n")[-1][:200]
    if passes(alone)[0]:
        return out | dict.fromkeys(alone, "passed")
    kept = []
    for f in alone:
        ok, said = passes([*kept, f])
        if ok:
            kept.append(f)
            out[f] = "passed"
        else:
            out[f] = "failed together with other removals: " + said.strip().split("\n")[-1][:160]
    return out


def test_rounds(spark):
    r = random.Random(8)
    repos, rows, rules = {}, [], {}
    for k in range(24):
        files = [f"f{i:02d}" for i in range(r.choice([0, 1, 3, 8, 12]))]
        items = [(f, r.choice([None] * 9 + ["not provable (test code)"])) for f in files]
        need, clash = {f for f in files if r.random() < 0.1 * (k % 4)}, [set(r.sample(files, 2)) for _ in range(k % 3) if len(files) > 1]
        odd = {f for f in files if r.random() < 0.05}
        loaded = None if k % 5 else {f for f in files if r.random() < 0.8} | {"always"}

        def passes(some, need=need, clash=clash, odd=odd):
            some = set(some)
            if some & odd:
                return False, f"compile error: line {len(some)}"
            if some & need:
                return False, "trace\n  more\nAssertionError: " + "x" * 300 + "\n\n"
            if any(c <= some for c in clash):
                return True, "3 passed, 1 skipped"  # a run that skips a test counts as failed
            return True, "4 passed"

        repos[f"r{k}"] = (items, passes, k % 7 == 6, loaded)
        rows += [(f"r{k}", f, 1, "import", "x", why) for f, why in items]
    candidates = spark.createDataFrame(rows, "repo string, file string, line int, kind string, name string, why_not string")
    seen = spark.createDataFrame([(k, f) for k, (*_, loaded) in repos.items() for f in loaded or ()], "repo string, rel string")
    rounds = []

    def execute(runs):
        by = {}
        for x in runs.collect():
            by.setdefault((x.repo, x.run), []).extend([x.file] if x.file else [])
        rounds.append(len(by))
        out = []
        for (repo, run), some in by.items():
            items, passes, broken, _ = repos[repo]
            out.append((repo, run, *((not broken, "4 passed") if run == "baseline" else passes(some))))
        return spark.createDataFrame(out, "repo string, run string, ok boolean, output string")

    s = proofs.prove(candidates, execute, seen, isolate=6)
    got = {}
    for x in proofs.settled(s).collect():
        got.setdefault(x.repo, {})[x.file] = x.proof
    fewer = "fewer tests passed than before any change, or more were skipped"
    want = {k: plain(items, lambda some, p=passes: (False, fewer) if p(some)[1].startswith("3 passed") else p(some), broken, loaded, 6) for k, (items, passes, broken, loaded) in repos.items() if items}
    assert got == want and len(rounds) <= 10 and any("together" in p for w in want.values() for p in w.values()) and any("limit" in p for w in want.values() for p in w.values())
    sums = {x.repo: x for x in proofs.summary(s).collect()}
    assert {k: x.passed for k, x in sums.items()} == {k: sum(p == "passed" for p in w.values()) for k, w in want.items()}
    assert all((x.batch == "baseline failed") == repos[k][2] for k, x in sums.items())
    assert proofs.prove(candidates.limit(0), execute).count() == 0


def test_a_lost_round_is_asked_for_again(spark):
    c = proofs.numbered(spark.createDataFrame([("r", "a", 1, "import", "x", None), ("r", "b", 1, "import", "y", None)], "repo string, file string, line int, kind string, name string, why_not string"))
    done = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "repo string, run string, ok boolean, output string")
    ask = lambda *rows: sorted((x.run, x.name) for x in proofs.next_runs(proofs.state(c, done(*rows))).collect())
    assert ask() == [("baseline", None)] and ask(("baseline", True, "")) == [("batch", "x"), ("batch", "y")]
    some = [("baseline", True, ""), ("batch", False, ""), ("single:1", True, "")]
    assert ask(*some) == [("single:2", "y")] and ask(*some, ("single:2", True, "")) == [("together", "x"), ("together", "y")]
    some += [("single:2", True, ""), ("together", False, "")]
    assert ask(*some) == [("grow:1", "x")] and ask(*some, ("grow:1", True, "")) == [("grow:2", "x"), ("grow:2", "y")] and ask(*some, ("grow:1", True, ""), ("grow:2", False, "")) == []


def test_judging_in_order(spark):
    r = random.Random(4)
    rows, answers, want = [], [], {}
    for k in range(40):
        failed = judged = 0
        for i in range(r.randrange(0, 14)):
            verdict, decision = r.choice(["REMOVE", "AMBIGUOUS", "SIMPLIFY"]), r.choice(["REMOVE", "KEEP", None, None] if k % 2 else ["REMOVE", "KEEP", "KEEP", None])
            rows.append((f"r{k}", f"f{i:02d}", 1, "x", verdict))
            answers.append((f"r{k}", f"f{i:02d}", 1, "x", decision))
            default = "REMOVE" if verdict == "REMOVE" else "KEEP"
            if verdict == "SIMPLIFY":
                w = ("SIMPLIFY", None)
            elif failed >= 2:
                w = (default, "row")
            elif judged >= 6:
                w = (default, "budget" if verdict == "AMBIGUOUS" else None)
            else:
                judged += 1
                failed = failed + 1 if decision is None else 0
                w = (decision or default, None if decision else "call")
            want[f"r{k}", f"f{i:02d}"] = w
    f = spark.createDataFrame(rows, "repo string, file string, line int, name string, verdict string")
    a = spark.createDataFrame(answers, "repo string, file string, line int, name string, decision string")
    got = {(x.repo, x.file): (x.final, next((w for w in ("row", "budget", "call") if x.note and w in x.note), None)) for x in jury.judged_in_order(f, a, limit=6).collect()}
    assert got == want
