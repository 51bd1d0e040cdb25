"""The pattern index finds what trying every pattern on every line finds."""

import random
import re

import pytest

from loglattice.operators import pattern_index as pi
from loglattice.operators.documents import denylist_scan


@pytest.mark.parametrize("pattern, runs", [
    ("Jane Doe", ["jane doe"]), (r"jane\s+doe", ["jane", "doe"]), (r"@x\.org", ["@x.org"]), ("colou?rs", ["colo"]),
    ("abc|def", []), ("(abc|def)ghi", ["ghi"]), ("abc[xyz]def", ["abc", "def"]), ("abcd*", ["abc"]), ("abcd{0,3}efg", ["abc", "efg"]),
    ("abcd+", ["abcd"]), (r"\x41bcdef", []), (r"\Qabc\E", []), ("(?i)abc", []), ("(?:abc)?defg", ["defg"]), ("ab.cd", []), ("é-abc", ["-abc"]),
    (r"abc\(def", ["abc(def"]), ("[abc", []), ("(abc", []), ("[]abc]def", []), (r"(a\)b)cdef", ["cdef"]), ("[(]abc", ["abc"]), ("^abc$", ["abc"]),
    ("a{2}bcd", ["bcd"]), ("abc\\", []), ("(a(?=b)c)def", []), (r"\bword\b", ["word"]), ("", []),
])
def test_required_runs(pattern, runs):
    assert pi.required_runs(pattern) == runs


def test_five_thousand_patterns_one_by_one(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(600)]
    shapes = [r"{a}\s+{b}", "{a}", r"\b{a}\b", "{a}|{b}", "{a}.?{b}", "[xy]{a}", "({a}|{b})z", "{a}+", r"{a}\.{b}", "{a}{b}*"]
    patterns = [rng.choice(shapes).format(a=rng.choice(words), b=rng.choice(words)) for _ in range(5000)]
    lines = [(n, rng.choice([" ", "  ", ".", ""]).join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 9)))) for n in range(120)]
    lines += [(500, None), (501, ""), (502, "ab"), (503, "x" * 50_000 + "abcdef")]
    frame = spark.createDataFrame(lines, "n int, line string")
    got = {}
    for r in pi.pattern_hits(frame, patterns).collect():
        got[r["n"], r["pattern"]] = got.get((r["n"], r["pattern"]), 0) + 1
    want = {}
    for p in patterns:
        tried = re.compile(p, re.I).search
        for n, line in lines:
            if line is not None and tried(line):
                want[n, p] = want.get((n, p), 0) + 1
    assert got == want and len(want) > 1000
    keyed, others = pi.pattern_keys(patterns)
    assert len(keyed) > 2000 and len(keyed) + len(others) == 5000


def test_the_plan_does_not_grow(spark):
    frame = spark.createDataFrame([(1, "x")], "n int, line string")
    sizes = [
        len(pi.pattern_hits(frame, [f"pattern number {i}" for i in range(n)])._jdf.queryExecution().executedPlan().toString())
        for n in (10, 5000)
    ]
    assert abs(sizes[0] - sizes[1]) < 100


def test_letters_that_fold_to_ascii_and_scans(spark):
    lines = [(1, "deſK top"), (2, "lİne"), (3, "lıNE"), (4, "desk"), (5, "Straße"), (6, "none")]
    frame = spark.createDataFrame(lines, "n int, line string")
    hits = {(r["n"], r["pattern"]) for r in pi.pattern_hits(frame, ["desk", "line", "straße", "zz"]).collect()}
    one_by_one = {(r["line_no"], r["pattern"]) for r in denylist_scan(
        spark.createDataFrame([("a.py", "\n".join(t for _, t in lines))], "path string, text string"), ["desk", "line", "straße", "zz"]).collect()}
    assert hits == one_by_one == {(1, "desk"), (2, "line"), (3, "line"), (4, "desk"), (5, "straße")}
    files = spark.createDataFrame([("src/a.py", "fine\nJane DOE"), ("tests/b.py", "jane doe")], "path string, text string")
    got = pi.denylist_scan_indexed(files, ["# note", "", r"jane\s+doe", "x?"])
    assert {(r["path"], r["line_no"], r["pattern"]) for r in got.collect()} == {("src/a.py", 2, r"jane\s+doe"), ("src/a.py", 1, "x?"), ("src/a.py", 2, "x?")}
    assert pi.pattern_hits(frame, []).count() == 0
