import time

import pytest
from pyspark.sql import functions as F

from loglattice.functions import fixed_values as fv
from loglattice.functions.text import any_of, truncated, word_initials
from loglattice.operators import documents as docs


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def lines(spark, text, **options):
    got = docs.chunk_lines(one(spark, text), **options).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    return [r["text"] for r in got]


def test_line_chunks_by_hand(spark):
    assert lines(spark, "") == [] == lines(spark, "  \n \n")
    assert lines(spark, "Just one short sentence.") == ["Just one short sentence."]
    # "aaaa\n" and "bbbb\n" fill ten characters; "cccc\n" starts from the last three: "bb\n"
    assert lines(spark, "aaaa\nbbbb\ncccc", size=10, overlap=3) == ["aaaa\nbbbb", "bb\ncccc"]
    assert lines(spark, "aaaa\nbbbb\ncccc", size=10, overlap=0) == ["aaaa\nbbbb", "cccc"]
    # an overlap longer than the chunk repeats all of it
    assert lines(spark, "aa\nbbbbbbbb\ncc", size=6, overlap=50) == [
        "aa", "aa\nbbbbbbbb", "aa\nbbbbbbbb\ncc"]
    assert lines(spark, "Hello world. " * 100) == [("Hello world. " * 100).strip()]  # never cut
    many = lines(spark, "Line number with some content.\n" * 200)
    assert all(0 < len(c) < 2000 for c in many) and len(many) == 15


def by_blocks(text, size, overlap):
    """Chunk by chunk: the overlap, one line, and as many more as fit."""
    lines = [line + "\n" for line in text.split("\n")]
    chunks, head, first = [], "", 0
    while first < len(lines):
        fits = [n for n in range(first + 1, len(lines) + 1)
                if len(head) + sum(map(len, lines[first:n])) <= size]
        stop = max([first + 1, *fits])
        chunk = head + "".join(lines[first:stop])
        chunks.append(chunk.strip())
        head, first = chunk[len(chunk) - min(overlap, len(chunk)):], stop
    return chunks if chunks[-1] else chunks[:-1]


@pytest.mark.parametrize("size, overlap", [(8, 0), (8, 2), (8, 4), (8, 6), (500, 50), (500, 400)])
def test_word_chunks_equal_brute_force(spark, size, overlap):
    length, stride = int(size * 0.75), int(size * 0.75) - int(overlap * 0.75)
    rows = [(n, " \t".join(f"wörd{i}" for i in range(n)) + "\xa0") for n in (1, 5, 6, 7, 12, 13, 40, 999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in docs.chunk_words(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for n, text in rows:
        all_words = text.split()
        assert got[n] == [" ".join(all_words[s:s + length]) for s in range(0, n, stride)]


@pytest.mark.parametrize("size, overlap", [(500, 50), (40, 7), (12, 0), (5, 30)])
def test_line_chunks_equal_brute_force(size, overlap):
    texts = ["é" * i + "\n" * (i % 4) + "word " * (i % 9) + "\n" + "x" * (i * 3 % 17) for i in range(60)]
    texts += ["\n".join(texts), "\n\n\n", "a\n" * 300, " \n" * 300]
    for text in texts:
        assert docs.line_chunks(text, size, overlap) == by_blocks(text, size, overlap)


def test_word_chunks(spark):
    text = "  ".join(f"w{i}" for i in range(700)) + " 　end\n"
    got = docs.chunk_words(one(spark, text)).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["total_chunks"]) for r in got] == [(0, 3), (1, 3), (2, 3)]
    words = text.split()
    assert [r["text"] for r in got] == [" ".join(words[s:s + 375]) for s in (0, 338, 676)]
    assert docs.chunk_words(one(spark, " \n ")).count() == 0 == docs.chunk_words(one(spark, "")).count()
    assert docs.chunk_words(one(spark, None)).count() == 0
    assert docs.chunk_words(one(spark, "x " * 338)).count() == 1


def scrubbed(spark, text, **rules):
    return docs.anonymize_documents(one(spark, text), **rules).first()["text"]


@pytest.mark.parametrize("text, expected", [
    ("Reach me at 555-123-4567 for details.", "Reach me at [PHONE REDACTED] for details."),
    ("Contact: person@example.com", "Contact: [EMAIL REDACTED]"),
    ("Profile: https://linkedin.com/in/someone-real", "Profile: [LINKEDIN REDACTED]"),
    ("Lives at 12 Oak St now", "Lives at [ADDRESS REDACTED] now"),
    ("holds a Top Secret/SCI, TS/SCI or secret clearance", "holds a [CLEARANCE LEVEL], [CLEARANCE LEVEL] or [CLEARANCE LEVEL]"),
    ("I worked at Deloitte.", "I worked at a Big Four professional services firm."),
    ("META and riot games", "a top-3 social media conglomerate and a major gaming company"),
    ("ciónga metaphor", "ciónga metaphor"),  # letters are letters, accented or not
    ("One.\nTranscribed by otter.ai\nTwo.", "One.\n\nTwo."),
    ("One.\ntranscribed by hand\nTranscribed by hand", "One.\ntranscribed by hand"),
    ("First.\n\n\n\n\nSecond. \n", "First.\n\nSecond."),
    ("Ada asked Bo Lind; Adam did not", "the interviewer asked the interviewer; Adam did not"),
    ("costs $1 \\ $2", "costs $1 \\ $2"),
])
def test_anonymize(spark, text, expected):
    assert scrubbed(spark, text, interviewers=["Ada", "Bo Lind"]) == expected


def test_rules_that_are_left_out_would_have_changed_nothing(spark):
    """Every text is what all rules one after the other make of it."""
    parts = ["call ٥٥٥-١٢٣-٤٥٦٧", "a@b.co", "HTTPS://linkedin.com/in/x", "12 Oak st", "TS/ſcı", "ſecret  clearance", "meta",
             "Ada", "ADA\u0301", "bo lind", "x OTTER.AI y\nz", "Transcribed by me", "transcribed by me", "\n\n\n", "1\n\n\n\n2", ""]
    texts = parts + [f"{a} {b}\n{c}" for a, b, c in zip(parts, parts[3:], parts[7:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for people in (["Ada", "Bo Lind"], ["A?da|bo\\s+lind"], []):
        for person_rules in ([], [(r"\boak\b", "Meta 12")]):
            plain = docs.apply_rules(F.col("text"), [*fv.DOCUMENT_PII_RULES, *person_rules, *fv.ORGANISATION_RULES])
            plain = docs.apply_rules(plain, [(rf"\b{p}\b", fv.INTERVIEWER_LABEL) for p in people])
            plain = F.regexp_replace(plain, "(?dimU)" + fv.CREDIT_LINE_ANY_CASE, "")
            plain = F.regexp_replace(plain, "(?dmU)" + fv.CREDIT_LINE_AS_WRITTEN, "")
            plain = docs.strip(F.regexp_replace(plain, r"\n{3,}", "\n\n"))
            got = docs.anonymized(F.col("text"), person_rules=person_rules, interviewers=people)
            assert df.select(plain.alias("a"), got.alias("b")).where("NOT a <=> b").count() == 0


def test_a_rule_is_not_tried_where_its_mark_is_missing(spark):
    """Looking for an address in a run of dotted letters takes time with the square of its length."""
    scrubbed(spark, "x")
    text, begun = "a." * 150_000, time.monotonic()
    assert scrubbed(spark, text) == text
    assert time.monotonic() - begun < 8


def test_every_organisation_rule_is_reached(spark):
    """The combined pattern must let through whatever a single rule matches."""
    examples = {p: p.replace(r"\b", "").replace("?", "").replace(r"\s*", " ") for p, _ in fv.ORGANISATION_RULES}
    rows = [(i, f"at {e.upper() if i % 2 else e}.") for i, e in enumerate(examples.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in docs.anonymize_documents(df).orderBy("doc_id").collect()]
    assert got == [f"at {r}." for _, r in fv.ORGANISATION_RULES]


def test_combined_patterns():
    assert any_of([r"\ba", r"\bb"], "ab") == r"(?iU)\b(?=[ab])(?:(?:a)|(?:b))"
    assert any_of(["a", r"\bb"]) == r"(?iU)(?:(?:a)|(?:\bb))"
    assert word_initials([r"\bAb", "c"]) == "ac" and word_initials([r"\b\d"]) == ""


def test_person_rules_come_with_the_first_step(spark):
    rules = [(r"\bJo\s+Doe\b", "the $candidate")]
    assert scrubbed(spark, "jo  doe of Dell", person_rules=rules) == (
        "the $candidate of a Fortune 100 technology manufacturer")


@pytest.mark.parametrize("stem, expected", [
    ("Deloitte_interview_2024", "interview_2024"),
    ("Ada_first_round_interview", "first_round_interview"),
    ("interview_transcript_otter_ai", "interview_transcript"),
    ("notes (1)  final__v2", "notes_final_v2"),
    ("notes(1)", "notes"),
    ("", "interview_transcript"),
    ("Google", "interview_transcript"),
    ("Riot Games_riot_x", "x"),
])
def test_filenames(spark, stem, expected):
    df = spark.createDataFrame([(stem,)], "stem string")
    assert docs.anonymize_filenames(df, interviewers=["Ada"]).first()["clean_name"] == expected


@pytest.mark.parametrize("text, expected", [
    ("Contact me at real.person@example.com for details", "Contact me at [email redacted] for details"),
    ("Call me at 555-867-5309", "Call me at [phone redacted]"),
    ("https://www.linkedin.com/in/real-person/ HTTPS://LINKEDIN.COM/in/x", "[linkedin redacted] HTTPS://LINKEDIN.COM/in/x"),
    ("12 Oak St and 12 oak st", "[address redacted] and 12 oak st"),
    ("The candidate has 8+ years of consulting experience.", "The candidate has 8+ years of consulting experience."),
    ("JO works", "the candidate works"),
])
def test_redact(spark, text, expected):
    got = docs.redact_pii(one(spark, text), person_rules=[(r"\bJo\b", "the candidate")])
    assert got.first()["text"] == expected


@pytest.mark.parametrize("text, kinds", [
    ("nothing", []),
    ("123-45-6789", ["SSN pattern"]),
    ("call 555.123.4567", ["Phone number"]),
    ("zip 20001-1234", ["SSN pattern", "ZIP code"]),
    ("zip 20001", ["ZIP code"]),
    ("1 Main Ave, 20001", ["ZIP code", "Street address"]),
    ("5551234567", ["Phone number"]),
])
def test_detect_and_withhold(spark, text, kinds):
    assert docs.detect_pii(one(spark, text)).first()["pii_kinds"] == kinds
    withheld = docs.withhold_pii(one(spark, text)).first()["text"]
    assert withheld == (fv.WITHHELD_MESSAGE if kinds else text)


def test_tags(spark):
    files = spark.createDataFrame([
        ("resumes/master-career-file.md", "master-career-file.md"),
        ("resumes/Cloud-PM.md", "Cloud-PM.md"),
        ("resumes/other.md", "other.md"),
        ("transcripts/product.md", "product.md"),
        ("architecture/how.md", "how.md"),
    ], "path string, filename string")
    got = {r["filename"]: (r["type"], r["access_level"], r["role_tag"])
           for r in docs.tag_documents(files).collect()}
    assert got == {
        "master-career-file.md": ("career", "restricted", "general"),
        "Cloud-PM.md": ("resume", "restricted", "pm"),  # `pm` is tried before `cloud`
        "other.md": ("resume", "restricted", "general"),
        "product.md": ("transcript", "public", "general"),
        "how.md": ("architecture", "public", "general"),
    }


def test_denylist(spark):
    files = spark.createDataFrame([
        ("src/a.py", "fine\nJane DOE here\nx"),
        ("src/b.pyc", "Jane Doe"),
        ("src/tests/c.py", "Jane Doe"),
        ("src/scrub.py", "Jane Doe"),
        ("src/d.md", "mail jane.doe@x.org and jane doe"),
    ], "path string, text string")
    patterns = ["# names", "", r"jane\s+doe", r"@x\.org", "absent"]
    hits = docs.denylist_scan(files, patterns)
    assert {(r["path"], r["line_no"], r["pattern"]) for r in hits.collect()} == {
        ("src/a.py", 2, r"jane\s+doe"), ("src/d.md", 1, r"jane\s+doe"), ("src/d.md", 1, r"@x\.org")}
    assert tuple(docs.denylist_verdict(hits).first()) == (3, False)
    assert tuple(docs.denylist_verdict(docs.denylist_scan(files, ["# only"])).first()) == (0, True)


def test_scrub_report(spark):
    files = spark.createDataFrame([("Deloitte_call", "At Deloitte. " + "y" * 600)], "stem string, text string")
    row = docs.corpus_scrub_report(files).first()
    assert row["output_name"] == "call.md"
    assert row["n_chars"] == len(row["text"]) > 600 and row["preview"] == row["text"][:500]


def test_row_wise_operators_do_not_shuffle(spark):
    df = one(spark, "x")
    for result in (docs.chunk_lines(df), docs.chunk_words(df), docs.anonymize_documents(df),
                   docs.redact_pii(df), docs.detect_pii(df)):
        assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()


def test_truncated(spark):
    cut = spark.createDataFrame([("x" * 501,), ("é" * 500,)], "t string").select(truncated(F.col("t"), 500))
    assert [r[0] for r in cut.collect()] == ["x" * 497 + "...", "é" * 500]
