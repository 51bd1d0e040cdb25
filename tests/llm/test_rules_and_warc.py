"""Operators that SQL can express, and what SQL cannot see of them."""

import hashlib
import io
import zipfile

import duckdb
import pytest
from check_oracles import database, difference
from pyspark.sql import functions as F

from loglattice.llm import quality_rules as rules
from loglattice.llm import warc_zip
from loglattice.llm.oracles import ORACLES
from loglattice.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, sf_dir, name):
    con = database(sf_dir)
    assert difference(QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_measures_of_odd_texts(odd_docs, no_docs):
    got = odd_docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    frame = rules.quality_rules(got, fraction=0.5).toPandas()
    con = duckdb.connect()
    con.register("documents", odd_docs.toPandas())
    want = con.execute(ORACLES["op4_quality_rules"].replace("FROM documents", "FROM (SELECT row_number() OVER () AS doc_id, text FROM documents)")).df()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(map(tuple, frame[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
    assert {"lang", "source"} <= set(frame.columns)
    assert rules.quality_rules(no_docs).count() == 0


def test_equal_hashes_are_checked_by_word(spark, monkeypatch):
    """With few bits of hash left every window looks like others; the words decide."""
    docs = spark.createDataFrame([(1, "a b c d e f a b c g h a b c d"), (2, "a a a a"), (3, "a b")], "doc_id long, text string")
    want = {r["doc_id"]: r["n_repeat_words"] for r in rules.word_measures(docs).collect()}
    monkeypatch.setattr(rules, "PLACE_BITS", 62)
    assert {r["doc_id"]: r["n_repeat_words"] for r in rules.word_measures(docs).collect()} == want
    assert want == {1: 11, 2: 4, 3: 0}


def test_rules_are_ordered_by_rejection_per_cost(spark):
    sample = spark.range(2000).withColumn("text", F.lit("x"))
    never, always = rules.Rule("never", F.col("id") < 0), rules.Rule("always", F.col("id") >= 0)
    assert [r.name for r in rules.order_rules(sample, [never, always])][0] == "always"
    verdicts = rules.cascade(sample, [rules.Rule("null", F.lit(None).cast("boolean")), never]).select("kept").distinct().collect()
    assert [r["kept"] for r in verdicts] == [True]


PAGES = [
    (1, "http://a/ü\r\n", "x" * 1000),
    (5, None, "x" * 1000),
    (3, "http://b", "x" * 1000),
    (3, "http://b", "x" * 1000),
    (7, "u", "é" * 500),
    (8, "u", "é" * 499 + "ab"),
    (9, "u", "x" * 999),
    (10, "u", "x" * 999),
    (11, "u", None),
    (None, "u", "x" * 1000),
    (None, "u", "y" * 1000),
    (None, "u", "y" * 1000),
    (12, "u", "line\r\n\r\nWARC/1.1\r\n" * 100),
]


def test_records_of_odd_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc_zip.read_packages(warc_zip.write_packages(pages), payloads=True).collect()
    want = []
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        holder = max((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(raw) >= 1000 else None
        refers = holder if holder is not None and holder != page_id else None
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0))).count() == 0


def test_zip64_directory(monkeypatch):
    """Directories of packages beyond 4 GB, forced at small size; other ZIP readers agree."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    package = warc_zip.Package(out)
    for i in range(20):
        package.add(i, "http://x", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None)
    package.close()
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw
    assert [r["payload"] for r in warc_zip.read_package(io.BytesIO(raw), len(raw))] == [b"p" * i for i in range(20)]
    begin, size = warc_zip.members(io.BytesIO(raw), len(raw))[warc_zip.ARCHIVE]
    assert zipfile.ZipFile(io.BytesIO(raw)).read(warc_zip.ARCHIVE) == raw[begin : begin + size]


def test_broken_packages_are_refused():
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"no zip"), 6)
    record = warc_zip.record(1, None, b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError):
        warc_zip.parse_record(record)
