"""Repeated passages, near copies and linked vectors against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import jaccard_join, suffix_dedup, vector_links
from loglattice.llm.common import components


def cut_by_force(rows, window=200):
    """(bytes, removed, spans, hash of the rest) of every text."""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        mark = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                mark[i : i + window] = True
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), int(mark.sum()), int((np.diff(mark.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


REPEATS = ["a" * 500, "a" * 199, "ab" * 300, "éà" * 90 + "x", "y" + "éà" * 90 + "x" * 60 + "z", "xyz" * 66 + "q", "xyz" * 66 + "qrr", "b" * 200, "cb" + "b" * 199]


def test_passages(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    letters = "".join(chr(97 + i) for i in rng.integers(0, 4, 3000))
    # Copies of one text with an edit at different places: partners of finished groups must stay.
    edited = [letters[:k] + "#" + letters[k:] for k in (150, 700, 701, 2400)] + [letters, letters, letters[900:1250]]
    more = spark.createDataFrame([(1000 + i, t, "en", "a", 0) for i, t in enumerate(REPEATS + edited)], odd_docs.schema)
    docs = odd_docs.union(more)
    got = suffix_dedup.dedup_passages(docs.withColumn("uid", F.lit("clash")).withColumn("spans", F.lit("own")))
    assert "source" in got.columns
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect())
    rows = docs.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, cut_by_force([r["text"] for r in rows])))
    assert found == want
    assert sum(x[2] for x in want) > 0
    assert suffix_dedup.dedup_passages(no_docs).count() == 0


def test_passages_of_the_shared_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = suffix_dedup.dedup_passages(docs).collect()
    want = {r["doc_id"]: x for r, x in zip(rows, cut_by_force([r["text"] for r in rows]))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_threshold_is_checked(no_docs):
    with pytest.raises(ValueError):
        suffix_dedup.dedup_passages(no_docs, threshold=50)


def runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def links_by_force(rows, threshold=0.8):
    """key -> (class, links, kept) of rows with distinct places; rows that share a key are listed."""
    sets = [runs(t) if k is not None else frozenset() for k, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return [(rows[i][0], min((rows[j][0] for j in groups[root(i)] if rows[j][0] is not None), default=None), n[i]) for i in range(len(rows))], len(groups)


def test_near_copies(odd_docs, no_docs):
    docs = odd_docs.withColumn("set", F.lit("clash")).withColumn("class", F.lit("clash"))
    got = jaccard_join.jaccard_links(docs).collect()
    want, groups = links_by_force([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert sorted(map(repr, ((r["doc_id"], r["class_id"], r["n_links"]) for r in got))) == sorted(map(repr, want))
    assert sum(r["kept"] for r in got) == groups
    assert all(r["doc_id"] == r["class_id"] for r in got if r["kept"])
    assert jaccard_join.jaccard_links(no_docs).count() == 0


def test_near_copies_in_many_blocks(spark, monkeypatch):
    """One large group of near copies over several blocks: all links are counted, none twice."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(60):
        some = list(words)
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            some[k] = f"x{i}"
        rows.append((i, " ".join(some)))
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = links_by_force(rows)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted(want)


def test_near_copies_of_the_shared_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = jaccard_join.jaccard_links(docs).collect()
    want, _ = links_by_force([tuple(r) for r in docs.collect()])
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted(want)


def test_posterior_keeps_likely_pairs():
    """The bound is the exact tail of the Beta posterior, and true pairs are all but never dropped."""
    least = jaccard_join.least_matches(0.8, 1e-9)
    for n, m in list(least.items())[:3]:
        def tail(k):
            grid = (np.arange(200_000) + 0.5) / 200_000
            density = grid**k * (1 - grid) ** (n - k)
            return density[grid >= 0.8].sum() / density.sum()

        assert tail(m) >= 1e-9 and (m == 0 or tail(m - 1) < 1e-9)
    assert all(b >= a for a, b in itertools.pairwise(least.values()))
    assert math.isclose(jaccard_join.BANDS * jaccard_join.ROWS, max(least))


def vectors_by_force(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=float)
        v = v / np.abs(v).max()
        return v / np.sqrt((v * v).sum())

    units = [unit(r[1]) for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = units[i], units[j]
        if a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2] and a @ b >= threshold:
            n[i] += 1
            n[j] += 1
            parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(ids[i])
    return [(ids[i], n[i], min(groups[root(i)])) for i in range(len(rows))]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 64)
    rng = np.random.default_rng(10)
    rows, centres = [], rng.standard_normal((40, 32))
    for i in range(400):
        v = centres[rng.integers(40)] + rng.standard_normal(32) * rng.choice([0.1, 0.25, 0.4])
        rows.append((i, [float(x) for x in v], int(rng.integers(3)) if i % 50 else None))
    rows += [
        (1000, None, 1), (1001, [0.0] * 32, 1), (1002, [], 1), (1003, [float("nan")] * 32, 1), (1004, [float("inf")] + [1.0] * 31, 1),
        (1005, [None] + [1.0] * 31, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [1e300] * 32, 1), (1009, [1e-300] * 32, 1),
        (1010, [1.0] * 32, 1), (1011, [1.0] * 32, 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("clash"))
    got = [tuple(r) for r in vector_links.linked_vectors(frame).collect()]
    want = vectors_by_force(rows)
    assert sorted((a, b, c) for a, b, c, _ in got) == sorted(want)
    assert all(kept == (a == c) for a, _, c, kept in got)
    assert vector_links.linked_vectors(frame.limit(0)).count() == 0


def test_collisions_are_counted_in_windows():
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((30, 7)), rng.standard_normal((20, 7))
    want = (np.abs(a[None, :, :] - b[:, None, :]) <= 0.4).sum(axis=2)
    assert (vector_links._collisions(a, b, 0.4) == want).all()


def test_calibration_reaches_its_recall():
    reach, least = vector_links.calibrate(0.93, 48, 0.9999)
    rng = np.random.default_rng(12)
    hits = (np.abs(rng.standard_normal((20_000, 48))) * math.sqrt(2 - 2 * 0.93) <= reach).sum(axis=1)
    assert (hits >= least).mean() >= 0.999


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (3, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, **{i: 100 for i in range(100, 161)}}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_are_not_fetched_by_a_join(spark, monkeypatch):
    """They are most of what a class has: each join on them moves them once more."""
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    docs = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_links(docs).collect()}
    assert got == {i: (i % 3, 1) for i in range(6)}
    assert "Join" not in plans["shared-bands"] and plans["band-stars"].count("Join") == 1


def test_a_class_brings_its_shared_bands_along(spark, monkeypatch):
    """Whatever the size of a group of near copies, a class is one row until its bands are dealt out, and nothing joins them again."""
    rows, plans = {}, {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        frame = written(df, name)
        rows.setdefault(name, []).append(frame.count())
        return frame

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    words = [f"w{i}" for i in range(120)]
    for n in (20, 40):
        docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(n)], "doc_id long, text string")
        assert {(r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_links(docs).collect()} == {(0, n - 1)}
    assert rows["band-stars"] == rows["band-blocks"] == [20, 40]
    assert "Join" not in plans["blocks-in-bands"]


def test_a_group_is_moved_few_times(spark, monkeypatch):
    """However many classes a group of near copies has, each is moved once per block, and blocks are cut by bytes."""
    pairs = []

    def kept(df, name):
        frame = written(df, name)
        if name == "block-pairs":
            pairs.append(frame.count())
        return frame

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(120)]
    for n in (60, 120):
        docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(n)], "doc_id long, text string")
        assert {(r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_links(docs).collect()} == {(0, n - 1)}
    most = jaccard_join.SPLIT
    assert max(pairs) <= most * (most + 1) // 2


def test_near_copies_meet_in_few_blocks(spark, monkeypatch):
    """Near copies have their smallest neighbours in many places; each is still moved about once per block of the whole group."""
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(120)]
    most = []
    for n in (100, 200):
        rows = []
        for i in range(n):
            some = list(words)
            for k in rng.integers(0, 120, int(rng.integers(0, 9))):
                some[k] = f"x{i}"
            rows.append((i, " ".join(some)))
        got = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted(links_by_force(rows)[0])
        sides = tables["block-pairs"].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
        most.append(sides.join(tables["band-members"], "block").groupBy("class").count().agg(F.max("count")).first()[0])
    assert max(most) <= jaccard_join.SPLIT
