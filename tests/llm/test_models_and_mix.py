"""Trained scorers on held-out labels and planted cases; mixing and the pipeline against their contracts."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglattice.llm import jaccard_join, labelled, mixing, quality_model, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def held_out(scored, labels, label):
    frame = scored.select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id").toPandas()
    assert (frame["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in frame["doc_id"]]).all()
    frame = frame[frame["held_out"]]
    return (frame["predicted"] == frame[label]).mean()


@pytest.mark.parametrize("module, scores, label", [("quality", quality_model.quality_scores, "quality"), ("toxicity", toxicity.toxicity_scores, "toxic")])
def test_scores(tables, module, scores, label):
    docs, labels = tables
    odd = docs.sparkSession.createDataFrame([(10**6, None), (10**6, ""), (None, "x"), (10**6 + 1, "a" * 300_000)], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("clash"))
    scored = scores(both, labels).cache()
    assert held_out(scored, labels, label) >= 0.9
    assert scored.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    assert scored.count() == both.count() and "lang" in scored.columns
    assert scored.where(f"doc_id = {10**6}").select("score").distinct().count() == 1
    scored.unpersist()
    assert scores(docs.limit(0), labels.limit(0)).count() == 0
    unknown = scores(docs.limit(20), labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in unknown] == [0.5]


def test_restored_words(tables):
    docs, _ = tables
    words = ["idiot", "moron", "stupid", "loser", "trash", "clown", "disgusting"]
    lines = docs.sparkSession.createDataFrame([(" ".join(words * 20),)], "text string")
    restorer = toxicity.Restorer(toxicity.costs(toxicity.character_counts(docs.select("text").union(lines))))
    for disguised, word in [
        ("1d10t", "idiot"), ("id!ot", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("i d i o t", "idiot"), ("l.0.s.e.r", "loser"),
        ("tr@sh", "trash"), ("cl0wn", "clown"), ("stuuuupid", "stupid"), ("looooser", "loser"), ("D-I-S-G-U-S-T-I-N-G", "disgusting"),
    ]:
        assert word in restorer.words(f"so {disguised}, then"), disguised
    assert restorer.words(None) == restorer.words("  ") == set()
    assert restorer.words("plain words") == {"plain", "words"}


@pytest.fixture(scope="module")
def restorer(tables):
    docs, _ = tables
    words = ["idiot", "moron", "stupid", "loser", "trash", "clown", "disgusting"]
    lines = docs.sparkSession.createDataFrame([(" ".join(words * 20),)], "text string")
    return toxicity.Restorer(toxicity.costs(toxicity.character_counts(docs.select("text").union(lines))))


def test_signs_at_any_place(restorer):
    for disguised, word in [
        ("idio+", "idiot"), ("1d107", "idiot"), ("1di0+", "idiot"), ("!diot", "idiot"), ("!d!ot", "idiot"), ("*diot", "idiot"), ("|oser", "loser"),
        ("(lown", "clown"), ("tra$h!", "trash"), ("1diot!!", "idiot"), ("(cl0wn)", "clown"), ("!diot!", "idiot"), ("m0r0n|1d10t", "idiot"),
    ]:
        assert word in restorer.words(f"so {disguised}, then"), disguised
    assert restorer.words("1053 or 10,531") == {"or"}


def test_spaced_words(restorer):
    for disguised, word in [
        ("you are a l o s e r", "loser"), ("I d i o t", "idiot"), ("i d ! o t", "idiot"), ("t/r/a/s/h", "trash"), ("t, r, a, s, h", "trash"), ("t\tr\ta\ts\th", "trash"),
        ("I l o s e r a n d", "loser"), ("(l o s e r!)", "loser"), ("a $ t u p 1 d c l o w n", "stupid"), ("a $ t u p 1 d c l o w n", "clown"), ("i * d * i * o * t", "idiot"),
        ("l|o|s|e|r", "loser"), ("i  d i - o t", "idiot"), ("l\no\ns\ne\nr", "loser"), (" ".join("whatonecansayisthatyouallareidiots"), "idiot"),
    ]:
        assert word in restorer.words(f"so {disguised}, then"), disguised
    assert "loser" in restorer.words("b " * 5_000 + "l o s e r" + " b" * 5_000)
    assert restorer.words("1 0 5 3 1 0") == set()


def test_repeated_letters(restorer):
    for disguised, word in [
        ("st" + "u" * 40 + "pid", "stupid"), ("iiddiioott", "idiot"), ("sttuuppiidd", "stupid"), ("stuupid", "stupid"), ("l" + "0" * 50 + "ser", "loser"),
        ("i" * 30 + "d" * 30 + "i" * 30 + "0" * 20 + "t" * 9, "idiot"), ("m0r0n" + "!" * 60, "moron"), ("l o o o o s e r", "loser"),
    ]:
        assert word in restorer.words(f"so {disguised}, then"), disguised
    assert "idiot" in restorer.words("ab" * 150_000 + " 1d10t")


@pytest.mark.parametrize("bad", ["zły", "дурак", "μωρό", "傻瓜", "ass", "głupi"])
def test_short_words_and_other_letters(spark, bad):
    good = ["kot", "дом", "σπίτι", "天气", "tea", "źródło"]
    texts = [(i, (f"{good[i % 6]} {bad} {good[i // 6 % 6]}" if bad != "傻瓜" else f"天{bad}气{i}") if i % 2 else f"{good[i % 6]} 天气 {good[i // 6 % 6]}", i % 2) for i in range(200)]
    scored = toxicity.toxicity_scores(spark.createDataFrame(texts, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    assert scored.where("predicted <> y").count() == 0


def test_letters_beyond_latin_1(restorer):
    for disguised, word in [("д у р а к", "дурак"), ("дуррррак", "дурак"), ("gł0wa", "głowa"), ("傻 瓜", "傻"), ("你是傻瓜吗", "傻瓜"), ("nai\u0308ve", "naïve")]:
        assert word in restorer.words(f"so {disguised}, then"), disguised


def test_logistic_and_folds(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] + 0.5)))).astype(int)
    assert np.allclose(labelled.logistic(x, y), [2.0, -1.0, 0.5], atol=0.3)
    got = spark.range(200).select("id", labelled.fold("id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_targets(odd_docs, no_docs):
    docs = odd_docs.withColumn("size", F.lit("clash")).withColumn("pattern", F.lit("clash"))
    taken, about = mixing.mix(docs, F.array("source"), mixing.cycled)
    rows = taken.collect()
    sizes = {}
    for r in odd_docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + n_words(r["text"])
    aims = {r["source"]: r for r in about.collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert {s: aims[s]["source_size"] for s in names} == sizes
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, left, want = list(names), float(sum(sizes.values())), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        want |= share if not over else {s: 3.0 * sizes[s] for s in over}
        left -= sum(want[s] for s in over)
        open_ = [s for s in open_ if s not in want]
    for s in names:
        assert aims[s]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rows if r["sources"][0] == s) - want[s]) <= 2
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows) and len(rows) == odd_docs.count()
    again = mixing.mix(odd_docs.repartition(5), F.array("source"), mixing.cycled)[0].collect()
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["taken"]) for r in again))) == sorted(map(repr, ((r["doc_id"], r["size"], r["taken"]) for r in rows)))
    assert mixing.mix(no_docs, F.array("source"), mixing.cycled)[0].count() == 0


def test_pipeline_mixes_whole_copies(spark, odd_docs):
    mixed = corpus_pipeline.mixed_documents(spark, odd_docs, SF).collect()
    texts = {r["text"] for r in odd_docs.collect()}
    assert mixed and all(r["text"] in texts for r in mixed)
    got, about = {}, mixing.mix(odd_docs, F.array("source"), mixing.cycled)[1].collect()
    for r in mixed:
        got[r["source"]] = got.get(r["source"], 0) + n_words(r["text"])
    for r in about:
        longest = max(n_words(d["text"]) for d in odd_docs.where(F.col("source").eqNullSafe(r["source"])).collect())
        assert abs(got.get(r["source"], 0) - r["target"]) <= longest / 2 + 2


def test_flow_is_cheapest():
    """Against all whole-number flows of small networks."""
    import itertools

    rng = np.random.default_rng(7)
    for _ in range(25):
        sizes = rng.integers(1, 4, 2).tolist()
        members = [sorted(set(rng.integers(0, 2, 2).tolist())) for _ in sizes]
        quotas = rng.integers(0, 6, 2).tolist()
        flow = mixing.min_cost_flow(sizes, members, quotas, 2)

        def price(amounts):
            total = sum(a - s if a > s else 0 for a, s in zip(amounts, sizes))
            return (-sum(amounts), total)

        best = min(
            price([sum(f) for f in both])
            for both in itertools.product(*(
                [f for f in itertools.product(*(range(quotas[s] + 1) if s in m else [0] for s in range(2))) if sum(f) <= 2 * n]
                for n, m in zip(sizes, members)
            ))
            if all(sum(f[s] for f in both) <= quotas[s] for s in range(2))
        )
        assert price([sum(f.values()) for f in flow]) == best
        assert all(set(f) <= set(m) for f, m in zip(flow, members))


def test_pipeline_stages(spark, tables):
    docs, labels = tables
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        kept = stage(spark, kept, SF)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        path = f"{corpus_pipeline.written(kept, 'test-stage').inputFiles()[0].rsplit('/', 1)[0]}"
        kept = spark.read.parquet(path)
        sizes.append((before.count(), kept.count()))
    assert sizes[0][1] < sizes[0][0] and sizes[1][1] < sizes[1][0] and sizes[2][1] == sizes[2][0]
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    first = {r["doc_id"] for r in corpus_pipeline.good_documents(spark, docs, SF).select("doc_id").collect()}
    assert len(good - first) <= 0.03 * len(good)
    pieces = corpus_pipeline.packed_sequences(spark, kept, SF).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
    assert pieces.groupby("uid")["length"].sum().sum() == pieces.groupby("uid")["doc_tokens"].first().sum()
    assert pieces["uid"].nunique() == kept.count()


def test_near_copies_in_the_pipeline_meet_in_few_blocks(spark, monkeypatch):
    """The stage moves a near copy once per block of its group, however many there are, and keeps one document per group."""
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    written = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rng = np.random.default_rng(15)
    words, rows = [f"w{i}" for i in range(120)], [(10**6, "some other text of seven words", "en", "a", 0)]
    for i in range(300):
        some = list(words)
        for k in rng.integers(0, 120, int(rng.integers(0, 9))):
            some[k] = f"x{i}"
        rows.append((i, " ".join(some), "en", "a", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    distinct = {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs, SF).collect()}
    runs = {r[0]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in rows for w in [r[1].split()]}
    near = {a: [b for b in runs if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])] for a in runs}
    first, before = {a: min(near[a]) for a in near}, None
    while first != before:
        first, before = {a: min(first[b] for b in near[a]) for a in near}, first
    assert distinct == set(first.values()) and len(distinct) < 250
    sides = tables["block-pairs"].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    times = sides.join(tables["band-members"], "block").groupBy("class").count()
    assert times.agg(F.max("count")).first()[0] <= jaccard_join.SPLIT


def test_scores_remember_chunks_and_not_texts():
    """A chunk that comes again is not read again, and what is remembered changes no number."""
    table = toxicity.costs(np.ones(toxicity.BASE**toxicity.ORDER))
    weights = {"idio": 3.0, "idiot$": 2.0, "bad$": -0.5, "hate$": 1.0}
    texts = ["You 1diot!!", "h a t e you", "bad", "an idiot, 1diot h a t e", "", None, "bad h a t e bad", "idiots hatee"]
    scorer = toxicity.Scorer(table, weights)
    read = []
    words_of = scorer.restorer.words_of
    scorer.restorer.words_of = lambda chunk: read.append(chunk) or words_of(chunk)
    first = [scorer.numbers(t) for t in texts]
    assert len(read) == len(set(read))
    assert [scorer.numbers(t) for t in texts] == first and len(read) == len(set(read))
    for text, numbers in zip(texts, first):
        words = toxicity.Restorer(table).words(text)
        found = [x for w in words if (x := max((weights.get(f, 0.0) for f in toxicity.features(w)), default=0.0))]
        assert numbers == (max(found, default=0.0), math.log1p(len(found)))
