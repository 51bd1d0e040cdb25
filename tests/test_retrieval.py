import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglattice.functions.vectors import block_candidates, nearest_in_block, unit_rows
from loglattice.operators import profiles, retrieval
from loglattice.plans import derived as d
from loglattice.schemas import PROFILE, SKILL_ANALYSIS


@pytest.fixture(scope="module")
def cloud(spark):
    """300 vectors around ten centres; a third of them are copies of one."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(10, 16))
    points = [centres[i % 10] + 0.3 * draw.normal(size=16) for i in range(200)]
    points += [points[0]] * 100
    rows = [(i, [float(x) for x in p], "abc"[i % 3]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp string").cache()


def as_queries(vectors, n=40):
    return vectors.where(F.col("vec_id") < n).withColumnRenamed("vec_id", "query_id")


def brute(queries, vectors, k, match=None):
    """(query, neighbour ids) by plain Python."""
    def cosine(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    rows, found = vectors.collect(), {}
    for q in queries.collect():
        allowed = [v for v in rows if match is None or v[match] == q[match]]
        ranked = sorted((round(cosine(q["embedding"], v["embedding"]), 9), v["vec_id"]) for v in allowed)
        found[q["query_id"]] = [v for _, v in ranked[:k]]
    return found


def ids(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("block_rows", [4096, 16])
@pytest.mark.parametrize("match", [None, "grp"])
def test_exact_search_on_both_paths(spark, cloud, monkeypatch, block_rows, match):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)  # many blocks on either side
    queries = as_queries(cloud)
    hits = retrieval.cosine_top_k(queries, cloud.repartition(7), 5, match, block_rows=block_rows)
    assert ids(hits) == brute(queries, cloud, 5, match)
    assert [r["rank"] for r in hits.where("query_id = 0").orderBy("rank").collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("match", [None, "grp"])
def test_blocked_search_has_no_cross_join(cloud, match):
    hits = retrieval.cosine_top_k(as_queries(cloud), cloud, match=match, block_rows=16)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_fewer_vectors_than_k_and_none(spark, cloud):
    queries = as_queries(cloud, 3)
    assert retrieval.cosine_top_k(queries, cloud.limit(2), 5).count() == 6
    for rows in (4096, 16):
        assert retrieval.cosine_top_k(queries, cloud.limit(0), 5, block_rows=rows).count() == 0
        assert retrieval.cosine_top_k(queries.limit(0), cloud, 5, block_rows=rows).count() == 0


def test_distance_range_and_zero_vector(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0]), (3, [0.0, 0.0])],
                              "vec_id long, embedding array<float>")
    got = retrieval.cosine_top_k(as_queries(v, 1), v, 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["distance"]) for r in got] == [(0, 0.0), (1, 1.0), (3, 1.0), (2, 2.0)]


def test_block_ties_go_to_the_first_row():
    block = unit_rows([[1, 0], [0, 1], [1, 0], [2, 0]])
    rows, cols, found = nearest_in_block(unit_rows([[1, 0]]), block, 2)
    assert (rows.tolist(), cols.tolist(), found.tolist()) == ([0, 0], [0, 2], [0.0, 0.0])


def test_a_block_needs_no_array_of_all_pairs():
    rows = unit_rows(np.random.default_rng(4).normal(size=(5000, 16)))
    rows[1000:3000] = rows[0]  # copies tie with their k-th
    block = pd.DataFrame({"id": np.arange(5000), "vector": list(rows)})
    tracemalloc.start()
    got = block_candidates(np.arange(5000), rows, block, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    asked = [0, 2500, 4000]
    every = np.round(1 - (rows[asked][:, None] * rows[None]).sum(axis=2), 9)
    want = [[q, v] for q, row in zip(asked, every) for v in np.lexsort((np.arange(5000), row))[:3]]
    assert got[got["query"].isin(asked)][["query", "id"]].to_numpy().tolist() == want


def test_longer_rows_than_one_are_not_left_out():
    rows = np.random.default_rng(5).normal(size=(600, 32))
    block = 1000 + rows  # far from length one, and near each other
    queries = unit_rows(rows[:50])
    exact = 1.0 - queries @ block.T
    found = nearest_in_block(queries, block, 4, 40)[1].reshape(50, 4)
    assert (found == np.argsort(exact, axis=1, kind="stable")[:, :4]).all()


@pytest.mark.parametrize("keyed", [False, True])
def test_rows_are_not_sent_to_more_blocks_as_a_table_grows(spark, keyed):
    def candidates(n):
        queries, rows = (
            spark.range(n).select(F.col("id").alias(name), F.array(F.rand(1), F.rand(2)).alias("vector"), F.lit("").alias("key"))
            for name in ("query", "id")
        )
        schema = retrieval._candidate_schema(queries, rows)
        return retrieval._blocked_candidates(queries, rows, schema, 1, keyed, 16).count()

    assert candidates(400) <= 8 * 400
    assert candidates(1600) <= 4 * candidates(400)


@pytest.mark.parametrize("match", [None, "grp"])
def test_exact_search_over_blocks_cut_by_bytes(cloud, monkeypatch, match):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 20 * 16 * 8)  # 20 rows of 16 dimensions
    queries = as_queries(cloud)
    assert ids(retrieval.cosine_top_k(queries, cloud, 5, match)) == brute(queries, cloud, 5, match)


@pytest.mark.parametrize("match", [None, "grp"])
def test_approximate_search_recall(cloud, match):
    queries = as_queries(cloud)
    exact = retrieval.cosine_top_k(queries, cloud, 5, match).select("query_id", "vec_id")
    near = retrieval.ann_top_k(queries, cloud, 5, match)
    assert near.select("query_id", "vec_id").distinct().count() == near.count()
    assert near.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * exact.count()
    assert near.groupBy("query_id").count().where("count > 5").count() == 0


def test_public_mode_filters_before_ranking(cloud):
    vectors = cloud.withColumn("access_level", F.when(F.col("grp") == "a", "public").otherwise("restricted"))
    public = retrieval.filtered_top_k(as_queries(cloud), vectors, "public")
    assert public.count() == 200  # five each, all of them public
    assert public.join(vectors.where("grp <> 'a'"), "vec_id").count() == 0
    every = retrieval.filtered_top_k(as_queries(cloud), vectors, "all")
    assert ids(every) == brute(as_queries(cloud), cloud, 5)


@pytest.mark.parametrize("question, interview, architecture", [
    ("Tell me about a time you failed", True, False),
    ("What's your biggest weakness?", True, False),
    ("What is the tech stack?", False, True),
    ("How is this DEPLOYED?", False, True),
    ("What certifications?", False, False),
    ("needle in a haystack of storage", False, True),  # plain substrings
])
def test_routing(spark, question, interview, architecture):
    df = spark.createDataFrame([(1, question)], "question_id long, question string")
    row = retrieval.route_tiers(df).first()
    assert (row["needs_interview"], row["needs_architecture"]) == (interview, architecture)


@pytest.fixture
def results(spark):
    asked = spark.createDataFrame([
        (1, "Tell me about a time", [1.0, 0.0]),
        (2, "tech stack and a conflict", [0.0, 1.0]),
        (3, "plain", [-1.0, 0.0]),
    ], "question_id long, question string, embedding array<float>")
    vectors = spark.createDataFrame([
        ("resume", "chunk_0", "r" * 300, [1.0, 0.0]), ("resume", "chunk_1", "r1", [1.0, 1.0]),
        ("interview", "iv_0", "i0", [0.0, 1.0]),
    ], "tier string, chunk_id string, text string, embedding array<float>")
    return retrieval.retrieve_tiers(asked, vectors, k=2)


def test_tiered_retrieval_with_approximate_search(spark):
    vectors = [[math.cos(a), math.sin(a)] for a in (0.0, 0.01, 3.0)]
    stored = spark.createDataFrame(
        [("resume", f"chunk_{i}", f"t{i}", v) for i, v in enumerate(vectors)],
        "tier string, chunk_id string, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "plain", vectors[0])],
                                  "question_id long, question string, embedding array<float>")
    row = retrieval.retrieve_tiers(asked, stored, 2, retrieval.ann_top_k).first()
    assert row["resume_chunks"] == ["t0", "t1"] and row["top_distance"] == 0.0


def test_tiered_retrieval(results):
    one, two, three = results.orderBy("question_id").collect()
    assert one["resume_chunks"] == ["r" * 300, "r1"] and one["interview_chunks"] == ["i0"]
    assert (one["top_distance"], one["used_tiers"]) == (0.0, ["resume", "interview"])
    assert two["resume_chunks"] == ["r1", "r" * 300]
    assert two["arch_chunks"] == [] and two["used_tiers"] == ["resume", "interview"]  # tier is empty
    assert three["interview_chunks"] == [] and three["used_tiers"] == ["resume"]


def test_questions_with_one_vector_are_searched_once(spark):
    asked = spark.createDataFrame([
        (1, "plain", [1.0, 0.0]), (2, "Tell me about a time", [1.0, -0.0]), (3, "tech stack", [1.0, 0.0]),
        (4, "plain", [0.0, 1.0]), (5, "plain", None),
    ], "question_id long, question string, embedding array<float>")
    vectors = spark.createDataFrame([
        ("resume", "chunk_0", "r0", [1.0, 0.1]), ("resume", "chunk_1", "r1", [0.0, 1.0]),
        ("interview", "iv_0", "i0", [0.0, 1.0]),
    ], "tier string, chunk_id string, text string, embedding array<float>")
    sizes = []

    def search(queries, *args, **names):
        sizes.append(queries.count())
        return retrieval.cosine_top_k(queries, *args, **names)

    got = retrieval.retrieve_tiers(asked, vectors, 2, search).orderBy("question_id").collect()
    assert sizes == [4]  # two vectors in the resume tier, one in each of the others
    assert [r["resume_chunks"] for r in got] == [["r0", "r1"]] * 3 + [["r1", "r0"], []]
    assert [r["interview_chunks"] for r in got] == [[], ["i0"], [], [], []]
    assert [r["used_tiers"] for r in got][1:3] == [["resume", "interview"], ["resume"]]
    assert got[0]["top_distance"] == got[1]["top_distance"] == got[2]["top_distance"] > 0
    assert (got[3]["top_distance"], got[4]["top_distance"]) == (0.0, 1.0)


def test_empty_resume_tier(spark):
    asked = spark.createDataFrame([(1, "x", [1.0])], "question_id long, question string, embedding array<float>")
    vectors = spark.createDataFrame([], "tier string, chunk_id string, text string, embedding array<float>")
    row = retrieval.retrieve_tiers(asked, vectors).first()
    assert (row["top_distance"], row["used_tiers"], row["resume_chunks"]) == (1.0, ["resume"], [])


def test_context_and_sources(results):
    texts = {r["question_id"]: r["context"] for r in retrieval.assemble_context(results).collect()}
    assert texts[3] == "[RESUME FACTS]\n\n" + "r1\n\n---\n\n" + "r" * 300
    assert texts[1].endswith("\n\n[INTERVIEW PATTERNS — use only for behavioral questions]\n\ni0")
    refs = retrieval.source_refs(results).where("question_id = 1").orderBy("position").collect()
    assert [(r["chunk"], r["relevance"]) for r in refs] == [("r" * 200, 1.0), ("r1", 0.9)]


def test_encoding_and_ids(spark):
    chunks = spark.createDataFrame([
        ("resume", 0, "spark jobs"), ("interview", 0, "a time"), ("architecture", 3, "cloud run"),
    ], "tier string, chunk_index int, text string")
    stored = retrieval.embed_chunks(chunks)
    got = {r["chunk_id"]: r["embedding"] for r in stored.collect()}
    assert set(got) == {"chunk_0", "iv_0", "arch_3"}
    assert all(len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())
    again = retrieval.embed_chunks(chunks, existing=stored.where("tier <> 'interview'"))
    assert [r["chunk_id"] for r in again.collect()] == ["iv_0"]

    def load():
        return lambda batch: [[len(t), 1.0] for t in batch]

    lengths = retrieval.embed_chunks(chunks, retrieval.pandas_encoder(load))
    assert {r["chunk_id"]: r["embedding"] for r in lengths.collect()}["iv_0"] == [6.0, 1.0]


def test_encoder_finds_the_same_text(spark):
    words = ["spark", "warehouse", "funnel", "mail", "budget", "profile"]
    texts = spark.createDataFrame([(i, f"{w} report number {i}") for i, w in enumerate(words)],
                                  "vec_id long, text string")
    model = retrieval.fit_text_encoder(texts)
    stored = retrieval.encode_texts(model, texts)
    asked = retrieval.encode_texts(model, spark.createDataFrame([(9, "which funnel")], "query_id long, text string"))
    assert retrieval.cosine_top_k(asked, stored, 1).first()["vec_id"] == 2


def test_skill_match(spark):
    df = spark.createDataFrame([
        (1, ["sql", "aws"], ["sql", "go", "aws"], "d" * 201), (2, ["sql"], [], "short"),
    ], "application_id long, candidate_skills array<string>, job_skills array<string>, job_description string")
    one, two = retrieval.skill_match(df).orderBy("application_id").collect()
    assert (one["match_percentage"], one["matching_skills"], one["missing_skills"]) == (67, ["sql", "aws"], ["go"])
    assert one["job_description_preview"] == "d" * 200 + "..." and two["job_description_preview"] == "short"
    assert two["match_percentage"] is None


def test_answers(spark):
    df = spark.createDataFrame([(1, '{"match_percentage": 80, "matching_skills": ["a"]}'), (2, "Sure! {}")],
                               "id long, content string")
    one, two = retrieval.parse_analyses(df, SKILL_ANALYSIS).orderBy("id").collect()
    assert one["analysis"]["match_percentage"] == 80 and one["raw_response"] is None
    assert two["analysis"] is None and two["raw_response"] == "Sure! {}"


# -- profiles ------------------------------------------------------------------


@pytest.fixture
def people(spark):
    person = (
        1, ("N", "n@x.org", "l", "City"), "A summary.",
        {"technical_development": ["Python scripting", "SQL"], "cloud": ["AWS", "python on AWS"]},
        [
            ("A Big Four Firm", "Consultant", "May 2018 – July 2025",
             [("Lab", "Enablement", ["one", "two"]), ("Two", "Sub", [])]),
            ("Other", "Analyst", "October 2016 – April 2018", []),
            ("Third", "Intern", "2014", []),
        ],
        [("College", "BSc", "Maths"), ("Second", "MSc", "Stats")],
        ["Cert A", "Cert B"],
        [("Demo", "A tool.")],
    )
    skills = F.create_map(  # a Python dict would lose its order on the way
        F.lit("technical_development"), F.array(F.lit("Python scripting"), F.lit("SQL")),
        F.lit("cloud"), F.array(F.lit("AWS"), F.lit("python on AWS")),
    )
    return spark.createDataFrame([person], PROFILE).withColumn("skills", skills)


def companies(df):
    return [r["company"] for r in df.orderBy("position").collect()]


def test_experience(people):
    search = profiles.experience_search
    assert companies(search(people)) == ["A Big Four Firm", "Other", "Third"]
    assert companies(search(people, company="BIG four")) == ["A Big Four Firm"]
    assert companies(search(people, after=2018)) == ["A Big Four Firm"]
    assert companies(search(people, after=2014)) == ["A Big Four Firm", "Other", "Third"]
    assert companies(search(people, after=2099)) == [] and len(companies(search(people, "", 0))) == 3


def test_skills(people):
    search = profiles.skills_search
    assert search(people, keyword="PYTHON").first()["skills"] == {
        "technical_development": ["Python scripting"], "cloud": ["python on AWS"]}
    assert search(people, category="cloud", keyword="sql").first()["skills"] == {"cloud": ["AWS", "python on AWS"]}
    assert search(people, keyword="cobol").count() == 0 == search(people, category="none").count()
    assert len(search(people).first()["skills"]) == 2


def test_sections(people):
    certificates = profiles.profile_sections(people, "certifications")
    assert [r["name"] for r in certificates.orderBy("position").collect()] == ["Cert A", "Cert B"]
    assert profiles.profile_sections(people, "education").count() == 2
    whole = profiles.profile_sections(people)
    assert "portfolio_projects" not in whole.columns
    assert whole.first()["certifications"][0]["name"] == "Cert A"


def test_rendered_profile(people):
    assert profiles.render_profile_text(people).first()["text"] == (
        "# Professional Summary\nA summary.\n\n"
        "# Skills\n\n## Technical Development\n- Python scripting\n- SQL\n## Cloud\n- AWS\n- python on AWS\n\n"
        "# A Big Four Firm — Consultant (May 2018 – July 2025)\n\n## Lab: Enablement\n- one\n- two\n## Two: Sub\n\n\n"
        "# Other — Analyst (October 2016 – April 2018)\n\n\n"
        "# Third — Intern (2014)\n\n\n"
        "# Education\nBSc in Maths, College\n\n"
        "# Certifications\n- Cert A\n- Cert B\n\n"
        "# Portfolio Projects\n\n## Demo\nA tool.\n"
    )


def test_rendered_lists(spark):
    qa = spark.createDataFrame(
        [(1, [("Q1", "R1", ["a", "b"]), ("Q2", "R2", None)])],
        "doc_id long, items array<struct<question:string,response_pattern:string,tags:array<string>>>")
    assert profiles.render_patterns_text(qa).first()["text"] == (
        "INTERVIEW PATTERN — Q1\nTags: a, b\nResponse pattern: R1\n\n---\n"
        "INTERVIEW PATTERN — Q2\nTags: \nResponse pattern: R2\n")
    adr = spark.createDataFrame([(1, [("D1", 4, "C1"), ("D2", None, "C2")])],
                                "doc_id long, items array<struct<decision:string,phase:int,content:string>>")
    assert profiles.render_decisions_text(adr).first()["text"] == (
        "ARCHITECTURE DECISION — D1\nPhase: 4\nC1\n\n---\nARCHITECTURE DECISION — D2\nPhase: n/a\nC2\n")


def test_actions(spark, sf_dir):
    actions = d.actions(d.table(spark, sf_dir, "orders"))
    got = profiles.action_validation(actions).where("action_id in (2, 3, 5, 6)").orderBy("action_id").collect()
    assert [r["status"] for r in got] == ["received", "shortlisted", None, None]
    assert [r["missing_field"] for r in got] == [None, None, "priority", "recruiter_email"]
    assert got[0]["confirmation_id"].startswith("conf_") and len(got[0]["confirmation_id"]) == 13
    assert got[1]["confirmation_id"] is None


def test_unknown_actions_are_refused(spark, sf_dir):
    actions = d.actions(d.table(spark, sf_dir, "orders")).limit(20)
    for odd in ("delete", None):
        got = profiles.action_validation(actions.withColumn("action", F.lit(odd).cast("string"))).collect()
        assert {(r["status"], r["message"], r["missing_field"]) for r in got} == {(None, None, "action")}


def test_section_titles(spark):
    keys = ["ci/cd", "front-end", "big_data", "it's", "3d ART", "école"]
    frame = spark.createDataFrame([(k,) for k in keys], "k string").select(profiles._label(F.col("k")).alias("t"))
    assert [r["t"] for r in frame.collect()] == [k.replace("_", " ").title() for k in keys]


def test_missing_vectors_are_left_out(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 1e-6])], "vec_id long, embedding array<float>")
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding")
    got = retrieval.cosine_top_k(queries, v, 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 0), (0, 2), (2, 2), (2, 0)]


def test_chunk_ids_are_unique_and_tiers_give_k(spark):
    texts = ["alpha beta", "gamma delta", "alpha gamma", "beta beta"]
    chunks = spark.createDataFrame([("resume", i, 0, t) for i, t in enumerate(texts)], "tier string, doc_id long, chunk_index int, text string")
    embedded = retrieval.embed_chunks(chunks)
    assert embedded.select("tier", "chunk_id").distinct().count() == len(texts)
    model = retrieval.fit_text_encoder(chunks)
    asked = retrieval.encode_texts(model, spark.createDataFrame([(1, "alpha")], "question_id long, text string"))
    asked = asked.withColumnRenamed("text", "question")
    row = retrieval.retrieve_tiers(asked, embedded, k=3).first()
    assert len(row["resume_chunks"]) == 3
