from pyspark.sql import functions as F

from noctua.functions import text
from noctua.operators import search, verify

COLUMNS = "doc_id int, id string, domain string, mem_type string, title string, summary string, body string, sensitivity string, confidence double, confirmation_count int, updated_at string, last_confirmed_at string, status string, vault_path string"


def memory(k, title, body="", status="active", sensitivity="normal", mem_type="fact", updated="2026-06-30T10:00:00Z"):
    return (k, f"m{k}", "work", mem_type, title, title, body, sensitivity, 0.9, 1, updated, updated, status, f"work/memories/m{k}.md")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def found(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_two_title_words_find_the_one_memory(spark):
    rows = frame(spark, memory(1, "Release checklist for gateway"), memory(2, "Lunch menu"))
    assert found(search.search(rows, "gateway release", "2026-07-01")) == ["m1"]


def test_operators_in_a_query_are_harmless(spark):
    rows = frame(spark, memory(1, "O'Brien's \"gateway\" [plan] - notes"))
    assert found(search.search(rows, "o'brien \"gateway\" [plan] -", "2026-07-01")) == ["m1"]


def test_stale_ranks_below_active(spark):
    rows = frame(spark, memory(1, "Deploy window", status="stale"), memory(2, "Deploy window"))
    assert found(search.search(rows, "deploy window", "2026-07-01")) == ["m2", "m1"]
    assert found(search.search(rows, "deploy window", "2026-07-01", include_stale=False)) == ["m2"]


def test_absent_topic_blank_query_and_bad_domain(spark):
    rows = frame(spark, memory(1, "Deploy window"))
    assert found(search.search(rows, "photosynthesis", "2026-07-01")) == []
    assert found(search.search(rows, "  ", "2026-07-01")) == []
    for bad in (lambda: search.search(rows, "x", "2026-07-01", domain="garden"), lambda: search.search(rows, "x" * 1001, "2026-07-01")):
        try:
            bad()
            raise AssertionError
        except ValueError:
            pass


def test_expired_rows_are_not_in_the_index(spark):
    rows = frame(spark, memory(1, "Deploy window", status="expired"), memory(2, "Other"))
    assert found(search.search(rows, "deploy", "2026-07-01")) == []


def test_future_dates_give_recency_above_one(spark):
    rows = frame(spark, memory(1, "x", updated="2026-07-11"), memory(2, "x", updated="not a date"))
    ages = {r.id: r.a for r in rows.select("id", search.age_days(F.col("updated_at"), "2026-07-01").alias("a")).collect()}
    assert ages == {"m1": -10, "m2": 0}


def test_context_leaves_sensitive_out_and_marks_stale(spark):
    rows = frame(
        spark, memory(1, "Gateway fact", "fresh <b>"), memory(2, "Gateway old", "older", status="stale"), memory(3, "Gateway salary", "secret figure", sensitivity="sensitive")
    )
    got = search.context(search.search(rows, "gateway", "2026-07-01")).first()
    assert len(got.injected) == 2 and got.unverified == ["work/memories/m2.md"]
    assert "secret figure" not in got.block and "fresh &lt;b&gt;" in got.block and 'verify="UNVERIFIED"' in got.block


def test_context_budget_falls_back_to_summaries_and_skips(spark):
    rows = frame(spark, memory(1, "Gateway one", "a" * 9000), memory(2, "Gateway two", "b" * 9000, updated="2026-06-01T00:00:00Z"))
    got = search.context(search.search(rows, "gateway", "2026-07-01"), budget=9500).first()
    assert 'compressed="true"' in got.block and len(got.injected) == 2 and got.used <= 9500


def test_fused_evidence_drops_near_repeats_of_a_path_only(spark):
    e = [(0.9, "p", "alpha beta gamma delta", 1), (0.8, "p", "alpha beta gamma delta", 2), (0.7, "q", "alpha beta gamma delta", 3)]
    df = spark.createDataFrame([(e,)], "e array<struct<score:double,path:string,text:string,ord:int>>")
    assert [x.ord for x in df.select(search.fused(F.col("e")).alias("f")).first().f] == [1, 3]


def test_the_best_by_score_enter_the_fusion(spark):
    say = lambda k: " ".join(f"word{k}x{j}" for j in range(5))
    frame_of = lambda kind, n, top: spark.createDataFrame([(q, f"{kind}{i}", i, top - 0.01 * (n - i), "p", say(f"{kind}{i}")) for q in (7, 200) for i in range(n)], "q int, id string, nr int, score double, path string, text string")
    got = {r.q: list(r.kept) for r in search.fused_evidence(frame_of("m", 20, 0.5), frame_of("s", 40, 0.9), "q").collect()}
    best = [f"s{i}" for i in range(39, 31, -1)]
    assert got == {7: best, 200: best}
    few = {r.q: list(r.kept) for r in search.fused_evidence(frame_of("m", 20, 0.955), frame_of("s", 40, 0.9), "q").collect()}
    assert few[7] == ["m19", "m18", "m17", "m16", "m15", "m14", "s39", "s38"]


def test_evidence_is_fused_for_every_import_from_whole_documents(spark, tmp_path):
    from noctua.plans import registry

    texts = [(i, " ".join(f"t{i}w{j}" for j in range(600 if i == 250 else 30)), "src0") for i in range(300)]
    spark.createDataFrame(texts, "doc_id bigint, text string, source string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.import_id: list(r.kept) for r in registry.queries()["A10_fused_evidence"](spark, str(tmp_path)).collect()}
    assert len(got) == 300 and "memory:m250" in got[250] and len([x for x in got[250] if x.startswith("source:250:250:")]) >= 3


def test_support_terms_are_stemmed_in_order_of_endings(spark):
    df = spark.createDataFrame([("policies uses testing landed buses cats gas the",)], "s string")
    assert sorted(df.select(text.support_terms(F.col("s")).alias("t")).first().t) == ["buse", "cats", "gas", "land", "policy", "test", "uses"]


def evidence(spark):
    return spark.createDataFrame(
        [(1, 1, "a.md", "The gateway authenticates requests with signed tokens", 0.94), (1, 2, "b.md", "Signed tokens expire after an hour at the gateway", 0.88)],
        "question_id int, number int, path string, text string, score double",
    )


def test_supported_claim_gives_high_confidence(spark):
    claims = spark.createDataFrame([(1, 1, "Gateway authenticates requests. ", [1, 2, 2, 9]), (1, 2, "Signed tokens expire", [2])], "question_id int, claim_no int, text string, citations array<int>")
    got = verify.answers(verify.accepted(claims, evidence(spark)), evidence(spark)).first()
    assert got.answer == "Gateway authenticates requests [1][2]. Signed tokens expire [2]."
    assert (got.sources, got.confidence) == (2, "high")


def test_unsupported_uncited_or_late_claims_are_dropped(spark):
    rows = [(1, 1, "Gateway runs on steam engines", [1]), (1, 2, "Gateway", [7]), (1, 3, "  ", [1]), (1, 9, "Gateway", [1]), (1, 4, "x" * 601, [1])]
    claims = spark.createDataFrame(rows, "question_id int, claim_no int, text string, citations array<int>")
    assert verify.accepted(claims, evidence(spark)).count() == 0


def test_json_is_found_in_prose(spark):
    df = spark.createDataFrame([("Here:\n```json\n{\"claims\": [{}]}\n``` done",), ("none",)], "s string")
    assert [r.j for r in df.select(verify.json_object(F.col("s")).alias("j")).collect()] == ['{"claims": [{}]}', None]


def test_terms_of_evidence_stay_where_they_are_and_add_up(spark):
    """A claim may find its terms in several pieces of evidence, one of them null or there twice; no list of terms is collected."""
    rows = [(1, 1, "signed gateway", [1, 2]), (1, 2, "signed gateway", [1]), (1, 3, "tokens", [2, 3]), (1, 4, "the", [1])]
    claims = spark.createDataFrame(rows, "question_id int, claim_no int, text string, citations array<int>")
    seen = spark.createDataFrame([(1, 1, "a", "The gateway", 0.9), (1, 2, "b", "Signed tokens", 0.8), (1, 3, "c", None, 0.7)], "question_id int, number int, path string, text string, score double")
    found = verify.accepted(claims, seen)
    assert sorted((r.claim_no, r.citations) for r in found.collect()) == [(1, [1, 2]), (3, [2, 3])]
    assert "flatten" not in found._jdf.queryExecution().optimizedPlan().toString()
