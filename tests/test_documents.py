from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noctua.functions import text
from noctua.functions.diff import unified
from noctua.operators import documents


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "s string").select(expression(F.col("s")).alias("x")).first().x


def chunks(spark, body):
    return [r.chunk for r in documents.chunked(spark.createDataFrame([(1, body)], "k int, text string")).orderBy("chunk_index").collect()]


def test_letters_without_spaces_are_cut_with_overlap(spark):
    got = chunks(spark, "".join(chr(97 + i % 26) for i in range(4000)))
    assert len(got) >= 3 and max(map(len, got)) <= 1500 and got[0][-220:] == got[1][:220]


def reference_chunks(body):
    s, out, at = body.replace("\0", "").replace("\r\n", "\n"), [], 0
    while at < len(s):
        stop = hard = min(at + 1500, len(s))
        if hard < len(s):
            stop = next((i + 1 for i in range(hard - 1, max(hard - 240, at + 1) - 1, -1) if s[i].isspace()), hard)
        if s[at:stop].strip():
            out.append(s[at:stop].strip())
        if stop == len(s):
            break
        at = max(0, stop - 220)
    return out


def test_chunks_cover_any_text(spark):
    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.text(alphabet="ab \n é", min_size=0, max_size=900), max_size=6))
    def check(parts):
        body = "".join(parts)
        assert chunks(spark, body) == reference_chunks(body)

    check()
    assert chunks(spark, "") == [] and chunks(spark, " \n ") == []


def test_quality_of_spaced_out_and_of_plain_text(spark):
    bad = " ".join("letterbyletterspacing") + " normal words follow here for a while"
    good = "The gateway authenticates every request with a signed token. Tokens expire after one hour and must be renewed."
    for value, passes in ((bad, False), (good, True), ("", False), ("too short", False)):
        q = one(spark, value, text.quality)
        got = spark.createDataFrame([(q,)], "q struct<visible:int,alnum:int,bad:int,tokens:int,singles:int,run:int>").select(text.quality_passed(F.col("q")).alias("p"), text.quality_score(F.col("q")).alias("s")).first()
        assert got.p is passes and (got.s >= 70) is passes


def test_first_passing_attempt_else_best(spark):
    good = "The gateway authenticates every request with a signed token and keeps the audit trail."
    rows = [(1, 1, "x"), (1, 2, good), (1, 3, good), (2, 1, "x"), (2, 2, "y")]
    got = documents.best_attempt(spark.createDataFrame(rows, "k int, engine_order int, text string"), "k").collect()
    assert {(r.k, r.engine_order, r.passed) for r in got} == {(1, 2, True), (2, 2, False)}


def test_markdown_blocks_skip_code_and_keep_headings(spark):
    body = "intro line\nmore\n# Auth ##\n- first item\n1. second item\n```\ncode\n```\nimport x\n<CodeBlock a\n  b\n/>\ntext after\n---\nend"
    got = documents.blocks(spark.createDataFrame([(1, body)], "k int, text string"), "k", "text").orderBy("ord").collect()
    assert [(r.heading, r.paragraph) for r in got] == [("Overview", "intro line more"), ("Auth ##", "first item"), ("Auth ##", "second item"), ("Auth ##", "text after end")]


def test_candidates_are_ranked_distinct_and_few_per_heading(spark):
    a = "Requests require authentication with a signed JWT in the header"
    body = f"# API\n- {a}\n- {a} always\n- The timeout of the endpoint must be one hour at most\n- Idempotency keys are required for each conversation retry\n# Notes\n- we decided that the deprecated header must go next year"
    got = documents.candidates(spark.createDataFrame([(1, "Guide", body)], "k int, title string, text string"), "k", "title", "text").orderBy("rank").collect()
    assert [r.mem_type for r in got].count("decision") == 1 and sum(r.title.startswith("API: ") for r in got) == 2
    assert any(r.title.startswith("Guide: we decided") for r in got) and got[0].confidence == 0.84


def test_sentences_are_cut_only_when_long(spark):
    short = "One. Two. Three."
    assert one(spark, short, documents.sentences) == [short]
    long = " ".join(f"This is sentence number {i} and it is long enough to be kept." for i in range(8))
    assert len(one(spark, long, documents.sentences)) == 8


def test_html_entities_are_decoded_in_turn(spark):
    assert one(spark, "<p>a &amp;lt; b</p><script>x</script>&nbsp;c", text.html_to_text).split() == ["a", "<", "b", "c"]


def test_public_addresses(spark):
    cases = {"127.0.0.1": False, "10.1.2.3": False, "169.254.0.9": False, "1.1.1.1": True, "93.184.216.34": True, "203.0.113.7": False, "x.y": None, "256.1.1.1": None}
    for ip, want in cases.items():
        assert one(spark, ip, text.is_public_ipv4) is want


def test_addresses_of_version_6_and_hosts_that_are_addresses(spark):
    cases = {"::1": False, "::": False, "fe80::1": False, "FC00::1": False, "ff02::1": False, "2001:db8::5": False, "2001:4860:4860::8888": True, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "::8.8.8.8": True, "64:ff9b::1": True,
             "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": None, "1::2::3": None, "1:2:3:4:5:6:7::8": None, ":1": None, "g::1": None, "::1.2.3.256": None, "8.8.8.8": True, "::12345": None, "": None}
    assert {ip: one(spark, ip, text.is_public_address) for ip in cases} == cases
    import ipaddress

    for ip in ("2a00::1", "a:b::c:d", "::5", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4"):
        whole = ipaddress.IPv6Address(ip).packed
        assert one(spark, ip, text.ipv6_segments) == [256 * whole[k] + whole[k + 1] for k in range(0, 16, 2)]
    urls = {"http://[::1]/": "not public", "http://[fe80::1]:80/x": "not public", "http://[2a00::1]/": None, "http://127.1/": "not public", "http://0x7f000001/": "not public", "http://2130706433/": "not public", "http://1.2.3.4/": None, "http://a.1b/": None}
    assert {u: one(spark, u, text.fetch_refusal) for u in urls} == urls


def test_dates_of_both_spellings(spark):
    got = [one(spark, s, text.first_date) for s in ("2026-07-21", "2026-07-21T10:00:00Z", "2026-07-21T10:00:00.5+02:00", "21.7.2026", "2026-02-31")]
    assert [str(d) for d in got] == ["2026-07-21"] * 3 + ["None"] * 2


def test_unified_diff(spark):
    got = unified(spark.createDataFrame([(1, "a\nb", "a\nc"), (2, "x", "x")], "k int, o string, n string"), "k", "o", "n").orderBy("k").collect()
    assert "-b" in got[0].diff and "+c" in got[0].diff and got[1].diff == ""


def test_candidates_stay_in_the_row_of_their_document(spark):
    """No join and no group of documents: rows without an id, or with an id that others have, are documents too."""
    body = "# Setup\n- Authentication is required with a JWT for the endpoint, {} must be enabled by default\n"
    rows = [(None, "A", body.format("caching")), (1, "B", body.format("paging")), (1, "C", body.format("the gateway"))]
    found = documents.candidates(spark.createDataFrame(rows, "k int, title string, text string"), "k", "title", "text")
    assert [(r.k, r["rank"]) for r in found.orderBy(F.col("k").asc_nulls_first()).collect()] == [(None, 1), (1, 1), (1, 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_sentences_of_long_text_equal_a_plain_fold(spark):
    import random
    import re

    draw = random.Random(5)
    whole = " ".join("".join(draw.choices("ab .!?\n ", k=draw.randint(1, 60))) for _ in range(400)).strip()
    out, now = [], ""
    for piece in re.split(r"(?<=[.!?])(?=\s)", whole):
        now += piece
        if len(now) > 45:
            out, now = [*out, now], ""
    assert one(spark, whole, documents.sentences) == [x.strip() for x in [*out, now] if len(x.strip()) >= 45]


def test_python_takes_up_few_rows_of_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x"] * 1000})
    assert [b.num_rows for b in documents.in_slices([batch])] == [256, 256, 256, 232]


def test_imports_are_one_pass(spark):
    from noctua.operators import imports

    body = "<p>Authentication is required with a JWT for the endpoint, caching must be enabled by default.</p>"
    rows = [(1, "work", "A", "url", body * 3), (1, "work", "B", "url", "<p>password: hunter2</p>"), (None, "work", "C", "url", body), (2, "work", "D", "text", None)]
    out = imports.imported(spark.createDataFrame(rows, "id int, domain string, title string, input_kind string, content string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.title, r.refusal, r.chunks) for r in out.collect()} == {("A", None, 1), ("B", "secrets", 0), ("C", None, 1), ("D", "empty", 0)}


def test_a_diff_holds_few_rows_of_a_batch_as_strings(spark):
    """The step that slices batches is on the way, and odd rows go through it."""
    rows = [(i, f"a\nb{i}" if i % 3 else None, f"a\nc{i}" if i % 2 else f"a\nb{i}") for i in range(600)]
    found = unified(spark.createDataFrame(rows, "k int, a string, b string").coalesce(1), "k", "a", "b")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r["diff"] for r in found.collect()}
    assert len(got) == 600 and got[2] == "" and got[1].endswith("-b1\n+c1") and "+a" in got[0]


def test_addresses_of_one_file_are_judged_in_many_tasks(spark, tmp_path):
    import __spark_entry__

    spark.range(40).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["T20_public_addresses"](spark, f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == 360


def test_odd_addresses(spark):
    want = {"1::\n2": None, "a:::b": None, ":::": None, "1::2::3": None, "1:2:3:4:5:6:7::8": None, "1:2:3:4:5:6:7::": True, "::": False, "::1.2.3.4": True, "::FFFF:10.1.2.3": False, "0:0:0:0:0:ffff:0808:0808": True, "::1:2:3.4.5": None, "2001:db8::": False, "2001:0DB8::1": False, "2001:db80::": True, "febf::": False, "fec0::": True, "172.15.0.1": True, "172.31.09.1": False, "100.128.1.1": True, "192.0.02.1": False, "192.0.1.1": True, "01.2.3.4": True, "256.1.1.1": None, "1.2.3": None}
    assert {ip: one(spark, ip, text.is_public_address) for ip in want} == want
