"""The index against a plain count of terms: builds, changes, merges, tags, weights, questions, skipped blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.operators import index as ix
from noctua.operators import search
from noctua.operators.index import Index

ROWS = "id string, doc_id int, title string, summary string, body string, tags array<string>, domain string, status string, updated_at string, mem_type string, confidence double, confirmation_count int"
WORDS = [f"w{k}" for k in range(40)] + ["über", "the", "É"]


@pytest.fixture(autouse=True)
def bounds_even_for_small_tables(monkeypatch):
    monkeypatch.setattr(ix, "SMALL", 0)


def rows_of(seed, n, first=0):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randrange(k)))
    return [(f"m{first + i}", first + i, say(4), say(9), rng.choice([None, say(40), say(15)]), rng.choice([None, [], [rng.choice(WORDS), "Tag-x"]]), rng.choice(["work", "personal"]), "active", "2026-06-01", "fact", 0.9, 1) for i in range(n)]


def plain(rows, terms, weights=None):
    fields = []
    for r in rows:
        parts = [r[2], r[3], r[4], " ".join(r[5] or [])]
        folded = [(x or "").lower().translate(str.maketrans("üé", "ue")) for x in parts]
        fields.append([[w for w in re.split(r"[\W_]+", x) if w] for x in folded])
    n, average = len(rows), sum(sum(map(len, f)) for f in fields) / max(1, len(rows))
    count = [[Counter(x) for x in f] for f in fields]
    df = Counter(w for c in count for w in set().union(*c))
    out = {}
    for r, f, c in zip(rows, fields, count, strict=True):
        size, score, hit = sum(map(len, f)), 0.0, False
        for w in terms:
            tf = sum(k * x[w] for k, x in zip(weights or (1, 1, 1, 1), c, strict=True))
            if any(x[w] for x in c):
                hit = True
                score += max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))
        if hit:
            out[r[0]] = score
    return out


def check(spark, index, rows, k=7):
    assert (index.n, index.total) == (len(rows), sum(r.length for r in index.docs().collect()))
    df = spark.createDataFrame(rows, ROWS)
    for terms, own in ((["w0", "w3", "w3"], ["w0", "w3"]), (["w39", "w38", "the", "uber", "tag", "nothing"], None)):
        want = plain(rows, terms)
        if own is None:
            assert {r.id: round(r.bm25, 9) for r in index.hits(terms).collect()} == {x: round(v, 9) for x, v in want.items()}
        asked = spark.createDataFrame([("q", w) for w in terms], "q string, term string")
        order = sorted(want.items(), key=lambda x: (-round(x[1], 9), int(x[0][1:])))[:k]
        got = sorted((r.position, r.id, round(r.bm25, 9)) for r in index.best(asked, df, k, tie="doc_id", own=own).collect())
        assert got == [(i, x, round(v, 9)) for i, (x, v) in enumerate(order)]


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/index"


def test_an_index_follows_rows_that_come_change_and_go(spark, folder, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 4)
    rows = {r[0]: r for r in rows_of(1, 90)}
    index = Index.build(spark.createDataFrame(list(rows.values()), ROWS).repartition(3), folder, search.FIELDS)
    for step in range(2):
        new = {r[0]: r for r in rows_of(10 + step, 25, first=20 * step)} | {r[0]: r for r in rows_of(20 + step, 10, first=200 + 10 * step)}
        gone = [x for x in list(rows)[::7] if x not in new]
        rows = {k: v for k, v in (rows | new).items() if k not in gone}
        index = index.changed(spark.createDataFrame(list(new.values()), ROWS), spark.createDataFrame([(x,) for x in gone] + [("unknown",)], "id string"))
    assert len(index.segments) == 3
    check(spark, index, list(rows.values()))
    index = index.merged()
    assert len(index.segments) == 1
    index = Index(spark, folder).changed(spark.createDataFrame(rows_of(40, 12, first=5), ROWS))
    rows |= {r[0]: r for r in rows_of(40, 12, first=5)}
    check(spark, index, list(rows.values()))


def test_deltas_are_merged_past_their_number(spark, folder, monkeypatch):
    monkeypatch.setattr(ix, "MOST_SEGMENTS", 2)
    rows = {r[0]: r for r in rows_of(2, 20)}
    index = Index.build(spark.createDataFrame(list(rows.values()), ROWS), folder, search.FIELDS)
    for step in range(2):
        new = {r[0]: r for r in rows_of(30 + step, 6, first=4 * step)}
        rows |= new
        index = index.changed(spark.createDataFrame(list(new.values()), ROWS))
    assert len(index.segments) == 1
    index = index.changed(spark.createDataFrame([], ROWS), spark.createDataFrame([(x,) for x in rows], "id string"))
    assert (index.n, index.total) == (0, 0) and index.hits(["w0"]).count() == 0 and index.terms().count() == 0


def test_a_change_that_was_not_committed_is_not_seen(spark, folder):
    rows = rows_of(3, 20)
    Index.build(spark.createDataFrame(rows, ROWS), folder, search.FIELDS)
    ix._segment(spark.createDataFrame(rows_of(4, 9, first=100), ROWS), folder, search.FIELDS, "id")  # a writer that died here
    index = Index(spark, folder)
    ix.SMALL = 1  # one pass, restored by the fixture
    asked = spark.createDataFrame([(0, "w0")], "q int, term string")
    want = sorted(plain(rows, ["w0"]).items(), key=lambda x: (-round(x[1], 9), int(x[0][1:])))[:4]
    assert [r.id for r in index.best(asked, spark.createDataFrame(rows, ROWS), 4, tie="doc_id", own=["w0"]).orderBy("position").collect()] == [x for x, _ in want]
    assert index.n == 20 and {r.id for r in index.docs().collect()} == {r[0] for r in rows}


def test_an_empty_table_and_missing_fields(spark, folder):
    index = Index.build(spark.createDataFrame([], ROWS), folder, search.FIELDS)
    assert (index.n, index.average) == (0, 0.0) and index.hits(["w0"]).count() == 0
    index = index.changed(spark.createDataFrame([("a", "One two"), ("b", None)], "id string, title string"))
    assert index.n == 2 and [r.id for r in index.hits(["two"]).collect()] == ["a"]


def test_a_word_only_in_a_tag_is_found_and_fields_have_weights(spark, folder):
    rows = [("m0", 0, "w1", None, None, ["gateway"], "work", "active", "", "fact", 0.9, 1), ("m1", 1, "gateway", None, "w1 w2", None, "work", "active", "", "fact", 0.9, 1), ("m2", 2, "w3", None, None, None, "work", "active", "", "fact", 0.9, 1)]
    index = Index.build(spark.createDataFrame(rows, ROWS), folder, search.FIELDS)
    assert {r.id for r in index.hits(["gateway"]).collect()} == {"m0", "m1"}
    weights = {"title": 3.0, "tags": 0.5}
    got = {r.id: round(r.bm25, 9) for r in index.hits(["gateway", "w1"], weights).collect()}
    assert got == {k: round(v, 9) for k, v in plain(rows, ["gateway", "w1"], (3, 1, 1, 0.5)).items()}
    df = spark.createDataFrame(rows, ROWS)
    assert [r.id for r in search.search(df, "gateway", "2026-07-01", index=index).where("relevance > 0").orderBy("rank").collect()][0] == "m1"
    assert {r.id for r in search.search(df.drop("tags"), "gateway", "2026-07-01").collect()} == {"m1"} and {r.id for r in search.search(df, "gateway", "2026-07-01").collect()} == {"m0", "m1"}


def test_questions_in_one_job_equal_single_searches(spark, folder):
    rows = rows_of(6, 60)
    df = spark.createDataFrame(rows, ROWS).withColumn("status", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("status")))
    index = Index.build(df, folder, search.FIELDS)
    asked = [(1, "w0 w3 ww", "work"), (2, "  ", None), (3, "x" * 1001, None), (4, rows[8][2] or "w1", None)]
    got = search.search_questions(df, spark.createDataFrame(asked, "q int, query string, domain string"), "2026-07-01", index, 5).collect()
    for q, text, domain in asked:
        mine = sorted((r.rank, r.id, round(r.score, 9)) for r in got if r.q == q)
        want = [] if len(text) > 1000 else sorted((r.rank, r.id, round(r.score, 9)) for r in search.search(df, text, "2026-07-01", domain, limit=5, index=index).collect())
        assert mine == want


def test_most_blocks_of_common_terms_stay_closed(spark, folder, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 8)
    rows = [(f"m{i}", i, "common filler words here", None, "rare find" if i in (100, 101, 300) else "more filler text", None, "work", "active", "", "fact", 0.9, 1) for i in range(800)]
    df = spark.createDataFrame(rows, ROWS)
    index = Index.build(df, folder, search.FIELDS)
    asked = spark.createDataFrame([(0, w) for w in ("common", "rare", "find")], "q int, term string")
    assert {r.id for r in index.best(asked, df, 3, tie="doc_id").collect()} == {"m100", "m101", "m300"}
    assert ix.opened_share(index, asked, df.withColumn("id", F.col("id")), 3) < 0.05
    plan = index.bounds(index.asked(asked), ["common"], None)._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in plan.split("ReadSchema")[1] and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_terms_folded_as_bytes_equal_those_of_the_column(spark):
    texts = ["", None, "Plain ASCII, x_y 12", "Éa ÜBER über_y", "İI ß ÆØ×÷ Þ", "éa a b", "\x00tab\there\x7f", "ΟΔΟΣ мир 東京٣", "end", "  ", "ÿ", "Ã©"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
    half = df.select(ix._half_folded(ix._value(df, "x")).alias("x")).toArrow()["x"].combine_chunks().cast("string")
    words, row = ix._words(half)
    want = [(r.i, w) for r in df.select("i", ix.folded(df, "x").alias("x")).orderBy("i").collect() for w in r.x.split(" ") if w]
    assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == want
    sliced, row = ix._words(half.slice(3, 4))
    assert list(zip(row.tolist(), sliced.to_pylist(), strict=True)) == [(i - 3, w) for i, w in want if 3 <= i < 7]


def test_an_entry_takes_the_bytes_its_counts_need():
    docs, tf, n = np.array([1, 511, 7, 0, 300, 65535]), np.array([[0, 3], [0, 300], [1, 0], [0, 70000], [2, 1], [5, 0]]), np.array([2, 1, 3])
    packed = ix._packed(docs, tf, n, np.maximum.reduceat(tf, [0, 2, 3]))
    assert [len(v) for v in packed.to_pylist()] == [2 + 2 * 4, 2 + 3, 2 + 3 * 7]
    got = ix._unpacked(packed, 2)
    assert [x.tolist() for x in got] == [docs.tolist(), tf.tolist(), [0, 0, 1, 2, 2, 2], n.tolist()]


def test_what_a_change_sends_to_a_posting_is_a_bit_for_each_document(spark, folder, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 64)
    rows = rows_of(7, 256)
    index = Index.build(spark.createDataFrame(rows, ROWS).coalesce(1), folder, search.FIELDS).changed(spark.createDataFrame(rows[::2], ROWS))
    sent = index._bits(index.void()).collect()
    assert len(sent) == 4 and all(len(r.gone) <= 8 for r in sent)
    check(spark, index, rows)


def test_few_questions_do_not_shuffle_the_postings(spark, folder):
    df = spark.createDataFrame(rows_of(8, 60), ROWS)
    asked = spark.createDataFrame([(1, "w0"), (2, "w3")], "q int, term string")
    index = Index.build(df, folder, search.FIELDS)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.best(asked, df, 3, tie="doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("BroadcastHashJoin [term") >= 2  # the index's terms, and the postings
