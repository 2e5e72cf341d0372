import itertools
import os
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from noctua.operators import catalog, documents, usage
from noctua.sources import tables, vault
from noctua.streaming import events as stream

ITEM = "id string, ord int, kind string, display_name string, summary string, category string, provider string, tags array<string>, updated_at bigint, confidence double"


def test_merge_takes_the_richer_of_two(spark):
    rows = [("x", 1, "workflow", "n", "short", None, "local", ["a", "B"], 120, 0.72), ("x", 2, "agent", "n", "a longer summary", "c", "claude", ["b", "z"], 240, 0.84), ("x", 3, "skill", "n", None, None, "local", [], None, 0.84)]
    got = catalog.merged(spark.createDataFrame(rows, ITEM)).first()
    assert (got.kind, got.provider, got.summary, got.updated_at, got.confidence) == ("skill", "claude", "a longer summary", 240, 0.84)
    assert sorted(x.lower() for x in got.tags) == ["a", "b", "z"]


def test_nested_roots_collapse(spark):
    p = spark.createDataFrame([("/r/a",), ("/r/a/b",), ("/r/ab",), ("/q",)], "path string")
    assert sorted(r.path for r in catalog.topmost(p).collect()) == ["/q", "/r/a", "/r/ab"]


def test_item_ids(spark):
    df = spark.createDataFrame([("/home/u/x/package.json", "My Demo Agent!")], "p string, n string")
    assert df.select(catalog.item_id(F.col("p"), "/home/u", F.col("n")).alias("i")).first().i == "~/x/package.json::my-demo-agent"


def test_pages_are_clamped(spark):
    df = spark.range(20)
    assert [r.id for r in catalog.page(df, ["id"], 99).collect()] == [16, 17, 18, 19]
    assert [r.id for r in catalog.page(df, ["id"], 0).collect()] == list(range(8))


def test_missing_tables_read_as_empty(spark, tmp_path):
    spark.range(3).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "t"))
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "id bigint").count() == 0
    got = tables.read_or_empty(spark, str(tmp_path / "t"), "id bigint, later string")
    assert got.columns == ["id", "later"] and got.count() == 3


def test_notes_go_to_files_and_back(spark, tmp_path):
    note = "---\r\nid: m1\r\ntype: fact\r\ndomain: work\r\ntitle: \"A: b\"\r\ncreated: 2026-07-21\r\nupdated: 2026-07-21T10:00:00Z\r\ntags: [x, y]\r\n---\r\nBody\r\nline"
    os.makedirs(tmp_path / "work/memories")
    os.makedirs(tmp_path / "_archive/work")
    (tmp_path / "work/memories/m1.md").write_text(note, newline="")
    (tmp_path / "work/memories/bad.md").write_text("no header")
    (tmp_path / "_archive/work/old.md").write_text(note)
    got = {r.path: r for r in vault.parsed(vault.listing(spark, str(tmp_path))).collect()}
    assert set(got) == {"work/memories/m1.md", "work/memories/bad.md"} and got["work/memories/bad.md"].error == "no frontmatter"
    m = got["work/memories/m1.md"]
    assert (m.id, m.title, m.created_at, m.confidence, m.tags, m.body, m.error) == ("m1", "A: b", "2026-07-21", 0.7, ["x", "y"], "Body\nline", None)


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("x" * 600_000)
    (tmp_path / "b.md").write_text("small")
    assert [r.content for r in tables.bounded_files(spark, str(tmp_path)).collect()] == ["small"]


def test_usage_of_nothing_is_zero(spark):
    t = spark.createDataFrame([], "cwd string, tokens_used bigint, archived int, updated_at bigint, updated_at_ms bigint")
    assert usage.token_total(t).first().total_tokens == 0 and usage.thread_counts(t).first().threads == 0 and usage.top_workspaces(t).count() == 0


def test_streamed_events_count_once(spark, tmp_path):
    rows = [(1, i % 10, i) for i in range(40)] + [(2, -1, 100), (2, -1, 101)]
    spark.createDataFrame(rows, "task_id bigint, seq bigint, arrival bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.event_stream(spark, str(tmp_path / "in"), "task_id bigint, seq bigint, arrival bigint")
    run = stream.ring_counts(source).writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.task_id, r.held, r.last_seq) for r in spark.table("ring").collect()} == {(1, 10, 9), (2, 2, 0)}


def test_every_query_is_registered_with_the_names_of_its_sql():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q) and len(o) > 140


def test_near_duplicates_equal_brute_force_over_all_ids_and_whole_texts(spark):
    rng, rows = random.Random(4), []
    head = " ".join(f"header{i}" for i in range(20))  # over 150 characters
    for i in range(60):
        base = [f"w{i // 6}x{j}" for j in range(30 + i % 3)]
        for _ in range(rng.randrange(9)):
            base[rng.randrange(len(base))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(base)))
    rows += [(100, head + " " + rows[0][1]), (101, head + " " + rows[30][1]), (7007, rows[8][1].upper()), (7008, rows[8][1]), (200, None), (201, ""), (202, "- a")]
    sets = [(k, {w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if len(w) >= 3}) for k, t in rows]
    want = sorted((min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len(x & y) / len(x | y) >= 0.72)
    classes, pairs = documents.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.72)
    of = {r.doc_id: r.class_id for r in classes.collect()}
    assert of == {k: min([j for j, y in sets if y == s] if s else [k]) for k, s in sets}
    got = {(r.a, r.b) for r in pairs.collect()}
    # the classes' pairs, with equal sets put back in, are all pairs
    assert sorted((a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets), 2) if x and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in got)) == want
    assert of[7007] == of[7008] == 8 and (100, 101) not in want and len(got) < len(want)


def test_marks_of_sets_differ_no_more_than_the_sets_and_rare_words_are_the_rarest(spark):
    draw = random.Random(3)
    sets = {i: {f"w{min(draw.randrange(400), draw.randrange(400))}" for _ in range(draw.randint(1, 80))} for i in range(300)}
    sets |= {i: {f"w{draw.randrange(900)}" for _ in range(1200)} for i in range(300, 304)}  # long ones
    got = documents._marked(spark.createDataFrame([(i, sorted(w)) for i, w in sets.items()], "id bigint, w array<string>"), 0.72).orderBy("id").collect()
    assert [r.n for r in got] == [len(w) for w in sets.values()]
    for a, b in zip(got, got[1:]):
        differ = lambda p, q: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(p or [], q or []))
        assert differ(a.marks, b.marks) <= len(sets[a.id] ^ sets[b.id]) and differ(a.wide, b.wide) <= len(sets[a.id] ^ sets[b.id])
    assert all((r.wide is not None) == (r.n > documents.LONG) for r in got) and got[-1].n > documents.LONG
    # the places run from 1, without those of words that no other set has
    assert all([p.k for p in r.rare] == sorted({p.k for p in r.rare}) and all(1 <= p.k <= r.n for p in r.rare) for r in got)
    _, found = documents.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in sets.items()], "doc_id bigint, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "marks" in plan
