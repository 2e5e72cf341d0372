"""The pipeline on a small corpus, stage by stage, against plain versions."""

import corpus_pipeline as cp
from noctua.llm._shared import stored

from .conftest import prose
from .test_operators import TERM, brute_components, low

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    base, passage, leak = prose(1, 200), prose(2, 90), prose(3, 40)
    texts = [base, base.replace(base.split()[50], "changed", 1), prose(4, 120) + "\n" + passage, prose(5, 130) + "\n" + passage, prose(6, 80) + " " + leak, "short text", "buy now! " * 80, None, "", prose(7, 5000), passage]
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], leak


def test_stages_keep_what_they_should(spark, tmp_path):
    rows, leak = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, f"file://{tmp_path}"), name)
        seen[name] = docs
        assert name == "best_fit_packing" or docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    ids = {k: sorted({r.doc_id for r in v.select("doc_id").collect()}) for k, v in seen.items()}
    assert ids["quality_rules"] == [0, 1, 2, 3, 4, 9, 10]
    kept = {r.doc_id: r.text for r in seen["quality_rules"].collect()}
    assert ids["near_dedup"] == [k for k, _, c in brute_components(sorted(kept.items()), 5) if k == c] == [0, 2, 3, 4, 9, 10]
    cut = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert sorted(cut) == [0, 2, 3, 4, 9] and cut[3].text == prose(5, 130) + "\n" and cut[3].n_chars == len(cut[3].text) and cut[2].text == kept[2]
    assert ids["benchmark_decontamination"] == [0, 2, 3, 9]
    packed = seen["best_fit_packing"].collect()
    assert sum(r.n_tokens for r in packed) == sum(len((cut[k].text or "").split()) for k in (0, 2, 3, 9))
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in cp.run(spark, f"file://{tmp_path}").collect()) == sorted((r.doc_id, r.piece, r.n_tokens) for r in packed)
    assert TERM.findall(low(leak))


def test_repeated_rows_and_columns_of_other_names(spark, tmp_path):
    """Equal rows, ids with several texts, rows without an id, and columns that operators use themselves."""
    a, b, c, passage, leak = prose(1, 200), prose(2, 180), prose(3, 90), prose(4, 70), prose(5, 30)
    rows = [(1, a), (1, a), (1, b), (1, "short"), (2, c + "\n" + passage), (3, prose(6, 90) + "\n" + passage), (3, prose(6, 90) + "\n" + passage), (None, prose(7, 80)), (None, a), (4, prose(8, 60) + " " + leak), (None, None)]
    extra = "cut_text string, kept string, noctua string, g int, spans array<int>, n_removed int"
    docs = spark.createDataFrame([(k, t, None, "s", len(t or ""), "x", "y", None, 1, [2], 3) for k, t in rows], COLUMNS + ", " + extra).repartition(6)
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, f"file://{tmp_path}"), name)
        assert out.columns == docs.columns
        docs, seen[name] = out, sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert len(seen["quality_rules"]) == 9
    assert seen["near_dedup"] == sorted([(1, a), (1, b), (2, rows[4][1]), (3, rows[5][1]), (0, rows[7][1]), (4, rows[9][1])])
    assert seen["substring_dedup"] == sorted((k, prose(6, 90) + "\n" if k == 3 else t) for k, t in seen["near_dedup"])
    assert [k for k, _ in seen["benchmark_decontamination"]] == [0, 1, 1, 2, 3]
    packed = cp.STAGES[-1][1](spark, docs, f"file://{tmp_path}").collect()
    assert sum(r.n_tokens for r in packed) == sum(len(t.split()) for _, t in seen["benchmark_decontamination"])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
