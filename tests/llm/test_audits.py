"""Quality classifier, filter audit and source audit against brute force, on odd rows and on empty tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from noctua.llm import filter_audit, pu_quality, source_audit

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, LABELS = "doc_id bigint, text string, lang string, source string", "doc_id bigint, quality int, toxic int"


# --- filter audit


def brute_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for k, text, *_ in docs:
        if k is not None:
            first[text or ""] = min(k, first.get(text or "", k))
    for k, q, x in labels:
        good |= {k} if q == 1 else set()
        toxic |= {k} if x == 1 else set()
    rows = defaultdict(list)
    for k, text, lang, _ in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), k is not None and k > first[text]]
        rows[lang or ""].append(({c for c, x in zip("ABCDE", fails, strict=True) if x}, k in good and k is not None, k in toxic and k is not None))
    out = []
    for part, docs_ in rows.items():
        figures, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                earlier = set(order[: step - 1])
                here = [r for r in docs_ if c in r[0] and not r[0] & earlier]
                shapley[c] += len(here)
                figures.append((part, order, step, sum(not r[0] & (earlier | {c}) for r in docs_), len(here), sum(c in r[0] and bool(r[0] & earlier) for r in docs_), sum(r[0] == {c} for r in docs_), sum(r[1] for r in here), sum(r[2] for r in here), c))
        out += [(*f[:-1], shapley[f[-1]]) for f in figures]
    return sorted(out)


def audited(spark, docs, labels):
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect())


def audit_rows(odd_rows):
    rng = random.Random(3)
    long = prose(8, 140)
    rows = [(k, t, rng.choice(["en", None]), None) for k, t in odd_rows]
    texts = [long, long.upper(), long + " #1", "few words", prose(9, 40) * 4, long.replace("a", "A"), " ".join(f"w{i}" for i in range(150)), "", None]
    rows += [(rng.randrange(14, 60), rng.choice(texts), rng.choice(["en", "de", "", None]), "s") for _ in range(90)]
    rows += [(None, long, "en", "s"), (None, None, None, None), (7, "word", "fr", "s")]
    return rows


def test_filter_audit_equals_brute_force(spark, odd_rows):
    rows = audit_rows(odd_rows)
    labels = [(k, k % 2, k % 3 // 2) for k in range(0, 60, 2)] + [(4, None, 1), (4, 0, None), (None, 1, 1), (999, 1, 1), (16, 0, 0), (16, 1, 0)]
    got = audited(spark, rows, labels)
    assert got == brute_audit(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_masks_come_back_exactly_from_parity_sums(spark):
    rng = random.Random(5)
    cells = [rng.choice([0, 1, 7, 10**15]) for _ in range(32)]
    rows = spark.createDataFrame([("p", m, n) for m, n in enumerate(cells) if n], "part string, mask int, n bigint")
    sums = filter_audit.parity_sums(rows, ["part"])
    assert sums.first().sums[0] == sum(cells) and sums.select(filter_audit.inverted().alias("c")).first().c == cells


def test_filter_audit_of_empty_tables_and_clashing_names(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).count() == 0
    more = odd.withColumn("mask", odd["g"]).withColumn("first", odd["g"]).withColumn("digest", odd["g"]).withColumn("part", odd["g"])
    got = filter_audit.audit(more, none.withColumn("good", none["toxic"]).withColumn("mask", none["toxic"]))
    assert got.count() == 600 and {r.part for r in got.collect()} == {""}


# --- source audit


def brute_divergence(docs, least, most):
    count, has, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(TERM.findall((text or "").translate(ASCII)))
        count[lang, source] += found
        has[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in has[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({w: count[lang, s][w] for w in kept})
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if count[lang, s][w] and p[s][w] > q[w])[:most]
            out += [(lang, s, part, x[2], -x[0], k) for part, xs in (("pair", pairs), ("term", terms)) for k, x in enumerate(xs, 1)]
    return sorted(out)


def diverged(spark, docs, least, most=50):
    got = source_audit.divergence(spark.createDataFrame(docs, DOCS), least_docs=least, most_ranks=most)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in got.collect())


def source_rows(odd_rows, n_sources=9):
    rng = random.Random(11)
    rows = [(k, t, rng.choice(["en", None]), rng.choice(["a", None])) for k, t in odd_rows]
    for i in range(220):
        lang, s = rng.choice(["en", "en", "de"]), rng.randrange(n_sources)
        words = rng.choices(["The", "of", "UND", "É", "ü", "naïve"], k=12) + rng.choices([f"own{'xyzuvwabc'[s % 9]}q", f"rare{'abcdefgh'[rng.randrange(8)]}"], k=6)
        rows.append((100 + i, rng.choice([" ", "7", "-"]).join(words), lang, f"src{s}" if s else "Ärger"))
    return rows + [(900, "123 456", "de", "wordless"), (901, None, "xx", "alone"), (902, "a b", "yy", "one"), (903, "a b", "yy", "two"), (None, "the of", "en", "src1")]


@pytest.mark.parametrize("block,postings,heavy", [(256, 1 << 18, 2), (4, 8, 2), (3, 5, 0), (3, 5, 10**6)])
def test_source_audit_equals_brute_force(spark, odd_rows, monkeypatch, block, postings, heavy):
    """Tiles of one and of several blocks and buckets; all terms heavy; all terms light."""
    monkeypatch.setattr(source_audit, "BLOCK", block)
    monkeypatch.setattr(source_audit, "POSTINGS", postings)
    monkeypatch.setattr(source_audit, "HEAVY", heavy)
    rows = source_rows(odd_rows)
    assert diverged(spark, rows, 5, 4) == brute_divergence(rows, 5, 4)


def test_dense_and_light_sums_add_up_alike(monkeypatch):
    monkeypatch.setattr(source_audit, "SLAB", 7)
    rng = np.random.default_rng(2)
    zl, zr, n_terms = rng.integers(1, 50, 7), rng.integers(1, 50, 5), 40
    sides, full = [], []
    for z in (zl, zr):
        dense = np.repeat(z[:, None], n_terms, axis=1)
        source, term = np.nonzero(rng.random((len(z), n_terms)) < 0.3)
        p = z[source] + rng.integers(0, 90, len(source))
        dense[source, term] = p
        sides.append((source, term, p))
        full.append(dense)
    want = np.abs(full[0][:, None] - full[1][None]).sum(axis=2) - n_terms * np.abs(zl[:, None] - zr)
    assert (source_audit.light_sums(*sides, zl, zr) == want).all() and (source_audit.dense_sums(*sides, zl, zr) == want).all()


def test_shares_beyond_64_bits(spark):
    got = spark.range(1).select(source_audit.share(*(source_audit.F.lit(x).cast("bigint") for x in (10**15, 7 * 10**15, 10**6))).alias("p")).first().p
    assert got == 1 + 10**9 * (10**15 + 5) // (7 * 10**15 + 5 * 10**6)


def test_source_audit_of_empty_tables_and_clashing_names(spark, odd):
    assert diverged(spark, [], 1) == []
    more = odd.selectExpr("*", "doc_id % 2 AS source", "2 AS no", "3 AS z", "4 AS term", "5 AS n")
    got = source_audit.divergence(more, least_docs=1).collect()
    assert {r.part for r in got} == {"pair", "term"} and {(r.lang, r.source) for r in got} == {("", ""), ("", "0"), ("", "1")}


# --- quality classifier


def quality_rows(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = ". ".join(prose(seed * 10**5 + 7 * i + k, rng.randrange(6, 14)).capitalize() for k in range(rng.randrange(3, 12))) + "."
        good = rng.random() < 0.7
        if not good:
            text = [text.upper() + "!!", " ".join(w + "###" for w in text.split()), (text.split()[0] + " ") * 60][rng.randrange(3)]
        rows.append((i, text, int(good)))
    return rows


def test_quality_classifier_on_held_out_rows(spark):
    rows = quality_rows(1600)
    labels = [(k, q, 0) for k, _, q in rows if k % 3 == 0]
    docs = spark.createDataFrame([(k, t, "x", None) for k, t, _ in rows], DOCS).repartition(5)
    found = pu_quality.scored(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in found.collect()}
    assert abs(got[0].prior - np.mean([q for *_, q in rows])) < 0.08
    truth = {k: q for k, _, q in rows}
    out = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in out} == {k for k in truth if zlib.crc32(b"%d" % k) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    # labels of held-out rows, and labels of 0, are never used
    other = [(k, 1 - q if zlib.crc32(b"%d" % k) % 4 == 2 else q or None, 1) for k, q, _ in labels]
    again = {r.doc_id: r.score for r in pu_quality.scored(docs, spark.createDataFrame(other, LABELS)).collect()}
    assert max(abs(again[k] - r.score) for k, r in got.items()) < 1e-9


def test_sums_equal_plain_gradients_and_curvature():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, pu_quality.BINS, (30, len(pu_quality.FEATURES))) + np.arange(len(pu_quality.FEATURES)) * pu_quality.BINS
    w, times = rng.normal(0, 0.3, pu_quality.WIDTH + 1), rng.integers(1, 4, 30).astype(float)
    x = np.zeros((30, pu_quality.WIDTH + 1))
    x[np.arange(30)[:, None], cells] = 1
    x[:, -1] = 1
    g = x @ w
    s = pu_quality.Sums.unpacked(pu_quality.sums_of(cells, w, times))
    sig = 1 / (1 + np.exp(-g))
    assert s.n == times.sum() and np.isclose(s.loss_up, times @ np.log1p(np.exp(-g))) and np.isclose(s.loss_down, times @ np.log1p(np.exp(g)))
    assert np.allclose(s.up, (times * (sig - 1)) @ x) and np.allclose(s.down, (times * sig) @ x) and np.allclose(s.curve, x.T @ ((times * sig * (1 - sig))[:, None] * x))


def test_risk_on_negatives_is_corrected_upwards():
    one = np.ones(pu_quality.WIDTH + 1)
    sums = lambda up, down: pu_quality.Sums(10, up, down, -one, 2 * one, np.eye(len(one)))
    risk, step = pu_quality.step_of(sums(1, 20), sums(0, 30), 0.5)
    assert np.isclose(risk, 0.05 + 3 - 1) and np.allclose(step, -0.05 + 0.2 - 0.1)
    risk, step = pu_quality.step_of(sums(1, 80), sums(0, 30), 0.5)
    assert np.isclose(risk, 0.05) and np.allclose(step, -pu_quality.CORRECTION * (0.2 - 0.1))


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(4)
    positive, negative = np.clip(rng.normal(70, 12, 6000), 0, 99), np.clip(rng.normal(30, 12, 2000), 0, 99)
    count = lambda x: np.bincount(x.astype(int), minlength=100)
    for n in (6000, 2000):
        share = n / (n + 2000)
        assert abs(pu_quality.prior_of(count(positive), count(np.concatenate((positive[:n], negative)))) - share) < 0.05


def test_quality_classifier_of_odd_rows(spark, odd, odd_rows):
    labels = spark.createDataFrame([(0, 1, 0), (10, 1, 0), (11, 1, 0), (11, None, 0), (None, 1, 0), (5, 0, 0), (6, 1, 0)], LABELS)
    clash = odd.selectExpr("*", "1 AS x", "true AS positive", "2 AS held_out", "3 AS quality")
    got = pu_quality.scored(clash, labels.selectExpr("*", "1 AS positive", "2 AS x")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in odd_rows)
    empty = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in got) and all(r.held_out is False for r in got if r.doc_id is None)
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in pu_quality.scored(odd, nothing).collect()} == {0.5}
    assert pu_quality.scored(spark.createDataFrame([], DOCS), labels).count() == 0


def test_features_of_plain_texts():
    texts = ["", "One two three.", "AB CD\nAB CD\nx #1", "go go go!"]
    import pyarrow as pa

    from noctua.llm import _text as t

    data, at = t.buffers(pa.array(texts))
    m = pu_quality.measures(data, at)
    assert m["words"].tolist() == [0, 3, 6, 3] and np.allclose(m["distinct_words"], [1, 1, 4 / 6, 1 / 3 + 1 / 3]) and np.allclose(m["top_word"], [0, 1 / 3, 2 / 6, 2 / 3])
    assert np.allclose(m["capital_words"], [0, 0, 4 / 6, 0]) and np.allclose(m["repeated_lines"], [0, 0, 1 / 3, 0]) and np.allclose(m["repeated_neighbours"], [0, 0, 0, 1 / 3])
    assert np.allclose(m["symbols"], [0, 0, 1 / 16, 0]) and np.allclose(m["sentence_ends"], [0, 1 / 3, 0, 1 / 3]) and np.allclose(m["digits"], [0, 0, 1 / 16, 0])


def test_rows_without_an_id_are_judged_by_the_registered_quality_query(spark, tmp_path):
    from noctua.llm import queries

    spark.createDataFrame([(None, "word " * 60, "en", "s"), (1, prose(5, 80), "en", "s"), (None, None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in queries.op8_quality_rules(spark, str(tmp_path)).collect())
    assert got == [("1", 80, True), ("None", 0, False), ("None", 60, False)]
