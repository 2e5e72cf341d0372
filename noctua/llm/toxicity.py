"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows are divided by a hash of their id: one part gives a lexicon, one grows the trees, one calibrates. The
lexicon holds words and word beginnings that are far more frequent in toxic documents; it is counted on the executors, and at
most ``MOST_TERMS`` entries come back. At most ``MOST_ROWS`` labelled rows (those of least hash) teach lexicon, trees and
calibration, a stated bound: their ids and labels are broadcast, and only dense features reach the driver. The texts
stay where they are. All rows are then scored where they are read, without a shuffle.

Only the text is an input. Null and blank texts have all features 0 and get the score of such a row. Without labels of
both kinds every score is the share of positive labels, 0 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t

MOST_ROWS, MOST_TERMS, LEAST_ODDS, LEAST_DOCS = 50_000, 4096, 2.0, 5
STARTS, NEAR = (5, 6, 7, 8), 5
#: Common insults, and words that address the reader.
INSULTS = "idiot moron stupid worthless pathetic disgusting scum trash loser clown dumb fool jerk hate ugly".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine sie tu te toi vous votre usted ustedes ti".split()
_FEATURES = 18

_LEET = np.arange(256, dtype=np.uint8)
_LEET[65:91] += 32
for _a, _b in zip(b"013457@", b"oieasta", strict=True):
    _LEET[_a] = _b
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b"0123456789@$*!"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*b"!?.,;:-'\"()"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    data, at = t.buffers(pa.array([" ".join(words)]))
    h, *_ = t.words(_LEET[data], at, _LETTER)
    return np.sort(h)


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole words and of their beginnings (0 where a word is too short); starts, ends, first words."""
    plain = _LEET[data]
    s, e, first = t.word_borders(plain, at, _LETTER)
    out = [t.span_hash(plain, s, e)]
    for n in STARTS:
        out.append(np.where(e - s > n, t.span_hash(plain, s, np.minimum(s + n, e)) ^ np.uint64(n), np.uint64(0)))
    return out, s, e, first


def _in(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(of):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    i = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return (of[i] == values) & (values != 0), i


def features(data: np.ndarray, at: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of dense features per text; ``terms`` are sorted hashes."""
    n_rows = len(at) - 1
    hashes, s, e, first = _terms(data, at)
    row = t.row_of(first)
    n = np.maximum(1, np.diff(first))
    weight = np.zeros(len(s))
    for h in hashes:
        hit, i = _in(h, terms)
        np.maximum(weight, np.where(hit, weights[i] if len(weights) else 0.0, 0.0), out=weight)
    insult = _in(hashes[0], _INSULT_HASH)[0]
    you = _in(hashes[0], _YOU_HASH)[0]
    bad = insult | (weight > 0)
    total = np.concatenate(([0], np.cumsum(you)))
    k = np.arange(len(s))
    lo, hi = np.maximum(first[row], k - NEAR), np.minimum(first[row + 1], k + NEAR + 1)
    beside = bad & (total[hi] > total[lo])
    per = lambda x: np.bincount(row, x, minlength=n_rows)
    size = np.maximum(1, np.diff(at))
    chars = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
    upper = (data >= 65) & (data < 91)
    tall = np.concatenate(([0], np.cumsum(upper)))
    loud = (e - s > 2) & (tall[e] - tall[s] == e - s)
    letter = _ASCII_LETTER[data]
    hidden = np.zeros(len(data), bool)
    triple = np.zeros(len(data), bool)
    if len(data) > 2:
        hidden[1:-1] = _SIGN[data[1:-1]] & letter[:-2] & letter[2:]
        triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    most = np.zeros(n_rows)
    np.maximum.at(most, row, weight)
    cap, excl = chars(upper), chars(data == 33)
    x = np.stack(
        [
            per(weight > 0) / n, per(weight) / n, most, np.log1p(per(weight > 0)), per(insult) / n, np.log1p(per(insult)), np.log1p(per(bad)),
            per(beside) / n, np.log1p(per(beside)), per(you) / n, cap / size, per(loud) / n, excl / size, chars(data == 63) / size,
            chars(_PUNCT[data]) / size, chars(hidden) / n, chars(triple) / n, np.log1p(np.diff(first)),
        ],
        axis=1,
    )
    return x


_INSULT_HASH, _YOU_HASH = _hashes(INSULTS), _hashes(SECOND_PERSON)


@dataclass
class Trees:
    """Boosted trees on logistic loss. Every tree is complete, of ``depth`` levels, over binned features."""

    depth: int = 3
    rounds: int = 80
    rate: float = 0.15
    bins: int = 48
    least: float = 4.0
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edge, x[:, f], "right") for f, edge in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        # nearly all values of some features are 0: quantiles of the others too
        pick = lambda v: np.unique(np.concatenate((np.quantile(v, np.linspace(0, 1, self.bins // 2)[1:-1]), np.quantile(v[v > v.min()], np.linspace(0, 1, self.bins // 2)[:-1]) if (v > v.min()).any() else [])))
        self.edges = [pick(x[:, f]) for f in range(x.shape[1])]
        b, width = self._binned(x), self.bins + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            which, where = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, width, np.int64)
            for level in range(self.depth):
                n = 1 << level
                local = node - (n - 1)
                best = np.full(n, 1e-9)
                for f in range(x.shape[1]):
                    cell = local * width + b[:, f]
                    g = np.bincount(cell, grad, n * width).reshape(n, width)
                    h = np.bincount(cell, hess, n * width).reshape(n, width)
                    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    top = np.argmax(gain, axis=1)
                    value = gain[np.arange(n), top]
                    better = value > best
                    best[better] = value[better]
                    at = np.flatnonzero(better) + n - 1
                    which[at], where[at] = f, top[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), which[node]] > where[node])
            leaf = node - ((1 << self.depth) - 1)
            value = self.rate * np.bincount(leaf, grad, 1 << self.depth) / (np.bincount(leaf, hess, 1 << self.depth) + self.ridge)
            score += value[leaf]
            self.trees.append((which, where, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, where, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, which[node]] > where[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the non-decreasing fit: neighbours that fall are pooled."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # least score, greatest score, positives, rows
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3] or blocks[-2][1] == blocks[-1][0]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    x = [v for b in blocks for v in ((b[0],) if b[0] == b[1] else (b[0], b[1]))]
    p = [(b[2] + 0.01) / (b[3] + 0.02) for b in blocks for _ in range(1 if b[0] == b[1] else 2)]
    return np.array(x), np.maximum.accumulate(np.array(p))


def remainder(key: Column, by: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % by


def lexicon(rows: DataFrame, most: int = MOST_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of terms that mark positive rows of (text, label), and their weights, log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, "text"):
            hashes, _, _, first = _terms(data, at)
            row = np.tile(t.row_of(first), len(hashes))
            h = np.concatenate(hashes)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            keep = (h != 0) & np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
            h, row = h[keep], row[keep]
            label = part.column(1).to_numpy()[row]
            term, at_ = np.unique(h, return_index=True)
            each = np.diff(np.append(at_, len(h)))
            pos = np.add.reduceat(label, at_) if len(h) else label
            many = pos > 0  # the counts of negative rows matter only for terms of positive ones
            totals = np.bincount(part.column(1).to_numpy(), minlength=2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(term.view(np.int64), 0)), pa.array(np.append(pos, totals[1]).astype(np.int64)), pa.array(np.append(each - pos, totals[0]).astype(np.int64)), pa.array(np.append(many, True))],
                names=["term", "pos", "neg", "many"],
            )

    counts = rows.select("text", F.col("label").cast("bigint").alias("label")).mapInArrow(count, "term bigint, pos bigint, neg bigint, many boolean")
    total = counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos >= {LEAST_DOCS} OR term = 0")
    got = total.withColumn("odds", F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5)))
    sums = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not sums[0] or not sums[1]:
        return np.zeros(0, np.uint64), np.zeros(0)
    shift = float(np.log((sums[0] + 1) / (sums[1] + 1)))
    top = got.where((F.col("odds") - shift >= LEAST_ODDS) & (F.col("term") != 0)).orderBy(F.desc(F.col("odds") * F.log1p("pos")), "term").limit(most).collect()
    term = np.array([r.term for r in top], np.int64).view(np.uint64)
    weight = np.array([r.odds - shift for r in top], float)
    order = np.argsort(term)
    return term[order], weight[order]


def scored(docs: DataFrame, labels: DataFrame, by: int = 5, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text leaves 0 by ``by``), score, predicted of each document.

    ``labels`` has (doc_id, toxic); rows with a null label teach nothing, of several labels of a document the greatest counts.
    Rows without a doc_id are scored, teach nothing and are not held out. Equal texts have equal scores, whatever their ids;
    very long ones are measured in one piece.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("label"))
    known = known.where((remainder(F.col("doc_id"), by) != 0) & F.col("label").isin(0, 1))
    # at most most_rows small rows, whatever the input: a broadcast of bounded size, and the texts stay where they are
    sample_of = known.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most_rows)
    taught = docs.join(F.broadcast(sample_of), "doc_id").select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)).alias("part"))
    terms, weights = lexicon(taught.where("part < 4"))
    near_doc = F.xxhash64("doc_id", F.lit("sample"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, "text"):
            x = features(data, at, terms, weights).astype("<f4")
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "part", "near", "x"])

    rows = taught.where("part >= 4").select("text", "label", "part", near_doc.alias("near")).mapInArrow(dense, "label bigint, part bigint, near bigint, x binary")
    sample = rows.orderBy("near", "x").limit(most_rows).collect()
    y = np.array([r.label for r in sample], float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        model, points, chance = Trees(edges=[np.zeros(0)] * _FEATURES), None, share
    else:
        x = np.frombuffer(b"".join(r.x for r in sample), "<f4").reshape(len(y), -1).astype(float)
        fit = np.array([r.part < 8 for r in sample])
        fit = fit if len(set(y[fit].tolist())) == 2 and len(set(y[~fit].tolist())) == 2 else np.ones(len(y), bool)
        model = Trees().fit(x[fit], y[fit])
        rest = ~fit if not fit.all() else fit
        points, chance = isotonic(model.score(x[rest]), y[rest]), 0.0
    sent = spark.sparkContext.broadcast((terms, weights, model, points, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, model, points, chance = sent.value
        for part, data, at in t.chunks(batches, "text"):
            raw = model.score(features(data, at, terms, weights).astype("<f4").astype(float))
            p = np.interp(raw, *points) if points is not None else np.full(len(raw), chance)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), by) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
