"""Quality scores by positive-unlabelled learning: trusted positives, unlabelled web text and an estimated class prior.

Known good documents (label 1) are the only labels used; all other text is unlabelled, of which some share, the class prior, is
good too. With P the positives, U all texts of the training part and l the logistic loss, the unbiased risk of a score g is
``prior * E_P[l(g)] + (E_U[l(-g)] - prior * E_P[l(-g)])``. The bracket is the risk on negatives, which can't be negative: where
it falls below 0 the step goes up along its gradient instead, as in non-negative PU learning.

The prior comes from the data by best-bin estimation: a first model tells P from U, and on rows that it has not seen the prior
is the least ratio of the share of U to the share of P above any score, with a bound for chance.

The score is additive: a weight for each bin of each of a fixed list of dense features. Edges of bins are fixed, so a text's bins
depend on the text alone, and a document becomes a few bytes where it is read. Training passes run over these bytes of all
documents, labelled or not, without samples or caps: every task returns sums of losses, gradients and curvature, and sums of tasks
are added up on executors in groups before they reach the driver, where the damped Newton step is taken.

Null, empty and blank texts have the bins of a text without words and the score of such. Rows without a doc_id are scored and count
as unlabelled text; rows that share a doc_id are scored one by one, with the labels of the id. Of several labels of a document the
greatest counts; null labels teach nothing. Very long texts are measured in one piece. Without a trusted positive nothing can be learnt
and every score is 0.5. An empty table gives no row. Columns of the input but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._shared import dropped, stored
from .toxicity import remainder

BINS = 16
#: Shares are binned by their logarithm ("log"), or evenly ("even"); amounts by their logarithm ("size").
FEATURES = {
    "words": "size", "word_length": "size", "line_words": "size", "distinct_words": "even", "top_word": "log", "repeated_trigrams": "even", "repeated_lines": "even", "repeated_neighbours": "log",
    "capitals": "log", "capital_words": "log", "symbols": "log", "marks": "log", "digits": "log", "punctuation": "log", "wordless": "log", "symbol_words": "log", "sentence_ends": "log", "long_words": "log", "non_ascii": "even",
}
WIDTH = len(FEATURES) * BINS
#: Penalties of a weight and of the step between neighbouring bins, per row; passes of each fit; step of the correction.
RIDGE, ROUGH, PASSES, CORRECTION = 2e-4, 2e-3, 12, 0.5
#: One row in so many is kept from the first model and gives the prior; bins of its scores; chance allowed for.
HOLD, CUTS, CHANCE = 5, 1024, 0.1

_is = lambda *codes: np.isin(np.arange(256), np.array([x for c in codes for x in (c if isinstance(c, range) else [c])]))
_UPPER, _SMALL, _DIGIT, _HIGH = _is(range(65, 91)), _is(range(97, 123)), _is(range(48, 58)), _is(range(128, 256))
_SYMBOL, _MARK, _PUNCT, _END = _is(*b"#*$%&|<>@^~_=+\\/{}[]"), _is(*b"!?"), _is(*b".,;:'\"()-"), _is(*b".!?")
_SOLID = _UPPER | _SMALL | _DIGIT | _HIGH


def _binned(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "even":
        out = x * BINS
    elif kind == "log":  # 0, then two bins for each halving below 1
        out = np.where(x > 0, 2 * np.log2(np.maximum(x, 1e-12)) + BINS, 0)
    else:
        out = np.log2(np.maximum(x, 0) + 1)
    floor = 1 if kind == "log" else 0
    return np.where((x > 0) | (kind != "log"), np.clip(np.floor(out), floor, BINS - 1), 0).astype(np.uint8)


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The features of each row of one slice of texts."""
    n_rows = len(at) - 1
    h, s, e, first = t.words(data, at, ~t.SPACE)
    row, n = t.row_of(first), np.diff(first)
    words, size = np.maximum(n, 1), np.maximum(np.diff(at), 1)
    per = lambda x: np.bincount(row, x, minlength=n_rows)
    before = lambda mask: np.concatenate(([0], np.cumsum(mask[data])))
    within = lambda total: total[e] - total[s]
    upper, small, symbol, solid, high = (before(x) for x in (_UPPER, _SMALL, _SYMBOL, _SOLID, _HIGH))
    by_row = lambda total: np.diff(total[at])
    letters = np.maximum(by_row(upper) + by_row(small) + by_row(high), 1)

    def repeats(key: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys that occurred before in the row, by row; and the most of one key."""
        order = np.argsort(t.mix(key ^ t.mix(r.astype(np.uint64) + np.uint64(1))))
        k, rr = key[order], r[order]
        edge = t.edges(k, rr)
        run = np.diff(edge)
        most = np.zeros(n_rows, np.int64)
        if len(run):
            np.maximum.at(most, rr[edge[:-1]], run)
            return np.bincount(rr[edge[:-1]], run - 1, minlength=n_rows), most
        return np.zeros(n_rows), most

    again, most = repeats(h, row)
    pos = t.gram_rows(first, 3)
    again3, _ = repeats(t.grams(h, 3)[pos], row[pos])
    ls, le, _ = t.word_borders(data, at, ~_is(10))
    kept = solid[le] > solid[ls]
    ls, le = ls[kept], le[kept]
    line_row = np.searchsorted(at, ls, "right") - 1
    line_key = t.span_hash(data, ls, le)
    again_line, _ = repeats(line_key, line_row)
    lines = np.maximum(np.bincount(line_row, minlength=n_rows), 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    length = e - s
    return {
        "words": n, "word_length": 2 ** np.minimum(per(length) / words, 15) - 1, "line_words": n / lines, "distinct_words": 1 - again / words, "top_word": most / words,
        "repeated_trigrams": again3 / words, "repeated_lines": again_line / lines, "repeated_neighbours": per(same) / words, "capitals": by_row(upper) / letters,
        "capital_words": per((within(upper) > 1) & (within(small) == 0)) / words, "symbols": by_row(symbol) / size, "marks": by_row(before(_MARK)) / size, "digits": by_row(before(_DIGIT)) / size,
        "punctuation": by_row(before(_PUNCT)) / size, "wordless": per(within(solid) == 0) / words, "symbol_words": per(within(symbol) > 0) / words,
        "sentence_ends": per(_END[data[e - 1]]) / words, "long_words": per(length > 25) / words, "non_ascii": by_row(high) / size,
    }


def bins(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One byte per row and feature."""
    found = measures(data, at)
    return np.stack([_binned(np.asarray(found[k], float), kind) for k, kind in FEATURES.items()], axis=1)


def binned(docs: DataFrame) -> DataFrame:
    """doc_id and x, the bins of the text, one row per row; texts are read where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, "text"):
            x = bins(data, at)
            yield pa.RecordBatch.from_arrays([part.column(0), _packed(x)], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, x binary")


def _packed(x: np.ndarray) -> pa.Array:
    off = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _cells(column: pa.Array) -> np.ndarray:
    """The weight numbers of each row: one of each feature."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(len(column), -1).astype(np.int64) + np.arange(len(FEATURES)) * BINS


@dataclass
class Sums:
    """Of one kind of rows: their number, losses of both signs, gradients (bias last) of both, curvature."""

    n: float
    loss_up: float
    loss_down: float
    up: np.ndarray
    down: np.ndarray
    curve: np.ndarray

    SIZE = 3 + 2 * (WIDTH + 1) + (WIDTH + 1) * (WIDTH + 2) // 2

    def packed(self) -> np.ndarray:
        return np.concatenate(([self.n, self.loss_up, self.loss_down], self.up, self.down, self.curve[np.triu_indices(WIDTH + 1)]))

    @classmethod
    def unpacked(cls, x: np.ndarray) -> Sums:
        w = WIDTH + 1
        curve = np.zeros((w, w))
        curve[np.triu_indices(w)] = x[3 + 2 * w :]
        return cls(*x[:3], x[3 : 3 + w], x[3 + w : 3 + 2 * w], curve + np.triu(curve, 1).T)


def sums_of(cells: np.ndarray, w: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Packed ``Sums`` of rows that count ``times`` each: losses l(g) = log(1 + exp(-g)) and l(-g) of the scores under ``w``."""
    g = w[cells].sum(axis=1) + w[WIDTH]
    p = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
    total = lambda x: np.append(np.bincount(cells.ravel(), np.repeat(x, cells.shape[1]), WIDTH), x.sum())
    up, down, bend = total(times * (p - 1)), total(times * p), times * p * (1 - p)
    curve = np.zeros((WIDTH + 1, WIDTH + 1))
    curve[:WIDTH, WIDTH] = np.bincount(cells.ravel(), np.repeat(bend, cells.shape[1]), WIDTH)
    curve[WIDTH, WIDTH] = bend.sum()
    for i in range(cells.shape[1]):
        for j in range(i, cells.shape[1]):
            pair = np.bincount((cells[:, i] - i * BINS) * BINS + cells[:, j] - j * BINS, bend, BINS * BINS)
            curve[i * BINS : (i + 1) * BINS, j * BINS : (j + 1) * BINS] = pair.reshape(BINS, BINS)
    return Sums(times.sum(), (times * np.logaddexp(0, -g)).sum(), (times * np.logaddexp(0, g)).sum(), up, down, curve).packed()


def _gathered(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' vectors: added up on executors in about as many groups as each has members, then on the driver."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table.column("v"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    # tasks are told apart by a number; its hash by the square root of what the shuffle is as wide as
    groups = max(1, int(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    got = parts.withColumn("g", F.pmod(F.xxhash64("task"), F.lit(groups))).groupBy("g").applyInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r.v, np.float64) for r in got), np.zeros(width))


def pass_over(taught: DataFrame, w: np.ndarray, fold: str | None) -> tuple[Sums, Sums]:
    """Sums over all positives and over all rows of ``taught`` (x, positive, held) under weights ``w``."""
    sent = taught.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * Sums.SIZE)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(lo, 1 << 16)
                cells, positive = _cells(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
                total[Sums.SIZE :] += sums_of(cells, sent.value, np.ones(len(cells)))
                total[: Sums.SIZE] += sums_of(cells[positive], sent.value, np.ones(int(positive.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    rows = taught.where(fold) if fold else taught
    total = _gathered(rows.select("x", "positive").mapInArrow(run, "v binary").withColumn("task", F.spark_partition_id()), 2 * Sums.SIZE)
    sent.unpersist()
    return Sums.unpacked(total[: Sums.SIZE]), Sums.unpacked(total[Sums.SIZE :])


def _penalty() -> np.ndarray:
    """Curvature of the penalties: of weights, and of steps between bins of one feature."""
    step = np.diff(np.eye(BINS), axis=0)
    out = np.kron(np.eye(len(FEATURES)), ROUGH * step.T @ step + RIDGE * np.eye(BINS))
    return np.pad(out, ((0, 1), (0, 1)))


def newton(w: np.ndarray, grad: np.ndarray, curve: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The next weights: a damped step; no score moves by more than a few units at once."""
    step = np.linalg.solve(curve + penalty + 1e-6 * np.eye(len(w)), grad + penalty @ w)
    most = np.abs(step).max()
    return w - step * min(1.0, 2.0 / most) if most else w


def told_apart(taught: DataFrame) -> np.ndarray:
    """Weights of the first model, which tells positives from all rows."""
    w, penalty = np.zeros(WIDTH + 1), _penalty()
    for _ in range(PASSES // 2):
        p, u = pass_over(taught, w, "NOT held")
        w = newton(w, p.up / p.n + u.down / u.n, p.curve / p.n + u.curve / u.n, penalty)
    return w


def prior_of(n_pos: np.ndarray, n_all: np.ndarray) -> float:
    """Best-bin estimate from counts of positives and of all rows by rising score."""
    above = lambda x: np.cumsum(x[::-1])
    p, u, n_p, n_u = above(n_pos), above(n_all), n_pos.sum(), n_all.sum()
    share_p, share_u = p[p > 0] / n_p, u[p > 0] / n_u
    slack = 1.01 * (np.sqrt(np.log(4 / CHANCE) / (2 * n_u)) + np.sqrt(np.log(4 / CHANCE) / (2 * n_p))) / share_p
    return float(np.clip((share_u / share_p)[np.argmin(share_u / share_p + slack)], 0.01, 0.99))


def estimated_prior(taught: DataFrame, w: np.ndarray) -> float:
    """The share of good texts among all, from the rows that the first model has not seen."""
    sent = taught.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, CUTS))
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _chance(_cells(batch.column(0)), sent.value)
            at = np.minimum((p * CUTS).astype(np.int64), CUTS - 1)
            count[1] += np.bincount(at, minlength=CUTS)
            count[0] += np.bincount(at[batch.column(1).to_numpy(zero_copy_only=False)], minlength=CUTS)
        yield pa.RecordBatch.from_arrays([pa.array([count.tobytes()], pa.binary())], names=["v"])

    rows = taught.where("held").select("x", "positive").mapInArrow(run, "v binary").withColumn("task", F.spark_partition_id())
    pos, every = _gathered(rows, 2 * CUTS).reshape(2, CUTS)
    sent.unpersist()
    return prior_of(pos, every) if pos.sum() and every.sum() else 0.5


def _chance(cells: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[cells].sum(axis=1) + w[WIDTH], -60, 60)))


def step_of(p: Sums, u: Sums, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and the direction to go down: the gradient of the unbiased risk, or, where the risk on negatives has
    fallen below 0, back up along that part's own gradient."""
    negative = u.loss_down / u.n - prior * p.loss_down / p.n
    back = u.down / u.n - prior * p.down / p.n
    risk = prior * p.loss_up / p.n + max(0.0, negative)
    return risk, (prior * p.up / p.n + back if negative >= 0 else -CORRECTION * back)


def fitted(taught: DataFrame, prior: float) -> np.ndarray:
    """Weights of least non-negative risk over all rows of ``taught``."""
    w, penalty = np.append(np.zeros(WIDTH), np.log(prior / (1 - prior))), _penalty()
    best, least = w, np.inf
    for k in range(PASSES + 1):
        p, u = pass_over(taught, w, None)
        risk, grad = step_of(p, u, prior)
        if risk + w @ penalty @ w / 2 < least:
            best, least = w, risk + w @ penalty @ w / 2
        if k < PASSES:
            w = newton(w, grad, u.curve / u.n, penalty)
    return best


def scored(docs: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text leaves ``held_out`` by ``by``), score, predicted (score of ``least`` or more), prior.

    ``labels`` has (doc_id, quality). Nothing of held-out rows, label or text, is used in training.
    """
    spark = docs.sparkSession
    out: Column = F.coalesce(remainder(F.col("doc_id"), by) == held_out, F.lit(False))
    rows = stored(binned(docs).withColumn("held_out", out), "bins")
    good = labels.where("doc_id IS NOT NULL AND quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    part = F.pmod(F.xxhash64("doc_id", "x", F.lit("held")), F.lit(HOLD)) == 0
    taught = stored(rows.where("NOT held_out").join(good, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"), part.alias("held")), "taught")
    n_good = taught.where("positive").count()
    w, prior = np.zeros(WIDTH + 1), 0.5
    if n_good:
        prior = estimated_prior(taught, told_apart(taught))
        w = fitted(taught, prior)
    dropped(taught)
    sent = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chance(_cells(batch.column(2)), sent.value) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(p), pa.array((p >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int").withColumn("prior", F.lit(prior))
