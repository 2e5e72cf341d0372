"""Text scores from a log-bilinear language model trained with noise-contrastive estimation.

Counts. Every training token of the corpus is counted: groups of documents send each of their distinct words once
with its count, and get its total back, in the order asked. A word is named by a 64-bit hash whose low bits are its ending class.

Model. The most frequent words are classes of their own; all others form ``ENDINGS`` classes by their last letters, each of
which is dealt into leaves by the word's hash. The number of leaves grows with the square root of the corpus. A
context is the two tokens before, a log-bilinear predictor is the sum of their vectors, each scaled by the
weights of its place, and scores of all classes are its products with their vectors, plus a bias; so are scores of the
leaves of a class. Training is noise-contrastive on both levels: true classes and leaves are told from draws of
the unigram distribution, which needs no normalisation. All
training tokens are used once, in ``ROUNDS`` rounds: each task trains on its rows from the common start, and the
weighted mean of all tasks is the next start. Means are summed on the executors; only one model reaches the driver.

Scores. Products of all contexts with all classes, in batches, give the normaliser of each context once, products with the
leaves of the token's class that of the leaf. The probability of a token is that of its class, times, for an ending class,
that of its leaf and the smoothed share of the word in the leaf, where each leaf keeps the share of one unseen
word. So probabilities over all known words and the unseen ones add up to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._shared import dealt, n_buckets, stored, survey, unpacked

CLASSES, ENDINGS, WIDTH, NOISE, BATCH, ROUNDS, RATE, CALM, SMOOTH = 1024, 64, 24, 32, 1024, 2, 0.1, 30.0, 0.1
#: Noise leaves of a token; leaves of a class at most; floats of the model that are summed at once.
LEAF_NOISE, MOST_LEAVES, SUMMED = 2, 4096, 8192
_LOW = np.uint64(ENDINGS - 1)
#: The end of a text, as a token.
END = np.uint64(0xE0D0E0D0E0D0E0C0)
_ASKED = "bucket int, g int, words binary, counts binary"
_COUNTED = "kind tinyint, g int, bucket int, counts binary"


def leaves_for(n_bytes: int) -> int:
    """Leaves of an ending class for a corpus of so many bytes: 16 at 0.2 GB, 32 at 1 GB, 512 at 250 GB, ``MOST_LEAVES`` from 16 TB on."""
    return min(MOST_LEAVES, 1 << max(0, round(np.log2(max(1, n_bytes) ** 0.5 / 1024))))


def leaf_of(words: np.ndarray, leaves: int) -> np.ndarray:
    """The leaf of a word: its ending class, then bits of its hash."""
    return ((words & _LOW) * np.uint64(leaves) + ((words >> np.uint64(6)) & np.uint64(leaves - 1))).astype(np.int64)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, each row's words and then ``END``; and each row's first token, with the total last."""
    low = t.lower(data)
    h, s, e, first = t.words(low, at, ~t.SPACE)
    tail = np.zeros(len(h), np.int64)
    for back in (1, 2, 3):
        i = e - back
        tail = tail * 257 + np.where(i >= s, low[np.maximum(i, 0)], 0) if len(h) else tail
    h = (h & ~_LOW) | (t.mix(tail.astype(np.uint64)) & _LOW)
    h[h == END] += np.uint64(ENDINGS)
    rows = len(at) - 1
    out = np.full(len(h) + rows, END)
    first = first + np.arange(rows + 1)
    place = np.ones(len(out), bool)
    place[first[1:] - 1] = False
    out[place] = h
    return out, first


def _asked(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, g, words, counts): the distinct words of each group, sorted, with their counts in training rows."""

    def ask(table: pa.Table) -> pa.Table:
        word, count = _distinct(table)
        bucket = (t.mix(word) % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, word, count = bucket[order], word[order], count[order]
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        g = table.column("g")[0].as_py()
        cut = lambda x, size: pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * size).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
        return pa.Table.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(np.full(len(edge) - 1, g, np.int32)), cut(word, 8), cut(count.astype("<i8"), 8)], names=["bucket", "g", "words", "counts"])

    return docs.groupBy("g").applyInArrow(ask, _ASKED)


def _chunked(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return t.chunks(iter([unpacked(table)]), "text")


def _parsed(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a group's rows: their distinct tokens, sorted, the number among those of each token, each row's first token."""
    for part, data, at in _chunked(table):
        word, first = tokens(data, at)
        u, inverse = np.unique(word, return_inverse=True)
        yield part, u, inverse, first


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    held, weight = [], []
    for part, u, inverse, first in _parsed(table):
        train = part.column(part.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
        held.append(u)
        weight.append(np.bincount(inverse, np.repeat(train, np.diff(first)), len(u)))
    word, inverse = np.unique(np.concatenate(held), return_inverse=True)
    return word, np.bincount(inverse, np.concatenate(weight), len(word)).astype(np.int64)


_TOP = np.dtype([("word", "<u8"), ("n", "<i8")])


def _packed(by_n: np.ndarray, by_v: np.ndarray, words: np.ndarray, totals: np.ndarray, most: int) -> bytes:
    """Tokens and words of each leaf, and the ``most`` most frequent words, with the end in any case."""
    top = np.argsort(-totals, kind="stable")[:most]
    top = np.union1d(top[totals[top] > 0], np.flatnonzero((words == END) & (totals > 0)))
    rec = np.empty(len(top), _TOP)
    rec["word"], rec["n"] = words[top], totals[top]
    return by_n.astype("<i8").tobytes() + by_v.astype("<i8").tobytes() + rec.tobytes()


def _merged(packed: list[bytes], most: int, n: int) -> bytes:
    """The summaries of several buckets, with ``n`` leaves, as one."""
    head = np.sum([np.frombuffer(x[: 16 * n], "<i8") for x in packed], axis=0)
    rec = np.concatenate([np.frombuffer(x[16 * n :], _TOP) for x in packed])
    rec = rec[np.lexsort((rec["word"], -rec["n"]))]
    return _packed(head[:n], head[n:], rec["word"], rec["n"], most)


def counted(docs: DataFrame, most: int, n: int, leaves: int) -> DataFrame:
    """kind 0: (g, bucket, counts) totals in the order asked; kind 1: one packed summary of each of ``n`` buckets."""

    def solve(bucket: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word, inverse = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([r[2] for r in rows]), len(word)).astype(np.int64)
        back = total[inverse].astype("<i8")
        edge = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows])))
        leaf = leaf_of(word, leaves)
        summary = _packed(np.bincount(leaf, total, ENDINGS * leaves), np.bincount(leaf, total > 0, ENDINGS * leaves), word, total, most)
        counts = [back[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] + [summary]
        kind = np.append(np.zeros(len(rows), np.int8), np.int8(1))
        g = np.array([r[0] for r in rows] + [0], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(g), pa.array(np.full(len(g), bucket, np.int32)), pa.array(counts, pa.binary())], names=["kind", "g", "bucket", "counts"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, g, words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if bucket != now and held:
                    yield from solve(now, held)
                    held = []
                now = bucket
                held.append((g, np.frombuffer(words.as_buffer(), np.uint64).copy(), np.frombuffer(counts.as_buffer(), "<i8").copy()))
        if held:
            yield from solve(now, held)

    return _asked(docs, n).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _COUNTED)


def summary(table: DataFrame, n: int, most: int, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and words of each leaf, frequent words and their counts. Buckets' summaries are merged in about
    the square root of their number of groups, and those on the driver, so neither holds more than a few thousand."""
    wide, size = max(1, int(n**0.5)), ENDINGS * leaves

    def merge(part: pa.Table) -> pa.Table:
        return pa.table({"counts": pa.array([_merged(part.column("counts").to_pylist(), most, size)], pa.binary())})

    rows = table.where("kind = 1").withColumn("part", F.col("bucket") % wide).select("part", "counts").groupBy("part").applyInArrow(merge, "counts binary").collect()
    packed = [bytes(r.counts) for r in rows]
    whole = _merged(packed, most, size) if packed else _packed(np.zeros(size), np.zeros(size), np.zeros(0, np.uint64), np.zeros(0, np.int64), most)
    head, rec = np.frombuffer(whole[: 16 * size], "<i8"), np.frombuffer(whole[16 * size :], _TOP)
    return head[:size].astype(float), head[size:].astype(float), rec["word"].copy(), rec["n"].copy()


class Vocabulary:
    """Classes: ENDINGS ending classes, the end of a text, then the frequent words; and one more for the start, in contexts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, by_n: np.ndarray, by_v: np.ndarray):
        keep = words != END
        ends = int(counts[~keep].sum())
        words, counts = words[keep], counts[keep]
        order = np.argsort(words)
        self.words, counts = words[order], counts[order]
        self.n, self.v = int(by_n.sum()), int(by_v.sum())
        own = np.append(self.words, END)
        own_n = np.append(counts, ends)
        self.leaves = len(by_n) // ENDINGS
        leaf = leaf_of(own, self.leaves)
        self.rest_n = by_n - np.bincount(leaf, own_n, len(by_n))
        self.rest_v = by_v - np.bincount(leaf, own_n > 0, len(by_n))
        self.size = ENDINGS + 1 + len(self.words)
        self.counts = np.concatenate((self.rest_n.reshape(ENDINGS, -1).sum(axis=1), [ends], counts)).astype(float)

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = (words & _LOW).astype(np.int64)
        if len(self.words):
            i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[i] == words, i + ENDINGS + 1, out)
        return np.where(words == END, ENDINGS, out)

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes one and two tokens before; the start class before a text."""
        one, two = np.full(len(classes), self.size), np.full(len(classes), self.size)
        one[1:] = classes[:-1]
        two[2:] = classes[:-2]
        begin = first[:-1]
        one[begin] = two[begin] = self.size
        second = begin[np.diff(first) > 1] + 1
        two[second] = self.size
        return one, two


class Model:
    """Vectors of classes as context (R) and as target (Q), weights of the two places (C), biases (b), vectors and biases of leaves (U, c)."""

    def __init__(self, vocabulary: Vocabulary, width: int = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = vocabulary.size
        share = (vocabulary.counts + SMOOTH) / (vocabulary.counts + SMOOTH).sum()
        self.parts = {
            "R": rng.normal(0, 0.3, (k + 1, width)).astype("f4"),
            "Q": np.zeros((k, width), "f4"),
            "C": np.ones((2, width), "f4") * np.array([[1.0], [0.7]], "f4"),
            "b": np.log(share).astype("f4"),
        }
        self.leaves = vocabulary.leaves
        inside = vocabulary.rest_n.reshape(ENDINGS, -1) + SMOOTH
        inside = (inside / inside.sum(axis=1, keepdims=True)).ravel()
        self.parts |= {"U": np.zeros((len(inside), width), "f4"), "c": np.log(inside).astype("f4")}
        self.noise, self.leaf_noise = share, inside

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts.values()])

    def set(self, flat: np.ndarray) -> Model:
        at = 0
        for name, x in self.parts.items():
            self.parts[name] = flat[at : at + x.size].reshape(x.shape).astype("f4")
            at += x.size
        return self

    def trainer(self, seed: int, noise: int = NOISE, rate: float = RATE):
        """A function that takes one batch (target, leaf, one before, two before) and steps uphill; steps are scaled by past gradients."""
        rng = np.random.default_rng(seed)
        p, past = self.parts, {k: np.full_like(v, CALM) for k, v in self.parts.items()}
        log_noise = np.log(noise * self.noise).astype("f4")
        edge = np.cumsum(self.noise)
        leaves, leaf_edge = self.leaves, np.cumsum(self.leaf_noise)
        log_leaf = np.log(LEAF_NOISE * self.leaf_noise).astype("f4")

        def descend(w: np.ndarray, leaf: np.ndarray, h: np.ndarray, dh: np.ndarray) -> None:
            """Tells the leaves of ending classes from others of their class; adds to dh."""
            rows = np.flatnonzero(w < ENDINGS)
            if leaves < 2 or not len(rows):
                return
            true, h_ = leaf[rows], h[rows]
            # each ending class takes up 1 of the cumulated noise
            drawn = np.minimum(np.searchsorted(leaf_edge, w[rows][:, None] + rng.random((len(rows), LEAF_NOISE))), (w[rows][:, None] + 1) * leaves - 1)
            drawn = np.maximum(drawn, w[rows][:, None] * leaves)
            ut, ud = p["U"][true], p["U"][drawn]
            gt = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h_, ut) + p["c"][true] - log_leaf[true], -30, 30)))
            gn = -1 / (1 + np.exp(-np.clip(np.einsum("ij,ikj->ik", h_, ud) + p["c"][drawn] - log_leaf[drawn], -30, 30)))
            dh[rows] += gt[:, None] * ut + np.einsum("ik,ikj->ij", gn, ud)
            ids = np.concatenate((true, drawn.ravel()))
            add("U", ids, np.concatenate((gt[:, None] * h_, (gn[:, :, None] * h_[:, None, :]).reshape(-1, h_.shape[1]))))
            add("c", ids, np.concatenate((gt, gn.ravel())))

        def add(name: str, ids: np.ndarray, g: np.ndarray) -> None:
            order = np.argsort(ids.astype(np.uint16) if len(p[name]) < 1 << 16 else ids, kind="stable")  # by radix where it can
            ids = ids[order]
            at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            who, total = ids[at], np.add.reduceat(g[order], at, axis=0)
            past[name][who] += total * total
            p[name][who] += rate * total / np.sqrt(past[name][who])

        def step(w: np.ndarray, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
            r1, r2 = p["R"][one], p["R"][two]
            h = p["C"][0] * r1 + p["C"][1] * r2
            drawn = np.minimum(np.searchsorted(edge, rng.random(noise) * edge[-1]), len(edge) - 1)
            qw, qn = p["Q"][w], p["Q"][drawn]
            true = np.einsum("ij,ij->i", h, qw) + p["b"][w] - log_noise[w]
            gd = 1 / (1 + np.exp(np.clip(true, -30, 30)))
            false = h @ qn.T + (p["b"][drawn] - log_noise[drawn])
            gn = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
            dh = gd[:, None] * qw + gn @ qn
            descend(w, leaf, h, dh)
            add("Q", np.concatenate((w, drawn)), np.concatenate((gd[:, None] * h, gn.T @ h)))
            add("b", np.concatenate((w, drawn)), np.concatenate((gd, gn.sum(axis=0))))
            add("R", np.concatenate((one, two)), np.concatenate((p["C"][0] * dh, p["C"][1] * dh)))
            add("C", np.array([0, 1]), np.stack(((r1 * dh).sum(axis=0), (r2 * dh).sum(axis=0))))

        return step

    def normalisers(self, most: int = 1 << 23) -> np.ndarray:
        """Log of the sum over classes, for each pair of classes before: [one, two]."""
        r, q, b, c = (self.parts[x] for x in ("R", "Q", "b", "C"))
        out = np.empty((len(r), len(r)), "f4")
        by = q @ (r * c[1]).T  # classes x second place
        for i in range(len(r)):
            s = by + (q @ (r[i] * c[0]) + b)[:, None]
            top = s.max(axis=0)
            out[i] = np.log(np.exp(s - top).sum(axis=0)) + top
        return out

    def log_probability(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, z: np.ndarray, leaf: np.ndarray | None = None) -> np.ndarray:
        """Of the classes, and of the leaves where they are given."""
        p, n = self.parts, self.leaves
        out = np.empty(len(w))
        for lo in range(0, len(w), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            h = p["C"][0] * p["R"][one[s]] + p["C"][1] * p["R"][two[s]]
            out[s] = np.einsum("ij,ij->i", h, p["Q"][w[s]]) + p["b"][w[s]] - z[one[s], two[s]]
            if leaf is not None and n > 1:
                order = np.argsort(w[s], kind="stable")
                cut = np.searchsorted(w[s][order], np.arange(ENDINGS + 1))
                for c in np.flatnonzero(np.diff(cut)).tolist():
                    for at in range(int(cut[c]), int(cut[c + 1]), max(1, (1 << 22) // n)):
                        rows = order[at : min(int(cut[c + 1]), at + max(1, (1 << 22) // n))]
                        x = h[rows] @ p["U"][c * n : c * n + n].T + p["c"][c * n : c * n + n]
                        top = x.max(axis=1)
                        total = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top
                        out[lo + rows] += x[np.arange(len(rows)), leaf[s][rows] - c * n] - total
        return out


def trained(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` rounds over the training rows of (doc_id, text, train)."""
    spark = docs.sparkSession
    model = Model(vocabulary)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((model, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            start, words = sent.value
            own = Model.__new__(Model)
            own.parts, own.noise, own.leaves, own.leaf_noise = {x: v.copy() for x, v in start.parts.items()}, start.noise, start.leaves, start.leaf_noise
            step, seen = own.trainer(1000 + k), 0
            for _, data, at in t.chunks(batches, "text"):
                word, first = tokens(data, at)
                w, leaf = words.classes(word), leaf_of(word, words.leaves)
                one, two = words.contexts(w, first)
                for lo in range(0, len(w), BATCH):
                    s = slice(lo, lo + BATCH)
                    step(w[s], leaf[s], one[s], two[s])
                seen += len(w)
            if seen:
                flat = np.append(float(seen), own.flat().astype(float) * seen)
                parts = [flat[lo : lo + SUMMED].tobytes() for lo in range(0, len(flat), SUMMED)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["i", "x"])

        def add_up(table: pa.Table) -> pa.Table:
            total = 0.0
            for x in table.column("x"):
                total = total + np.frombuffer(x.as_buffer())
            return pa.table({"i": table.column("i")[:1], "x": pa.array([total.tobytes()], pa.binary())})

        part = docs.where("train").where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k).select("text")
        sums = part.mapInArrow(run, "i int, x binary").groupBy("i").applyInArrow(add_up, "i int, x binary").toArrow()
        if sums.num_rows:
            x = np.concatenate([np.frombuffer(y) for _, y in sorted(zip(sums.column("i").to_pylist(), sums.column("x").to_pylist(), strict=True))])
            model.set(x[1:] / x[0])
    return model


def remainder(key: Column, by: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % by


def scored(docs: DataFrame, by: int = 10, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Rows whose crc32 of the id as text leaves 0 by ``by`` are held out of counts and training. Null is the empty text,
    whose one token is the end. Repeated rows count as often as they come. Rows without a doc_id are scored, teach nothing
    and are not held out. With no training row all counts are 0. Of words equally frequent at the vocabulary's edge those
    of least hash are classes of their own. Which rows a task trains on follows the layout of the input, and so do the
    later decimals of ``score``; counts and ``base_score`` do not.
    """
    spark = docs.sparkSession
    left = remainder(F.col("doc_id"), by)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(left != 0, F.lit(False)).alias("train"), F.coalesce(left == 0, F.lit(False)).alias("held_out"))
    size, _ = survey(docs)
    n = n_buckets(spark, 1, size)
    groups = dealt(docs, n_buckets(spark, 4, size), F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")))
    most = classes - ENDINGS - 1
    leaves = leaves_for(size)
    table = stored(counted(groups, most, n, leaves), "counts")
    by_n, by_v, words, counts = summary(table, n, most, leaves)
    vocabulary = Vocabulary(words, counts, by_n, by_v)
    model = trained(docs, vocabulary, rounds)
    sent = spark.sparkContext.broadcast((model, vocabulary, model.normalisers()))

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        model, words, z = sent.value
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not own.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        parts = list(_parsed(own))
        known = np.unique(np.concatenate([u for _, u, *_ in parts]))
        bucket = (t.mix(known) % np.uint64(n)).astype(np.int32)
        known = known[np.argsort(bucket, kind="stable")]
        back = sorted(zip(told.column("bucket").to_pylist(), told.column("counts").to_pylist(), strict=True))
        total = np.frombuffer(b"".join(x[1] for x in back), "<i8").astype(float)
        order = np.argsort(known)
        known, total = known[order], total[order]
        log_base = np.log10((total + SMOOTH) / (words.n + SMOOTH * (words.v + 1)))
        leaf = leaf_of(known, words.leaves)
        log_share = np.log((total + SMOOTH) / (words.rest_n[leaf] + SMOOTH * (words.rest_v[leaf] + 1)))
        out = []
        class_ = words.classes(known)
        for part, u, inverse, first in parts:
            i = np.searchsorted(known, u)[inverse]
            w = class_[i]
            logp = model.log_probability(w, *words.contexts(w, first), z, leaf[i]) + np.where(w < ENDINGS, log_share[i], 0.0)
            row = t.row_of(first)
            per = lambda x: np.bincount(row, x, part.num_rows)
            got = [part.column(0), part.column("held_out"), np.diff(first), per(total[i] > 0).astype(np.int64), np.full(part.num_rows, words.n), per(log_base[i]), per(logp) / np.log(10)]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c.cast(k) for c, k in zip(got, kinds, strict=True)], names=names))
        return pa.Table.from_batches(out)

    told = table.where("kind = 0").select("g", "bucket", "counts")
    ddl = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return groups.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(score, ddl)
