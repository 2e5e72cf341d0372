"""Near-duplicate classes from bottom-k sketches of word shingles.

One hash function serves all: a document's sketch is the k smallest hashes of its shingle set (the whole set where it
is smaller). Documents of equal sets form a class first, and only its smallest id goes on. Inverted lists of retained
values bring candidates together, the sketch of the union estimates their similarity, and full sets verify it.

Which values are listed: a pair at the threshold shares at least ``floor_share`` of the union's k smallest values but
for a chance of about 1e-7, so leaving each document's ``t - 1`` most frequent values out (t = floor_share * k)
still leaves such a pair one list in common. Values that one document has alone need no list. A passage that many
documents share therefore makes no long list unless it is a third or more of the document.

Inside a list a search visits members and keeps one tree of candidate links for each group that hangs together,
never all pairs; long lists are dealt into parts. Groups of the same members in other lists join to loose clusters. A
cluster's texts meet once, in blocks of bounded size that share a pivot: full sets are compared from one document on to
those it links with, and by products of incidence matrices for the rest. What stands apart from the most of a
cluster of several blocks is compared with all of it. Again only trees of the true links go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as t
from ._shared import ROW, dealt, keyed, n_buckets, stored, survey, unpacked, with_text
from .components import components

#: Values of a sketch; the chance with which a pair at the threshold may be lost to its sketches.
K, LOST = 32, 1e-7
#: A block of a cluster holds about so many shingles and documents at most.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 21, 4096
#: Members of a list that are searched in one place; visits without a link before products take over; their rows at once.
HOT, IDLE, ROWS = 1 << 16, 32, 2048
_NONE, _PAD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint32(0xFFFFFFFF)
_COUNT = np.dtype([("v", "<u8"), ("n", "<i8"), ("g", "<i4")])
_LIST = np.dtype([("v", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("part", "<i4"), ("sketch", "<u4", K)])


def floor_share(percent: int) -> float:
    """Share of the union's ``K`` smallest values that a pair at ``percent`` per cent has in common but for a chance of
    ``LOST``, by the binomial distribution: 12 of 32 at 80. Below 40 per cent there is none, an error."""
    p, tail, t = percent / 100, 0.0, 0
    while t < K and (tail := tail + comb(K, t) * p**t * (1 - p) ** (K - t)) <= LOST:
        t += 1
    if not t:
        raise ValueError(f"sketches of {K} values do not find pairs at {percent} per cent")
    return t / K


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row; and each row's first, with the total last."""
    h, _, _, first = t.words(t.lower(data), at, ~t.SPACE)
    pos = t.gram_rows(first, size)
    g, row = t.grams(h, size)[pos], t.row_of(first)[pos]
    count = np.diff(first)
    for m in range(1, size):  # shorter texts: the whole sequence is the one shingle
        if len(short := np.flatnonzero(count == m)):
            g = np.concatenate((g, t.mix(t.grams(h, m)[first[short]] + np.uint64(m))))
            row = np.concatenate((row, short))
    g[g == _NONE] = 0
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        keep = np.append(True, (g[1:] != g[:-1]) | (row[1:] != row[:-1]))
        g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(len(at)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, sig_a, sig_b, sketch): the set's size, a 128-bit name of the set, its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, "text"):
            g, edge = shingle_sets(data, at, size)
            n = np.diff(edge)
            sums = [np.concatenate((np.zeros(1, t.U64), np.cumsum(t.mix(g ^ np.uint64(x)), dtype=t.U64))) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            sig = [(s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums]
            held = np.minimum(n, K)
            off = np.concatenate(([0], np.cumsum(held)))
            take = np.repeat(edge[:-1] - off[:-1], held) + np.arange(off[-1])
            sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((off * 8).astype(np.int32).tobytes()), pa.py_buffer(g[take].tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sig[0]), pa.array(sig[1]), sketch], names=["doc_id", "n_shingles", "sig_a", "sig_b", "sketch"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, sig_a bigint, sig_b bigint, sketch binary")


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column of 64-bit hashes, and the count in each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, t.U64), np.zeros(0, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw.copy().view(t.U64), np.diff(off) // 8


def _met(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket")


def counted(groups: DataFrame, n: int) -> DataFrame:
    """(g, payload): for each group how many representatives hold each of its values that others hold too.

    A group sends each value once with its count, so a value that a third of all documents hold costs one record a group.
    """

    def ask(table: pa.Table) -> pa.Table:
        values, _ = _sketches(unpacked(table).column("sketch"))
        value, count = np.unique(values, return_counts=True)
        rec = np.empty(len(value), _COUNT)
        rec["v"], rec["n"], rec["g"] = value, count, table.column("g")[0].as_py()
        return pa.Table.from_batches([t.squeezed_blocks((value % np.uint64(n)).astype(np.int32), rec)], schema=t.BLOCKS)

    def answer(batches):
        for rec in t.unsqueezed(batches, _COUNT):
            rec = rec[np.argsort(rec["v"], kind="stable")]
            edge = t.edges(rec["v"])
            size = np.diff(edge)
            rec["n"] = np.repeat(np.add.reduceat(rec["n"], edge[:-1]), size) if len(rec) else rec["n"]
            rec = rec[rec["n"] > 1]
            got = t.squeezed_blocks(rec["g"], rec)
            yield pa.RecordBatch.from_arrays(got.columns, names=["g", "payload"])

    return _met(groups.groupBy("g").applyInArrow(ask, t.BLOCKS_DDL)).mapInArrow(answer, "g int, payload binary")


def listed(groups: DataFrame, n: int, percent: int) -> DataFrame:
    """(bucket, payload): inverted lists: each representative under the values that list it, with its sketch.

    A list of more than ``HOT`` members is dealt into parts by a hash of the member.
    """
    floor = floor_share(percent)

    def post(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return pa.Table.from_batches([], schema=t.BLOCKS)
        rows = unpacked(own)
        values, count = _sketches(rows.column("sketch"))
        ids, size = rows.column("doc_id").to_numpy(), rows.column("n_shingles").to_numpy()
        total = np.concatenate([t.unsqueeze(x.as_buffer(), _COUNT) for x in told.column("payload")])
        total = total[np.argsort(total["v"], kind="stable")]
        at = np.minimum(np.searchsorted(total["v"], values), len(total) - 1)
        freq = np.where(total["v"][at] == values, total["n"][at], 1)
        row = np.repeat(np.arange(len(ids)), count)
        keep = np.flatnonzero(freq > 1)
        keep = keep[np.lexsort((values[keep], freq[keep], row[keep]))]
        edge = t.edges(row[keep])
        have, of = np.diff(edge), row[keep][edge[:-1]]
        least = np.ceil(floor * np.minimum(size[of], K)).astype(np.int64)
        held = np.maximum(0, have - least + 1)
        off = np.concatenate(([0], np.cumsum(held)))
        take = keep[np.repeat(edge[:-1] - off[:-1], held) + np.arange(off[-1])]
        who = row[take]
        sketch = np.full((len(ids), K), _PAD, np.uint32)
        sketch[np.arange(K) < count[:, None]] = np.minimum(values >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32)
        rec = np.empty(len(take), _LIST)
        rec["v"], rec["doc"], rec["n"], rec["sketch"] = values[take], ids[who], size[who], sketch[who]
        parts = -(-freq[take] // HOT)
        rec["part"] = np.where(parts > 1, t.mix(ids[who].view(t.U64)) % parts.astype(t.U64), -1)
        key = t.mix(rec["v"] + (rec["part"] + 1).astype(t.U64))
        return pa.Table.from_batches([t.blocks((key % np.uint64(n)).astype(np.int32), rec, t.BLOCKS)], schema=t.BLOCKS)

    return groups.groupBy("g").cogroup(counted(groups, n).groupBy("g")).applyInArrow(post, t.BLOCKS_DDL)


def _estimate(one: np.ndarray, one_n: int, many: np.ndarray, many_n: np.ndarray) -> np.ndarray:
    """Similarity of one document to many, from the k smallest values of each union; padding is the largest value."""
    i = np.searchsorted(one, many)
    shared = (one[np.minimum(i, K - 1)] == many) & (many != _PAD)
    return _share(i, shared, np.int64(one_n), many_n)


def _estimate_rows(left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray) -> np.ndarray:
    """The same for pairs of rows."""
    i = (left[:, None, :] < right[:, :, None]).sum(axis=2)
    shared = (left[:, None, :] == right[:, :, None]).any(axis=2) & (right != _PAD)
    return _share(i, shared, left_n, right_n)


def _share(i: np.ndarray, shared: np.ndarray, one_n: np.ndarray, many_n: np.ndarray) -> np.ndarray:
    rank = i + np.arange(K) - (np.cumsum(shared, axis=1) - shared)
    union = np.minimum(one_n, K) + np.minimum(many_n, K) - shared.sum(axis=1)
    return (shared & (rank < K)).sum(axis=1) / np.maximum(1, np.minimum(K, union))


def _sizes_fit(one: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    one, many = np.int64(one), many.astype(np.int64)
    return 100 * np.minimum(one, many) >= percent * np.maximum(one, many)


def _groups(rec: np.ndarray, percent: int) -> list[list[int]]:
    """Members that hang together by estimate, two at least; the most central members are visited first."""
    floor = floor_share(percent)
    values, inverse = np.unique(rec["sketch"], return_inverse=True)
    held = np.bincount(inverse.ravel())
    held[values == _PAD] = 0
    left = np.argsort(-held[inverse.reshape(rec["sketch"].shape)].sum(axis=1), kind="stable")
    out, queue, group = [], [], []
    while len(left):
        if not queue:
            out.append(group)
            queue, left = [int(left[0])], left[1:]
            group = list(queue)
            continue
        p = queue.pop()
        fit = np.flatnonzero(_sizes_fit(rec["n"][p], rec["n"][left], percent))
        near = fit[_estimate(rec["sketch"][p], int(rec["n"][p]), rec["sketch"][left[fit]], rec["n"][left[fit]].astype(np.int64)) >= floor]
        got = left[near].tolist()
        group += got
        queue += got
        left = np.delete(left, near)
    return [g for g in (*out, group) if len(g) > 1]


def _tree(docs: np.ndarray) -> list[tuple[int, int]]:
    """Links that join a group without a hub: each document with the nearest smaller id of higher priority, a hash.

    Depth and degree are about the logarithm of the group's size, and groups of nearly the same members give mostly
    the same links, so those of many lists are few after all.
    """
    docs = np.unique(docs)
    rank = t.mix(docs.view(t.U64)).tolist()
    out, stack, root = [], [], None
    for k, doc in enumerate(docs.tolist()):
        while stack and rank[stack[-1][0]] < rank[k]:
            stack.pop()
        if root is not None:
            out.append((stack[-1][1] if stack else root, doc))
        if not stack:
            root = doc
        stack.append((k, doc))
    return out


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate links, as trees. The groups of the parts of one long list are strung together, whatever their sketches."""
    floor = floor_share(percent)

    def meet(batches):
        for _, rec in t.gathered(batches, _LIST):
            rec = rec[np.lexsort((rec["doc"], rec["part"], rec["v"]))]
            edge = t.edges(rec["v"], rec["part"])
            size, whole = np.diff(edge), rec["part"][edge[:-1]] < 0
            found, links, ends = [np.zeros((0, 2), np.int64)], [], []
            pairs = edge[:-1][(size == 2) & whole]
            for two in np.array_split(pairs, max(1, len(pairs) // 4096)):
                two = two[_sizes_fit(rec["n"][two], rec["n"][two + 1], percent)]
                near = _estimate_rows(rec["sketch"][two], rec["n"][two].astype(np.int64), rec["sketch"][two + 1], rec["n"][two + 1].astype(np.int64)) >= floor
                found.append(np.stack((two[near], two[near] + 1), axis=1))
            for k in np.flatnonzero((size > 2) | ~whole):
                docs = rec["doc"][edge[k] : edge[k + 1]]
                groups = _groups(rec[edge[k] : edge[k + 1]], percent)
                for group in groups:
                    links += _tree(docs[np.array(group)])
                if not whole[k]:
                    alone = np.setdiff1d(np.arange(len(docs)), np.concatenate([np.zeros(0, np.int64), *(g[1:] for g in groups)]))
                    ends += [(int(d), int(rec["v"][edge[k]].view(np.int64))) for d in docs[alone]]
            pair = np.sort(rec["doc"][np.concatenate(found)], axis=1)
            pair = np.unique(np.concatenate((pair, np.array(links, np.int64).reshape(-1, 2))), axis=0)
            end = np.array(ends, np.int64).reshape(-1, 2)
            none = np.arange(len(pair) + len(end)) >= len(pair)
            columns = [np.append(pair[:, 0], end[:, 0]), np.append(pair[:, 1], end[:, 0]), np.append(pair[:, 0], end[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=none), pa.array(columns[2], mask=~none)], names=["a", "b", "v"])

    found = stored(_met(lists).mapInArrow(meet, "a bigint, b bigint, v bigint"), "candidates")
    strung = found.where("b IS NULL").select("a", F.lead("a").over(Window.partitionBy("v").orderBy("a")).alias("b")).where("b IS NOT NULL")
    return found.where("b IS NOT NULL").select("a", "b").union(strung).distinct()


class _Sets:
    """Full shingle sets of some documents, and which of them hang together by links at the threshold."""

    def __init__(self, ids: np.ndarray, g: np.ndarray, edge: np.ndarray, percent: int):
        self.ids, self.edge, self.percent, self.size = ids, edge, percent, np.diff(edge)
        self.value, self.g = np.unique(g, return_inverse=True)
        self.row = np.repeat(np.arange(len(ids)), self.size)
        self.top = np.arange(len(ids))

    def root(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = int(self.top[x])
        return x

    def join(self, a: int, b: int) -> None:
        x, y = sorted((self.root(a), self.root(b)))
        self.top[y] = x

    def linked(self, overlap: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (100 * overlap >= self.percent * (self.size[one] + self.size[other] - overlap)) & (overlap > 0)

    def visit(self, left: np.ndarray) -> np.ndarray:
        """Joins documents of ``left`` to what a visited one links with, as long as visits go on to find some; those that are left."""
        queue, held = [], np.isin(self.row, left)
        g, row = self.g[held], self.row[held]
        idle, mark = 0, np.zeros(len(self.value), bool)
        free = np.zeros(len(self.ids), bool)
        free[left] = True
        while free.any() and idle < IDLE:
            if not queue:
                queue = [int(np.flatnonzero(free)[0])]
                free[queue[0]] = False
            p = queue.pop(0)
            mark[:] = False
            mark[self.g[self.edge[p] : self.edge[p + 1]]] = True
            overlap = np.bincount(row[mark[g]], minlength=len(self.ids))
            near = np.flatnonzero(free & self.linked(overlap, np.arange(len(self.ids)), np.full(len(self.ids), p)))
            for k in near.tolist():
                self.join(p, k)
            free[near] = False
            queue += near.tolist()
            idle = 0 if len(near) else idle + 1
            if len(near) * 8 > len(left):
                still = free[row]
                g, row = g[still], row[still]
        return np.append(np.flatnonzero(free), queue).astype(np.int64)

    def products(self, left: np.ndarray, right: np.ndarray) -> None:
        """Joins all links between documents of ``left`` and of ``right``: overlaps by products of incidence matrices."""
        both = np.zeros(len(self.ids), np.int64)
        both[left], both[right] = 1, both[right] | 2
        order = np.argsort(self.g, kind="stable")
        order = order[both[self.row[order]] > 0]
        g, row = self.g[order], self.row[order]
        new = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
        column = np.cumsum(new) - 1
        common = np.bincount(column)[column] > 1 if len(g) else np.zeros(0, bool)  # a hash of one set alone adds nothing
        column, row = column[common], row[common]
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
        place_l, place_r = (np.full(len(self.ids), -1) for _ in range(2))
        for lo in range(0, len(left), ROWS):
            for lo_r in range(0, len(right), ROWS):
                one, two = left[lo : lo + ROWS], right[lo_r : lo_r + ROWS]
                place_l[:], place_r[:] = -1, -1
                place_l[one], place_r[two] = np.arange(len(one)), np.arange(len(two))
                overlap = np.zeros((len(one), len(two)), np.float32)
                wide = max(256, (1 << 22) // (len(one) + len(two)))
                for c_lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
                    a, b = np.searchsorted(column, (c_lo, c_lo + wide))
                    c, r = column[a:b] - c_lo, row[a:b]
                    x, y = np.zeros((len(one), wide), np.float32), np.zeros((len(two), wide), np.float32)
                    x[place_l[r][place_l[r] >= 0], c[place_l[r] >= 0]] = 1
                    y[place_r[r][place_r[r] >= 0], c[place_r[r] >= 0]] = 1
                    overlap += x @ y.T
                i, j = np.nonzero(overlap)
                ok = self.linked(overlap[i, j], one[i], two[j]) & (one[i] != two[j])
                for p, q in zip(one[i[ok]].tolist(), two[j[ok]].tolist(), strict=True):
                    self.join(p, q)

    def trees(self) -> list[tuple[int, int]]:
        roots = np.array([self.root(k) for k in range(len(self.ids))])
        order = np.argsort(roots, kind="stable")
        edge = t.edges(roots[order])
        return [x for lo, hi in zip(edge[:-1], edge[1:], strict=True) if hi - lo > 1 for x in _tree(self.ids[order[lo:hi]])]


def _solved(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): true links, as trees, among the documents of each cell of (component, i, j, other, doc_id, text).

    Rows of ``other`` 0 are looked at among themselves and against those of ``other`` 1, those not among themselves.
    """

    def solve(held):
        ids, other, sets = (np.concatenate(x) for x in zip(*((i, o, g) for i, o, g, _ in held), strict=True))
        edge = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(e) for *_, e in held]))))
        all_ = _Sets(ids, sets, edge, percent)
        own, others = np.flatnonzero(other == 0), np.flatnonzero(other)
        if len(others):
            all_.products(own, others)
        else:
            left = all_.visit(own)
            if len(left):
                all_.products(own, left)
        tree = all_.trees()
        a, b = (np.array(x, np.int64) for x in (zip(*tree, strict=True) if tree else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        now, held = None, []
        for part, data, at in t.chunks(batches, "text"):
            keys = np.stack([part.column(k).to_numpy() for k in (0, 1, 2)], axis=1)
            g, edge = shingle_sets(data, at, size)
            cut = t.edges(*keys.T)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                key = tuple(keys[lo].tolist())
                if key != now and held:
                    yield solve(held)
                    held = []
                now = key
                held.append((part.column(4).to_numpy()[lo:hi], part.column(3).to_numpy()[lo:hi], g[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo]))
        if held:
            yield solve(held)

    dealt_ = rows.select("component", "i", "j", "other", "doc_id", "text").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt_.mapInArrow(run, "a bigint, b bigint")


def verified(trees: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int, n: int) -> DataFrame:
    """(a, b): true links, as trees, of the documents that hang together by ``trees``.

    Each text goes once to a block of its cluster, together with one text, the pivot, that all blocks of the cluster share.
    What then does not hang together with the most of its cluster goes, once more, to all blocks of that cluster.
    """
    cluster = components(trees)
    sized = cluster.join(reps.select(F.col("doc_id").alias("id"), "n_shingles"), "id")
    per = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    blocks = sized.groupBy("component").agg(per.alias("n_blocks"))
    placed = stored(cluster.join(blocks, "component").select(F.col("id").alias("doc_id"), "component", "n_blocks", F.pmod(F.xxhash64("id"), "n_blocks").cast("int").alias("i"), F.xxhash64("id", F.lit("pivot")).alias("rank")), "blocks")
    large = placed.where("n_blocks > 1")
    pivots = large.groupBy("component").agg(F.min_by(F.struct("doc_id", "n_blocks", "i"), "rank").alias("p")).select("p.doc_id", "component", F.explode(F.sequence(F.lit(0), F.col("p.n_blocks") - 1)).alias("at"), F.col("p.i").alias("own"))
    zero = F.lit(0)
    first = placed.select("doc_id", "component", "i", zero.alias("j"), zero.alias("other")).union(pivots.where("at <> own").select("doc_id", "component", F.col("at").alias("i"), zero, zero))
    links = stored(_solved(with_text(docs, first, n), size, percent), "links")
    if large.isEmpty():
        return links
    # clusters of several blocks: what hangs together after the first pass, and what stands apart from the most of it
    part = placed.where("n_blocks > 1").join(components(links).withColumnRenamed("component", "part"), placed.doc_id == F.col("id"), "left").withColumn("part", F.coalesce("part", "doc_id"))
    parts = part.groupBy("component", "part").agg(F.count("*").alias("n"))
    most = parts.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("n_parts")).where("n_parts > 1")
    apart = stored(part.join(most, "component").withColumn("apart", F.col("part") != F.col("most")), "apart")
    n_cells = apart.where("apart").groupBy("component").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("n_cells"))
    cells = apart.join(n_cells, "component")
    every = cells.select("doc_id", "component", "i", F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("j"), zero.alias("other"))
    again = cells.where("apart").select("doc_id", "component", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("doc_id", F.lit("cell")), "n_cells").cast("int").alias("j"), F.lit(1).alias("other"))
    return links.union(_solved(with_text(docs, every.union(again), n), size, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: doc_id, n_shingles, class_id (smallest id of an equal set), component_id and kept.

    Links documents whose sets of ``size``-word shingles (A-Z lower-cased) have at least ``percent`` per cent of their
    union in common. A text with fewer words is one shingle; one without words, or null, is linked with nothing. Rows
    that share a doc_id, and rows without one, are documents of their own: they follow each other in the order of their
    texts' digests, those without a doc_id after all others. ``kept`` is true for the first row of each component only.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_bytes, unique = survey(docs)
    rows = keyed(docs, unique)
    out = classes(rows.select(F.col(ROW).alias("doc_id"), "text"), n_bytes, size, percent)
    if unique:
        return out
    names = rows.select(ROW, F.col("doc_id").alias("real_id"))
    for x in ("class_id", "component_id", "doc_id"):
        out = out.withColumnRenamed(x, ROW).join(names, ROW).drop(ROW).withColumnRenamed("real_id", x)
    return out.select("doc_id", "n_shingles", "class_id", "component_id", "kept")


def classes(docs: DataFrame, n_bytes: int, size: int, percent: int) -> DataFrame:
    """The result for (doc_id, text) of unique doc_ids, with ``n_bytes`` bytes of text."""
    sig = stored(signatures(docs, size), "signatures")
    equal = sig.where("n_shingles > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("doc_id"))
    reps = stored(equal, "classes")
    n, n_groups = (n_buckets(docs.sparkSession, x, n_bytes // 4) for x in (1, 2))
    links = verified(candidates(listed(dealt(reps.select("doc_id", "n_shingles", "sketch"), n_groups), n, percent), percent), reps, docs, size, percent, n_buckets(docs.sparkSession, 2, n_bytes))
    comp = components(links)
    named_ = reps.select("sig_a", "sig_b", "n_shingles", F.col("doc_id").alias("rep")).join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    out = sig.drop("sketch").join(named_, ["sig_a", "sig_b", "n_shingles"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
