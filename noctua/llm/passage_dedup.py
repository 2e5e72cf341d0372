"""Removal of passages that earlier documents hold, word for word or nearly so, by collinear chaining.

1. Seeds are spaced: words 0, 1, 2, 3 and 5 of ``K`` in a row, so one of them survives where every fifth word differs. A
   place is a seed if the least hash of its five words is that of the first or the last one. That depends on those words
   alone, so a seed is one in every copy that keeps them; and of ``W`` places in a row one is a seed (the least word of
   ten either begins one or ends one), so any ``K + W - 1`` equal words share a seed. Documents are dealt into groups; a group asks once, for each distinct seed, where it occurs first (least
   doc_id, then position). A seed that a third of all documents hold costs one request per group.
2. A document's seeds with their earlier occurrences in one other document are points in a plane. Runs on one
   diagonal merge to segments, and a Fenwick tree over the other document's positions finds the chain of segments,
   rising in both, of greatest length less gap costs.
3. The words of the earlier document around each chain are fetched, as far as the document's own seeds go on occurring
   in earlier documents, and chain and gaps are aligned: equal words inside segments, edit distance inside gaps,
   extension at both ends while it pays. A lone seed in text that nobody shares is a phrase, not a passage. A passage counts if one earlier document holds ``least`` words of it or
   more with at least ``IDENTITY`` of them equal, in the same order; short pieces of several documents add up to nothing.
4. Seeds that an earlier document holds but no passage that counts covers go on, each in pairs with the next ``NEAR`` ones
   within ``PAIR`` words that documents share: each pair is chained with the first document that holds both so near, and
   those chains are aligned too. So phrases that many documents hold apart do not hide the document that holds them together.
5. Passages that count are removed; the earliest document that holds one keeps it.

Words are runs of anything but ASCII white space, A-Z lower-cased; null has none. Every row has one result. Rows that share
a doc_id, and rows without one, are documents of their own: they follow each other in the order of their texts'
digests, those without a doc_id after all others. Repeats inside one document stay.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _text as t
from ._shared import ROW, dealt, groups_of, keyed, n_buckets, named, stored, survey, unpacked

#: Words of a seed, counted from its place.
SHAPE = (0, 1, 2, 3, 5)
K, W, LEAST, IDENTITY = SHAPE[-1] + 1, 5, 50, 0.8
#: Cost of a word of gap in a chain; the longest step between seeds of one segment; words fetched beyond the last shared seed; gap that may split a chain.
GAP_COST, STEP, EXTEND, SPLIT = 0.15, 20, 24, 12
#: In text that repeats itself at once, a seed is no point again within so many words; extension goes over them.
AGAIN = 16
#: A seed is paired with so many of the next shared ones, at most so many words further on.
NEAR, PAIR = 6, 48
_ASK = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("g", "<i4")])
_TOLD = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
#: A place of a seed that occurs elsewhere too; ``open`` where an earlier document holds it and, later, nothing covers it.
_PLACE = np.dtype([("doc", "<i8"), ("pos", "<i4"), ("open", "u1")])
_HAVE = np.dtype([("doc", "<i8"), ("pos", "<i4"), ("open", "u1"), ("seed", "<u8")])
_WISH = np.dtype([("seed", "<u8"), ("g", "<i4"), ("open", "u1")])
_PAIRED = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("to", "<i4"), ("g", "<i4"), ("open", "u1")])
#: kind 0: a chain of doc_id with ref; 1: a request of group ``asker`` for the words of ref from lo to hi; 2: those words;
#: 3: places of seeds that occur elsewhere too; 4: a passage of doc_id that counts; 5: those places with seeds, to go on with.
_CHAIN = "g int, kind tinyint, doc_id bigint, ref bigint, asker int, lo int, hi int, packed binary"
_CHAIN_FIELDS = [("g", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("ref", pa.int64()), ("asker", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("packed", pa.binary())]
#: Rows for a group; kind 0: places, 1: seeds that some group wants, 2: first holders of pairs.
_GROUPED = "g int, kind tinyint, payload binary"


def seed_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the words of ``SHAPE`` at each place; the last ``K - 1`` places have none."""
    m = max(0, len(h) - K + 1)
    out = np.zeros(m, t.U64)
    for k in SHAPE if m else ():
        out = t.mix((out ^ h[k : k + m]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, row, word position) of each row's seeds, in order, from word hashes and each row's first word."""
    m = max(0, len(h) - K + 1)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = np.minimum.reduce([h[k : k + m] for k in SHAPE[1:-1]])
    begin, end = h[:m], h[K - 1 : K - 1 + m]
    pos = np.flatnonzero(np.minimum(begin, end) <= inner)
    row = np.searchsorted(first, pos, "right") - 1
    inside = pos + K <= first[row + 1]
    pos, row = pos[inside], row[inside]
    return seed_hashes(h)[pos], row, pos - first[row]


def _again(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a document has the same seed at most ``AGAIN`` words before; ``order`` sorts by seed, document and place."""
    out = np.zeros(len(seed), bool)
    now, before = order[1:], order[:-1]
    out[now] = (seed[now] == seed[before]) & (doc[now] == doc[before]) & (pos[now] - pos[before] <= AGAIN)
    return out


def chains(b: np.ndarray, a: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Chains of segments (b_lo, b_hi, a_lo, a_hi) through the seed matches of one pair of documents, best first.

    Segments are runs of matches on one diagonal. f(j) = own words + max(0, max f(i) - gap cost) over segments i that
    end before j begins in both documents; the inner maximum is a prefix maximum over a_hi, kept in a Fenwick tree.
    A segment belongs to one chain, and those inside the words of a better chain to none.
    """
    order = np.lexsort((b, b - a))
    b, a = b[order], a[order]
    cut = np.append(True, (np.diff(b - a) != 0) | (np.diff(b) > STEP))
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(b)) - 1
    seg = sorted(zip(b[lo].tolist(), (b[hi] + K).tolist(), a[lo].tolist(), (a[hi] + K).tolist(), strict=True))
    if len(seg) == 1:
        yield seg
        return
    tops = sorted({s[3] for s in seg})
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(tops) + 1)
    by_end = sorted(range(len(seg)), key=lambda i: seg[i][1])
    score, back, done = [0.0] * len(seg), [-1] * len(seg), 0
    for j, (b_lo, b_hi, a_lo, _) in enumerate(seg):
        while done < len(seg) and seg[by_end[done]][1] - K < b_lo and by_end[done] < j:
            i = by_end[done]
            done += 1
            value = (score[i] + GAP_COST * (seg[i][1] + seg[i][3]) / 2, i)
            k = bisect_right(tops, seg[i][3])
            while k < len(tree):
                if value > tree[k]:
                    tree[k] = value
                k += k & -k
        best, k = (-1e18, -1), bisect_right(tops, a_lo + K - 1)
        while k:
            best = max(best, tree[k])
            k -= k & -k
        gain = best[0] - GAP_COST * (b_lo + a_lo) / 2
        score[j] = b_hi - b_lo + max(0.0, gain)
        back[j] = best[1] if gain > 0 else -1
    used, taken = [False] * len(seg), []  # taken: the words of better chains, as disjoint spans in order
    for j in sorted(range(len(seg)), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j] and not _inside(taken, seg[j]):
            used[j] = True
            chain.append(seg[j])
            j = back[j]
        if chain:
            chain.reverse()
            _take(taken, chain[0][0], chain[-1][1])
            yield chain


def _inside(taken: list[tuple[int, int]], seg: tuple[int, int, int, int]) -> bool:
    k = bisect_right(taken, (seg[0], 1 << 62))
    return k > 0 and seg[1] <= taken[k - 1][1]


def _take(taken: list[tuple[int, int]], lo: int, hi: int) -> None:
    a, b = bisect_right(taken, (lo, -1)), bisect_right(taken, (hi, 1 << 62))
    a -= a > 0 and taken[a - 1][1] >= lo
    if a < b:
        lo, hi = min(lo, taken[a][0]), max(hi, taken[b - 1][1])
    taken[a:b] = [(lo, hi)]


def _edits(x: list[int], y: list[int]) -> int:
    """Edit distance of two word lists of any length, a bit for each word of ``x`` (Myers, Hyyro)."""
    if not x or not y:
        return max(len(x), len(y))
    where: dict[int, int] = {}
    for i, u in enumerate(x):
        where[u] = where.get(u, 0) | 1 << i
    full, top, n = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    up, down = full, 0
    for v in y:
        eq = where.get(v, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(level | up) & full, up & level
        n += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(level | more) & full, more & level
    return n


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many words ``x`` and ``y`` begin with in common."""
    n, lo, step = min(len(x), len(y)), 0, 16
    while lo < n:
        hi = min(n, lo + step)
        differ = x[lo:hi] != y[lo:hi]
        k = int(differ.argmax())
        if differ[k]:
            return lo + k
        lo, step = hi, step * 4
    return n


def _reach(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """How far to extend in ``x`` and in ``y`` (equal words 1, others, inserted and deleted ones -2), and the equal words
    on the way: for each number of edits the furthest place on each diagonal, until none is within 6 of the best."""
    best, at = 0, (0, 0, 0)
    front, edits = {0: (0, 0)}, 0  # by diagonal: words of x, equal ones
    while front:
        new = {}
        for d, (i, same) in front.items():
            run = _common(x[i:], y[i - d :])
            i, same = i + run, same + run
            score = same - 2 * edits
            if score > best:
                best, at = score, (i, i - d, same)
            new[d] = i, same
        edits, front = edits + 1, {}
        for d, (i, same) in new.items():
            if same - 2 * edits < best - 6:
                continue
            for d_to, i_to in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):
                if i_to <= len(x) and i_to - d_to <= len(y) and (i_to, same) > front.get(d_to, (-1, 0)):
                    front[d_to] = i_to, same
    return at


def aligned(chain: list[tuple[int, int, int, int]], own: np.ndarray, other: np.ndarray, shift: int, least: int = LEAST, identity: float = IDENTITY) -> list[tuple[int, int, float]]:
    """(b_lo, b_hi, identity) of the passages of a chain; ``other`` holds the earlier document's words from ``shift`` on.

    A gap of more than ``SPLIT`` words of which less than half are equal ends one passage and begins another, unless
    one of both is shorter than ``least`` and both with the gap still have ``identity``.
    """
    parts: list[list[int]] = []  # b_lo, b_hi, a_lo, a_hi, equal words
    for b_lo, b_hi, a_lo, a_hi in chain:
        if parts:
            over = max(0, parts[-1][1] - b_lo, parts[-1][3] - a_lo)
            b_lo, a_lo = b_lo + over, a_lo + over
        if b_lo >= b_hi:
            continue
        x, y = own[b_lo:b_hi], other[a_lo - shift : a_hi - shift]
        same = int((x == y).sum())
        if same < len(x):  # words inserted and deleted again between seeds shift what is equal
            same = max(same, len(x) - _edits(x.tolist(), y.tolist()))
        if parts:
            like, most = _like(own[parts[-1][1] : b_lo], other[parts[-1][3] - shift : a_lo - shift])
            if most <= SPLIT or 2 * like >= most:
                parts[-1][1], parts[-1][3], parts[-1][4] = b_hi, a_hi, parts[-1][4] + same + like
                continue
        parts.append([b_lo, b_hi, a_lo, a_hi, same])
    for k, (b_lo, b_hi, a_lo, a_hi, _) in enumerate(parts):
        floor_b, floor_a = (parts[k - 1][1], parts[k - 1][3] - shift) if k else (0, 0)
        left, left_a, more = _reach(own[floor_b:b_lo][::-1], other[floor_a : a_lo - shift][::-1])
        top_b, top_a = (parts[k + 1][0], parts[k + 1][2] - shift) if k + 1 < len(parts) else (len(own), len(other))
        right, right_a, again = _reach(own[b_hi:top_b], other[a_hi - shift : top_a])
        parts[k] = [b_lo - left, b_hi + right, a_lo - left_a, a_hi + right_a, parts[k][4] + more + again]
    out: list[list[int]] = []
    for part in parts:
        if out:
            x = out[-1]
            like = _like(own[x[1] : part[0]], other[x[3] - shift : part[2] - shift])[0]
            short = min(x[1] - x[0], part[1] - part[0]) < least
            if _identity(both := [x[0], part[1], x[2], part[3], x[4] + like + part[4]]) >= identity and short:
                out[-1] = both
                continue
        out.append(part)
    return [(x[0], x[1], _identity(x)) for x in out]


def _identity(x: list[int]) -> float:
    return x[4] / max(1, x[1] - x[0], x[3] - x[2])


def _like(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Equal words of two gaps, and the words of the longer one; a gap that is far longer than the other is wholly unlike."""
    most = max(len(x), len(y))
    return (most - _edits(x.tolist(), y.tolist()) if most <= SPLIT or 2 * min(len(x), len(y)) >= most else 0), most


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _words(rows: pa.RecordBatch | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, word hashes, and each document's first word with the total last."""
    ids, held, edge = np.zeros(0, np.int64), [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    if rows is not None:
        ids = rows.column("doc_id").to_numpy()
        for _, data, at in t.chunks(iter([rows]), "text"):
            h, _, _, first = t.words(t.lower(data), at, ~t.SPACE)
            held.append(h)
            edge.append(first[1:] + edge[-1][-1])
    return ids, np.concatenate(held), np.concatenate(edge)


def _blocks(key: np.ndarray, rec: np.ndarray, n: int) -> pa.Table:
    return pa.Table.from_batches([t.squeezed_blocks((key % np.uint64(n)).astype(np.int32), rec)], schema=t.BLOCKS)


def _answers(held: list[tuple[np.ndarray, np.ndarray]], kind: int) -> pa.RecordBatch:
    got = t.squeezed_blocks(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
    return pa.RecordBatch.from_arrays([got.column(0), pa.array(np.full(got.num_rows, kind, np.int8)), got.column(1)], names=["g", "kind", "payload"])


def _answered(asked: DataFrame, dtype: np.dtype, answer, kind: int) -> DataFrame:
    """For each bucket of records what ``answer`` gives, (groups, records in order of their first field), dealt to the groups."""

    def run(batches):
        held, size = [], 0
        for rec in t.unsqueezed(batches, dtype):
            g, got = answer(rec)
            if len(got):
                held.append((g, got))
                size += got.nbytes
            if size > 1 << 23:
                yield _in_order(held, kind)
                held, size = [], 0
        if held:
            yield _in_order(held, kind)

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _GROUPED)


def _in_order(held: list[tuple[np.ndarray, np.ndarray]], kind: int) -> pa.RecordBatch:
    g, rec = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    order = np.argsort(rec[rec.dtype.names[0]], kind="stable")
    return _answers([(g[order], rec[order])], kind)


def _first_seen(docs: DataFrame, n: int) -> DataFrame:
    """For each group the seeds that other groups hold too, with their first occurrence of all.

    A group asks once for a seed, with its own first occurrence; what only one group holds needs no answer."""

    def ask(table: pa.Table) -> pa.Table:
        ids, h, first = _words(unpacked(table))
        seed, row, pos = seeds(h, first)
        order = np.argsort(seed, kind="stable")  # documents are in order, so the first of each seed is the earliest
        lead = order[t.edges(seed[order])[:-1]]
        rec = np.empty(len(lead), _ASK)
        rec["seed"], rec["doc"], rec["pos"], rec["g"] = seed[lead], ids[row[lead]], pos[lead], table.column("g")[0].as_py()
        return _blocks(rec["seed"], rec, n)

    def answer(rec):
        rec = rec[np.lexsort((rec["doc"], rec["seed"]))]
        edge = t.edges(rec["seed"])
        size = np.diff(edge)
        lead, told = np.repeat(edge[:-1], size), np.repeat(size, size) > 1
        got = np.empty(int(told.sum()), _TOLD)
        for x in _TOLD.names:
            got[x] = rec[x][lead[told]]
        return rec["g"][told], got

    return _answered(docs.groupBy("g").applyInArrow(ask, t.BLOCKS_DDL), _ASK, answer, 0)


def _records(table: pa.Table, dtype: np.dtype, kind: int) -> np.ndarray:
    """The records of one kind that came to a group."""
    held = [t.unsqueeze(x.as_buffer(), dtype) for k, x in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True) if k == kind]
    return np.concatenate(held) if held else np.zeros(0, dtype)


class _Runs:
    """Runs of places (doc, pos), in order, with steps of at most ``step`` words."""

    def __init__(self, place: np.ndarray, step: int):
        far = np.cumsum(np.append(0, np.diff(place["pos"]) > step)) if len(place) else place["pos"]
        edge = t.edges(place["doc"], far)
        self.doc, self.lo, self.hi = place["doc"][edge[:-1]], place["pos"][edge[:-1]], place["pos"][edge[1:] - 1] + K
        self.size = np.repeat(self.hi - self.lo, np.diff(edge))  # of the run of each place

    def around(self, doc: int, lo: int, hi: int) -> tuple[int, int]:
        """From the begin of the run with the place ``lo`` to the end of that with the place ``hi``."""
        a, b = np.searchsorted(self.doc, (doc, doc + 1))
        at = a + np.searchsorted(self.lo[a:b], (lo, hi), "right") - 1
        return int(self.lo[at[0]]), int(self.hi[at[1]])


class _Found:
    """Chains of a group's documents, and the words of others that they need.

    ``shared`` are the places of the group's seeds that occur elsewhere, in order. A chain of less than ``K + W - 1`` words
    goes on only where such seeds follow each other without a break as far as in ``least`` equal words, and none goes on
    inside another one of ``least`` words. The words of the other document are asked for as far as they follow each
    other on both sides of a chain, in steps of at most ``STEP`` words.
    """

    def __init__(self, g: int, n_groups: int, shared: np.ndarray, least: int):
        self.g, self.n, self.rows, self.asked, self.least, self.whole = g, n_groups, [], {}, least, least - 2 * (W - 1)
        self.near, self.tight = _Runs(shared, STEP), _Runs(shared, W)

    def add(self, doc: np.ndarray, ref: np.ndarray, b: np.ndarray, a: np.ndarray) -> None:
        """Points (b, a) of documents and earlier ones, in order of (doc, ref)."""
        edge, held, last = t.edges(doc, ref), [], None
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if doc[lo] != last and held:
                self._document(int(last), held)
                held = []
            last = doc[lo]
            one = hi - lo == 1
            for chain in [[(int(b[lo]), int(b[lo]) + K, int(a[lo]), int(a[lo]) + K)]] if one else chains(b[lo:hi], a[lo:hi]):
                held.append((chain[0][0], chain[-1][1], int(ref[lo]), chain))
        if held:
            self._document(int(last), held)

    def _document(self, doc: int, held: list[tuple[int, int, int, list]]) -> None:
        long = sorted((lo, hi) for lo, hi, *_ in held if hi - lo >= self.least)
        starts, tops = [lo for lo, _ in long], np.maximum.accumulate([hi for _, hi in long]) if long else []
        for lo, hi, ref, chain in held:
            if hi - lo < self.least:
                k = bisect_right(starts, lo)
                if k and hi <= tops[k - 1]:
                    continue
                if hi - lo < K + W - 1:
                    left, right = self.tight.around(doc, lo, hi - K)
                    if right - left < self.whole:
                        continue
            left, right = self.near.around(doc, lo, hi - K)
            self.rows.append((self.g, 0, doc, ref, self.g, 0, 0, np.array(chain, np.int32).tobytes()))
            near, far = self.asked.get(ref, (1 << 30, 0))
            more = max(EXTEND, self.least - (hi - lo))  # a chain at one end of a passage has the rest of it on one side
            low = chain[0][2] - (lo - left) * 5 // 4 - more
            high = chain[-1][3] + (right - hi) * 5 // 4 + more
            self.asked[ref] = min(near, max(0, low)), max(far, high)

    def table(self) -> pa.Table:
        asked = sorted(self.asked.items())
        to = groups_of(np.array([x for x, _ in asked], np.int64), self.n).tolist() if asked else []
        return _table(self.rows + [(g, 1, 0, ref, self.g, lo, hi, b"") for g, (ref, (lo, hi)) in zip(to, asked, strict=True)], _CHAIN_FIELDS)


def chained(docs: DataFrame, n_groups: int, n: int, least: int) -> DataFrame:
    """Chains of each document with the first holders of its seeds, for its own group; and requests for words, for the groups of those."""

    def find(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table([], _CHAIN_FIELDS)
        ids, h, first = _words(unpacked(own))
        seed, row, pos = seeds(h, first)
        doc, g = ids[row], own.column("g")[0].as_py()
        # the first occurrence in the group, or what other groups told of an earlier one
        order = np.argsort(seed, kind="stable")
        edge = t.edges(seed[order])
        size = np.diff(edge)
        lead = np.empty(len(seed), np.int64)
        lead[order] = np.repeat(order[edge[:-1]], size)
        ref, ref_pos = doc[lead], pos[lead]
        shared = np.empty(len(seed), bool)
        shared[order] = np.repeat(size, size) > 1
        rec = _records(told, _TOLD, 0)
        if len(rec):
            rec = rec[np.argsort(rec["seed"], kind="stable")]
            i = np.minimum(np.searchsorted(rec["seed"], seed), len(rec) - 1)
            hit = rec["seed"][i] == seed
            ref[hit], ref_pos[hit] = rec["doc"][i[hit]], rec["pos"][i[hit]]
            shared |= hit
        place = np.empty(int(shared.sum()), _PLACE)
        place["doc"], place["pos"], place["open"] = doc[shared], pos[shared], (ref < doc)[shared]
        found = _Found(g, n_groups, place, least)
        use = np.flatnonzero((ref < doc) & ~_again(seed, doc, pos, order))
        use = use[np.lexsort((pos[use], ref[use], doc[use]))]
        edge = t.edges(doc[use], ref[use])  # lone seeds that go no further are most of all
        lone = np.repeat(np.diff(edge), np.diff(edge)) == 1
        use = use[~lone | (found.tight.size[(np.cumsum(shared) - 1)[use]] >= found.whole)]
        found.add(doc[use], ref[use], pos[use], ref_pos[use])
        found.rows.append((g, 3, 0, 0, g, 0, 0, t.squeeze(place)))
        return found.table()

    return docs.groupBy("g").cogroup(_first_seen(docs, n).groupBy("g")).applyInArrow(find, _CHAIN)


def _fetched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The words asked for, on their way to the groups that asked: one answer for each group and document, however many
    chains. What is where it belongs already goes on as it is."""

    def fetch(own: pa.Table, asked: pa.Table) -> pa.Table:
        out, kinds = [], asked.column("kind").to_numpy() if asked.num_rows else np.zeros(0)
        through, asked = asked.filter(pa.array(kinds != 1)), asked.filter(pa.array(kinds == 1))
        if own.num_rows and asked.num_rows:
            wanted: dict[int, list[tuple[int, int, int]]] = {}
            for ref, asker, lo, hi in zip(*(asked.column(x).to_pylist() for x in ("ref", "asker", "lo", "hi")), strict=True):
                wanted.setdefault(ref, []).append((asker, lo, hi))
            rows = unpacked(own)
            rows = rows.filter(pa.array(np.isin(rows.column("doc_id").to_numpy(), np.fromiter(wanted, np.int64))))
            ids, h, first = _words(rows)
            for k, ref in enumerate(ids.tolist()):
                words = h[first[k] : first[k + 1]]
                out += [(asker, 2, 0, ref, asker, lo, hi, words[lo:hi].tobytes()) for asker, lo, hi in wanted[ref]]
        return pa.concat_tables([through, _table(out, _CHAIN_FIELDS)])

    return docs.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(fetch, _CHAIN)


def _held(table: pa.Table) -> tuple[dict, dict, dict]:
    """By document: its chains, the fetched words, and the passages that count already."""
    held, others, spans = {}, {}, {}
    for kind, doc, ref, lo, hi, packed in zip(*(table.column(x).to_pylist() for x in ("kind", "doc_id", "ref", "lo", "hi", "packed")), strict=True):
        if kind == 0:
            held.setdefault(doc, []).append((ref, np.frombuffer(packed, np.int32).reshape(-1, 4).tolist()))
        elif kind == 2:
            others[ref] = lo, np.frombuffer(packed, np.uint64)
        elif kind == 4:
            spans.setdefault(doc, []).append((lo, hi, ref))
    return held, others, spans


def _counted(held, words: np.ndarray, others: dict, least: int, identity: float) -> list[tuple[int, int, int]]:
    """Passages (lo, hi, ref) that count, each by itself."""
    spans = []
    for ref, chain in held:
        shift, other = others[ref]
        spans += [(lo, hi, ref) for lo, hi, like in aligned(chain, words, other, shift, least, identity) if like >= identity and hi - lo >= least]
    return spans


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """The union of passages (lo, hi, ref) as disjoint runs, with all their refs."""
    out: list[tuple[int, int, list[int]]] = []
    for lo, hi, ref in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi), [*out[-1][2], ref])
        else:
            out.append((lo, hi, [ref]))
    return [(lo, hi, sorted(set(refs))) for lo, hi, refs in out]


def _settled(docs: DataFrame, found: DataFrame, least: int, identity: float) -> DataFrame:
    """Passages that count (kind 4), and the places of all seeds that occur elsewhere (kind 5)."""

    def settle(own: pa.Table, chains_: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table([], _CHAIN_FIELDS)
        out, g = [], own.column("g")[0].as_py()
        held, others, _ = _held(chains_)
        place = np.concatenate([np.zeros(0, _PLACE), *(t.unsqueeze(x.as_buffer(), _PLACE) for k, x in zip(chains_.column("kind").to_pylist(), chains_.column("packed"), strict=True) if k == 3)])
        rows = unpacked(own)
        ids, h, first = _words(rows.filter(pa.array(np.isin(rows.column("doc_id").to_numpy(), place["doc"]))))
        have = np.empty(len(place), _HAVE)
        for x in _PLACE.names:
            have[x] = place[x]
        at = first[np.searchsorted(ids, place["doc"])] + place["pos"] if len(place) else np.zeros(0, np.int64)
        have["seed"] = seed_hashes(h)[at] if len(at) else 0
        edge = np.searchsorted(place["doc"], np.append(ids, 1 << 62))
        for k, doc in enumerate(ids.tolist()):
            if doc not in held:
                continue
            words = h[first[k] : first[k + 1]]
            spans = _counted(held[doc], words, others, least, identity)
            out += [(g, 4, doc, ref, g, lo, hi, b"") for lo, hi, ref in spans]
            own_ = have[edge[k] : edge[k + 1]]
            for lo, hi, _ in united(spans):
                own_["open"][(own_["pos"] >= lo) & (own_["pos"] + K <= hi)] = 0
        out.append((g, 5, 0, 0, g, 0, 0, t.squeeze(have)))
        return _table(out, _CHAIN_FIELDS)

    return docs.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(settle, _CHAIN)


def _wanted(first: DataFrame, n: int) -> DataFrame:
    """For each group the places of its seeds (kind 0), and which of its seeds some document wants to go on with (kind 1)."""

    def wish(batches):
        for batch in batches:
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have = t.unsqueeze(x.as_buffer(), _HAVE)
                order = np.lexsort((have["open"] == 0, have["seed"]))  # an open place first
                lead = order[t.edges(have["seed"][order])[:-1]]
                rec = np.empty(len(lead), _WISH)
                rec["seed"], rec["g"], rec["open"] = have["seed"][lead], g, have["open"][lead]
                yield from _blocks(rec["seed"], rec, n).to_batches()

    def answer(rec):
        rec = rec[np.argsort(rec["seed"], kind="stable")]
        edge = t.edges(rec["seed"])
        size = np.diff(edge)
        told = np.repeat(np.maximum.reduceat(rec["open"], edge[:-1]) if len(rec) else rec["open"], size) > 0
        return rec["g"][told], rec[told]

    places = first.where("kind = 5").select("g", F.col("packed").alias("payload"))
    told = _answered(places.mapInArrow(wish, t.BLOCKS_DDL), _WISH, answer, 1)
    return told.unionByName(places.withColumn("kind", F.lit(0).cast("tinyint")))


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the group's wanted seeds with the next ones, in order of pair, document and place; and the places themselves."""
    have, wish = _records(table, _HAVE, 0), _records(table, _WISH, 1)
    have = have[np.isin(have["seed"], wish["seed"])]
    have = have[~_again(have["seed"], have["doc"], have["pos"], np.argsort(have["seed"], kind="stable"))]
    held = [np.zeros(0, _PAIRED)]
    for step in range(1, NEAR + 1):
        x, y = have[:-step], have[step:]
        gap = y["pos"] - x["pos"]
        near = np.flatnonzero((x["doc"] == y["doc"]) & (gap >= K) & (gap <= PAIR)) if len(x) else []
        if len(near):
            out = np.empty(len(near), _PAIRED)
            out["seed"] = t.mix(x["seed"][near] * np.uint64(0xD6E8FEB86659FD93) + y["seed"][near])
            out["doc"], out["pos"], out["to"], out["open"] = x["doc"][near], x["pos"][near], y["pos"][near], x["open"][near] | y["open"][near]
            held.append(out)
    rec = np.concatenate(held)
    rec["g"] = table.column("g")[0].as_py()
    return rec[np.lexsort((rec["to"], rec["pos"], rec["doc"], rec["seed"]))], have


def _chained_pairs(held: DataFrame, n_groups: int, n: int, least: int) -> DataFrame:
    """Chains of each document with the first holders of its pairs of seeds, and requests for words."""

    def ask(table: pa.Table) -> pa.Table:
        rec, _ = _pairs(table)
        edge = t.edges(rec["seed"])
        lead = rec[edge[:-1]]
        lead["open"] = np.maximum.reduceat(rec["open"], edge[:-1]) if len(rec) else lead["open"]
        return _blocks(lead["seed"], lead, n)

    def answer(rec):
        rec = rec[np.lexsort((rec["doc"], rec["seed"]))]
        edge = t.edges(rec["seed"])
        size = np.diff(edge)
        lead = np.repeat(edge[:-1], size)
        told = (rec["open"] > 0) & (lead != np.arange(len(rec)))
        return rec["g"][told], rec[lead[told]]

    def find(own: pa.Table) -> pa.Table:
        rec, have = _pairs(own)
        edge = t.edges(rec["seed"])
        lead = rec[np.repeat(edge[:-1], np.diff(edge))]
        told = _records(own, _PAIRED, 2)
        if len(told):
            told = told[np.argsort(told["seed"], kind="stable")]
            i = np.minimum(np.searchsorted(told["seed"], rec["seed"]), len(told) - 1)
            hit = told["seed"][i] == rec["seed"]
            lead[hit] = told[i[hit]]
        use = (rec["open"] > 0) & (lead["doc"] < rec["doc"])
        x, ref = rec[use], lead[use]
        points = np.unique(np.concatenate([np.stack([x["doc"], ref["doc"], x[k], ref[k]], 1) for k in ("pos", "to")]).astype(np.int64), axis=0)
        found = _Found(own.column("g")[0].as_py(), n_groups, have, least)
        found.add(*points.T)
        return found.table()

    told = _answered(held.groupBy("g").applyInArrow(ask, t.BLOCKS_DDL), _PAIRED, answer, 2)
    return held.unionByName(told).groupBy("g").applyInArrow(find, _CHAIN)


def _removed(docs: DataFrame, size: int, least: int, identity: float) -> DataFrame:
    """The result for (doc_id, text, ...) of unique doc_ids, with ``size`` bytes of text; further columns go through."""
    n_groups, n = n_buckets(docs.sparkSession, 2, size), n_buckets(docs.sparkSession, 1, size)
    more = [x for x in docs.schema.fields if x.name not in ("doc_id", "text")]
    docs = dealt(docs, n_groups)
    first = stored(_settled(docs, _fetched(docs, chained(docs, n_groups, n, least)), least, identity), "op10_passages")
    held = stored(_wanted(first, n), "op10_places")
    found = _fetched(docs, _chained_pairs(held, n_groups, n, least)).unionByName(first.where("kind = 4"))
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", span), ("source_ids", pa.list_(pa.int64())), ("kept", pa.string()), ("kept_sha256", pa.string())]
    ddl = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, spans array<struct<lo:bigint,hi:bigint>>, source_ids array<bigint>, kept string, kept_sha256 string"
    schema, names = T.StructType([*T._parse_datatype_string(ddl).fields, *more]), [x.name for x in more]

    def cut(own: pa.Table, chains_: pa.Table) -> pa.Table:
        out = []
        held, others, counted = _held(chains_)
        for part, data, at in t.chunks(iter([unpacked(own)] if own.num_rows else ()), "text"):
            rows = []
            h, s, e, first = t.words(t.lower(data), at, ~t.SPACE)
            null = part.column("text").is_null().to_pylist()
            for k, doc in enumerate(part.column("doc_id").to_pylist()):
                words, text = h[first[k] : first[k + 1]], data[at[k] : at[k + 1]].tobytes()
                gone = united(counted.get(doc, []) + _counted(held.get(doc, ()), words, others, least, identity))
                kept, last = text, 0
                if gone:
                    begin, parts = s[first[k] : first[k + 1]] - at[k], []
                    for lo, hi, _ in gone:
                        parts.append(text[last : begin[lo]])
                        last = begin[hi] if hi < len(words) else len(text)
                    kept = b"".join([*parts, text[last:]])
                rows.append((doc, len(words), sum(hi - lo for lo, hi, _ in gone), len(gone), [{"lo": lo, "hi": hi} for lo, hi, _ in gone], sorted({r for *_, refs in gone for r in refs}), None if null[k] else kept.decode(), hashlib.sha256(kept).hexdigest()))
            done = _table(rows, fields)
            out.append(pa.Table.from_arrays([*done.columns, *(pa.chunked_array([part.column(x)]) for x in names)], names=[*done.column_names, *names]))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return docs.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut, schema)


def remove_passages(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """doc_id, n_words, n_removed (words), n_spans, spans (lo, hi in words), source_ids (earlier documents that hold
    them), kept (the text without the spans; null stays null), kept_sha256 of each row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size, unique = survey(docs)
    rows = keyed(docs, unique)
    out = _removed(rows.select(F.col(ROW).alias("doc_id"), "text"), size, least, identity)
    return named(out, rows, unique, "source_ids")


def cut_rows(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """All rows and columns of ``docs``, their texts without those passages; and ``ROW``_removed, the words that went.

    The texts are dealt out once and joined with nothing. A null text stays null."""
    size, unique = survey(docs)
    rows = keyed(docs, unique)
    hidden = {x: f"c{k}" for k, x in enumerate(docs.columns) if x != "text"}  # names of the operator's own may come up
    named_ = rows.select(F.col(ROW).alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(x).alias(y) for x, y in hidden.items()))
    out = _removed(named_, size, least, identity)
    return out.select(*(F.col("kept").alias("text") if x == "text" else F.col(hidden[x]).alias(x) for x in docs.columns), F.col("n_removed").alias(ROW + "_removed"))
