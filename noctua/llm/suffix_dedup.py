"""Exact removal of repeated byte strings with two-stage suffix sorting and adjacent common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller doc_id, or
in the same one at an earlier byte. Sorting all suffixes of the corpus would move hundreds of times its size. What a
suffix array is needed for is far less, and is found in three steps:

1. Each window of ``length`` bytes has an anchor: the position of the least rolling hash of its ``GRAM``-byte grams.
   Windows that share an anchor position form a segment; equal windows have equal anchors, so a window that occurs
   twice lies in two segments whose anchor grams are equal. Segments are shuffled by the gram's hash (18 bytes of
   hashes and positions each, no text), after equal segments of one batch were merged into the earliest.
2. Of equal segments all but the earliest are repeats as a whole. Where one gram has different segments, their bytes
   are fetched and their suffixes are sorted: those smaller than their successor directly, the rest induced by scans
   over the first-byte buckets. Runs of adjacent common prefixes of ``length`` or more are the repeated windows.
3. The repeated intervals are joined with their documents and cut out.

A gram with more than ``HOT_GRAM`` different segments is taken apart: each window of its segments goes by its own hash, equal ones
of a group of documents as one, so contexts of a common line meet only where they are equal, in many tasks.

A text that many documents copy, or a passage that many hold, sends one segment record for each 16 MB of records of
a task, however many rows have it; the merged ones are repeats at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._shared import ROW, dealt, groups_of, keyed, n_buckets, named, stored, survey, unpacked

LENGTH, GRAM, HOT_GRAM = 100, 32, 256
#: Bytes of segments sorted at once.
SORTED_BYTES = 1 << 19
_SEG = np.dtype([("gram", "<u8"), ("body", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("size", "<i2")])
_HIT = np.dtype([("doc", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("gram", "<u8")])
_PARTS = pa.schema([("kind", pa.int8()), *t.BLOCKS])
_BYTES = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("body", pa.binary())])


def two_stage_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` (bytes) in order of their first ``depth`` bytes, or more.

    Suffixes smaller than their successor (type B) are sorted directly. The others are induced by scans over the
    first-byte buckets in rising order: among type A suffixes of one bucket the order is that of their successors,
    which begin with a smaller byte, or with the same byte and are placed a step before. In a bucket type A comes first.
    """
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    run_end = change[np.searchsorted(change, np.arange(n), "right")]
    small = np.zeros(n, bool)
    inner = run_end < n
    small[inner] = text[run_end[inner]] > text[inner]
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    direct = np.flatnonzero(small)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    direct = direct[np.argsort(keys.view(f"S{depth}").ravel(), kind="stable")]
    count, large = np.bincount(text, minlength=256), np.bincount(text[~small], minlength=256)
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    rank = np.full(n + 1, -1, np.int64)  # the empty suffix is the least
    of = text[direct]
    rank[direct] = (start + large)[of] + np.arange(len(direct)) - np.searchsorted(of, of, "left")
    rest = np.flatnonzero(~small)
    rest = rest[np.lexsort(((run_end - np.arange(n))[rest], text[rest]))]
    key = text[rest].astype(np.int64) << 32 | (run_end - np.arange(n))[rest]
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(rest)) if len(rest) else [0]
    free = start.copy()
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        one = rest[lo:hi]
        c = text[one[0]]
        rank[one[np.argsort(rank[one + 1], kind="stable")]] = free[c] + np.arange(hi - lo)
        free[c] += hi - lo
    array = np.empty(n, np.int64)
    array[rank[:n]] = np.arange(n)
    return array


def shared_prefixes(text: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """For each entry of ``array`` whether it has ``length`` bytes in common with the entry before it."""
    out = np.zeros(len(array), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for lo in range(1, len(array), 1 << 16):
        k = np.arange(lo, min(len(array), lo + (1 << 16)))
        out[k] = (view[array[k]] == view[array[k - 1]]).all(axis=1)
    return out


def segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window start, bytes, gram hash, body hash) of each segment of the slice, starts within the row."""
    size = np.diff(at)
    rows = np.flatnonzero(size >= length)
    empty = np.zeros(0, np.int64)
    if not len(rows):
        return empty, empty, empty, empty.view(t.U64), empty.view(t.U64)
    g = t.window_hash(data, gram)
    w = length - gram + 1  # grams in a window
    least, span = g.copy(), 1
    while span * 2 <= w:  # least of the next 2, 4, ... grams
        np.minimum(least[:-span], least[span:], out=least[:-span]) if span < len(least) else None
        span *= 2
    rest = w - span
    if rest:
        np.minimum(least[:-rest], least[rest:], out=least[:-rest])
    count = size[rows] - length + 1
    row = np.repeat(rows, count)
    start = np.repeat(at[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    key = least[start]
    new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
    new[1:] |= g[start[1:] - 1] == key[1:]  # in periodic text the same gram comes again: another anchor
    edge = np.flatnonzero(new)
    lo, hi = start[edge], start[np.append(edge[1:], len(start)) - 1]
    return row[edge], lo - at[row[edge]], hi - lo + length, key[edge], t.span_hash(data, lo, hi + length)


def _merged(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each set of equal segments, and the others."""
    order = np.lexsort((rec["lo"], rec["doc"], rec["size"], rec["body"], rec["gram"]))
    rec = rec[order]
    first = np.append(True, (rec["gram"][1:] != rec["gram"][:-1]) | (rec["body"][1:] != rec["body"][:-1]) | (rec["size"][1:] != rec["size"][:-1])) if len(rec) else np.zeros(0, bool)
    return rec[first], rec[~first]


def _hits(rec: np.ndarray, gram: bool) -> np.ndarray:
    out = np.empty(len(rec), _HIT)
    out["doc"], out["lo"], out["hi"], out["gram"] = rec["doc"], rec["lo"], rec["lo"] + rec["size"], rec["gram"] if gram else 0
    return out


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the window starts that are not the earliest with their bytes; strings come in order of rank."""
    sizes = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    count = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(bodies)), count)
    place = np.full(len(text), -1)
    start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    place[start] = np.arange(len(start))  # windows in order of rank
    array = two_stage_suffixes(text, length)
    array = array[place[array] >= 0]
    group = np.cumsum(~shared_prefixes(text, array, length))
    rank = place[array]
    order = np.lexsort((rank, group))
    later = np.append(False, group[order][1:] == group[order][:-1])
    repeated = np.zeros(len(start), bool)
    repeated[rank[order[later]]] = True
    edge = np.concatenate(([0], np.cumsum(count)))
    return [np.flatnonzero(repeated[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(starts, cut)]


def found_hits(docs: DataFrame, n_groups: int, n: int, length: int, gram: int, hot: int) -> DataFrame:
    """(g, payload): packed hits of each group's documents: repeated segments (gram 0), and segments to be compared; their
    ``hi`` is negative where more than ``hot`` share a gram."""

    def cut(batches):
        seg, hit = t.Scatter(n), t.Scatter(n_groups)
        held, size = [], 0

        def out():
            nonlocal held, size
            kept, gone = _merged(np.concatenate(held))
            held, size = [], 0
            kept = kept[np.lexsort((kept["lo"], kept["doc"]))]
            for kind, blocks in ((0, [*seg.add(kept["gram"], kept), *seg.rest()]), (1, [*hit.add(groups_of(gone["doc"], n_groups).astype(t.U64), _hits(gone, False)), *hit.rest()])):
                for b in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int8)), *b.columns], schema=_PARTS)

        for part, data, at in t.chunks(batches, "text", 1 << 20):
            row, lo, bytes_, key, body = segments(data, at, length, gram)
            rec = np.empty(len(row), _SEG)
            rec["doc"], rec["lo"], rec["size"], rec["gram"], rec["body"] = part.column(0).to_numpy()[row], lo, bytes_, key, body
            held.append(rec)
            size += rec.nbytes
            if size > 1 << 24:
                yield from out()
        if held:
            yield from out()

    def meet(batches):
        out = t.Scatter(n_groups)

        def rest(blocks):
            for b in blocks:
                yield pa.RecordBatch.from_arrays(b.columns, names=["g", "payload"])

        def solve(rec):
            kept, gone = _merged(rec)
            same = np.flatnonzero(kept["gram"][1:] == kept["gram"][:-1])
            open_ = np.zeros(len(kept), bool)
            open_[same] = open_[same + 1] = True
            compare = _hits(kept[open_], True)
            edge = t.edges(compare["gram"])
            many = np.repeat(np.diff(edge) > hot, np.diff(edge))
            compare["hi"][many] *= -1
            for hits in (_hits(gone, False), compare):
                yield from rest(out.add(groups_of(hits["doc"], n_groups).astype(t.U64), hits))

        now, held = None, []
        for batch in batches:
            through = batch.filter(pa.compute.equal(batch.column(0), 1)).select(["bucket", "payload"])
            if through.num_rows:
                yield pa.RecordBatch.from_arrays(through.columns, names=["g", "payload"])
            batch = batch.filter(pa.compute.equal(batch.column(0), 0))
            for b, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != now and held:
                    yield from solve(np.concatenate(held))
                    held = []
                now = b
                held.append(np.frombuffer(payload.as_buffer(), _SEG).copy())
        if held:
            yield from solve(np.concatenate(held))
        yield from rest(out.rest())

    parts = docs.select("doc_id", "text").mapInArrow(cut, "kind tinyint, " + t.BLOCKS_DDL)
    met = parts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(meet, "g int, payload binary")
    return stored(met, "hits")


def _by_doc(payloads: list[bytes]) -> dict[int, np.ndarray]:
    """The hits of each document, in order."""
    rec = np.frombuffer(b"".join(payloads), _HIT)
    rec = rec[np.lexsort((rec["hi"], rec["lo"], rec["doc"]))]
    edge = np.append(np.flatnonzero(np.append(True, rec["doc"][1:] != rec["doc"][:-1])), len(rec)) if len(rec) else [0]
    return {int(rec["doc"][a]): rec[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)}


def compared(docs: DataFrame, hits: DataFrame, n_groups: int, length: int) -> DataFrame:
    """(g, payload): the repeated windows of segments with equal grams and different bytes, by sorting their suffixes."""
    binary = lambda data, off: pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    def fetch(own: pa.Table, told: pa.Table) -> pa.Table:
        held, apart = [], []
        rec = np.frombuffer(b"".join(told.column("payload").to_pylist()), _HIT)
        wanted = _by_doc([rec[rec["gram"] != 0].tobytes()])
        for part, data, at in t.chunks(iter([unpacked(own)]), "text") if own.num_rows and wanted else ():
            for k, doc in enumerate(part.column(0).to_pylist()):
                if doc in wanted:
                    own_hits = wanted[doc]
                    if (own_hits["hi"] < 0).any():
                        apart.append((doc, data[at[k] : at[k + 1]], own_hits[own_hits["hi"] < 0]))
                        own_hits = own_hits[own_hits["hi"] > 0]
                    size = own_hits["hi"] - own_hits["lo"]
                    off = np.concatenate(([0], np.cumsum(size)))
                    take = np.repeat(at[k] + own_hits["lo"] - off[:-1], size) + np.arange(off[-1])
                    held.append((own_hits["gram"].view(np.int64), own_hits["doc"], own_hits["lo"], size, data[take]))
        if not held:
            return pa.Table.from_batches([], schema=_BYTES)
        gram, doc, lo, size, data = (np.concatenate([np.ascontiguousarray(x[i]) for x in held]) for i in range(5))
        out = [pa.Table.from_arrays([pa.array(gram), pa.array(doc), pa.array(lo), binary(data, np.concatenate(([0], np.cumsum(size))))], schema=_BYTES)]
        return pa.concat_tables([*out, *singles(apart)])

    def singles(apart):
        """The windows of segments of frequent grams, each by its hash: the earliest of equal ones with its bytes, the others,
        repeats at once, without."""
        held = []
        for doc, text, hits in apart:  # documents come in order
            hash_ = t.window_hash(text, length)
            lo = np.unique(np.concatenate([np.arange(a, -b - length + 1) for a, b in zip(hits["lo"].tolist(), hits["hi"].tolist(), strict=True)]))
            held.append((hash_[lo], np.full(len(lo), doc), lo, text[lo[:, None] + np.arange(length)]))
        if held:
            hash_, doc, lo, body = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(hash_, kind="stable")
            first = np.zeros(len(order), bool)
            first[order[t.edges(hash_[order])[:-1]]] = True
            size = np.where(first, length, 0)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(first), [pa.py_buffer(np.packbits(first, bitorder="little").tobytes()), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32).tobytes()), pa.py_buffer(body[first].tobytes())])
            key = np.where(first, hash_, t.mix(hash_ ^ doc.view(np.uint64))).view(np.int64)
            yield pa.Table.from_arrays([pa.array(key), pa.array(doc), pa.array(lo.astype(np.int32)), bytes_], schema=_BYTES)

    def sort_suffixes(batches):
        """Segments of one gram stay together; many grams share one suffix array, in which equal windows meet only if their grams are equal."""
        now, rows, size = None, [], 0

        def solve():
            nonlocal rows, size
            found = [(doc, lo, lo + length, 0) for doc, lo, body in rows if body is None]
            done, rows, size = sorted(x for x in rows if x[2] is not None), [], 0
            for (doc, lo, _), starts in zip(done, repeated_windows([x[2] for x in done], length), strict=True):
                found += [(doc, lo + a, lo + b, 0) for a, b in _runs(starts, length)]
            rec = np.array(found, _HIT)
            for b in t.Scatter(n_groups, 0).add(groups_of(rec["doc"], n_groups).astype(t.U64), rec) if len(rec) else ():
                yield pa.RecordBatch.from_arrays(b.columns, names=["g", "payload"])

        for batch in batches:
            for key, doc, lo, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    if size > SORTED_BYTES and rows:
                        yield from solve()
                    now = key
                rows.append((doc, lo, body))
                size += len(body or b"") + 16
        if rows:
            yield from solve()

    bytes_ = docs.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(fetch, "gram bigint, doc bigint, lo int, body binary")
    return bytes_.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort_suffixes, "g int, payload binary")


def _union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as disjoint maximal runs; spans that touch are one run."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > top[:-1])
    return list(zip(lo[first].tolist(), top[np.append(np.flatnonzero(first)[1:], len(lo)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (lo, hi), kept (the remaining bytes) and kept_sha256 of each row.

    Null is the empty text. Rows that share a doc_id, and rows without one, are documents of their own, which follow each
    other in the order of their texts' digests, those without a doc_id after all others; an equal row goes as a whole.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, unique = survey(docs)
    rows = keyed(docs, unique)
    return named(_removed(rows.select(F.col(ROW).alias("doc_id"), "text"), size, length, gram, hot), rows, unique)


def _removed(docs: DataFrame, n_bytes: int, length: int, gram: int, hot: int) -> DataFrame:
    """The result for (doc_id, text) of unique doc_ids, with ``n_bytes`` bytes of text."""
    n_groups, n = (n_buckets(docs.sparkSession, x, n_bytes) for x in (2, 1))
    groups = dealt(docs, n_groups)
    hits = found_hits(docs, n_groups, n, length, gram, hot)
    every = hits.union(compared(groups, hits, n_groups, length))
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", span), ("kept", pa.binary()), ("kept_sha256", pa.string())]
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<lo:int,hi:int>>, kept binary, kept_sha256 string"

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        rec = np.frombuffer(b"".join(told.column("payload").to_pylist()), _HIT)
        by_doc = _by_doc([rec[rec["gram"] == 0].tobytes()])
        for part, data, at in t.chunks(iter([unpacked(own)]), "text") if own.num_rows else ():
            for k, doc in enumerate(part.column(0).to_pylist()):
                text = data[at[k] : at[k + 1]].tobytes()
                gone = [(a, min(b, len(text))) for a, b in _union(by_doc[doc]["lo"], by_doc[doc]["hi"]) if a < len(text)] if doc in by_doc else []
                kept, lo = [], 0
                for a, b in gone:
                    kept.append(text[lo:a])
                    lo = b
                kept = b"".join([*kept, text[lo:]])
                out.append((doc, len(text), len(text) - len(kept), len(gone), [{"lo": a, "hi": b} for a, b in gone], kept, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.Table.from_arrays([pa.array(c, x) for c, (_, x) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return groups.groupBy("g").cogroup(every.groupBy("g")).applyInArrow(run, ddl)
