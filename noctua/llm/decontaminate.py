"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns blocks of documents into self-contained index segments: sorted term hashes and, for each term,
the ascending word positions in the block. Segments are rows of a Parquet table in the shared folder, so they can be
searched again and again, and rebuilt one by one when an executor is lost. A term that every document holds makes no
long list anywhere, since each segment has its own.

``phrase_hits`` sends the test phrases to all segments. In a segment a phrase starts from its rarest term's list,
moved back by the term's offset, and is intersected with the lists of the next rarest terms, moved likewise.
``proximity_hits`` finds windows that hold all terms of a query in any order.

The phrases are broadcast in groups of bounded size (``MOST_PHRASES``); more phrases make more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t
from ._shared import stored

WINDOW, MOST_PHRASES = 10, 200_000
#: Places left free between two documents of a segment, so that no phrase reaches from one into the next.
GAP = 1
INDEX = "segment bigint, doc_ids array<bigint>, starts binary, n_words binary, terms binary, ends binary, places binary"


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, first = t.words(t.lower(data), at, t.ALNUM)
    return h, first


def _segment(h: np.ndarray, first: np.ndarray) -> dict[str, bytes]:
    n = np.diff(first)
    shift = np.arange(len(n)) * GAP
    place = (np.arange(len(h)) + np.repeat(shift, n)).astype(np.int32)
    order = np.argsort(h, kind="stable")
    terms, begin = np.unique(h[order], return_index=True)
    ends = np.append(begin[1:], len(h)).astype(np.int32)
    starts = (first[:-1] + shift).astype(np.int32)
    parts = {"starts": starts, "n_words": n.astype(np.int32), "terms": terms, "ends": ends[: len(terms)], "places": place[order]}
    return {k: v.tobytes() for k, v in parts.items()}


def build_index(docs: DataFrame) -> DataFrame:
    """Index segments of (doc_id, text), one for each 2 MB or so of text; null texts have no words. Not yet stored:
    a segment is named by its task and place in it, so searches in several passes need a stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        task = TaskContext.get().partitionId() << 32
        for k, (part, data, at) in enumerate(t.chunks(batches, "text")):
            row = {"segment": task + k, "doc_ids": part.column(0), **_segment(*_terms(data, at))}
            yield pa.RecordBatch.from_arrays([pa.array([row[x]], kind) for x, kind in zip(names, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


class _Lists:
    """The postings of one segment row."""

    def __init__(self, row: dict[str, pa.Scalar]):
        at = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.doc_ids, self.starts, self.n_words = row["doc_ids"].values, at("starts", np.int32), at("n_words", np.int32)
        self.terms, self.ends, self.places = at("terms", np.uint64), at("ends", np.int32), at("places", np.int32)

    def spots(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term where its list begins and ends; both 0 where the segment lacks it."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[i] == terms
        begin = np.append(0, self.ends[:-1])
        return np.where(here, begin[i], 0), np.where(here, self.ends[i], 0)

    def docs(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1


def _phrases(lists: _Lists, terms: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase number, places where it starts); ``terms`` of phrase k are those from first[k] to first[k + 1]."""
    begin, end = lists.spots(terms)
    count = end - begin
    if not len(terms):
        return
    rarest = np.minimum.reduceat(count, first[:-1])
    for k in np.flatnonzero(rarest):
        lo, hi = first[k], first[k + 1]
        order = lo + np.argsort(count[lo:hi], kind="stable")
        found = None
        for j in order:
            held = lists.places[begin[j] : end[j]] - np.int32(j - lo)
            if found is None:
                found = held
            elif len(found) * 16 < len(held):
                i = np.minimum(np.searchsorted(held, found), len(held) - 1)
                found = found[held[i] == found]
            else:
                found = np.intersect1d(found, held, assume_unique=True)
            if not len(found):
                break
        if len(found):
            yield int(k), found


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(phrase, item_id, terms): each run of ``size`` item words, or all words of a shorter item that has some."""

    def run(batches):
        for part, data, at in t.chunks(batches, "text"):
            h, first = _terms(data, at)
            rows = []
            for k, item in enumerate(part.column(0).to_pylist()):
                own = h[first[k] : first[k + 1]]
                for i in range(max(1, len(own) - size + 1) if len(own) else 0):
                    rows.append((item, own[i : i + size].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "terms"])

    return items.where("item_id IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id bigint, terms binary")


def phrase_hits(index: DataFrame, phrases: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """(doc_id, segment, doc_row, n_words, item_id, lo, hi): word spans of documents that equal a phrase (item_id, terms).

    Every document also has one row with a null item_id, which carries its n_words. Segment and doc_row name a row,
    whether or not others have its doc_id. An item_id may be null no more than a phrase may be empty.
    """
    spark = index.sparkSession
    out = None
    phrases = phrases.distinct()
    total = phrases.count()
    parts = -(-total // most) or 1
    for p in range(parts):
        rows = (phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == p)).collect()
        sent = spark.sparkContext.broadcast(([r.item_id for r in rows], [bytes(r.terms) for r in rows]))
        got = index.mapInArrow(_search(sent, p == 0), "doc_id bigint, segment bigint, doc_row int, n_words bigint, item_id bigint, lo int, hi int")
        out = got if out is None else out.union(got)
    return out


def _search(sent, with_all: bool):
    def run(batches):
        items, packed = sent.value
        terms = np.frombuffer(b"".join(packed), np.uint64)
        size = np.array([len(x) // 8 for x in packed], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        items = np.array(items, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                lists = _Lists({x: batch.column(i)[row] for i, x in enumerate(batch.schema.names)})
                name = batch.column(0)[row].as_py()
                doc, phrase, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for k, found in _phrases(lists, terms, first):
                    doc.append(lists.docs(found))
                    phrase.append(np.full(len(found), k))
                    place.append(found)
                d, k = np.concatenate(doc), np.concatenate(phrase)
                lo = np.concatenate(place) - lists.starts[d] if len(d) else np.zeros(0, np.int32)
                n = len(lists.doc_ids) if with_all else 0
                every = np.concatenate((d, np.arange(n)))
                none = np.zeros(n, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        lists.doc_ids.take(pa.array(every)),
                        pa.array(np.full(len(every), name)),
                        pa.array(every.astype(np.int32)),
                        pa.array(lists.n_words[every].astype(np.int64)),
                        pa.array(np.concatenate((items[k], none)), pa.int64(), mask=np.arange(len(every)) >= len(d)),
                        pa.array(np.concatenate((lo, none)).astype(np.int32)),
                        pa.array(np.concatenate((lo + size[k], none)).astype(np.int32)),
                    ],
                    names=["doc_id", "segment", "doc_row", "n_words", "item_id", "lo", "hi"],
                )

    return run


def proximity_hits(index: DataFrame, queries: DataFrame, span: int, most: int = MOST_PHRASES) -> DataFrame:
    """(doc_id, query_id, lo, hi): for each query (query_id, text) the shortest windows of at most ``span`` words
    that hold all its distinct terms in any order, one for each place of its rarest term, found from that term's list.
    Queries go out ``most`` at a time; rows of ``queries`` without an id or a word match nothing."""
    spark = index.sparkSession
    packed = windows(queries.select(F.col("query_id").alias("item_id"), "text"), 1 << 30).distinct()
    parts = -(-packed.count() // most) or 1
    out = None
    for p in range(parts):
        rows = (packed if parts == 1 else packed.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == p)).collect()
        sent = spark.sparkContext.broadcast([(r.item_id, np.unique(np.frombuffer(r.terms, np.uint64))) for r in rows])
        got = index.mapInArrow(_near(sent, span), "doc_id bigint, query_id bigint, lo int, hi int")
        out = got if out is None else out.union(got)
    return out


def _near(sent, span: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lists = _Lists({x: batch.column(i)[row] for i, x in enumerate(batch.schema.names)})
                doc, out = [], []
                for query, terms in sent.value:
                    begin, end = lists.spots(terms)
                    if (end == begin).any():
                        continue
                    held = sorted((lists.places[a:b] for a, b in zip(begin, end, strict=True)), key=len)
                    for p, d in zip(held[0].tolist(), lists.docs(held[0]).tolist(), strict=True):
                        start = int(lists.starts[d])
                        low, high = max(start, p - span + 1), min(start + int(lists.n_words[d]), p + span)
                        near = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in held[1:]]
                        if all(map(len, near)):
                            marks = sorted([(p, 0), *((int(v), k + 1) for k, x in enumerate(near) for v in x)])
                            if best := _shortest(marks, len(held), p, span):
                                doc.append(d)
                                out.append((query, best[0] - start, best[1] + 1 - start))
                cols = list(zip(*out, strict=True)) or [()] * 3
                ids = lists.doc_ids.take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["doc_id", "query_id", "lo", "hi"])

    return run


def _shortest(marks: list[tuple[int, int]], n: int, p: int, span: int) -> tuple[int, int] | None:
    best, last = None, {}
    for place, term in marks:
        last[term] = place
        if len(last) == n and (low := min(last.values())) <= p <= place and place - low < span and (best is None or place - low < best[1] - best[0]):
            best = (low, place)
    return best


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside any window of an item), n_items, item_ids (sorted as
    strings), contaminated. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Texts and
    items that are null or have no words hit nothing; an empty benchmark leaves all documents clean. Repeated rows, rows
    that share a doc_id and rows without one have a result each; of rows that share an item_id all windows count for it."""
    index = stored(build_index(docs), "index")
    hits = phrase_hits(index, windows(items, size))
    merged = hits.groupBy("segment", "doc_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("lo", "hi")))).alias("spans"),
        F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("item_ids"),
    )
    # spans come in order: count each span's words beyond the furthest end so far
    fold = F.expr("aggregate(spans, named_struct('top', 0, 'n', 0L), (a, s) -> named_struct('top', greatest(a.top, s.hi), 'n', a.n + greatest(0, s.hi - greatest(a.top, s.lo))), a -> a.n)")
    return merged.select(
        "doc_id", "n_words", fold.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids"
    ).withColumn("contaminated", F.col("n_hit") > 0)


def hit_ids(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id): the ids of documents with any window of an item, and of no others."""
    index = stored(build_index(docs), "index")
    return phrase_hits(index, windows(items, size)).where("item_id IS NOT NULL").select("doc_id").distinct()
