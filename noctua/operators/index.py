"""An inverted index that follows its table: block postings, delta segments, fields with weights, questions as a table.

A segment's documents are numbered in blocks of ``BLOCK``, and (segment, block, doc) names a document for good, through
merges too. A row of postings is one term in one block: how many of its documents hold it, the largest count in each field,
the least length, and the entries themselves. The columns without the entries bound what any document of the block can
score, and Parquet reads them alone. So the best ``k`` of a question come in two passes: blocks with the greatest bounds are
scored first, their k-th score is a threshold, and of all other blocks only those are opened whose bound reaches it. The
result is exact.

Changed rows make a delta segment, which also names the documents of older segments that it makes void and takes their
counts off: the number of rows, the sum of lengths and each term's document count are sums over segments, so a search reads
the figures of a fresh build. Beyond ``MOST_SEGMENTS`` deltas the live rows of all segments are written as one again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from noctua.functions import text
from noctua.sources.tables import children, deleted, exists

K1, B = 1.2, 0.75
#: Documents of a block; deltas that are read beside the first segment; blocks that a question opens first, for eight rows that it wants.
BLOCK, MOST_SEGMENTS, FIRST_BLOCKS = 2048, 8, 1

#: Questions that are scored together; blocks of one scoring group; blocks of an index so small that bounds don't pay.
ASKED, SPAN, SMALL = 1024, 2, 32

#: Rows of an index whose void documents are sent to all tasks, a bit for each.
MOST_SENT = 1 << 28


#: ASCII letters to lower case, what is neither letter nor digit to a space; other bytes stay. Second bytes of accented letters (after 0xC3) to their base.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_BASES = np.zeros(256, np.uint8)
_BASES[[a.encode()[1] for a in text.ACCENTED]] = [ord(b) for b in text.BASE]


def _most(n_fields: int) -> list[str]:
    return [f"most_{k}" for k in range(n_fields)]


def _places(n: np.ndarray, width: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For values that begin at ``first``, of ``n`` entries and fields of ``width`` bytes: the value of each entry, and where its
    document and its count in each field lie. A value has a byte for the width of each field, two bytes for each document, and the counts field by field."""
    row = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = first + width.shape[1]
    doc, at = at[row] + 2 * own, at + 2 * n
    fields = []
    for w in width.T:
        fields.append(at[row] + w[row] * own)
        at = at + w * n
    return row, doc, fields


def _packed(docs: np.ndarray, tf: np.ndarray, n: np.ndarray, most: np.ndarray) -> pa.Array:
    """Runs of ``n`` entries (the document's number in its block, its counts by field) as binary values: a count takes as many bytes as
    the field's largest needs, none where that is 0."""
    width = np.array([0, 1, 2, 4])[(most > 0) + (most > 0xFF).astype(int) + (most > 0xFFFF)].reshape(len(n), tf.shape[1])
    off = np.append(0, np.cumsum(width.shape[1] + n * (2 + width.sum(1)))).astype(np.int64)
    row, at, fields = _places(n, width, off[:-1])
    out = np.zeros(off[-1], np.uint8)
    for k in range(width.shape[1]):
        out[off[:-1] + k] = width[:, k]
    out[at], out[at + 1] = docs & 0xFF, docs >> 8
    for k, place in enumerate(fields):
        for b in range(4):
            there = width[row, k] > b
            out[place[there] + b] = (tf[there, k] >> (8 * b)) & 0xFF
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column's values, where each begins, and how many it has; none for null."""
    values = [v or b"" for v in column.to_pylist()]
    size = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


def _unpacked(column: pa.Array, n_fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents and counts of all entries of a column, the value of each, and how many each value holds."""
    data, first, size = _joined(column)
    width = data[first[:, None] + np.arange(n_fields)].astype(np.int64)
    n = (size - n_fields) // (2 + width.sum(1))
    row, at, fields = _places(n, width, first)
    tf = np.zeros((len(row), n_fields), np.int64)
    for k, place in enumerate(fields):
        for b in range(4):
            there = np.flatnonzero(width[row, k] > b)
            tf[there, k] |= data[place[there] + b].astype(np.int64) << (8 * b)
    return data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8, tf, row, n


def _value(rows: DataFrame, field: str) -> Column:
    """A field as a text; lists of words (tags) are joined."""
    kind = rows.schema[field].dataType.simpleString()
    return F.coalesce(F.array_join(field, " ") if kind.startswith("array") else F.col(field), F.lit(""))


def folded(rows: DataFrame, field: str) -> Column:
    """The terms of a field as one text, a space between two."""
    return F.regexp_replace(F.translate(F.lower(_value(rows, field)), text.ACCENTED, text.BASE), text.ALNUM_SPLIT, " ")


def _half_folded(value: Column) -> Column:
    """What ``_words`` makes the terms of ``folded`` of: texts in ASCII stay, others get lower case and lose separators, not accents."""
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(F.regexp_replace(F.lower(value), text.ALNUM_SPLIT, " "))


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column of half-folded texts, and the row of each; folded as bytes, all rows at once."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().translate(_FOLD) if raw else b"", np.uint8).copy()
    offsets = offsets - offsets[0]
    kept = data != 32
    start = kept.copy()
    start[1:] &= ~kept[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # no term goes on in the next row
    start[edge] = kept[edge]
    start = np.flatnonzero(start)
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[_BASES[data[lead + 1]] > 0]
    data[lead + 1], kept[lead] = _BASES[data[lead + 1]], False
    off = np.append(np.cumsum(kept, dtype=np.int32)[start] - kept[start], np.count_nonzero(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data[kept].tobytes())]), np.searchsorted(offsets, start, "right") - 1


def _blocks(n_fields: int, block: int):
    """Postings of each block of documents (id, fields…), and a row without term that names the block's documents."""

    def of(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
        n = batch.num_rows
        found = [_words(batch.column(1 + f)) for f in range(n_fields)]
        coded = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        doc, field = np.concatenate([d for _, d in found]), np.repeat(np.arange(n_fields), [len(d) for _, d in found])
        length = np.bincount(doc, minlength=n)
        key, count = np.unique(((doc // block) * len(names) + code) * block + doc % block, return_inverse=True)
        tf = np.bincount(count * n_fields + field, minlength=len(key) * n_fields).reshape(-1, n_fields)
        run, own = key // block, key % block
        edge = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
        at = (run // max(len(names), 1)) * block + own
        most = np.maximum.reduceat(tf, edge) if len(edge) else tf
        least = np.minimum.reduceat(length[at], edge) if len(edge) else length[at]
        blocks = np.arange(-(-n // block))
        bounds = pa.array(np.append(blocks * block, n).astype(np.int32))
        word = names.take(pa.array(run[edge] % max(len(names), 1)))
        held = np.diff(np.append(edge, len(run)))
        counts = [held, *most.T, least]
        ids, lengths = pa.ListArray.from_arrays(bounds, batch.column(0)), pa.ListArray.from_arrays(bounds, pa.array(length, pa.int32()))
        own_rows = [word, pa.array(first + run[edge] // max(len(names), 1)), *(pa.array(x, pa.int32()) for x in counts), _packed(own, tf, held, most), pa.nulls(len(edge), ids.type), pa.nulls(len(edge), lengths.type)]
        doc_rows = [pa.nulls(len(blocks), pa.string()), pa.array(first + blocks), *(pa.nulls(len(blocks), pa.int32()) for _ in counts), pa.nulls(len(blocks), pa.binary()), ids, lengths]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(own_rows, doc_rows, strict=True)], names=["term", "block", "n", *_most(n_fields), "least", "entries", "ids", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([x]) for x in part.columns], names=part.schema.names)
                yield of(part, first)
                first += -(-part.num_rows // block)

    return run


class Index:
    """The index in ``folder`` of rows with a text key ``id``; opened as the last change left it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        versions = children(spark, f"{self.folder}/versions")
        self.version = max(v for v in versions if exists(spark, f"{self.folder}/versions/{v}/_SUCCESS"))
        rows = spark.read.parquet(f"{self.folder}/versions/{self.version}").orderBy("place").collect()  # a row for each segment
        self.segments = [r.segment for r in rows]
        self.fields: tuple[str, ...] = tuple(rows[0].fields)
        self.n, self.total = sum(r.n for r in rows), sum(r.total for r in rows)
        self._rows = rows

    # writing

    @staticmethod
    def there(spark: SparkSession, folder: str) -> bool:
        return any(exists(spark, f"{folder}/versions/{v}/_SUCCESS") for v in children(spark, f"{folder}/versions"))

    @classmethod
    def build(cls, rows: DataFrame, folder: str, fields: Sequence[str], key: str = "id") -> Index:
        """Index all of ``rows``, whose keys are unique; fields that the table lacks count as empty."""
        made = _segment(rows, folder, fields, key)
        return _commit(rows.sparkSession, folder, [(*made, list(fields))])

    def changed(self, rows: DataFrame, gone: DataFrame | None = None, key: str = "id") -> Index:
        """The index after ``rows`` were added or took the place of rows of the same key, and the keys of ``gone`` went."""
        keys = rows.select(F.col(key).cast("string").alias("id"))
        keys = (keys if gone is None else keys.unionByName(gone.select(F.col(key).cast("string").alias("id")))).distinct()
        old = self.docs().join(keys, "id", "left_semi")
        name, n, total = _segment(rows, self.folder, self.fields, key)
        path = f"{self.folder}/{name}"
        old.groupBy("segment", "block").agg(F.array_sort(F.collect_list("doc")).alias("gone")).write.parquet(f"{path}/void")
        # what becomes void takes its counts off: a pass over postings, whose blocks meet the few that lose documents
        void = self._bits(self.spark.read.parquet(f"{path}/void"))
        n_fields = len(self.fields)

        def lost_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, _, row, gone = _gone(batch, n_fields)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row[gone], minlength=batch.num_rows))], names=["term", "dead"])

        dead = self.raw_postings().join(void, ["segment", "block"]).select("term", "entries", "gone").mapInArrow(lost_of, "term string, dead bigint").where("dead > 0")
        dead.groupBy("term").agg((-F.sum("dead")).alias("df")).write.mode("append").parquet(f"{path}/terms")
        lost = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        now = [(r.segment, r.n, r.total, list(self.fields)) for r in self._rows]
        after = _commit(self.spark, self.folder, [*now, (name, n - lost.n, total - lost.total, list(self.fields))])
        return after.merged() if len(after.segments) > MOST_SEGMENTS else after

    def merged(self) -> Index:
        """One segment with the live rows of all; blocks keep their documents and bounds, less what is void."""
        name = _name()
        path = f"{self.folder}/{name}"
        _write_sorted(self.live_postings(), f"{path}/postings")
        self.docs().write.parquet(f"{path}/docs")
        self.terms().write.parquet(f"{path}/terms")
        return _commit(self.spark, self.folder, [(name, self.n, self.total, list(self.fields))])

    # reading

    def _each(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{s}/{table}" for s in self.segments))

    def void(self) -> DataFrame:
        """(segment, block, gone): documents of a block that later segments have made void."""
        found = self.spark.read.parquet(*(f"{self.folder}/{s}/void" for s in self.segments[1:]))  # deltas alone have some
        return found.groupBy("segment", "block").agg(F.flatten(F.collect_list("gone")).alias("gone"))  # at most BLOCK of them

    def _bits(self, void: DataFrame) -> DataFrame:
        """``void`` with a bit for each document in place of their list: it goes to every posting of the block."""

        def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = [np.packbits(np.bincount(g, minlength=1).astype(bool), bitorder="little").tobytes() for g in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["segment", "block", "gone"])

        out = void.select("segment", "block", "gone").mapInArrow(bits_of, "segment bigint, block bigint, gone binary")
        return F.broadcast(out) if self.n < MOST_SENT else out

    def docs(self) -> DataFrame:
        """(segment, block, doc, id, length) of the live rows."""
        all_ = self._each("docs").select("segment", "block", "doc", "id", "length")
        return all_ if len(self.segments) == 1 else all_.join(self.void(), ["segment", "block"], "left").where("gone IS NULL OR NOT array_contains(gone, doc)").drop("gone")

    def raw_postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        out = self._each("postings")
        return out if terms is None else out.where(F.col("term").isin(list(terms)))

    def live_postings(self) -> DataFrame:
        """Postings without what is void, with their bounds; rows without entries go."""
        out, n_fields = self.raw_postings(), len(self.fields)
        if len(self.segments) == 1:
            return out
        names = ["term", "segment", "block", "n", *_most(n_fields), "least", "entries"]

        def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, tf, row, gone = _gone(batch, n_fields)
                docs, tf, row = docs[~gone], tf[~gone], row[~gone]
                edge = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
                there, n = pa.array(row[edge]), np.diff(np.append(edge, len(row)))
                most = np.maximum.reduceat(tf, edge) if len(edge) else tf
                counts = [pa.array(n.astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in most.T), batch.column("least").take(there)]  # the least length stays a bound
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(there) for k in range(3)), *counts, _packed(docs, tf, n, most)], names=names)

        kinds = "term string, segment bigint, block bigint, n int, " + ", ".join(f"{x} int" for x in _most(n_fields)) + ", least int, entries binary"
        touched = out.join(self._bits(self.void()), ["segment", "block"], "left").select("term", "segment", "block", "least", "entries", "gone")
        return touched.mapInArrow(left, kinds)

    def terms(self, own: Sequence[str] | None = None) -> DataFrame:
        """(term, df) of the live rows."""
        return self._summed(self._each("terms").where(F.lit(True) if own is None else F.col("term").isin(list(own))))

    @staticmethod
    def _summed(out: DataFrame) -> DataFrame:
        return out.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def average(self) -> float:
        return self.total / self.n if self.n else 0.0

    # scoring

    def _idf(self) -> Column:
        return F.greatest(F.ln((F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))

    def _weights(self, weights: dict[str, float] | None) -> np.ndarray:
        return np.array([(weights or {}).get(f, 1.0) for f in self.fields])

    def asked(self, questions: DataFrame, own: Sequence[str] | None = None, few: bool = False) -> DataFrame:
        """(q, term, weight): the terms of ``questions`` (q, term, one row for each occurrence) that the index holds. Those of ``few``
        questions go to the index's terms, so that others are not shuffled."""
        each = questions.groupBy("q", "term").agg(F.count("*").alias("times"))
        terms = self._summed(self._each("terms").join(F.broadcast(questions.select("term").distinct()), "term", "left_semi")) if few else self.terms(own)
        out = each.join(terms, "term").select("q", "term", (F.col("times") * self._idf()).alias("weight"))
        # the terms of a few questions are a few rows: looked up once, they travel with the plan
        return out if own is None else self.spark.createDataFrame(out.collect(), out.schema)

    def bounds(self, asked: DataFrame, own: Sequence[str] | None, weights: dict[str, float] | None) -> DataFrame:
        """(q, term, weight, segment, block, bound): the blocks of each question, and what no document of a block can exceed."""
        heads = self.raw_postings(own).select("term", "segment", "block", *_most(len(self.fields)), "least").join(asked, "term")
        tf = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(x) for w, x in zip(self._weights(weights), _most(len(self.fields)), strict=True)))
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("least") / F.lit(self.average or 1.0)))
        most = heads.select("q", "term", "weight", "segment", "block", (F.col("weight") * gain).alias("gain"))
        return most.withColumn("bound", F.sum("gain").over(Window.partitionBy("q", "segment", "block"))).drop("gain")

    def _scored(self, postings: DataFrame, allowed: DataFrame, limits: list[str], k: int | None, weights: dict[str, float] | None, groups: int = 1) -> DataFrame:
        """(q, id, tie, bm25): of each group of blocks the ``k`` best rows of each question, or all.

        ``postings`` (g, segment, block, entries, qs) has the questions of a group g beside the term's entries, so entries travel
        once for all of them; ``allowed`` (segment, block, doc, length, id, tie, limits) has the rows that may be returned."""
        n_fields, average, per_field, names = len(self.fields), self.average or 1.0, self._weights(weights), limits
        q_kind = postings.schema["qs"].dataType.elementType["q"].dataType
        schema = T.StructType([T.StructField("q", q_kind), allowed.schema["id"], allowed.schema["tie"], T.StructField("bm25", T.DoubleType())])

        def score(key: tuple, told: pa.Table, rows: pa.Table) -> pa.Table:
            if not told.num_rows or not rows.num_rows:
                return to_arrow_schema(schema).empty_table()
            # blocks and rows of this group by number; documents that are void or not wanted have no row
            blocks = {b: i for i, b in enumerate(dict.fromkeys(zip(rows["segment"].to_pylist(), rows["block"].to_pylist(), strict=True)))}
            of = lambda t: np.array([blocks.get(x, -1) for x in zip(t["segment"].to_pylist(), t["block"].to_pylist(), strict=True)], np.int64)
            qs = told["qs"].combine_chunks()
            each, per_row = pc.list_flatten(qs), pc.list_value_length(qs).to_numpy()
            coded = each.field("q").dictionary_encode()
            q, weight = coded.indices.to_numpy(), each.field("weight").to_numpy()
            doc, tf, row, n = _unpacked(told["entries"].combine_chunks(), n_fields)
            place = np.full((len(blocks) + 1, 1 + max(pc.max(rows["doc"]).as_py(), int(doc.max()))), -1, np.int64)
            place[of(rows), rows["doc"].to_numpy()] = np.arange(rows.num_rows)
            at = place[of(told)[row], doc]  # -1 in the last row too, that of blocks without rows
            tf = tf @ per_field
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * rows["length"].to_numpy()[at] / average))  # of no use where ``at`` is -1
            sums, hit = np.zeros((len(coded.dictionary), rows.num_rows)), np.zeros((len(coded.dictionary), rows.num_rows), bool)
            e_edge, q_edge = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(per_row))
            for i in range(told.num_rows):  # a term of a block: its questions by its documents
                mine = at[e_edge[i] : e_edge[i + 1]]
                there = mine >= 0
                whose = slice(q_edge[i], q_edge[i + 1])
                sums[q[whose][:, None], mine[there]] += weight[whose][:, None] * gain[e_edge[i] : e_edge[i + 1]][there]
                hit[q[whose][:, None], mine[there]] = True
            for c in names:  # a question's limit is null or the row's own value
                own = rows[c].combine_chunks().dictionary_encode()
                code = {v: j for j, v in enumerate(own.dictionary.to_pylist())}
                limit = np.full(len(coded.dictionary), -2)
                for j, v in zip(q.tolist(), each.field(c).to_pylist(), strict=True):
                    limit[j] = -2 if v is None else code.get(v, -1)
                hit &= (limit[:, None] == -2) | (limit[:, None] == own.indices.fill_null(-3).to_numpy())
            rank = np.empty(rows.num_rows, np.int64)
            rank[pc.sort_indices(rows["tie"]).to_numpy()] = np.arange(rows.num_rows)
            who, what = [], []
            for j in range(len(sums)):
                found = np.flatnonzero(hit[j])
                if k is not None and len(found) > k:
                    found = found[np.lexsort((rank[found], -np.round(sums[j, found], 9)))[:k]]
                who.append(np.full(len(found), j))
                what.append(found)
            who, what = np.concatenate(who), np.concatenate(what)
            return pa.Table.from_arrays([coded.dictionary.take(pa.array(who)), rows["id"].combine_chunks().take(pa.array(what)), rows["tie"].combine_chunks().take(pa.array(what)), pa.array(sums[who, what])], names=schema.names)

        by = ["g", "segment", "span"]
        told = postings.select("g", "segment", (F.col("block") / SPAN).cast("bigint").alias("span"), "block", "entries", "qs")
        rows = allowed.withColumn("span", (F.col("block") / SPAN).cast("bigint")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return told.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(score, schema)

    def hits(self, terms: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
        """(id, bm25) of every row that holds one of ``terms``, a query's terms with repeats."""
        own = sorted(set(terms))
        asked = self.asked(self.spark.createDataFrame([(0, w) for w in terms], "q int, term string"), own)
        told = self.raw_postings(own).join(asked, "term").select(F.lit(0).alias("g"), "segment", "block", "entries", F.array(F.struct("q", "weight")).alias("qs"))
        return self._scored(told, self.docs().select("segment", "block", "doc", "length", "id", F.col("id").alias("tie")), [], None, weights).select("id", "bm25")

    def best(self, questions: DataFrame, rows: DataFrame, k: int, tie: str = "id", own: Sequence[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """(q, id, bm25, position) of the ``k`` best rows of each question, from 0.

        ``questions`` (q, term, and columns that ``rows`` has too, which must then be equal or null) may hold any number; ``rows``
        (id, tie, …) are those that may be returned. ``own`` names all terms of one question, whose scan skips other terms, and
        blocks by their bounds. A table of questions is scored in groups against every posting of its terms, each read once.
        Equal scores (to nine digits) go by ``tie``."""
        limits = [c for c in questions.columns if c not in ("q", "term")]
        may = rows.select(F.col("id").alias("row_id"), F.col(tie).alias("tie"), *limits)
        docs = self.docs().select("segment", "block", "doc", "length", F.col("id").alias("doc_key")).join(may, F.col("doc_key") == F.col("row_id").cast("string")).select("segment", "block", "doc", "length", F.col("row_id").alias("id"), "tie", *limits)
        order = Window.partitionBy("q").orderBy(F.desc(F.round("bm25", 9)), "tie")

        def first(found: DataFrame) -> DataFrame:
            best = found.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= k)  # a limit that each task takes first
            return best.select("q", "id", "bm25", (F.col("nr") - 1).alias("position"))

        if own is None:
            groups = max(1, -(-questions.select("q").distinct().count() // ASKED))
            asked = self.asked(questions.select("q", "term"), few=groups == 1)
            wanted = asked if not limits else asked.join(questions.select("q", *limits).distinct(), "q")
            g = F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("g")
            lists = wanted.groupBy("term", g).agg(F.collect_list(F.struct("q", "weight", *limits)).alias("qs"))  # about ASKED at most
            # the lists of one group are small and go to the postings; those of many meet them by term
            told = self.raw_postings().select("term", "segment", "block", "entries").join(F.broadcast(lists) if groups == 1 else lists, "term")
            return first(self._scored(told, docs, limits, k, weights, groups))

        asked = self.asked(questions.select("q", "term"), own)
        if self.n <= SMALL * BLOCK:
            told = self.raw_postings(own).select("term", "segment", "block", "entries").join(asked, "term").select(F.lit(0).alias("g"), "segment", "block", "entries", F.array(F.struct("q", "weight")).alias("qs"))
            return first(self._scored(told, docs, [], k, weights))
        blocks = self.bounds(asked, own, weights)

        def scored(opened: DataFrame) -> DataFrame:
            told = self.raw_postings(own).select("term", "segment", "block", "entries").join(opened.select("q", "term", "weight", "segment", "block"), ["term", "segment", "block"])
            told = told.select(F.lit(0).alias("g"), "segment", "block", "entries", F.array(F.struct("q", "weight")).alias("qs"))
            return first(self._scored(told, docs.join(opened.select("segment", "block").distinct(), ["segment", "block"], "left_semi"), [], k, weights))

        one = blocks.select("q", "segment", "block", "bound").distinct()
        start = one.withColumn("nr", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "segment", "block"))).where(F.col("nr") <= max(1, FIRST_BLOCKS * k // 8))
        seen = scored(blocks.join(start.select("q", "segment", "block"), ["q", "segment", "block"]))
        least = seen.groupBy("q").agg(F.count("*").alias("n"), F.min("bm25").alias("least")).where(F.col("n") == k).select("q", "least")
        # rounding may let a row a little below the threshold tie with it
        return scored(blocks.join(least, "q", "left").where("least IS NULL OR bound >= least - 1e-8"))


def opened_share(index: Index, questions: DataFrame, rows: DataFrame, k: int, own: Sequence[str] | None = None) -> float:
    """The share of blocks that ``best`` opens at its threshold, of all that hold a term: for tests and tuning."""
    blocks = index.bounds(index.asked(questions.select("q", "term"), own), own, None).select("q", "segment", "block", "bound").distinct()
    least = index.best(questions, rows, k, own=own).groupBy("q").agg(F.count("*").alias("n"), F.min("bm25").alias("least")).where(F.col("n") == k)
    got = blocks.join(least, "q", "left").agg(F.count("*").alias("all"), F.count_if(F.expr("least IS NULL OR bound >= least - 1e-8")).alias("open")).first()
    return got.open / got["all"] if got["all"] else 0.0


def _name() -> str:
    """A new segment's number, as text; documents carry it for good."""
    return str(uuid.uuid4().int >> 66)


def _gone(batch: pa.RecordBatch, n_fields: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a batch of postings (entries, gone) as documents and counts, the row of each, and whether its document is void."""
    docs, tf, row, _ = _unpacked(batch.column("entries"), n_fields)
    bits, first, size = _joined(batch.column("gone"))
    out = docs < 8 * size[row]
    out[out] = bits[first[row[out]] + (docs[out] >> 3)] >> (docs[out] & 7) & 1
    return docs, tf, row, out


def _write_sorted(postings: DataFrame, path: str, *more: Column) -> None:
    """In order of term and block; ranges split a term that all blocks hold."""
    postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block").select("*", *more).write.option("compression", "zstd").parquet(path)


def _segment(rows: DataFrame, folder: str, fields: Sequence[str], key: str) -> tuple[str, int, int]:
    """Write a segment; its name, rows and sum of lengths."""
    spark, name = rows.sparkSession, _name()
    path = f"{folder.rstrip('/')}/{name}"
    have = [_value(rows, f) if f in rows.columns else F.lit("") for f in fields]
    kinds = "term string, block bigint, n int, " + ", ".join(f"{x} int" for x in _most(len(have))) + ", least int, entries binary, ids array<string>, lengths array<int>"
    texts = rows.select(F.col(key).cast("string").alias("id"), *(x.alias(f"f{i}") for i, x in enumerate(have)))
    raw = texts.select("id", *(_half_folded(F.col(f"f{i}")).alias(f"f{i}") for i in range(len(have)))).mapInArrow(_blocks(len(have), BLOCK), kinds)
    raw.write.option("compression", "zstd").parquet(f"{path}/raw")  # numbers of blocks are those of this one reading
    raw = spark.read.parquet(f"{path}/raw")
    own = F.lit(int(name)).cast("bigint").alias("segment")
    _write_sorted(raw.where("term IS NOT NULL").drop("ids", "lengths"), f"{path}/postings", own)
    raw.where("term IS NULL").select("block", F.posexplode(F.arrays_zip("ids", "lengths")).alias("doc", "x")).select(own, "block", "doc", F.col("x.ids").alias("id"), F.col("x.lengths").alias("length")).write.parquet(f"{path}/docs")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    deleted(spark, f"{path}/raw")
    got = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    return name, got.n, got.total


def _commit(spark: SparkSession, folder: str, segments: list[tuple]) -> Index:
    """Make ``segments`` (name, n, total, fields) the index; readers see all of a change or nothing of it."""
    last = max((int(v) for v in children(spark, f"{folder}/versions")), default=0)
    rows = [(k, *s) for k, s in enumerate(segments)]
    spark.createDataFrame(rows, "place int, segment string, n bigint, total bigint, fields array<string>").coalesce(1).write.parquet(f"{folder}/versions/{last + 1:08d}")
    return Index(spark, folder)
