"""Session-level helpers of the training-data operators: shared tables, row keys, groups of documents."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text of a group of documents, about, and of the rows that a task holds while it packs them.
GROUP_BYTES, PACKED_BYTES = 1 << 24, 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a local session gets a
    temporary one; a cluster has no folder that all its machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noctua-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "noctua", spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = os.path.join(_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.noctua_path = path
    for held in _scratch:
        held.append(path)
    return out


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, in the end, the tables that were stored meanwhile, but for those given to the function it hands out."""
    kept: list[str] = []
    _scratch.append([])

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.noctua_path)
        return table

    try:
        yield keep
    finally:
        for path in _scratch.pop():
            if path not in kept:
                _delete(spark, path)


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` has written and nothing reads any more."""
    for x in tables:
        if x is not None:
            _delete(x.sparkSession, x.noctua_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored, once the results that read them are written."""
    _delete(spark, _folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_buckets(spark: SparkSession, times: int = 4, n_bytes: int = 0) -> int:
    """Buckets of a hashed exchange: follows the configured shuffle width, and the data where ``n_bytes`` is given."""
    return max(16, times * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // GROUP_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def survey(docs: DataFrame) -> tuple[int, bool]:
    """Bytes of all texts, and whether doc_id tells the rows apart: no null, no repeat. Only ids are shuffled."""
    per = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("size"))
    size, most, no_id = per.agg(F.sum("size"), F.max("n"), F.max(F.col("doc_id").isNull())).first()
    return size or 0, (most or 0) < 2 and not no_id


#: Name of the column that tells rows apart; no table of others has it.
ROW = "noctua_row_key"


def keyed(docs: DataFrame, unique: bool) -> DataFrame:
    """``docs`` with ``ROW``, a number that tells the rows apart and rises with doc_id.

    It is doc_id itself where that is unique. Else rows are numbered in the order of doc_id and of the text's digest,
    those without a doc_id last, and stored, so that a row has the same number wherever it is read.
    """
    if unique:
        return docs.withColumn(ROW, F.col("doc_id").cast("bigint"))
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.col("text").cast("string"), 256).asc_nulls_first()]
    return stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def named(out: DataFrame, rows: DataFrame, unique: bool, *lists: str) -> DataFrame:
    """``out`` of row numbers, as ``doc_id`` and in ``lists``, with the doc_ids of ``rows`` in their place."""
    if unique:
        return out
    names, columns = rows.select(ROW, F.col("doc_id").alias("real_id")), out.columns
    for x in lists:
        one = out.select("doc_id", F.explode(x).alias(ROW)).join(names, ROW).groupBy("doc_id").agg(F.array_sort(F.collect_set("real_id")).alias(x))
        out = out.drop(x).join(one, "doc_id", "left").withColumn(x, F.coalesce(x, F.array().cast("array<bigint>")))
    return out.withColumnRenamed("doc_id", ROW).join(names, ROW).withColumnRenamed("real_id", "doc_id").select(*columns)


def group_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def groups_of(doc_ids: np.ndarray, n: int) -> np.ndarray:
    """The same group numbers, in Python."""
    ids, inverse = np.unique(doc_ids, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % x) % n for x in ids.tolist()], np.int32)[inverse]


def dealt(docs: DataFrame, n: int, key: Column | None = None) -> DataFrame:
    """(g, payload): the rows of ``docs``, with doc_id, packed and compressed by group of doc_id, or of ``key`` where ids may be null.

    Plans that use this more than once share one exchange, and texts take a third of their size in it.
    """
    order = docs.columns

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        g = table.column("g").to_numpy()
        by = np.argsort(g, kind="stable")
        g, table = g[by], table.select(order).take(pa.array(by))
        edge = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        packed, option = [], pa.ipc.IpcWriteOptions(compression="zstd")
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=option) as w:
                w.write_table(table.slice(lo, hi - lo).combine_chunks())
            packed.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(g[edge[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["g", "payload"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > PACKED_BYTES:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return docs.withColumn("g", group_of(F.col("doc_id") if key is None else key, n)).mapInArrow(pack, "g int, payload binary")


def unpacked(table: pa.Table) -> pa.RecordBatch | None:
    """All rows of a group, in order of doc_id, those without one last; None for no row."""
    held = [b for x in table.column("payload") for b in pa.ipc.open_stream(x.as_buffer())]
    if not held:
        return None
    rows = pa.Table.from_batches(held)
    ids = rows.column("doc_id")
    order = np.argsort(ids.to_numpy(), kind="stable") if not ids.null_count else np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
    return rows.take(pa.array(order)).combine_chunks().to_batches()[0]


def with_text(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``keys`` (doc_id, ...) with the text of ``docs`` (doc_id, text), whose doc_ids are unique: an inner join in
    which texts travel packed, alike at every size."""
    schema = T.StructType([*keys.schema.fields, T.StructField("text", T.StringType())])

    def join(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return to_arrow_schema(schema).empty_table()
        rows, ids = unpacked(own), told.column("doc_id").to_numpy()
        at = np.searchsorted(rows.column("doc_id").to_numpy(), ids)
        text = rows.column("text").take(pa.array(at))
        return pa.Table.from_arrays([*told.drop_columns(["g"]).columns, pa.chunked_array([text])], names=schema.names)

    told = keys.withColumn("g", group_of(F.col("doc_id"), n))
    return dealt(docs, n).groupBy("g").cogroup(told.groupBy("g")).applyInArrow(join, schema)


def without(rows: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """``rows`` (with ``ROW``) but those whose keys are in ``gone`` (doc_id), in the same way; ``ROW`` goes too."""
    names = [x for x in rows.columns if x != ROW]
    schema = T.StructType([x for x in rows.schema.fields if x.name != ROW])
    hidden = rows.select(F.col(ROW).alias("doc_id"), *(F.col(x).alias(f"c{k}") for k, x in enumerate(names)))

    def drop(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return to_arrow_schema(schema).empty_table()
        held = unpacked(own)
        held = held.filter(pa.array(~np.isin(held.column("doc_id").to_numpy(), told.column("doc_id").to_numpy())))
        return pa.Table.from_arrays(held.columns[1:], names=names)

    told = gone.select("doc_id", group_of(F.col("doc_id"), n).alias("g"))
    return dealt(hidden, n).groupBy("g").cogroup(told.groupBy("g")).applyInArrow(drop, schema)
