"""The tamper-evident audit log: row hashes, appending, verification."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from noctua.sources import tables

_TAIL = "id bigint, hash string, n bigint"
GENESIS = "0" * 64
#: Rows that one task chains at most, about.
SPAN = 500_000


def payload() -> Column:
    """What a row's hash covers besides its predecessor's hash; nulls are empty or 0, and nothing stands between the parts."""
    cost = F.coalesce("cost_usd", F.lit(0.0))
    shown = F.when(cost == F.floor(cost), F.floor(cost).cast("string")).otherwise(cost.cast("string"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(*(part(c) for c in ("run_id", "task_id", "ts", "kind", "summary", "detail")), F.coalesce("tokens", F.lit(0)).cast("string"), shown)


def row_hash(prev: Column) -> Column:
    """Hash of a row and its predecessor's hash."""
    return F.sha2(F.concat(prev, payload()), 256)


def _folded(rows: DataFrame, last_hash: str) -> DataFrame:
    """``rows`` with prev_hash and hash, chained in order of id by one task, which holds all of them."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = last_hash
        for batch in batches:
            links = [last]
            for x in batch.column(batch.num_columns - 1).to_pylist():
                last = hashlib.sha256((last + x).encode()).hexdigest()
                links.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(links[:-1], pa.string()), pa.array(links[1:], pa.string())], names=[*batch.schema.names[:-1], "prev_hash", "hash"])

    return rows.withColumn("hashed", payload()).repartition(1).sortWithinPartitions("id").mapInArrow(run, f"{kinds}, prev_hash string, hash string")


def write_appended(rows: DataFrame, path: str, last_hash: str = GENESIS, span: int = SPAN) -> None:
    """Write ``rows`` with prev_hash and hash, chained in order of id, to ``path``.

    A chain is a sequence, so its links are made one after another. But no task holds more than about ``span`` rows: they are
    dealt to ranges of id, and each range is folded by a job of its own that begins with the last hash of the range before.
    """
    spark, ranges = rows.sparkSession, f"{tables.kept_dir(rows.sparkSession)}/ranges-{uuid.uuid4().hex}"
    n = -(-rows.count() // span)
    if n <= 1:
        return _folded(rows, last_hash).write.mode("overwrite").parquet(path)
    rows.repartitionByRange(n, "id").withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(ranges)
    tables.deleted(spark, path)
    try:
        for k in sorted(int(x.partition("=")[2]) for x in tables.children(spark, ranges) if x.startswith("_range=")):
            _folded(spark.read.schema(rows.schema).parquet(f"{ranges}/_range={k}"), last_hash).write.parquet(f"{path}/range={k}")
            last_hash = spark.read.parquet(f"{path}/range={k}").agg(F.max_by("hash", F.struct("id", "prev_hash"))).first()[0]
    finally:
        tables.deleted(spark, ranges)


def read_appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_appended`` wrote of rows of ``schema``."""
    full = StructType([*schema.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())])
    return spark.read.schema(full).option("recursiveFileLookup", "true").parquet(path)


def appended(rows: DataFrame, last_hash: str = GENESIS, span: int = SPAN) -> DataFrame:
    """``rows`` with prev_hash and hash, chained in order of id and stored once, so that what reads them does not chain anew."""
    path = f"{tables.kept_dir(rows.sparkSession)}/appended-{uuid.uuid4().hex}"
    write_appended(rows, path, last_hash, span)
    return read_appended(rows.sparkSession, path, rows.schema)


class Log:
    """An audit log in a folder that grows by batches: ``rows/batch=N`` and, once those are whole, ``tail/N`` with the
    last id and hash and the number of rows so far.

    A batch that was taken in already, as a stream repeats it after a failure, appends nothing. A batch of which the rows
    were written but not the tail is written anew over them. Readers see batches that have a tail, so never half a batch.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def tail(self) -> tuple[int, int, str, int]:
        """(last batch, last id, last hash, rows); of an empty log (-1, -1, GENESIS, 0)."""
        done = [int(x) for x in tables.children(self.spark, f"{self.folder}/tail") if x.isdigit() and tables.exists(self.spark, f"{self.folder}/tail/{x}/_SUCCESS")]
        if not done:
            return -1, -1, GENESIS, 0
        last = max(done)
        r = self.spark.read.schema(_TAIL).parquet(f"{self.folder}/tail/{last}").first()
        return last, r.id, r.hash, r.n

    def append(self, rows: DataFrame, batch: int) -> int:
        """Take in ``rows`` (id and the columns of an audit row) as batch number ``batch``; how many came. Ids must go on
        from the last one: a row at or below it would break the order of the chain, so it is an error."""
        last, last_id, last_hash, n = self.tail()
        if batch <= last:
            return 0
        path = f"{self.folder}/rows/batch={batch}"
        write_appended(rows, path, last_hash)
        written = read_appended(self.spark, path, rows.schema)
        new = written.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("id"), F.max_by("hash", F.struct("id", "prev_hash")).alias("hash")).first()
        if new.n and new.least <= last_id:
            raise ValueError(f"batch {batch} begins at id {new.least}, the log ends at {last_id}")
        row = [(new.id, new.hash, n + new.n)] if new.n else [(last_id, last_hash, n)]
        self.spark.createDataFrame(row, _TAIL).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/tail/{batch}")
        return new.n

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Append what a stream of audit rows has now, batch by batch, and go on from there next time."""
        run = stream.writeStream.foreachBatch(lambda rows, batch: self.append(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()

    def read(self, schema: StructType) -> DataFrame:
        """All rows of whole batches; ``schema`` is that of the rows taken in."""
        last = self.tail()[0]
        full = StructType([*schema.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())])
        if last < 0:
            return self.spark.createDataFrame([], full)
        done = [x for x in tables.children(self.spark, f"{self.folder}/rows") if int(x.partition("=")[2]) <= last]
        return self.spark.read.schema(full).option("recursiveFileLookup", "true").parquet(*(f"{self.folder}/rows/{x}" for x in done))


def verified(log: DataFrame, span: int = 100_000) -> DataFrame:
    """One row (ok, checked_rows, broken_at): the first row whose link or hash does not hold, and the rows up to it.

    Each row's hash is recomputed where it is. Links need the predecessor alone: rows are dealt by ranges of ``span`` ids,
    and only the last hash of each range crosses over, so no task sees the whole log. A null hash or link holds nowhere,
    and of rows that share an id one at most can hold.
    """
    # hash and link of a row as they are, and whether there is one before: a null hash before is not the begin of the log
    seen = F.struct(F.col("hash").alias("hash"))
    ranged = log.withColumn("part", F.floor(F.col("id") / span))
    ends = ranged.groupBy("part").agg(F.max_by(seen, F.struct("id", "prev_hash", "hash")).alias("end"))
    # the range before the next one of any rows: the log's ranges, not its rows, are in order in one window for each
    # block of ranges, and the blocks' ends cross over likewise
    block = F.floor(F.col("part") / span)
    ends = ends.withColumn("block", block)
    tops = ends.groupBy("block").agg(F.max_by("end", "part").alias("top"))
    tops = tops.select("block", F.lag("top").over(Window.orderBy("block")).alias("below"))
    before = ends.join(tops, "block").select("part", F.coalesce(F.lag("end").over(Window.partitionBy("block").orderBy("part")), "below").alias("carried"))
    w = Window.partitionBy("part").orderBy("id", "prev_hash", "hash")
    linked = ranged.withColumn("inner", F.lag(seen).over(w)).join(before, "part").withColumn("link", F.coalesce("inner", "carried"))
    expected = F.when(F.col("link").isNull(), F.lit(GENESIS)).otherwise(F.col("link.hash"))
    holds = F.col("prev_hash").isNotNull() & F.col("hash").isNotNull() & F.col("prev_hash").eqNullSafe(expected) & F.col("hash").eqNullSafe(row_hash(F.coalesce("prev_hash", F.lit(""))))
    bad = linked.where(~holds).agg(F.min("id").alias("broken_at"))
    return log.crossJoin(F.broadcast(bad)).agg(F.first("broken_at").isNull().alias("ok"), F.count_if(F.col("broken_at").isNull() | (F.col("id") <= F.col("broken_at"))).alias("checked_rows"), F.first("broken_at").alias("broken_at"))
