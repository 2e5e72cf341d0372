"""Streams of task events: each number once, the last of each task, catching up after a pause."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noctua.sources.tables import shared_dir

RING = 2000
#: Event numbers of a task that share one state; the states that a task's events without a number are dealt over.
BLOCK, LOOSE = 2048, 16
_STATE = "bits binary, n bigint, top bigint, status_at bigint, status string, step_at bigint, step bigint, tokens bigint, failed boolean, version bigint"
#: What is known of one block of a task after a batch; the greatest ``version`` of a block holds.
DIGEST = f"task_id bigint, block bigint, {_STATE}"


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of a folder of Parquet events, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(events: DataFrame, key: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once; state of keys older than the watermark is dropped. Events without a number (-1) all pass."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def ring_counts(events: DataFrame, most: int = RING) -> DataFrame:
    """(task_id, held, last_seq) after each batch: how many events a task's ring holds, and its last number.

    The state of a task is a few numbers and the last ``most`` event numbers, never the events.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        known = set(held)
        for frame in frames:
            for seq in frame.sort_values("arrival")["seq"].tolist():
                if seq == -1 or seq not in known:
                    held.append(int(seq))
                    known.add(seq)
                    last = max(last, int(seq))
        held = held[-most:]
        state.update((held, last))
        yield pd.DataFrame({"task_id": [key[0]], "held": [len(held)], "last_seq": [last]})

    return events.groupBy("task_id").applyInPandasWithState(update, "task_id bigint, held int, last_seq bigint", "held array<bigint>, last_seq bigint", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now into a Parquet table beside its checkpoint, and read that."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def since(events: DataFrame, task_id: int, seq: int) -> DataFrame:
    """What a client that has seen up to ``seq`` still lacks."""
    return events.where((F.col("task_id") == task_id) & (F.col("seq") > seq)).orderBy("seq")


def windowed_counts(events: DataFrame, at: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each kind per time window (an extension)."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size), "kind").agg(F.count("*").alias("events"))


class BlockState(StatefulProcessor):
    """State of one block of a task's event numbers: which were seen (a bit each), and what the events of numbers seen for
    the first time say."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("block", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        task, block = key
        old = self.state.get() if self.state.exists() else (b"", 0, -1, -1, None, -1, None, 0, False, 0)
        bits, n, top, status_at, status, step_at, step, tokens, failed, version = old
        seen = np.unpackbits(np.frombuffer(bytes(bits), np.uint8)) if bits else np.zeros(BLOCK, np.uint8)
        for frame in rows:
            if block >= 0:
                frame = frame.sort_values("arrival", kind="stable").drop_duplicates("seq")
                place = (frame["seq"] - block * BLOCK).to_numpy()
                frame = frame[seen[place] == 0]
                seen[(frame["seq"] - block * BLOCK).to_numpy()] = 1
                top = max([top, *frame["seq"].tolist()])
            n += len(frame)
            tokens += int(frame["tokens"].fillna(0).sum())
            failed = bool(failed or frame["failed"].fillna(False).astype(bool).any())
            told = frame[frame["status"].notna()].nlargest(1, "seq") if block >= 0 else frame[:0]
            if len(told) and told["seq"].iloc[0] > status_at:
                status_at, status = int(told["seq"].iloc[0]), told["status"].iloc[0]
            told = frame[frame["step"].notna()].nlargest(1, "seq") if block >= 0 else frame[:0]
            if len(told) and told["seq"].iloc[0] > step_at:
                step_at, step = int(told["seq"].iloc[0]), int(told["step"].iloc[0])
        new = (np.packbits(seen).tobytes() if block >= 0 else b"", n, int(top), status_at, status, step_at, step, tokens, failed, version + 1)
        self.state.update(new)
        values = (task, block, *new)
        yield pd.DataFrame({x.split()[0]: pd.Series([v], dtype=object) for x, v in zip(DIGEST.split(", "), values, strict=True)})

    def close(self) -> None:
        pass


def block_states(events: DataFrame) -> DataFrame:
    """Changes of block states from a stream of events (task_id, seq, arrival, status, step, tokens, failed).

    Numbers begin with 1, in any order; of events of one number the first counts, those without a number (-1) all do. A task
    is as many states as it has blocks of ``BLOCK`` numbers, so one busy task spreads over tasks of Spark, and a state is a
    few hundred bytes however long the stream runs. Needs the state store on RocksDB, which ``followed`` sets.
    """
    block = F.when(F.col("seq") >= 0, F.floor(F.col("seq") / BLOCK)).otherwise(-1 - F.pmod("arrival", F.lit(LOOSE)))
    rows = events.where("task_id IS NOT NULL AND seq IS NOT NULL").withColumn("block", block.cast("bigint"))
    return rows.groupBy("task_id", "block").transformWithStateInPandas(BlockState(), DIGEST, "Update", "None")


def followed(states: DataFrame, folder: str) -> DataFrame:
    """Run ``block_states`` over all that is there now, going on from the last time, and read all digests so far. A batch
    that is repeated after a failure overwrites what it wrote."""
    spark, key = states.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/digests/batch={batch}")
        states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(DIGEST).parquet(f"{folder}/digests/batch=*")


def task_states(digests: DataFrame) -> DataFrame:
    """(task_id, status, step, tokens, last_seq, events, n_missing, first_missing, outcome) of each task from its digests.

    Status and step are those of the greatest number that has one; ``first_missing`` is what a client has to ask for first.
    """
    state = F.struct(*(x.split()[0] for x in _STATE.split(", ")))
    now = digests.groupBy("task_id", "block").agg(F.max_by(state, "version").alias("s")).select("task_id", "block", "s.*")
    numbered = F.col("block") >= 0
    known = lambda c: F.max_by(c, F.when(F.col(c + "_at") >= 0, F.col(c + "_at"))).alias(c)
    per = now.groupBy("task_id").agg(
        known("status"), known("step"), F.sum("tokens").alias("tokens"), F.max("top").alias("last_seq"), F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(numbered, F.col("n"))), F.lit(0)).alias("held"), F.when(F.bool_or("failed"), "failed").otherwise("completed").alias("outcome"),
    )
    # the first number of each block that was not seen; where a block is full, the first of the next, if that is not there
    begin = F.col("block") * BLOCK
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BLOCK // 8)), lambda i: F.lpad(F.conv(F.hex(F.substring(F.col("bits"), i, F.lit(1))), 16, 2), 8, "0")), "")
    text = F.when(F.col("block") == 0, F.concat(F.lit("1"), F.substring(text, 2, BLOCK))).otherwise(text)  # there is no number 0
    hole = begin + F.coalesce(F.nullif(F.instr(text, "0"), F.lit(0)) - 1, F.lit(BLOCK))
    begins = now.where(numbered).select("task_id", begin.alias("hole"))
    holes = now.where(numbered).select("task_id", hole.alias("hole")).unionByName(per.select("task_id", F.lit(1).cast("bigint").alias("hole")).join(now.where("block = 0").select("task_id"), "task_id", "left_anti"))
    first = holes.join(begins, ["task_id", "hole"], "left_anti").groupBy("task_id").agg(F.min("hole").alias("first_missing"))
    last = F.greatest("last_seq", F.lit(0))
    return per.join(first, "task_id", "left").select("task_id", "status", "step", "tokens", last.alias("last_seq"), "events", (last - F.col("held")).alias("n_missing"), F.when(F.col("first_missing") <= last, F.col("first_missing")).alias("first_missing"), "outcome")
