import random

import pytest

from noctua.operators import audit
from noctua.streaming import events as stream

AUDIT = "id bigint, run_id string, task_id string, ts string, kind string, summary string, detail string, tokens bigint, cost_usd double"
EVENT = "task_id bigint, seq bigint, arrival bigint, status string, step bigint, tokens bigint, failed boolean"


def rows(spark, ids):
    return spark.createDataFrame([(i, "r", None if i % 3 else "7", "2026-07-01", "output", f"s{i}", None, i % 4 or None, (0.5, 2.0, None)[i % 3]) for i in ids], AUDIT)


def test_a_log_grows_by_batches_and_repeated_ones_append_nothing(spark, tmp_path):
    log = audit.Log(spark, f"file://{tmp_path}/log")
    empty = rows(spark, []).schema
    assert log.tail() == (-1, -1, audit.GENESIS, 0) and log.read(empty).count() == 0
    assert log.append(rows(spark, range(1, 40)), 0) == 39 and log.append(rows(spark, []), 1) == 0
    assert log.append(rows(spark, range(1, 40)), 0) == 0 and log.append(rows(spark, range(40, 61)), 2) == 21
    # rows of a batch whose tail was never written are not read, and the batch is written anew
    rows(spark, range(900, 950)).withColumn("prev_hash", audit.F.lit("x")).withColumn("hash", audit.F.lit("x")).write.parquet(f"file://{tmp_path}/log/rows/batch=3")
    assert log.read(empty).count() == 60 and log.tail()[0] == 2
    assert log.append(rows(spark, range(61, 71)), 3) == 10 and log.tail()[:2] == (3, 70) and log.tail()[3] == 70
    got, whole = log.read(empty), audit.appended(rows(spark, range(1, 71)))
    assert sorted(tuple(r) for r in got.select("id", "prev_hash", "hash").collect()) == sorted(tuple(r) for r in whole.select("id", "prev_hash", "hash").collect())
    assert tuple(audit.verified(got, span=16).first()) == (True, 70, None)
    with pytest.raises(ValueError, match="begins at id 70"):
        log.append(rows(spark, [70, 71]), 4)
    assert log.tail()[0] == 3


def test_task_states_of_a_stream_equal_a_plain_count(spark, tmp_path):
    """Numbers out of order, repeated with other contents, late, lost, over several blocks; a block of which nothing came."""
    rng, came = random.Random(8), []
    for task, numbers in ((1, range(1, 5001)), (2, range(1, 30)), (3, range(4200, 4300)), (4, [1, 2, 3]), (5, []), (6, range(1, 2048))):
        lost = {rng.choice(list(numbers)) for _ in range(5)} if len(numbers) > 20 and task != 6 else set()
        came += [(task, s, "running" if s % 3 == 0 else None, s % 7 if s % 2 == 0 else None, s % 100 if s % 5 == 0 else None, task == 2 and s == 20) for s in numbers if s not in lost]
    first = [x for x in came if x[1] % 11]
    late = [x for x in came if x[1] % 11 == 0] + [(t, s, "repeated", 99, 10_000, True) for t, s, *_ in first if s % 17 == 0]
    loose = [(4, -1, None, None, 5, None)] * 3 + [(5, -1, None, None, 1, True)]
    waves = [first + loose, late + [(None, 4, None, None, 1, None)]]
    n = 0
    for wave in waves:
        rng.shuffle(wave)
        spark.createDataFrame([(t, s, (n := n + 1), *rest) for t, s, *rest in wave], EVENT).repartition(3).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/in")
        digests = stream.followed(stream.block_states(source), f"file://{tmp_path}/s")
    want = {}
    for task in range(1, 7):
        own = sorted(x[1:] for x in came if x[0] == task)
        more = [x for x in loose if x[0] == task]
        seqs, last = {x[0] for x in own}, max([x[0] for x in own], default=0)
        missing = [s for s in range(1, last + 1) if s not in seqs]
        held = [x for x in own if x[1]]
        steps = [x for x in own if x[2] is not None]
        want[task] = (held[-1][1] if held else None, steps[-1][2] if steps else None, sum(x[3] or 0 for x in own) + sum(x[4] for x in more), last, len(own) + len(more), len(missing), missing[0] if missing else None, "failed" if any(x[4] for x in own) or any(x[5] for x in more) else "completed")
    assert {r[0]: tuple(r[1:]) for r in stream.task_states(digests).collect()} == want
    assert want[3][6] == 1 and want[3][5] >= 4199 and want[5][3:6] == (0, 1, 0) and want[6][5:7] == (0, None)
    sizes = [len(r.bits) for r in digests.collect()]
    assert max(sizes) == stream.BLOCK // 8 and digests.where("task_id = 1").select("block").distinct().count() == 3
    assert stream.task_states(digests.limit(0)).count() == 0
