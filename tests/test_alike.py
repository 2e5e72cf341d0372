"""Pairs of sets that are alike: all of them, by steps whose shuffles do not grow with the pairs' words."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from noctua.operators import alike, documents


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_words_do_not_travel_for_each_pair_of_a_large_group(spark):
    draw = random.Random(8)
    base = [f"word{i}x{draw.randrange(10**9)}" for i in range(150)]
    rows = [(i, " ".join([*draw.sample(base, 146), *(f"own{i}x{j}" for j in range(3))])) for i in range(400)]
    before, size = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that no task can hold
    try:
        _, found = documents.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert found.count() == 400 * 399 // 2
        assert shuffled(spark) - before < 6e6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


@pytest.mark.parametrize("theta, part", [(0.4, 4096), (0.6, 4), (0.72, 4), (0.72, 4096), (0.9, 4)])
def test_all_pairs_of_sets_of_frequent_words(spark, theta, part):
    """Few words, all frequent, so that neighbours are keys; rare ones; sets of two to nine words, long ones, and keys that are cut into cells."""
    draw, sets = random.Random(11), []
    for group in range(24):
        size = draw.choice((2, 3, 4, 5, 7, 9, 40, 330))
        base = draw.sample(range(60), size) if size < 60 else draw.sample(range(900), size)
        for _ in range(9):
            own = {f"word{x}" for x in base}
            for _ in range(draw.randrange(1 + max(2, size // 4))):
                own.discard(draw.choice(sorted(own)))
                own.add(draw.choice((f"word{draw.randrange(60)}", f"rare{draw.randrange(40)}", f"only{draw.randrange(10**9)}")))
            sets.append(frozenset(own))
    sets = sorted(set(sets), key=sorted)
    draw.shuffle(sets)
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) / len(a | b) >= theta}
    classes, found = documents.near_duplicates(spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id bigint, text string"), theta, part)
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    assert all(r.doc_id == r.class_id for r in classes.collect())


def test_sets_too_small_for_neighbours():
    # 0.72: 3 of 4 words in common are neighbours twice, and one word that differs parts them once
    assert alike.small(0.72) == 0 and alike.small(0.5) == alike.small(0.4) == float("inf") and alike.small(0.6) > 0


def test_packed_words_and_postings_come_back():
    x = np.array([3, -1, 2**62, -(2**40), 7], np.int64)
    lists = pa.ListArray.from_arrays(pa.array([0, 2, 2, 5], pa.int32()), pa.array(x))
    n, got = alike.words_of(alike.packed_words(lists).slice(1))
    assert n.tolist() == [0, 3] and (got == x[2:] >> 16 << 16).all()
    columns = [np.array([5, 2**40 - 1]), np.array([0, 9]), np.array([-7, 2**62]), np.array([1, 2**31]), np.array([3, 4]), np.array([0, 1]), np.array([2, 0])]
    back = alike._columns([alike._table(columns).T.tobytes()])
    assert all((a == b).all() for a, b in zip(back, columns))
