"""Connected components of a link table, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, stored

#: Tasks that share the rows of one label.
SALTS = 8


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) → (id, component): the smallest id that can be reached, for each id with a link.

    Labels fall to the least label among neighbours, then jump to their label's label, which shortens chains by half
    in each round. Every round is a table in the shared folder, so lineage stays short and lost executors cost one
    round. Loops and repeated links do no harm; an empty table gives an empty result.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    state = None
    for _ in range(most_rounds):
        now = label.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if now == state or not now[1]:
            dropped(both)
            return label
        state = now
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        fell = label.join(near, "id").select("id", F.least("component", "near").alias("component"))
        # labels that have a lower one themselves; a label that most rows bear is met in SALTS tasks
        moves = fell.select(F.col("component").alias("at")).distinct().join(fell, F.col("at") == F.col("id")).where("component < at")
        moves = moves.select("at", F.col("component").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = fell.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        before = label
        jumped = salted.join(moves, (salted.component == moves["at"]) & (salted.salt == moves["salt"]), "left")
        label = stored(jumped.select("id", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        dropped(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
