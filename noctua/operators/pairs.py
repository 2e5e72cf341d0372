"""Pairs of rows that hold the same term, however many hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A term's list is cut into parts of about so many rows; each pair of parts is a cell of its own.
PART = 4096


def met(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, also: Column | None = None, part: int = PART) -> DataFrame:
    """The rows of ``left`` and ``right`` that agree in ``on`` (other columns differ in name), where ``also`` holds.

    A term that more than ``part`` rows of a side hold has that side's rows dealt to parts by the hash of their id; a row goes
    to the cells of its own part with every part of the other side. So no cell has much more than ``part`` rows of each
    side, and each pair of rows meets in one cell. Terms below that are one cell, and their rows go nowhere else.
    """

    def hot(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.ceil(F.count("*") / part).cast("int").alias(name)).where(F.col(name) > 1)

    grid = hot(left, "cell_rows").join(hot(right, "cell_columns"), on, "full").na.fill(1, ["cell_rows", "cell_columns"])

    def dealt(rows: DataFrame, ident: str, own: str, other: str) -> DataFrame:
        n = F.coalesce(own, F.lit(1))
        rows = rows.join(grid, on, "left").withColumn(own, F.pmod(F.xxhash64(ident), n).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    cells = dealt(left, left_id, "cell_rows", "cell_columns").join(dealt(right, right_id, "cell_columns", "cell_rows"), [*on, "cell_rows", "cell_columns"])
    return cells if also is None else cells.where(also)


def prefixed(each: DataFrame, ident: str, on: list[str], freq: DataFrame, theta: float) -> DataFrame:
    """Of rows (ident, on, n: the size of the set) the ``n - ceil(theta n) + 1`` rarest terms of each set, with their place ``k``.

    Two sets of Jaccard similarity ``theta`` or more share one of them. Terms that ``freq`` (on, df) has not come first.
    """
    placed = each.join(freq, on, "left").withColumn("k", F.row_number().over(Window.partitionBy(ident).orderBy(F.coalesce("df", F.lit(0)), *on)))
    return placed.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * theta - 1e-9) + 1)


def may_reach(na: Column, ka: Column, nb: Column, kb: Column, theta: float) -> Column:
    """Whether sets that share the terms at these places, in one order of terms, may have a similarity of ``theta``."""
    return 1 + F.least(na - ka, nb - kb) >= F.lit(theta / (1 + theta)) * (na + nb) - 1e-6
