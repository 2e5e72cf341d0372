"""What each filter of a chain removes, in every order of the chain: a Walsh-Hadamard audit.

A document fails some of five filters: a mask of five bits. For each part and label the 32 signed parity sums of the masks
(the sum of +1 or -1 by the parity of the mask's bits inside a pattern) are plain sums, added up where rows are read. The
transform is its own inverse but for a factor, so the counts of all 32 masks come back exactly, and every order and every
Shapley value is arithmetic on 32 numbers a part.

Filters, with the condition under which a text fails (null counts as empty; words are maximal runs of no ASCII space):
A: under 100 words; B: fewer than 80 distinct words in a hundred; C: over 10 of a hundred code points in A-Z; D: a character
of ``#$%&*|``; E: the same text as any row of smaller doc_id, table-wide, whether that row is removed or not.

Rows that share a doc_id are documents of their own, with the labels of that id; none is a smaller one than the other, so equal
texts of the least id all pass E. Rows without a doc_id have no smaller one and are smaller than none: they pass E, and have
no label. Of several labels of a doc_id the greatest counts; null labels count as 0. A null part is the empty string. An
empty table has no part and gives no row. Texts are read once; what is shuffled is an id, a digest, a part and a mask a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

FILTERS = "ABCDE"
#: Limits of the filters: words, percent of distinct words, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
CELLS = 1 << len(FILTERS)
ORDERS = tuple("".join(x) for x in itertools.permutations(FILTERS))
#: The bit of E, the only filter that looks beyond a row.
_SEEN = 1 << FILTERS.index("E")


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, mask of the filters A to D that the text fails; one row per row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask with E, good, toxic and n, the number of equal rows, of ``rows`` as ``failures`` gives them."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.where("doc_id IS NOT NULL")
    # equal rows are one before anything is joined, and least ids are found map-side: no key is hot in a shuffle
    equal = named.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    joined = equal.join(known, "doc_id", "left").join(first, ["doc_id", "digest"], "left")
    no, mask = F.lit(False), F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(_SEEN)))
    nameless = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n"))
    return joined.select("part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n").union(
        nameless.select("part", "mask", no.alias("good"), no.alias("toxic"), "n")
    )


def parity_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` and ``sums``: for each pattern of bits the sum of n, signed by the parity of the mask's bits in the pattern."""
    sign = lambda t: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(t))) % 2)
    return rows.groupBy(*by).agg(F.array(*(F.sum(F.col("n") * sign(t)) for t in range(CELLS))).alias("sums"))


def inverted(sums: str = "sums") -> Column:
    """The number of rows of each mask, from the signed parity sums."""
    return F.expr(f"transform(sequence(0, {CELLS - 1}), m -> aggregate(sequence(0, {CELLS - 1}), 0L, (a, t) -> a + IF(bit_count(m & t) % 2 = 0, {sums}[t], -{sums}[t])) div {CELLS})")


def _over(cells: str, condition: str) -> Column:
    """The sum of the cells whose mask ``m`` holds ``condition``."""
    return F.expr(f"aggregate(sequence(0, {CELLS - 1}), 0L, (a, m) -> a + IF({condition}, {cells}[m], 0L))")


def orders_of(sums: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the parity sums per part, good and toxic (at most four rows a part)."""
    cells = sums.select("part", "good", "toxic", F.posexplode(inverted()).alias("mask", "n"))
    only = lambda x: F.sum(F.when(F.col(x), F.col("n")).otherwise(0))
    each = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good").alias("good"), only("toxic").alias("toxic"))
    row = F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic")))  # 32 entries
    arrays = each.groupBy("part").agg(row.alias("c")).select("part", F.col("c.n").alias("n"), F.col("c.good").alias("good"), F.col("c.toxic").alias("toxic"))
    steps = arrays.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - ascii('A'))")
    before = F.expr(f"aggregate(sequence(0, {len(FILTERS) - 1}), 0, (a, i) -> a + IF(instr(substr(filter_order, 1, step - 1), char(ascii('A') + i)) > 0, shiftleft(1, i), 0))")
    out = steps.withColumn("bit", bit).withColumn("before", before)
    here = "m & bit != 0 AND m & before = 0"
    figures = {
        "kept": _over("n", "m & (before | bit) = 0"),
        "removed": _over("n", here),
        "redundant": _over("n", "m & bit != 0 AND m & before != 0"),
        "unique_fails": _over("n", "m = bit"),
        "good_lost": _over("good", here),
        "toxic_lost": _over("toxic", here),
        # of the 120 orders, a document with k failures meets this filter first among them in 120 / k
        "shapley": F.expr(f"aggregate(sequence(0, {CELLS - 1}), 0L, (a, m) -> a + IF(m & bit != 0, n[m] * ({len(ORDERS)} div bit_count(m)), 0L))"),
    }
    return out.select("part", "filter_order", "step", *(x.alias(k) for k, x in figures.items()))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of ``docs`` (doc_id, text and the part's column) with ``labels`` (doc_id, quality, toxic)."""
    rows = stored(failures(docs, part), "failures")
    return orders_of(parity_sums(labelled(rows, labels), ["part", "good", "toxic"]))
