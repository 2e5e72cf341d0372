"""How far the sources of each language differ in their words: smoothed shares, and sums of their differences, heavy and light.

A term's share in a group (lang, source) is an integer, ``1 + (SCALE * (count + SMOOTH)) div (N + SMOOTH * V)``, over the V
terms that the language keeps (in at least ``least_docs`` of its documents). Two sources differ by the sum over all kept terms
of the absolute difference of their shares; a term of a source stands out by its share's excess over that of the language.

A source's share of all terms that it lacks is one number, z. So the distance of two sources is V * |z - z'| and, for each
term, a correction. Terms that a good part of the sources has (heavy) are laid out as dense tiles of sources by terms, and
numpy adds up differences of whole rows. Rare (light) terms are posting lists: every posting is corrected against the z of all
others by one search in sorted shares and prefix sums, and only those few sources that share a rare term are corrected
pairwise. Both are partial sums of integers over tasks (language, block of sources, block of sources, bucket of terms), so
their sum is exact and no task grows with a hot source, term or language.

A null text, lang or source counts as empty; rows that share a doc_id, equal rows and rows without one are documents of their
own. A group whose documents have no kept term, and a language that keeps none (V = 0, all values 0), still give their pairs. A
language with one source has no pair. An empty table gives no row. Very long texts are counted like others, in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from . import _text as t
from ._shared import stored

SCALE, SMOOTH = 1_000_000_000, 5
LEAST_DOCS, MOST_RANKS = 30, 50
#: Text that is counted at once; sources of one side of a tile; least postings of a bucket, about; terms of a slab of a dense tile.
SLICE_BYTES, BLOCK, POSTINGS, SLAB = 1 << 24, 256, 1 << 14, 512
#: A term is heavy where its sources squared are at least this many times all sources of the language.
HEAVY = 2

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of the term in the group's texts, and texts that have it, summed over slices only."""
    group = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, "text", SLICE_BYTES):
            lang, source = (part.column(k).dictionary_encode().indices.to_numpy().astype(np.int64) for k in (0, 1))
            _, of, code = np.unique(lang << 32 | source, return_index=True, return_inverse=True)  # of: a row of each group
            data = t.lower(data)
            h, s, e, first = t.words(data, at, _LETTER)
            row = t.row_of(first)
            key = t.mix(h + t.mix(code.astype(np.uint64) + np.uint64(1))[row])
            order = np.argsort(key, kind="stable")  # within a key rows rise
            key, row = key[order], row[order]
            edge = t.edges(key)
            new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
            if not len(key):
                continue
            lo = order[edge[:-1]]
            size = e[lo] - s[lo]
            off = np.concatenate(([0], np.cumsum(size)))
            letters = data[np.repeat(s[lo] - off[:-1], size) + np.arange(int(off[-1]))]
            term = pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())]).cast(pa.string())
            mine = pa.array(of[code[row[edge[:-1]]]])
            texts = np.add.reduceat(new.astype(np.int64), edge[:-1])
            yield pa.RecordBatch.from_arrays([part.column(0).take(mine), part.column(1).take(mine), term, pa.array(np.diff(edge)), pa.array(texts)], names=["lang", "source", "term", "n", "docs"])

    rows = docs.select(*group, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n of each group's kept terms; lang_n, of the language; k, sources that have it; first, true once a term."""
    # one exchange by term serves the sums of a group's slices, the language's figures and the choice of terms
    merged = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    told = merged.select("lang", "source", "term", "n", F.sum("docs").over(of).alias("lang_docs"), F.sum("n").over(of).alias("lang_n"), F.count("*").over(of).alias("k"), (F.min("source").over(of) == F.col("source")).alias("first"))
    return told.where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def share(count: Column, total: Column, v: Column) -> Column:
    """The smoothed share, exactly: products may pass 64 bits."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTH), wide(total + SMOOTH * v))


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Every occurring group with its number among its language's, N and z; and of the language V, N, sources and postings."""
    total = counts.groupBy("lang").agg(F.sum(F.col("first").cast("bigint")).alias("v"), F.sum(F.when(F.col("first"), F.col("lang_n"))).alias("lang_total"), F.count("*").alias("postings"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    empty = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    there = docs.select(empty("lang"), empty("source")).distinct()
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    groups = there.join(own, ["lang", "source"], "left").join(total, "lang", "left").select("lang", "source", zero("total"), zero("v"), zero("lang_total"), zero("postings"))
    # a group's number follows from the count of its language's sources before it: small rows, one per group
    numbered = groups.withColumn("no", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))
    sized = numbered.withColumn("n_sources", F.count("*").over(Window.partitionBy("lang")).cast("int"))
    # a language without kept terms has no share at all
    z = F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).otherwise(F.lit(0)).cast("bigint")
    return sized.withColumn("z", z)


def _blocks_of(no: Column, n_sources: Column) -> Column:
    """The tiles (a, b), a <= b, of blocks of sources that a source takes part in."""
    mine, last = (no / BLOCK).cast("int"), ((n_sources - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, mine).alias("a"), F.greatest(x, mine).alias("b")))


def light_sums(left: tuple, right: tuple, zl: np.ndarray, zr: np.ndarray) -> np.ndarray:
    """Corrections of light postings (source, term, share) of two blocks: every posting against all z, and pairs that share a term."""
    out = np.zeros((len(zl), len(zr)), np.int64)
    for (source, _, p), own, other, flip in ((left, zl, zr, False), (right, zr, zl, True)):
        order = np.lexsort((p, source))
        source, p = source[order], p[order]
        edge = np.searchsorted(source, np.arange(len(own) + 1))
        for i in np.flatnonzero(np.diff(edge)).tolist():
            x = p[edge[i] : edge[i + 1]]
            up = np.concatenate(([0], np.cumsum(x)))
            at = np.searchsorted(x, other, "right")  # shares up to z, and those beyond
            sums = at * other - up[at] + (up[-1] - up[at]) - (len(x) - at) * other - len(x) * np.abs(own[i] - other)
            out_i = out[:, i] if flip else out[i]
            out_i += sums
    # sources that share a term: posting by posting of the left with the run of the right's
    (sl, tl, pl), (sr, tr, pr) = left, right
    order = np.argsort(tr, kind="stable")
    sr, tr, pr = sr[order], tr[order], pr[order]
    lo, hi = np.searchsorted(tr, tl, "left"), np.searchsorted(tr, tl, "right")
    flat = out.reshape(-1)
    for k in range(int((hi - lo).max()) if len(lo) else 0):  # the k-th partner of each, all at once
        here = np.flatnonzero(hi - lo > k)
        j = lo[here] + k
        a, b, p, q = sl[here], sr[j], pl[here], pr[j]
        np.add.at(flat, a * len(zr) + b, np.abs(p - q) - np.abs(p - zr[b]) - np.abs(zl[a] - q) + np.abs(zl[a] - zr[b]))
    return out


def dense_sums(left: tuple, right: tuple, zl: np.ndarray, zr: np.ndarray) -> np.ndarray:
    """Corrections of heavy terms of two blocks: tiles of sources by terms, filled with z where a source lacks the term."""
    out = np.zeros((len(zl), len(zr)), np.int64)
    terms = np.unique(np.concatenate((left[1], right[1])))
    for lo in range(0, len(terms), SLAB):
        slab, tile = terms[lo : lo + SLAB], []
        for (source, term, p), z in ((left, zl), (right, zr)):
            here = (term >= slab[0]) & (term <= slab[-1])
            x = np.repeat(z[:, None], len(slab), axis=1)
            x[source[here], np.searchsorted(slab, term[here])] = p[here]
            tile.append(x)
        for i, x in enumerate(tile[0]):
            out[i] += np.abs(tile[1] - x).sum(axis=1)
    return out - len(terms) * np.abs(zl[:, None] - zr)


_SUMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("d", T.LongType())])


def _tiles(block: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The function that adds up one tile: lang, i, j, d of each pair i < j of its sources, what its postings add to V * |z - z'|."""

    def tile(key: tuple, postings: pa.Table, sources: pa.Table) -> pa.Table:
        lang, a, b = (x.as_py() for x in key[:3])
        if not postings.num_rows or not sources.num_rows:
            return to_arrow_schema(_SUMS).empty_table()
        no, z = sources.column("no").to_numpy(), sources.column("z").to_numpy()
        order = np.argsort(no)
        no, z = no[order], z[order]
        # a tile of one block with itself takes all its sources on both sides
        mine, theirs = np.flatnonzero(no // block == a), np.flatnonzero(no // block == b)
        term = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        source, p, heavy = (postings.column(x).to_numpy() for x in ("no", "p", "heavy"))
        total = np.zeros((len(mine), len(theirs)), np.int64)
        for kind, add in ((heavy, dense_sums), (~heavy, light_sums)):
            sides = []
            for side, who in ((a, mine), (b, theirs)):
                here = kind & (source // block == side)
                sides.append((np.searchsorted(no[who], source[here]), term[here], p[here]))
            total += add(*sides, z[mine], z[theirs])
        i, j = np.meshgrid(no[mine], no[theirs], indexing="ij")
        up = i < j
        return pa.table({"lang": pa.array([lang] * int(up.sum()), pa.string()), "i": pa.array(i[up], pa.int32()), "j": pa.array(j[up], pa.int32()), "d": pa.array(total[up], pa.int64())})

    return tile


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, i, j (numbers of sources, i < j), d: what terms add to V * |z - z'|, summed over the tiles."""
    # a bucket gives a sum for each pair of sources, and has as many postings at least
    least = F.greatest(F.lit(POSTINGS), (F.col("n_sources").cast("bigint") * F.col("n_sources") / 2).cast("bigint"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("postings") / least)).cast("int")
    k = F.col("k")
    mine = groups.select("lang", "source", "no", "z", "total", "v", "n_sources", n_buckets.alias("buckets"))
    p = share(F.col("n"), F.col("total"), F.col("v")).cast("bigint").alias("p")
    at = counts.join(mine, ["lang", "source"]).select("lang", "no", "term", p, (k * k >= HEAVY * F.col("n_sources")).alias("heavy"), F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), F.explode(_blocks_of(F.col("no"), F.col("n_sources"))).alias("t"))
    who = mine.select("lang", "no", "z", "buckets", F.explode(_blocks_of(F.col("no"), F.col("n_sources"))).alias("t")).select("*", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    key = ["lang", F.col("t.a").alias("a"), F.col("t.b").alias("b"), "bucket"]
    at = at.select(*key, "no", "term", "p", "heavy")
    who = who.select(F.col("lang").alias("lang"), *key[1:3], F.col("bucket").alias("bucket"), F.col("no").alias("no"), F.col("z").alias("z"))
    by = ["lang", "a", "b", "bucket"]
    parts = at.groupBy(*by).cogroup(who.groupBy(*by)).applyInArrow(_tiles(BLOCK), _SUMS)
    return parts.groupBy("lang", "i", "j").agg(F.sum("d").alias("d"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_ranks: int = MOST_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: each other source of the language by distance, all of them. Part
    ``term``: the ``most_ranks`` terms whose share is most above the language's. Ties go by the item's UTF-8 bytes."""
    counts = stored(kept_counts(docs, least_docs), "counts")
    groups = stored(groups_of(docs, counts), "groups")
    one = groups.select("lang", "source", "no", "z", "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("no2"), F.col("z").alias("z2"))
    pairs = one.join(two, "lang").where("no <> no2").select("lang", "source", "item", F.least("no", "no2").alias("i"), F.greatest("no", "no2").alias("j"), (F.col("v") * F.abs(F.col("z") - F.col("z2"))).alias("base"))
    far = pairs.join(pair_sums(counts, groups), ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("d", F.lit(0))).cast("bigint").alias("value"))
    p = share(F.col("n"), F.col("total"), F.col("v"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    excess = counts.join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # the window's limit is taken in every task before rows are shuffled: a hot source sends few
    top = excess.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_ranks)
    return far.withColumn("rank", F.row_number().over(order)).unionByName(top)
