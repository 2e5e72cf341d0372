"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt into shards of about ``SHARD`` documents by a hash of id and text; each shard is packed by itself, so no
task sees more than a shard and the result does not depend on the cluster. With that many pieces in a shard the last,
partly filled bin of each is all that dealing costs.

In a shard the pieces are placed in order of falling length. A piece goes into the open bin that it fills best; if none
has room a bin is opened. Its length is chosen by trial: for each permitted length the bin is filled with what fits of
the pieces that are left, longest first, and the length with the least cost for each token that it holds then is opened. A bin
costs its length plus ``overhead`` plus ``quadratic`` times the square of its length (attention). In the end each bin
shrinks to the least permitted length that holds its contents. Which lengths are worth opening depends on each
other, so all sets of lengths with the longest one are tried, and the packing of least cost in total stays. No
token is dropped: a document longer than the longest length is cut into pieces of that length and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS, SHARD = (512, 1024, 2048, 4096), 8192
OVERHEAD, QUADRATIC = 16.0, 1 / 16384
_OUT = "shard bigint, bin bigint, capacity int, used int, position int, doc_id bigint, piece int, token_from bigint, n_tokens int"


def cost(length: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return length + overhead + quadratic * length * length


class _Left:
    """The sizes not placed yet, with their numbers."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for x in sizes:
            self.count[x] = self.count.get(x, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.sizes[bisect_left(self.sizes, size)]

    def fill(self, room: int) -> int:
        """How much of ``room`` they fill, longest first."""
        free, k = room, len(self.sizes)
        while free and (k := bisect_right(self.sizes, free, 0, k)):
            k -= 1
            size = self.sizes[k]
            free -= size * min(self.count[size], free // size)
        return room - free


def _placed(sizes: list[int], order: list[int], opened: tuple[int, ...], price: dict[int, float]) -> tuple[list[int], list[int]]:
    """The bin of each piece and what each bin holds, where bins of ``opened`` lengths may be opened."""
    left = _Left(sizes)
    room: list[tuple[int, int]] = []  # (free, bin), sorted: the first with enough room fits best
    used: list[int] = []
    into = [0] * len(sizes)
    for i in order:
        size = sizes[i]
        left.take(size)
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            fit = [c for c in opened if c >= size]
            free, b = min(fit, key=lambda c: (price[c] / (size + left.fill(c - size)), c)), len(used)
            used.append(0)
        into[i] = b
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return into, used


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> list[tuple[int, int]]:
    """(bin, capacity after shrinking) of each piece; sizes lie between 1 and the longest length. The result is that of
    least cost among all sets of lengths that may be opened; on a tie, of the smaller set."""
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    price = {c: cost(c, overhead, quadratic) for c in lengths}
    best = None
    for n in range(len(lengths)):
        for some in combinations(lengths[:-1], n):
            into, used = _placed(sizes, order, (*some, lengths[-1]), price)
            shrunk = [lengths[bisect_left(lengths, u)] for u in used]
            total = sum(price[c] for c in shrunk)
            if best is None or total < best[0] - 1e-9:
                best = total, into, shrunk
    return [(b, best[2][b]) for b in best[1]]


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD, tokens: str = "regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')") -> DataFrame:
    """One row per piece: shard, bin (in the shard), capacity, used (tokens of the bin), position (of the piece in its
    bin), doc_id, piece, token_from (in the document), n_tokens.

    ``tokens`` is the SQL expression that counts a text's tokens; by default its words. A text without tokens, or null,
    is one piece of length 0 in bin -1 with capacity 0, so that no document is lost from the result. Repeated rows, rows
    that share a doc_id and rows without one are packed as often as they come; in a shard rows are ordered by doc_id, those
    without one last, then by tokens.
    """
    n_shards = max(1, -(-docs.count() // shard_rows))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.coalesce(F.expr(tokens), F.lit(0)).cast("bigint").alias("n"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).alias("shard"))
    longest = max(lengths)

    def run(table: pa.Table) -> pa.Table:
        n, shard = (table.column(x).to_numpy() for x in ("n", "shard"))
        ids = table.column("doc_id").combine_chunks()
        order = np.lexsort((n, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        ids, n = ids.take(pa.array(order)), n[order]
        count = np.maximum(1, -(-n // longest))
        doc = np.repeat(np.arange(len(ids)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(longest, n[doc] - piece * longest)
        full = np.flatnonzero(size > 0)
        bins, capacity = np.full(len(doc), -1), np.zeros(len(doc), np.int64)
        got = pack(size[full].tolist(), lengths)
        if got:
            bins[full], capacity[full] = zip(*got, strict=True)
        rank = np.lexsort((np.arange(len(doc)), bins))
        new = np.append(True, np.diff(bins[rank]) != 0)
        start = np.flatnonzero(new)
        position = np.empty(len(doc), np.int64)
        position[rank] = np.arange(len(doc)) - start[np.cumsum(new) - 1]
        used = np.bincount(bins + 1, size, minlength=1)[bins + 1]
        columns = [shard[np.zeros(len(doc), int)], bins, capacity.astype(np.int32), used.astype(np.int32), position.astype(np.int32), ids.take(pa.array(doc)), piece.astype(np.int32), piece * longest, size.astype(np.int32)]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.groupBy("shard").applyInArrow(run, _OUT)
