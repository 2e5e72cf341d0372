"""Vectorised text primitives over Arrow string buffers.

A batch's strings lie in one UTF-8 buffer. Word borders, word hashes and rolling hashes of byte windows come from
whole-buffer numpy operations, without a Python object per word. All separators here are ASCII, and the bytes of
multi-byte code points are never ASCII, so working on bytes gives the same words as working on code points.

A span is named by a 64-bit hash of its 8-byte pieces: each piece is scrambled with its place before they are summed, so
no arrangement of pieces cancels out. Spans of up to 8 bytes and of equal length never collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd constants that tell places, lengths and steps apart.
_PLACE, _SIZE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03), U64(0xD6E8FEB86659FD93)
#: The first n bytes of an 8-byte piece.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for bytes of words of letters and digits: 0-9, a-z, A-Z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of a public hash function)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Odd factors of the pieces of a window of up to 2048 bytes.
_FACTOR = mix(np.arange(1, 257, dtype=U64)) | U64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about ``most`` text bytes (one row at least), each with its bytes and offsets: bounds memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = buffers(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other characters stay."""
    return _LOWER[data]


def word_borders(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of ``inside`` bytes, none across rows; and each row's first word, with the total last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    m = inside[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = at[(at > 0) & (at < len(data))]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, at, "left")


def _pieces(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each byte span from ``s`` to ``e``."""
    if not len(s):
        return np.zeros(0, U64)
    piece, n = _pieces(data), e - s
    out = mix(piece[s] & _MASK[np.minimum(n, 8)])
    if len(long := np.flatnonzero(n > 8)):
        more = (n[long] - 1) >> 3
        edge = np.cumsum(more) - more
        j = np.arange(int(more.sum())) - np.repeat(edge, more) + 1
        at = np.repeat(s[long], more) + 8 * j
        x = piece[at] & _MASK[np.minimum(np.repeat(e[long], more) - at, 8)]
        out[long] += np.add.reduceat(mix(x + j.astype(U64) * _PLACE), edge)
    return mix(out + n.astype(U64) * _SIZE)


def window_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes (8 at least) from each position on that has so many after it."""
    n = max(0, len(data) - k + 1)
    piece, out = _pieces(data), np.zeros(n, U64)
    for i, at in enumerate(dict.fromkeys((*range(0, k - 7, 8), k - 8))):
        x = piece[at : at + n]
        out += (x ^ (x >> U64(31))) * _FACTOR[i]
    return mix(out)


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word; and each row's first word, with the total last."""
    s, e, first = word_borders(data, at, inside)
    return span_hash(data, s, e), s, e, first


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; the last n - 1 positions have none."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U64)
    for i in range(n if m else 0):
        out ^= h[i : i + m]
        out *= _STEP
        out ^= out >> U64(32)
    return mix(out)


#: Modulus and bases of the rolling hash.
_PRIME, _BASES = U64((1 << 31) - 1), (1_103_515_245, 48_271_007)


class Rolling:
    """Rolling hash of word sequences, for runs of any length: prefix sums of polynomials with two bases over a prime field."""

    def __init__(self, h: np.ndarray):
        self.sums, self.down = [], []
        for base, part in zip(_BASES, (h >> U64(33), h & U64(0x7FFFFFFF)), strict=True):
            up, down = (_powers(x, len(h) + 1) for x in (base, pow(base, -1, int(_PRIME))))
            self.sums.append(np.concatenate((np.zeros(1, U64), np.cumsum(part * up[:-1] % _PRIME, dtype=U64))))
            self.down.append(down)

    def runs(self, n: int) -> np.ndarray:
        """Hash of each run of n words; the last n - 1 positions have none."""
        m = max(0, len(self.sums[0]) - n)
        one, two = ((s[n : n + m] - s[:m]) % _PRIME * d[:m] % _PRIME for s, d in zip(self.sums, self.down, strict=True))
        return mix(one << U64(31) | two)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base`` in the prime field, by doubling."""
    out = np.ones(n, U64)
    done = 1
    while done < n:
        step = U64(pow(base, done, int(_PRIME)))
        out[done : 2 * done] = out[: min(done, n - done)] * step % _PRIME
        done *= 2
    return out


def gram_rows(first: np.ndarray, n: int) -> np.ndarray:
    """Word positions from which n words of one row follow."""
    count = np.maximum(0, np.diff(first) - n + 1)
    start = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return start + np.arange(int(count.sum()))


def blocks(bucket: np.ndarray, records: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One row (bucket, payload) for each bucket: the records of that bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], np.ascontiguousarray(records[order])
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    off = np.append(edge, len(bucket)).astype(np.int32) * np.int32(records.dtype.itemsize)
    payload = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), payload], schema=schema)


BLOCKS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
BLOCKS_DDL = "bucket int, payload binary"


class Scatter:
    """Gathers records, then gives them out as blocks once ``most`` bytes are there."""

    def __init__(self, n: int, most: int = 1 << 23):
        self.n, self.most, self.held, self.size = n, most, [], 0

    def add(self, key: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.held.append(((key % U64(self.n)).astype(np.int32), records))
            self.size += records.nbytes
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield blocks(np.concatenate([x[0] for x in self.held]), np.concatenate([x[1] for x in self.held]), BLOCKS)
        self.held, self.size = [], 0


def gathered(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each bucket; the rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now and held:
                yield now, np.concatenate(held)
                held = []
            now = b
            held.append(np.frombuffer(payload.as_buffer(), dtype).copy())
    if held:
        yield now, np.concatenate(held)


def squeeze(rec: np.ndarray) -> bytes:
    """Records whose first field rises, as compressed byte planes of that field's steps and the other fields."""
    if not len(rec):
        return b""
    names, out = rec.dtype.names, [np.int64(len(rec)).tobytes()]
    for i, name in enumerate(names):
        x = np.ascontiguousarray(rec[name])
        x = np.diff(x, prepend=x.dtype.type(0)) if i == 0 else x
        out.append(x.view(np.uint8).reshape(len(x), -1).T.tobytes())
    return pa.compress(b"".join(out), codec="zstd", asbytes=True)


def unsqueeze(packed: pa.Buffer | bytes, dtype: np.dtype) -> np.ndarray:
    packed = pa.py_buffer(packed)
    if not packed.size:
        return np.zeros(0, dtype)
    # the first frame field of zstd gives no reliable size, so records are read as a stream
    raw = pa.CompressedInputStream(pa.BufferReader(packed), "zstd").read()
    n, at = int(np.frombuffer(raw[:8], np.int64)[0]), 8
    out = np.empty(n, dtype)
    for i, name in enumerate(dtype.names):
        size = dtype[name].itemsize
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(dtype[name]).ravel()
        out[name] = np.cumsum(x, dtype=x.dtype) if i == 0 else x
        at += n * size
    return out


def squeezed_blocks(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, payload) for each bucket, with its records squeezed; they come in order of their first field."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    packed = [squeeze(records[lo:hi]) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], schema=BLOCKS)


def unsqueezed(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """All records of each bucket; the rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now and held:
                yield np.concatenate(held)
                held = []
            now = b
            held.append(unsqueeze(payload.as_buffer(), dtype))
    if held:
        yield np.concatenate(held)


def edges(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, with the total last."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    return np.append(np.flatnonzero(new), n)
