"""Quality rules: characters inside repeated n-grams and repeated lines, measured with rolling hashes.

``measure`` adds nothing to the text and drops no row. Per document it counts words, characters in words, symbols,
repeated lines and words in repeated three-word windows, and takes the share of word characters that lie inside
repeated n-grams of several lengths and inside repeated lines. ``judge`` turns these into a verdict.

A null or blank text has no words; all its counts are 0 and ``base_failed`` is true. Repeated rows are measured one by
one, and rows without an id too. The work needs no shuffle: a document is measured where it is read, in slices of about 2 MB of text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as t

#: n-gram lengths and, for each, the largest share of word characters that may lie inside repeated n-grams.
NGRAM_LIMITS = {5: 0.40, 7: 0.35, 10: 0.30}
#: Largest shares of word characters inside repeated lines, of symbols among word characters, of words in capitals.
LINE_LIMIT, SYMBOL_LIMIT, CAPITALS_LIMIT = 0.40, 0.05, 0.60
MIN_WORDS, REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capital_words")


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is it there a second time or later (in order of position)."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def _per_row(mask: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[edge[1:]] - total[edge[:-1]]


def _covered(pos: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, pos, 1) if len(pos) < 64 else None
    if len(pos) >= 64:
        step += np.bincount(pos, minlength=size + 1).astype(np.int32)
    step -= np.bincount(pos + n, minlength=size + 1)[: size + 1].astype(np.int32)
    return np.cumsum(step[:size]) > 0


def measures(data: np.ndarray, at: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The figures of each row of one slice of texts."""
    h, s, e, first = t.words(data, at, ~t.SPACE)
    row, n = t.row_of(first), len(h)
    char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = char[e] - char[s]
    by_row = lambda x: np.bincount(row, x, minlength=len(at) - 1)
    out = {"n_words": np.diff(first), "word_chars": by_row(length).astype(np.int64), "n_symbols": _per_row(_SYMBOL[data], at)}
    upper, small = (np.concatenate(([0], np.cumsum(x[data]))) for x in (_UPPER, _LOWER))
    out["n_capital_words"] = _per_row((upper[e] - upper[s] > 1) & (small[e] == small[s]), first)
    # lines: runs without a line feed that hold a word
    ls, le, _ = t.word_borders(data, at, np.arange(256) != 10)
    solid = np.concatenate(([0], np.cumsum(~t.SPACE[data])))
    keep = solid[le] > solid[ls]
    ls, le = ls[keep], le[keep]
    line_row = np.searchsorted(at, ls, "right") - 1
    mark = lambda key, r: t.mix(key ^ t.mix(r.astype(np.uint64) + np.uint64(1)))
    _, later = _twice(mark(t.span_hash(data, ls, le), line_row))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=len(at) - 1)
    line_chars = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~t.SPACE[data])))
    inside = np.bincount(line_row[later], (line_chars[le] - line_chars[ls])[later], minlength=len(at) - 1)
    least = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = inside / least
    rolling = t.Rolling(h)
    for k in dict.fromkeys((3, *lengths)):
        pos = t.gram_rows(first, k)
        twice, _ = _twice(mark(rolling.runs(k)[pos], row[pos]))
        cover = _covered(pos[twice], k, n)
        if k == 3:
            out["n_repeat_words"] = np.bincount(row[cover], minlength=len(at) - 1)
        if k in lengths:
            out[f"dup_{k}gram_share"] = by_row(length * cover) / least
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """One row per row of ``docs``: the id and all figures."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [*_COUNTS, "dup_line_share", *(f"dup_{k}gram_share" for k in lengths)]
    kinds = ["bigint"] * len(_COUNTS) + ["double"] * (1 + len(lengths))
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, "text"):
            got = measures(data, at, lengths)
            columns = [pa.array(got[x], pa.int64() if kind == "bigint" else pa.float64()) for x, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *names])

    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def base_failed(of: Callable[[str], Any] = F.col) -> Any:
    """The base rule on figures that ``of`` gives by name: columns, or arrays."""
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > REPEAT_PERCENT * of("n_words"))


def verdict(limits: dict[int, float] | None = None, of: Callable[[str], Any] = F.col) -> Any:
    """True for a document that no rule rejects; the base rule is not among them."""
    limits = NGRAM_LIMITS if limits is None else limits
    ok = (of("dup_line_share") <= LINE_LIMIT) & (of("n_symbols") <= SYMBOL_LIMIT * of("word_chars"))
    ok &= of("n_capital_words") <= CAPITALS_LIMIT * of("n_words")
    for k, most in limits.items():
        ok &= of(f"dup_{k}gram_share") <= most
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures with ``base_failed`` and ``kept``: false where the base rule or one of the method's fails."""
    return measure(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict())


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, where they are read: nothing is joined or shuffled.

    Each row is judged by its own text, so repeated rows, and rows that share an id or have none, are kept or go by themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in t.chunks(batches, text_col):
            got = measures(data, at, tuple(NGRAM_LIMITS))
            yield part.filter(pa.array(~base_failed(got.__getitem__) & verdict(of=got.__getitem__)))

    return docs.mapInArrow(run, docs.schema)
