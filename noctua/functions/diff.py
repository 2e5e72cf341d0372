"""Unified diffs of two wordings of a text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_slices


def unified(rows: DataFrame, key: str, old: str, new: str, context: int = 3) -> DataFrame:
    """(key, diff): the diff of each row; empty for equal texts. Line alignment needs Python; it runs over slices of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            lines = ["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "before", "after", lineterm="", n=context)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=[key, "diff"])

    return rows.select(key, F.col(old).cast("string"), F.col(new).cast("string")).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, diff string")
