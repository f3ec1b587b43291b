"""Long texts as ranges that tasks can share, told apart by the hash of the text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "text_hash string, total int, offset int, part string"


def text_hash(text: str):
    """What names a text: equal texts are worked on once, and a task that runs again gives the same name."""
    return F.sha2(text, 256)


def slices(texts: DataFrame, width: int, before: int, after: int) -> DataFrame:
    """(text_hash, total, offset, part) of each distinct text, once each range.

    ``texts`` has (text_hash, text). A part has the range's ``width``
    characters, up to ``before`` of those before it and ``after`` behind it.
    One pass over a text cuts all its ranges; then they are spread by hash and
    offset, copies of a text collapsing on the way.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = len(text)
                for offset in range(0, total, width):
                    part = text[max(0, offset - before) : offset + width + after]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int32()), pa.array([offset], pa.int32()), pa.array([part])], ["text_hash", "total", "offset", "part"])

    return texts.select("text_hash", "text").mapInArrow(cut, SCHEMA).dropDuplicates(["text_hash", "offset"])
