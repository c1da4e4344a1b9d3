"""Small text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_texts(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` alone, a null text as an empty one; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def map_batches(
    docs: DataFrame, run: Callable[[list, list], dict[str, list]], schema: str, slice_rows: int = 1000
) -> DataFrame:
    """Apply `run(ids, texts)` to slices of at most `slice_rows` documents; it returns columns by name.

    Slices bound the memory of a Python worker whatever the Arrow batch size of the session.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                found = run(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(found, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return whole_texts(docs).mapInArrow(batches, schema)
