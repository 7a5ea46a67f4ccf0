"""What the Arrow-based operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import importable

#: Whole texts that one slice of work holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, so that other columns, whatever their names, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's, in either case."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded bytes; a text is never split."""
    col = batch.column(batch.schema.get_field_index(column))
    start, size = 0, 0
    for i in range(batch.num_rows):
        n = len(col[i].as_buffer() or b"") if col[i].is_valid else 0
        if i > start and (size + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start, batch.num_rows - start)


def arrow_rows(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over bounded slices: work takes columns as lists and returns the columns of schema."""
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for piece in slices(batch, text):
                made = work(piece.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def arrow_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text") -> DataFrame:
    """mapInArrow over bounded slices of all columns, for work that keeps the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                yield work(piece)

    return df.mapInArrow(run, df.schema)
