"""Handlers of single envelopes: the recovery strategy holds for each call by itself, in the task that has the envelope.

A handler over a DataFrame fails as a whole, and which envelopes it failed for takes calls to find out, some for each
(Projection._without_failing). A function of one envelope needs none: its call is retried, skipped or fails where it is
made, so a micro-batch is one pass however many of its envelopes fail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from tidemark.session import importable
from tidemark.streaming.recovery import Recovery, recover

FAILED = "__failed"


class Skipped(Exception):
    """Envelopes of a micro-batch that were skipped: how many, and what one of them failed with."""


class EachEnvelope:
    """call takes an envelope as a dict of its columns and gives a row of `schema` as a dict, or None for no result."""

    def __init__(self, call: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str) -> None:
        self.call, self.schema = call, schema

    def results(self, rows: DataFrame, recovery: Recovery) -> tuple[DataFrame, Observation]:
        """Results over envelopes; and n and failure of what was skipped, once the results have been written."""
        importable(rows.sparkSession)
        out = StructType([*_parse_datatype_string(self.schema).fields, StructField(FAILED, StringType())])
        made, seen = rows.mapInArrow(_each(self.call, recovery, to_arrow_schema(out)), out), Observation()
        made = made.observe(seen, F.count(FAILED).alias("n"), F.max(FAILED).alias("failure"))
        return made.where(F.col(FAILED).isNull()).drop(FAILED), seen


def _each(call: Callable, recovery: Recovery, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for envelope in batch.to_pylist():
                failures = []
                done, result = recover(lambda e=envelope: call(e), recovery, lambda error, what: failures.append(error))
                if not done:
                    out.append({FAILED: f"{type(failures[-1]).__name__}: {failures[-1]}"})
                elif result is not None:
                    out.append(result)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return work
