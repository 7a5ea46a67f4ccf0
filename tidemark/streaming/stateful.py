"""Stateful streams: validation and user-defined folds with an entity's state kept between micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.operators.validation import Entity
from tidemark.session import importable


def validate_stream(events: DataFrame, order: list[str], reset_after_s: float | None = None) -> DataFrame:
    """A stream of (pid, seq_nr, ts, more) with `verdict` by the strict rule; state is an entity's last accepted number and time.

    Rows of an entity are sorted within a micro-batch; a missing predecessor counts as not found only if the journal
    has been asked, so without prev_us an unknown entity's row is rejected unless it has number 1.
    """
    importable(events.sparkSession)
    reset_us = None if reset_after_s is None else round(reset_after_s * 1_000_000)
    base = events.withColumn("__us", F.unix_micros("ts"))
    out = StructType([*base.schema.fields, StructField("verdict", StringType())])
    state_type = StructType([StructField("seq", LongType()), StructField("us", LongType())])

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entity = Entity(*state.get) if state.exists else Entity(0, None)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        verdicts = [entity.verdict(int(s), int(us), 0, None, None, reset_us) for s, us in zip(rows["seq_nr"], rows["__us"])]
        state.update((entity.seq, entity.us))
        yield rows.assign(verdict=verdicts)

    return base.groupBy("pid").applyInPandasWithState(fold, out, state_type, "append", GroupStateTimeout.NoTimeout).drop("__us")


def fold_stream(events: DataFrame, key: str, order: list[str], initial: Callable[[], Any], process: Callable[[Any, dict], Any], encode: Callable[[Any], str], decode: Callable[[str], Any]) -> DataFrame:
    """A stateful handler: (key, state) after each micro-batch that touched it. State is stored as text."""
    importable(events.sparkSession)
    out = StructType([events.schema[key], StructField("state", StringType())])

    def fold(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = decode(held.get[0]) if held.exists else initial()
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for row in rows.to_dict("records"):
            state = process(state, row)
        text = encode(state)
        held.update((text,))
        yield pd.DataFrame({key: [k[0]], "state": [text]})

    return events.groupBy(key).applyInPandasWithState(fold, out, StructType([StructField("state", StringType())]), "update", GroupStateTimeout.NoTimeout)


def without_late_repeats(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Overlapping re-reads: an event that comes again within the delay is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pid", "seq_nr"])
