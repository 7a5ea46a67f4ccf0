"""A replicated set as rows: additions win over removals that haven't seen them.

Every change at a replica has a dot, the replica and its running number. A state is the dots of additions that still
count, (kind, value, seq_nr, replica, counter), and a version vector, (replica, counter), of all that it has seen. A
removal takes away the dots that its replica knows. Where two states meet, a dot that one lacks is gone only if that
one has seen it; so the order and number of merges don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOTS = ["kind", "value", "seq_nr", "replica", "counter"]


class ORSet(NamedTuple):
    dots: DataFrame
    vector: DataFrame

    def values(self) -> DataFrame:
        """(kind, value, seq_nr): what is in the set, with the highest number of its additions."""
        return self.dots.groupBy("kind", "value").agg(F.max("seq_nr").alias("seq_nr"))


def replica_state(changes: DataFrame) -> ORSet:
    """The state of a replica that made changes (kind, value, seq_nr, replica, counter, removed) by itself, in the order of counter."""
    gone = changes.where("removed").groupBy("kind", "value", "replica").agg(F.max("counter").alias("__gone"))
    adds = changes.where("NOT removed").join(gone, ["kind", "value", "replica"], "left")
    return ORSet(adds.where("__gone IS NULL OR counter > __gone").select(*DOTS), _highest(changes))


def _highest(dots: DataFrame) -> DataFrame:
    return dots.groupBy("replica").agg(F.max("counter").alias("counter"))


def _not_seen(dots: DataFrame, vector: DataFrame) -> DataFrame:
    seen = vector.select("replica", F.col("counter").alias("__seen"))  # one row a replica
    return dots.join(F.broadcast(seen), "replica", "left").where("__seen IS NULL OR counter > __seen").select(*DOTS)


def merged(a: ORSet, b: ORSet) -> ORSet:
    """Dots of both, and of each those that the other hasn't seen."""
    both = a.dots.join(b.dots.select("kind", "value", "replica", "counter"), ["kind", "value", "replica", "counter"], "left_semi").select(*DOTS)
    dots = both.unionByName(_not_seen(a.dots, b.vector)).unionByName(_not_seen(b.dots, a.vector))
    return ORSet(dots, _highest(a.vector.unionByName(b.vector)))


def added(state: ORSet, values: DataFrame, replica: str) -> ORSet:
    """state after a replica adds values (kind, value, seq_nr): one new dot for all; what it knew of these values goes into it."""
    now = state.vector.where(F.col("replica") == replica).agg((F.coalesce(F.max("counter"), F.lit(0)) + 1).alias("counter"))  # one row
    new = values.select("kind", "value", "seq_nr", F.lit(replica).alias("replica")).join(F.broadcast(now)).select(*DOTS)
    rest = state.dots.join(values.select("kind", "value").distinct(), ["kind", "value"], "left_anti").select(*DOTS)
    return ORSet(rest.unionByName(new), _highest(state.vector.unionByName(now.select(F.lit(replica).alias("replica"), "counter"))))


def removed(state: ORSet, values: DataFrame) -> ORSet:
    """state after its replica removes values (kind, value): their dots go, and the version vector tells that they were seen."""
    return ORSet(state.dots.join(values.select("kind", "value").distinct(), ["kind", "value"], "left_anti").select(*DOTS), state.vector)
