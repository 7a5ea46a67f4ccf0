"""Groups over micro-batches and replicated sets."""

from datetime import UTC, datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import handlers as H
from tidemark.operators import orset as S
from tidemark.streaming.grouping import Groups

SCHEMA = "slice int, n long"
START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("cuts", [(), (7,), (1, 2, 3, 20)])
def test_groups_are_the_same_wherever_batches_end(spark, tmp_path, cuts):
    rows = [(n % 2, n) for n in range(23)]
    schema = spark.createDataFrame([], SCHEMA).schema
    groups, got = Groups(spark, str(tmp_path), schema, 4, ["n"]), []
    ends = [*cuts, len(rows)]
    for b, (a, e) in enumerate(zip([0, *cuts], ends)):
        got += groups.step(spark.createDataFrame(rows[a:e], SCHEMA), b, START + timedelta(seconds=b), last=b == len(cuts)).collect()
    assert sorted(tuple(r) for r in got) == sorted((s, n, n // 2 // 4) for s, n in rows)


def test_groups_closed_by_time(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    groups = Groups(spark, str(tmp_path), schema, 3, ["n"], within_s=10)

    def step(b, second, *ns):
        return sorted((r["n"], r["group_nr"]) for r in groups.step(spark.createDataFrame([(0, n) for n in ns], SCHEMA), b, START + timedelta(seconds=second)).collect())

    assert step(0, 0, 1, 2) == [] and step(0, 0, 1, 2) == []  # run again
    assert step(1, 9) == []
    assert step(2, 10) == [(1, 0), (2, 0)]
    assert step(3, 11, 3, 4, 5, 6) == [(3, 1), (4, 1), (5, 1)]
    assert step(4, 30) == [(6, 2)]
    with pytest.raises(ValueError):
        Groups(spark, str(tmp_path), schema, 0, ["n"])


def test_a_replicated_set(spark):
    change = "kind string, value string, seq_nr long, replica string, counter long, removed boolean"
    of = lambda *rows: S.replica_state(spark.createDataFrame([("k", v, n, r, c, gone) for v, n, r, c, gone in rows], change))
    values = lambda state: {(r["value"], r["seq_nr"]) for r in state.values().collect()}
    frame = lambda *vs: spark.createDataFrame([("k", v, 9) for v in vs], "kind string, value string, seq_nr long")
    a = of(("x", 1, "a", 1, False), ("y", 1, "a", 2, False), ("x", 0, "a", 3, True), ("z", 1, "a", 4, False))
    b = of(("x", 5, "b", 1, False), ("z", 7, "b", 2, False))
    assert values(a) == {("y", 1), ("z", 1)} and values(b) == {("x", 5), ("z", 7)}
    # A removal doesn't touch an addition that it hasn't seen; the highest number counts.
    both = S.merged(a, b)
    assert values(both) == {("x", 5), ("y", 1), ("z", 7)}
    gone = S.removed(both, frame("x", "z"))
    again = S.added(b, frame("x"), "b")
    assert values(S.merged(gone, again)) == {("x", 9), ("y", 1)} == values(S.merged(again, gone))
    # Any order of merges, and merges twice, give one state.
    states = [a, b, gone, again]
    dots = {frozenset(tuple(r) for r in S.merged(S.merged(S.merged(states[i], states[j]), states[k]), states[m]).dots.select(*S.DOTS).collect()) for i, j, k, m in list(permutations(range(4)))[::5]}
    assert len(dots) == 1
    once = S.merged(gone, again)
    assert values(S.merged(once, gone)) == values(once) == values(S.merged(once, once))
    assert S.merged(a, S.ORSet(a.dots.limit(0), a.vector.limit(0))).values().count() == 2
    assert once.vector.where(F.col("replica") == "b").first()["counter"] == 3


def test_groups_over_all_rows(spark):
    """Numbers go on from range to range; equal rows count each; an empty table has no groups; a column of the result's name is replaced."""
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("at"), F.lit("x").alias("group_nr")).unionByName(spark.createDataFrame([(5, "x")] * 3, "at long, group_nr string")).repartition(7)
    done = H.grouped(rows, 10, ["at"])
    assert done.columns == ["at", "group_nr"]
    expected = sorted([*range(1000), 5, 5, 5])
    assert sorted((r["at"], r["group_nr"]) for r in done.collect()) == [(v, i // 10) for i, v in enumerate(expected)]
    assert H.grouped(rows.where("at < 0"), 10, ["at"]).collect() == []
