import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import strict as S
from tidemark.operators import validation as V

T0 = datetime(2024, 1, 1)


def run(spark, text, stored=None, **more):
    """text: pid-seq@ms in arrival order. Accepted numbers by id."""
    rows = []
    for i, token in enumerate(text.split()):
        name, _, ms = token.partition("@")
        pid, _, nr = name.partition("-")
        rows.append((i, pid, int(nr), T0 + timedelta(milliseconds=int(ms)), (stored or {}).get(pid), None if stored is None else 0))
    df = spark.createDataFrame(rows, "arrival int, pid string, seq_nr long, ts timestamp, stored long, stored_us long")
    out = V.validate(df, ["arrival"], **more)
    got = {}
    for r in out.orderBy("arrival").collect():
        if r["verdict"] == V.ACCEPTED:
            got.setdefault(r["pid"], []).append(r["seq_nr"])
    return got


STRICT = {"unknown_accepted": False}
A = "p1-1@0 p1-2@1 p2-1@2 p1-3@4 p1-1@0 p1-2@1 p2-1@2 p2-2@3 p1-3@4 p1-4@5 p2-3@6"
B = "p1-1@0 p1-2@1 p2-1@2 p2-3@4 p1-3@5 p1-5@7"
C = "p1-2@1 p2-2@3 p2-3@4 p1-3@5 p1-4@6 p1-5@7 p2-4@8 p1-6@9"


def test_duplicates(spark):
    assert run(spark, A, **STRICT) == {"p1": [1, 2, 3, 4], "p2": [1, 2, 3]}


def test_unknown_numbers(spark):
    assert run(spark, B, **STRICT) == {"p1": [1, 2, 3], "p2": [1]}


def test_backtracking_fills_in(spark):
    assert run(spark, f"{B} {C}", **STRICT) == {"p1": [1, 2, 3, 4, 5, 6], "p2": [1, 2, 3, 4]}


def test_stored_state(spark):
    assert run(spark, "p1-3@0 p1-4@1 p1-6@2 p2-2@3", {"p1": 3}, **STRICT) == {"p1": [4]}


def test_reset(spark):
    assert run(spark, "p-1@0 p-2@1 p-1@5000 p-2@5001", reset_after_s=1, **STRICT) == {"p": [1, 2, 1, 2]}
    assert run(spark, "p-1@0 p-2@1 p-1@500", reset_after_s=1, **STRICT) == {"p": [1, 2]}
    assert run(spark, "p-1@0 p-2@1 p-2@5000", reset_after_s=1, **STRICT) == {"p": [1, 2]}


def test_unknown_entity_without_predecessor(spark):
    assert run(spark, "p-7@0 p-8@1") == {"p": [7, 8]}


def test_verdicts_by_origin(spark):
    df = spark.createDataFrame([("p", 5, T0, 1, "backtracking"), ("q", 5, T0, 1, "pubsub")], "pid string, seq_nr long, ts timestamp, prev_us long, origin string")
    assert {r["pid"]: r["verdict"] for r in V.validate(df, ["seq_nr"]).collect()} == {"p": V.REJECTED_BACKTRACKING, "q": V.REJECTED}
    late = df.withColumn("accept_before_us", F.lit(2).cast("long"))
    assert {r["verdict"] for r in V.validate(late, ["seq_nr"]).collect()} == {V.ACCEPTED}


def test_missing_ranges_and_replay(spark):
    journal = spark.createDataFrame([("p", n, T0) for n in range(1, 8) if n != 6], "pid string, seq_nr long, ts timestamp")
    live = journal.where("seq_nr NOT IN (3, 4)")
    ranges = V.missing_ranges(V.validate(live, ["seq_nr"], **STRICT))
    assert [tuple(r) for r in ranges.collect()] == [("p", 3, 7)]
    found, short = V.replay(ranges, journal)
    assert sorted(r["seq_nr"] for r in found.collect()) == [3, 4, 5, 7]
    assert [tuple(r) for r in short.collect()] == [("p", 5, 4)]


def test_random_catch_up(spark):
    """Events of a few entities, with repeats and losses that come again later: all arrive, each once, in order."""
    rng = random.Random(5)
    events = [(f"e{rng.randrange(4)}",) for _ in range(600)]
    counts, rows = {}, []
    for (pid,) in events:
        counts[pid] = counts.get(pid, 0) + 1
        rows.append((pid, counts[pid]))
    arrival = [r for r in rows if rng.random() > 0.1]
    arrival = [r for r in arrival for _ in range(2 if rng.random() < 0.1 else 1)] + rows
    df = spark.createDataFrame([(i, *r, T0) for i, r in enumerate(arrival)], "arrival int, pid string, seq_nr long, ts timestamp")
    done = V.validate(df, ["arrival"], **STRICT).where("verdict = 'accepted'").orderBy("arrival").collect()
    got = {}
    for r in done:
        got.setdefault(r["pid"], []).append(r["seq_nr"])
    assert got == {p: list(range(1, n + 1)) for p, n in counts.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "pid string, seq_nr long, ts timestamp")
    assert V.validate(df, ["seq_nr"]).count() == 0


def folded(rows, reset_us, free_only_one):
    """Verdicts of rows (pid, n, us, stored, prev_us) in arrival order, one at a time."""
    states, out = {}, []
    for pid, n, us, stored, prev in rows:
        entity = states.setdefault(pid, V.Entity(stored or 0, 0 if stored else None))
        if free_only_one and not entity.seq and n != 1:
            prev = 0
        out.append(entity.verdict(n, us, prev, None, None, reset_us))
    return out


@pytest.mark.parametrize(("seed", "reset_us", "strict", "small"), [(1, None, True, 0), (2, None, False, 0), (3, 40, True, 0), (4, 40, False, 30), (5, None, True, 512), (6, 40, False, 512)])
def test_equals_a_fold(spark, monkeypatch, seed, reset_us, strict, small):
    """Entities of every kind of disorder, over blocks of four numbers and as arrays: in order, repeated, shuffled, backwards, with gaps and with a state before."""
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(V, "SMALL", small)
    rng, rows = random.Random(seed), []
    for e in range(60):
        top = rng.randrange(1, 25)
        numbers = list(range(1, top + 1)) * rng.choice([1, 1, 2, 3])
        kind = e % 5
        if kind == 1:
            rng.shuffle(numbers)
        elif kind == 2:
            numbers = sorted(numbers, key=lambda n: n + rng.randrange(4))
        elif kind == 3:
            numbers = list(range(top, 0, -1)) * top
        elif kind == 4:
            numbers = [n for n in numbers if rng.random() > 0.1] + numbers
        stored = rng.choice([None, None, rng.randrange(1, 6)])
        rows += [(f"e{e}", n, stored, rng.choice([None, 5])) for n in numbers]
    clock = {}
    rows = [(p, n, clock.setdefault(p, rng.randrange(9)) + i % 500, stored, prev) for i, (p, n, stored, prev) in enumerate(rows)]
    frame = [(i, p, n, T0 + timedelta(microseconds=us), stored, None if stored is None else 0, prev) for i, (p, n, us, stored, prev) in enumerate(rows)]
    df = spark.createDataFrame(frame, "arrival int, pid string, seq_nr long, ts timestamp, stored long, stored_us long, prev_us long")
    base = round(T0.timestamp() * 1_000_000) if T0.tzinfo else spark.range(1).select(F.unix_micros(F.lit(T0))).first()[0]
    df = df.withColumn("stored_us", F.col("stored_us") + base)
    done = V.validate(df, ["arrival"], reset_after_s=None if reset_us is None else reset_us / 1_000_000, unknown_accepted=not strict)
    got = [r["verdict"] for r in done.orderBy("arrival").collect()]
    assert got == folded([(p, n, us, stored, prev) for p, n, us, stored, prev in rows], reset_us, strict)


@pytest.mark.parametrize("small", [0, 512])
def test_ties_nulls_and_clashing_names(spark, monkeypatch, small):
    """Equal rows: one is accepted; a row without id or number is rejected; columns named like the work's own stay as they are."""
    monkeypatch.setattr(V, "SMALL", small)
    rows = [("p", 1, "x"), ("p", 1, "x"), ("p", 2, "y"), ("p", None, "z"), (None, 1, "w"), ("p", 0, "v")]
    df = spark.createDataFrame(rows, "pid string, seq_nr long, pos string").withColumn("ts", F.lit(T0)).withColumn("at", F.lit(7)).withColumn("n", F.lit("n")).withColumn("row", F.lit("r"))
    got = V.validate(df, ["ts"], unknown_accepted=False)
    assert got.columns == [*df.columns, "verdict"]
    assert sorted((r["pos"], r["verdict"], r["at"], r["n"], r["row"]) for r in got.collect()) == [("v", V.REJECTED, 7, "n", "r"), ("w", V.REJECTED, 7, "n", "r"), ("x", V.ACCEPTED, 7, "n", "r"), ("x", V.DUPLICATE, 7, "n", "r"), ("y", V.ACCEPTED, 7, "n", "r"), ("z", V.REJECTED, 7, "n", "r")]


def test_no_python_in_the_plan(spark, monkeypatch):
    df = spark.createDataFrame([("p", 1, T0)], "pid string, seq_nr long, ts timestamp")
    for reset, small in ((None, 0), (1, 0), (1, 512)):
        monkeypatch.setattr(V, "SMALL", small)
        plan = V.validate(df, ["seq_nr"], reset_after_s=reset)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("MapInArrow", "MapInPandas", "PythonUDF", "FlatMapGroups"))


def test_rows_are_shuffled_once(spark):
    """Of small entities only the rows go through the shuffle, without what is made of them and without their id."""
    from pyspark.sql import functions as F

    from tidemark.operators.validation import validate

    rows = spark.range(40).select(F.concat(F.lit("e|"), (F.col("id") % 4).cast("string")).alias("entity"), (F.col("id") / 4).cast("long").alias("nr"), F.timestamp_seconds("id").alias("at"), "id")
    judged = validate(rows, ["id"], pid="entity", seq="nr", ts="at")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and "rejected" not in plan[plan.index("collect_list(") :].split("\n")[0]
    assert judged.columns == [*rows.columns, "verdict"]
    assert {(r["entity"], r["nr"]): r["verdict"] for r in judged.collect()} == {(f"e|{n % 4}", n // 4): "rejected" if n < 4 else "accepted" for n in range(40)}
