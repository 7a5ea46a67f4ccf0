"""Sequence validation: every entity's events exactly once and in order.

A row's verdict depends on which earlier rows were accepted, so the strict rule isn't a window function. Over tables an
entity with few rows is an array that one expression goes through; in a larger one accepted rows are a path from number to
number, found by windows and joins (operators.strict). In a stream an entity's state is at hand and Entity says what becomes of a row. The relaxed rule (gaps allowed) is a running maximum.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.strict import accepted_at
from tidemark.session import Scratch, stored

ACCEPTED, DUPLICATE, REJECTED, REJECTED_BACKTRACKING = "accepted", "duplicate", "rejected", "rejected_backtracking"
#: Rows of an entity up to which they are taken as one array.
SMALL = 512
#: Columns of a validation input beside the caller's own; each may be missing.
OPTIONAL = {"stored": "long", "stored_us": "long", "prev_us": "long", "accept_before_us": "long", "origin": "string"}


class Entity:
    """What is known of the entity in hand."""

    __slots__ = ("seq", "us")

    def __init__(self, seq: int, us: int | None) -> None:
        self.seq, self.us = seq, us

    def verdict(self, seq: int, us: int | None, prev_us: int | None, accept_before_us: int | None, origin: str | None, reset_us: int | None) -> str:
        """The strict rule; an accepted row becomes the state."""
        reset = reset_us is not None and self.us is not None and us is not None and us > self.us + reset_us
        rejected = REJECTED_BACKTRACKING if origin == "backtracking" else REJECTED
        if self.seq and seq <= self.seq and not reset:
            return DUPLICATE
        if self.seq:
            out = ACCEPTED if seq == self.seq + 1 or seq == 1 and reset else rejected
        elif seq == 1 or prev_us is None:
            out = ACCEPTED  # the first event, or one whose predecessor is gone
        else:
            out = ACCEPTED if accept_before_us is not None and prev_us < accept_before_us else rejected
        if out == ACCEPTED:
            self.seq, self.us = seq, us
        return out


def validate(events: DataFrame, order: list[str], reset_after_s: float | None = None, unknown_accepted: bool = True, pid: str = "pid", seq: str = "seq_nr", ts: str = "ts") -> DataFrame:
    """events with `verdict`. order is the arrival order within an entity; what it leaves open goes by number.

    Of the OPTIONAL columns, stored and stored_us are an entity's state before the batch, prev_us is the time of the
    event before (null: not found), accept_before_us the time before which a missing predecessor doesn't matter, and origin
    "backtracking", "pubsub" or null. With unknown_accepted an entity's first row is judged by prev_us; without, it is
    rejected unless it has number 1. Of rows that are equal in order and number one is accepted, the others repeat it. Rows
    without an id, or with no number of 1 or more, are rejected. An empty table gives an empty one.
    """
    plain = [c for c in events.columns if c != "verdict"]

    def derived(row: Column) -> dict[str, Column]:
        """What the rule needs of a row: made where it is needed, so that it isn't shuffled beside the row."""
        extra = {c: row[c].cast(t) if c in plain else F.lit(None).cast(t) for c, t in OPTIONAL.items()}
        first = (row[seq] == 1) | extra["prev_us"].isNull() | F.coalesce(extra["prev_us"] < extra["accept_before_us"], F.lit(False))
        return {
            "n": row[seq].cast("long"), "pos": F.struct(*[row[c].alias(f"o{i}") for i, c in enumerate(order)], row[seq].cast("long").alias("n")), "us": F.unix_micros(row[ts]), "free": first if unknown_accepted else row[seq] == 1,
            "stored": F.coalesce(extra["stored"], F.lit(0).cast("long")), "stored_us": extra["stored_us"], "rejected": F.when(extra["origin"] == "backtracking", REJECTED_BACKTRACKING).otherwise(REJECTED),
        }

    rows = events.select(F.struct(*plain).alias("row"), F.col(pid).alias("pid"))
    fit = F.col("pid").isNotNull() & F.coalesce(F.col("row")[seq].cast("long") >= 1, F.lit(False))
    reset_us = None if reset_after_s is None else round(reset_after_s * 1_000_000)
    judged = _by_size(rows.where(fit), derived, pid, reset_us)
    unfit = rows.where(~fit).select("row", derived(F.col("row"))["rejected"].alias("verdict"))
    return judged.select("row", "verdict").unionByName(unfit).select("row.*", "verdict")


Derived = Callable[[Column], dict[str, Column]]


def _by_size(rows: DataFrame, derived: Derived, pid: str, reset_us: int | None) -> DataFrame:
    """rows with verdict: entities of at most SMALL rows as an array each, larger ones by paths. Both give the same, so it doesn't matter that entities of one hash are counted together."""
    rows = rows.withColumn("hash", F.xxhash64("pid"))
    large = rows.groupBy("hash").count().where(F.col("count") > SMALL).select("hash")
    if large.isEmpty():
        return _folded(rows, derived, pid, reset_us)
    large = stored(large)
    big = rows.join(large, "hash", "left_semi").select("row", "pid", *(c.alias(name) for name, c in derived(F.col("row")).items()))
    judged = _judged(big) if reset_us is None else _judged_with_resets(big, reset_us)
    return _folded(rows.join(large, "hash", "left_anti"), derived, pid, reset_us).unionByName(judged.select("row", "verdict"))


def _folded(rows: DataFrame, derived: Derived, pid: str, reset_us: int | None) -> DataFrame:
    """(row, verdict) of entities with few rows: an expression goes through each one's rows in order. Only the rows are shuffled, each once and without the id that deals them."""
    names = rows.schema["row"].dataType.names
    slim = F.struct(*[F.col("row")[c].alias(c) for c in names if c != pid] or [F.lit(None).alias("none")])
    whole = lambda x: F.struct(*[(F.col("pid") if c == pid else x[c]).alias(c) for c in names])
    grouped = rows.select("pid", slim.alias("row")).groupBy("pid").agg(F.collect_list("row").alias("rows"))

    def placed(x: Column, i: Column) -> Column:
        known = derived(x)
        return F.struct(known["pos"].alias("pos"), i.alias("i"), F.struct(*[known[c].alias(c) for c in ("n", "us", "free", "stored", "stored_us", "rejected")]).alias("key"))

    dealt = grouped.select("pid", "rows", F.sort_array(F.transform("rows", placed)).alias("keys"))

    def step(state: Column, item: Column) -> Column:
        x, known = item["key"], state["n"] > 0
        reset = F.lit(False) if reset_us is None else F.coalesce(x["us"] > state["us"] + reset_us, F.lit(False))
        taken = F.when(known, (x["n"] == state["n"] + 1) | (x["n"] == 1) & reset).otherwise(x["free"])
        verdict = F.when(taken, ACCEPTED).when(known & (x["n"] <= state["n"]) & ~reset, DUPLICATE).otherwise(x["rejected"])
        return F.struct(F.when(taken, x["n"]).otherwise(state["n"]).alias("n"), F.when(taken, x["us"]).otherwise(state["us"]).alias("us"), F.array_append(state["verdicts"], verdict).alias("verdicts"))

    head = F.col("keys")[0]["key"]
    begin = F.struct(head["stored"].alias("n"), head["stored_us"].alias("us"), F.array().cast("array<string>").alias("verdicts"))
    done = dealt.select("pid", "rows", "keys", F.aggregate("keys", begin, step, lambda s: s["verdicts"]).alias("verdicts"))
    return done.select(F.inline(F.transform("keys", lambda x, i: F.struct(whole(F.col("rows")[x["i"]]).alias("row"), F.col("verdicts")[i].alias("verdict")))))


def _judged(rows: DataFrame) -> DataFrame:
    """rows with verdict, by the places at which their numbers are accepted."""
    places = accepted_at(rows.select("pid", "n", "pos", "free", "stored"))
    joined = rows.join(places, ["pid", "n"])
    nth = F.row_number().over(Window.partitionBy("pid", "n", "pos").orderBy(F.lit(1)))
    repeated = (F.col("n") <= F.col("stored")) | (F.col("at") <= F.col("pos")) | (F.col("below") < F.col("pos"))
    return joined.withColumn("verdict", F.when((F.col("at") == F.col("pos")) & (nth == 1), ACCEPTED).when(repeated, DUPLICATE).otherwise(F.col("rejected"))).drop("at", "below")


def _judged_with_resets(rows: DataFrame, reset_us: int) -> DataFrame:
    """rows with verdict where entities may begin again: as if they didn't, up to an entity's first reset, then its rest from there.

    Rounds are as many as the most resets of an entity. The state at a row is a running value of its entity, in one window.
    """
    parts, spark = [], rows.sparkSession
    by = Window.partitionBy("pid").orderBy("pos", F.when(F.col("verdict") == ACCEPTED, 0).otherwise(1))
    taken = F.when(F.col("verdict") == ACCEPTED, F.struct("n", "us"))
    with Scratch(spark) as at:
        while True:
            state = F.coalesce(F.last(taken, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.struct(F.col("stored").alias("n"), F.col("stored_us").alias("us")))
            seen = _judged(rows).withColumn("state", state).withColumn("reset", (F.col("state.n") > 0) & F.coalesce(F.col("us") > F.col("state.us") + reset_us, F.lit(False)))
            begins = F.col("reset") & (F.col("n") == 1) & (F.col("verdict") != ACCEPTED)
            # Rows up to an entity's first reset are done; which of equal rows begins it is the window's order too.
            through = F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
            counted = at.store(seen.withColumn("starts", begins).withColumn("through", through))
            here = F.when(F.col("starts"), ACCEPTED).when((F.col("verdict") == DUPLICATE) & F.col("reset"), F.col("rejected")).otherwise(F.col("verdict"))
            first = (F.col("through") == 0) | F.col("starts") & (F.col("through") == 1)
            parts.append(at.keep(counted.where(first).select("row", here.alias("verdict"))))
            rest = counted.where(~first)
            if rest.isEmpty():
                break
            again = counted.where(F.col("starts") & (F.col("through") == 1)).select("pid", F.col("us").alias("again_us"))
            rows = at.store(rest.join(again, "pid").select("row", "pid", "n", "pos", "us", "free", F.lit(1).cast("long").alias("stored"), F.col("again_us").alias("stored_us"), "rejected"))
    return reduce(DataFrame.unionByName, parts)


def validate_relaxed(events: DataFrame, order: list[str], pid: str = "pid", seq: str = "seq_nr") -> DataFrame:
    """events with `verdict` where gaps are allowed: accepted if above every number before."""
    w = Window.partitionBy(pid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce("stored", F.lit(0)) if "stored" in events.columns else F.lit(0)
    before = F.greatest(F.coalesce(F.max(seq).over(w), F.lit(0)), start)
    return events.withColumn("verdict", F.when(F.col(seq) > before, ACCEPTED).otherwise(DUPLICATE))


def with_state(events: DataFrame, records: DataFrame) -> DataFrame:
    """events with stored and stored_us of their entity: offsets loaded on demand, as one join."""
    best = records.groupBy("pid").agg(F.max(F.struct("seq_nr", "ts")).alias("m")).select("pid", F.col("m.seq_nr").alias("stored"), F.unix_micros("m.ts").alias("stored_us"))
    return events.join(best, "pid", "left")


def with_previous(events: DataFrame, journal: DataFrame, delete_after_s: float | None = None, records: DataFrame | None = None, accept_before: Column | None = None) -> DataFrame:
    """events with prev_us, the time of the event one number before, and accept_before_us.

    accept_before_us is the slice's newest stored time less delete_after_s, and where accept_before is given too, the earlier of both.
    """
    before = journal.select(F.col("pid"), (F.col("seq_nr") + 1).alias("seq_nr"), F.unix_micros("ts").alias("prev_us"))
    out = events.join(before, ["pid", "seq_nr"], "left")
    limit = F.lit(None).cast("long") if accept_before is None else F.unix_micros(accept_before)
    if records is not None and delete_after_s is not None:
        newest = records.groupBy("slice").agg((F.max(F.unix_micros("ts")) - round(delete_after_s * 1_000_000)).alias("__limit"))
        out = out.join(F.broadcast(newest), "slice", "left")  # at most one row a slice
        limit = F.least(limit, F.col("__limit"))
    return out.withColumn("accept_before_us", limit).drop("__limit")


def missing_ranges(verdicts: DataFrame, pid: str = "pid", seq: str = "seq_nr") -> DataFrame:
    """(pid, from_nr, to_nr): what to read again for rejected rows: from one past the last accepted to the highest rejected."""
    ok = F.max(F.when(F.col("verdict") == ACCEPTED, F.col(seq)))
    bad = F.max(F.when(F.col("verdict").startswith("rejected") & (F.coalesce(F.col("origin"), F.lit("")) != "pubsub"), F.col(seq))) if "origin" in verdicts.columns else F.max(F.when(F.col("verdict").startswith("rejected"), F.col(seq)))
    state = F.max("stored") if "stored" in verdicts.columns else F.lit(None).cast("long")
    known = F.coalesce(F.greatest(ok, state), F.lit(0).cast("long"))
    ranges = verdicts.groupBy(pid).agg(known.alias("__known"), bad.alias("to_nr")).where("to_nr > 1")
    return ranges.select(pid, F.when(F.col("__known") >= F.col("to_nr"), F.lit(1).cast("long")).otherwise(F.col("__known") + 1).alias("from_nr"), "to_nr")


def replay(ranges: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The journal's events of the ranges, and (pid, expected, found) of those ranges that aren't complete."""
    found = ranges.join(journal, "pid").where(F.col("seq_nr").between(F.col("from_nr"), F.col("to_nr")))
    counts = found.groupBy("pid").agg(F.count("*").alias("found"))
    short = ranges.join(counts, "pid", "left").select("pid", (F.col("to_nr") - F.col("from_nr") + 1).alias("expected"), F.coalesce("found", F.lit(0).cast("long")).alias("found")).where("expected <> found")
    return found.drop("from_nr", "to_nr"), short


def fill_gaps(events: DataFrame, pid: str = "pid", seq: str = "seq_nr") -> DataFrame:
    """(pid, seq_nr, filler): every number between an entity's first and last, filler where there is no event."""
    span = events.groupBy(pid).agg(F.min(seq).alias("__lo"), F.max(seq).alias("__hi"))
    wanted = span.select(pid, F.explode(F.sequence("__lo", "__hi")).alias(seq))
    have = events.select(pid, seq).distinct().withColumn("__have", F.lit(True))
    return wanted.join(have, [pid, seq], "left").select(pid, seq, F.col("__have").isNull().alias("filler"))


def replay_or_filter(live: DataFrame, replayed: DataFrame, passes: Column, filter_after: str = "filter_after") -> DataFrame:
    """live and replayed rows in one stream, with `replayed`; live rows are filtered.

    Replayed rows below their filter_after pass whatever the filter, the others are filtered too; 0 or null is no limit,
    so that all of them pass. Only replayed has the column; it goes.
    """
    again = replayed.withColumn("replayed", F.lit(True))
    limit = F.coalesce(F.col(filter_after), F.lit(0))
    free = again.where((limit == 0) | (F.col("seq_nr") < limit) | passes).drop(filter_after)
    return live.where(passes).withColumn("replayed", F.lit(False)).unionByName(free, allowMissingColumns=True)


IN_FLIGHT_LIMIT = 10_000


def in_flight(accepted: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """(pid, seq_nr): of each entity the highest accepted number, where that is above what is stored for it.

    With limit the query fails if there are as many entities as that or more: whoever handles them doesn't keep up.
    """
    top = accepted.groupBy("pid").agg(F.max("seq_nr").alias("seq_nr"))
    done = stored.groupBy("pid").agg(F.max("seq_nr").alias("__done"))
    flying = top.join(done, "pid", "left").where(F.col("__done").isNull() | (F.col("__done") < F.col("seq_nr"))).drop("__done")
    if limit is None:
        return flying
    count = flying.agg(F.count("*").alias("__n"))  # one row
    full = F.when(F.col("__n") >= limit, F.raise_error(F.concat(F.lit("too many envelopes in flight: "), F.col("__n").cast("string")))).otherwise(F.lit(True))
    return flying.join(F.broadcast(count), full.cast("boolean")).drop("__n")


def is_in_flight(events: DataFrame, flying: DataFrame) -> DataFrame:
    """events with in_flight: whether their entity has this number or a higher one in flight."""
    top = flying.groupBy("pid").agg(F.max("seq_nr").alias("__flying"))
    return events.join(top, "pid", "left").withColumn("in_flight", F.coalesce(F.col("seq_nr") <= F.col("__flying"), F.lit(False))).drop("__flying")
