"""The strict rule over tables: which row of an entity each number is accepted at, by joins and windows instead of a fold.

From an accepted row of number n the next accepted row is the first one of number n + 1 that arrives after it, so accepted
rows are a path. Numbers whose first arrivals are in order make stretches, which a path follows once it is on their first
arrivals; they are found by windows over blocks of numbers. Where a first arrival came too early, the path goes on over
later arrivals; these alone take part in pointer doubling, and only those of entities whose path meets such a place.

Work is dealt by entity and number, or entity and block of numbers, so that an entity of any size is many tasks' work; the
repeats of one number of one entity stay together in the last window, which streams them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Scratch

#: Numbers of an entity that one window takes.
BLOCK = 8192


def _block(seq: str | Column) -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / BLOCK)


def _numbers(rows: DataFrame) -> DataFrame:
    """(pid, n, block, first, stored, start, head): of each number its first arrival, its entity's state, and the number its stretch begins with."""
    per = rows.groupBy("pid", "n").agg(F.min("pos").alias("first"), F.min(F.when(F.col("free"), F.col("pos"))).alias("free"), F.max("stored").alias("stored"))
    # The last number of a block is a guest in the next one too, so that the next one's first number sees it.
    homes = F.when(F.col("n") % BLOCK == BLOCK - 1, F.array(_block("n"), _block("n") + 1)).otherwise(F.array(_block("n")))
    by = Window.partitionBy("pid", "block").orderBy("n")
    linked = (F.lag("n").over(by) == F.col("n") - 1) & (F.lag("first").over(by) < F.col("first"))
    dealt = per.withColumn("block", F.explode(homes)).withColumn("own", F.when(~F.coalesce(linked, F.lit(False)), F.col("n"))).where(_block("n") == F.col("block"))
    return dealt.withColumn("own", F.max("own").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def _with_entities(dealt: DataFrame) -> DataFrame:
    """Numbers with their entity's state and with stretches that came from blocks before."""
    blocks = dealt.groupBy("pid", "block").agg(F.max("own").alias("tail"), F.min("free").alias("free"), F.max("stored").alias("stored"))
    by = Window.partitionBy("pid")
    came = F.last("tail", ignorenulls=True).over(by.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    entity = blocks.select("pid", "block", came.alias("came"), F.min("free").over(by).alias("start"), F.coalesce(F.max("stored").over(by), F.lit(0)).alias("stored"))
    joined = dealt.drop("free", "stored").join(entity, ["pid", "block"])
    return joined.select("pid", "n", "block", "first", "stored", "start", F.coalesce("own", "came").alias("head"))


def _entries(numbers: DataFrame) -> DataFrame:
    """(pid, head, n, late): where each entity's path begins: on a stretch, or at a later arrival."""
    known = F.col("stored") > 0
    begin = numbers.where(F.when(known, F.col("n") == F.col("stored") + 1).otherwise(F.col("n") == F.col("start.n")))
    return begin.select("pid", "head", "n", F.when(~known & (F.col("start") != F.col("first")), F.col("start")).alias("late"))


def _late_path(rows: DataFrame, numbers: DataFrame, stretches: DataFrame, entries: DataFrame, at: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(pid, pos) of later arrivals on paths, and (pid, head, n) of the stretches that the paths come to from them; None if there are none."""
    left = entries.where("late IS NULL").join(stretches, ["pid", "head"])
    onward = left.select("pid", (F.col("end") + 1).alias("n")).join(numbers.select("pid", "n"), ["pid", "n"], "left_semi")
    active = at.store(onward.unionByName(entries.where("late IS NOT NULL").select("pid", "n")).withColumnRenamed("n", "least"))
    if active.isEmpty():
        return None
    points = rows.select("pid", "n", "pos").join(active, "pid").where("n >= least - 1").select("pid", "n", "pos").distinct()
    # From the latest to the earliest: the last row of number k that was met is the first one to arrive after.
    pairs = points.select("pid", F.col("n").alias("k"), "pos", F.col("pos").alias("target")).unionByName(points.select("pid", (F.col("n") + 1).alias("k"), "pos", F.lit(None).alias("target")))
    later = Window.partitionBy("pid", "k").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    follows = pairs.withColumn("next", F.last("target", ignorenulls=True).over(later)).where("target IS NULL AND next IS NOT NULL").select("pid", "pos", "next")
    follows = at.store(follows)
    outs = stretches.join(follows.withColumnRenamed("pos", "end_pos"), ["pid", "end_pos"]).select("pid", "head", F.col("next").alias("out"))
    firsts = numbers.select("pid", F.col("first").alias("next"), "head")
    hops = follows.join(firsts, ["pid", "next"], "left").join(outs, ["pid", "head"], "left")
    hops = at.store(hops.select("pid", "pos", F.when(F.col("head").isNull(), F.col("next")).otherwise(F.col("out")).alias("to"), "head", F.col("next.n").alias("n")))
    begin = left.select("pid", "head").join(outs, ["pid", "head"]).select("pid", F.col("out").alias("pos"))
    path = at.store(begin.unionByName(entries.where("late IS NOT NULL").select("pid", F.col("late").alias("pos"))))
    jump = hops.where("to IS NOT NULL").select("pid", "pos", "to")
    while True:
        reached = path.join(jump, ["pid", "pos"]).select("pid", F.col("to").alias("pos"))
        grown = at.store(reached)
        if grown.isEmpty():
            break
        path = at.store(path.unionByName(grown))
        jump = at.store(jump.join(jump.select("pid", F.col("pos").alias("to"), F.col("to").alias("far")), ["pid", "to"]).select("pid", "pos", F.col("far").alias("to")))
    return path, hops.join(path, ["pid", "pos"]).where("head IS NOT NULL").select("pid", "head", "n")


def accepted_at(rows: DataFrame) -> DataFrame:
    """(pid, n, at, below): the place in the order of arrival at which a number is accepted, null if never; and for numbers below an entity's first one, where that is.

    rows has pid, n, pos (a struct that orders an entity's rows, of which the last field is n), free (whether the row
    would be accepted from an entity of which nothing is known) and stored (the number known before, 0 or null: none).
    """
    with Scratch(rows.sparkSession) as at:
        numbers = at.store(_with_entities(_numbers(rows)))
        stretches = numbers.groupBy("pid", "head").agg(F.max("n").alias("end"), F.max("first").alias("end_pos"))
        entries = _entries(numbers)
        late = _late_path(rows, numbers, stretches, entries, at)
        visits = entries.where("late IS NULL").select("pid", "head", "n")
        if late is not None:
            visits = visits.unionByName(late[1])
        reach = visits.withColumnRenamed("n", "from").join(stretches.select("pid", "head", "end"), ["pid", "head"])
        reach = reach.select("pid", "head", "from", F.explode(F.sequence(_block("from"), _block("end"))).alias("block"))
        done = numbers.join(reach, ["pid", "head", "block"], "left").withColumn("at", F.when(F.col("n") >= F.col("from"), F.col("first")))
        if late is not None:
            done = done.join(late[0].select("pid", F.col("pos.n").alias("n"), F.col("pos").alias("again")), ["pid", "n"], "left").withColumn("at", F.coalesce("again", "at"))
        below = F.when((F.col("stored") == 0) & (F.col("n") < F.col("start.n")), F.col("start"))
        return at.keep(done.select("pid", "n", "at", below.alias("below")))
