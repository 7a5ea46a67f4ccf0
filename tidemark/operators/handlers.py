"""Read models: the queries that handlers maintain, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import coarse
from tidemark.session import stored


def word_count(texts: DataFrame, text: str = "text") -> DataFrame:
    words = texts.select(F.explode(F.split(F.lower(text), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def item_popularity(events: DataFrame) -> DataFrame:
    """(item_id, count): quantities added, less removed, adjusted by the difference; other events don't count."""
    delta = F.when(F.col("event_type") == "added", F.col("quantity")).when(F.col("event_type") == "adjusted", F.col("quantity") - F.col("old_quantity")).when(F.col("event_type") == "removed", -F.col("old_quantity"))
    return events.withColumn("__d", delta).where("__d IS NOT NULL").groupBy("item_id").agg(F.sum("__d").cast("long").alias("count"))


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def concatenated(rows: DataFrame, key: str, order: str, message: str, separator: str = "|") -> DataFrame:
    """(key, concatenated): an entity's messages in order. The result itself holds them all, so a row is as long as an entity's history."""
    parts = F.array_sort(F.collect_list(F.struct(order, message)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[message]), separator).alias("concatenated"))


def checkouts(events: DataFrame, kind: str = "purchase") -> DataFrame:
    return events.where(F.col("event_type") == kind).select("pid", "seq_nr", F.col("ts").alias("checked_out_at"))


def grouped(rows: DataFrame, size: int, order: list[str], partition: str | None = None) -> DataFrame:
    """rows with group_nr: consecutive groups of size rows within a partition column, or over all rows.

    order should be total; rows that it leaves open are grouped in any order. Over all rows, they are dealt by ranges of
    the order and stored, each range is numbered by itself, and numbers go on from the sizes of the ranges before.
    """
    nth = F.floor((F.col("__nth") - 1) / size).cast("long")
    if partition:
        numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
        return numbered.withColumn("group_nr", nth).drop("__nth")
    dealt = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before")))  # one row a range
    numbered = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).join(starts, "__range")
    return numbered.withColumn("__nth", F.col("__own") + F.col("__before")).withColumn("group_nr", nth).select(*[c for c in rows.columns if c != "group_nr"], "group_nr")


def coarse_locations(locations: DataFrame) -> DataFrame:
    """(lat, lon, ids): who is where; rows without coordinates are left out."""
    known = locations.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    cells = known.select(coarse(F.col("latitude")).alias("lat"), coarse(F.col("longitude")).alias("lon"), "id")
    return cells.groupBy("lat", "lon").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def coarse_changes(locations: DataFrame, order: list[str]) -> DataFrame:
    """Rows where the rounded position differs from the one before, the first included."""
    w = Window.partitionBy("id").orderBy(*order)
    lat, lon = coarse(F.col("latitude")), coarse(F.col("longitude"))
    same = (F.lag(lat).over(w) == lat) & (F.lag(lon).over(w) == lon)
    return locations.withColumn("lat", lat).withColumn("lon", lon).withColumn("__same", F.coalesce(same, F.lit(False))).where(~F.col("__same")).drop("__same")


def last_values(events: DataFrame, value: str = "value") -> DataFrame:
    return events.groupBy("pid").agg(F.max("seq_nr").alias("seq_nr"), F.max_by(value, "seq_nr").alias("value"))


def throughput(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """(window_start_us, n, per_second) of fixed windows."""
    start = F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long") * seconds * 1_000_000
    return events.groupBy(start.alias("window_start_us")).agg(F.count("*").alias("n")).withColumn("per_second", F.round(F.col("n") / seconds, 6))


def size_tags(events: DataFrame, amount: Column, medium: float = 10, large: float = 100) -> DataFrame:
    """events with running total and its tag: large, medium or small."""
    w = Window.partitionBy("pid").orderBy("seq_nr").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(amount).over(w)
    return events.withColumn("total", total).withColumn("size_tag", F.when(total >= large, "large").when(total >= medium, "medium").otherwise("small"))


def queue_state(requests: DataFrame, picked: DataFrame, completed: DataFrame) -> DataFrame:
    """(id, state): waiting or in_progress; completed ones are gone."""
    left = requests.join(completed.select("id"), "id", "left_anti")
    return left.join(picked.select("id", F.lit(True).alias("__p")).distinct(), "id", "left").select("id", F.when(F.col("__p"), "in_progress").otherwise("waiting").alias("state"))


def nearest(points: DataFrame, distance: Column) -> DataFrame:
    """The id of the smallest distance, ties by id."""
    return points.agg(F.min(F.struct(distance.alias("d"), F.col("id").alias("id"))).alias("m")).select("m.id", F.col("m.d").alias("distance"))


def history(events: DataFrame, limit: int = 100) -> DataFrame:
    w = Window.partitionBy("pid").orderBy(F.desc("seq_nr"))
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= limit)


def replicated_cart(events: DataFrame) -> DataFrame:
    """(pid, item, quantity): signed counts an item."""
    return events.groupBy("pid", "item").agg(F.sum("delta").cast("long").alias("quantity"))


def closed_by(events: DataFrame) -> DataFrame:
    """(pid, replicas): the set of replicas that closed a cart."""
    return events.where("closed").groupBy("pid").agg(F.array_join(F.array_sort(F.collect_set("replica")), ",").alias("replicas"))


def keep_alive(events: DataFrame, idle_s: float, key: str = "slice", ts: str = "ts") -> DataFrame:
    """(key, tick_us): a tick after each idle_s in which a key's stream had nothing; an event at that very time stands for it."""
    idle = round(idle_s * 1_000_000)
    w = Window.partitionBy(key).orderBy("__us")
    times = events.select(key, F.unix_micros(ts).alias("__us")).distinct().withColumn("__next", F.lead("__us").over(w))
    gaps = times.where(F.col("__next") - F.col("__us") > idle)
    return gaps.select(key, F.explode(F.sequence(F.col("__us") + idle, F.col("__next") - 1, F.lit(idle))).alias("tick_us"))


def in_order(events: DataFrame, key: str = "pid", seq: str = "seq_nr") -> DataFrame:
    """events with follows: whether the row before of the same key has the number before. Keys run beside one another, each in order."""
    w = Window.partitionBy(key).orderBy(seq)
    return events.withColumn("follows", F.coalesce(F.lag(seq).over(w) + 1 == F.col(seq), F.lit(False)))
