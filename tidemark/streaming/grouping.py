"""Groups of a stream's rows that don't end with its micro-batches.

A group is closed by so many rows or by so much time since its first one came. What is unfinished is stored with the
micro-batch and goes on with the next, so groups are the same wherever the micro-batches end. Numbers of groups go on too.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Groups:
    """Consecutive groups within each value of `key`, in the order of `order`; state is stored below `folder`.

    A micro-batch's rows come after those before it. One that runs again begins from the same state.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, size: int, order: list[str], key: str = "slice", within_s: float | None = None) -> None:
        if size < 1:
            raise ValueError("a group has at least one row")
        self.spark, self.folder, self.size, self.order, self.key, self.within_s = spark, folder, size, order, key, within_s
        self.schema = StructType(schema.fields).add("__since", "timestamp")
        self.numbers = StructType([schema[key]]).add("__closed", "long")

    def _read(self, name: str, schema: StructType) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def step(self, rows: DataFrame, batch_id: int, now: datetime | None = None, last: bool = False) -> DataFrame:
        """The rows of groups that this micro-batch closes, with group_nr; with `last` all are closed. now is the time of the micro-batch."""
        time = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        both = self._read(f"open-{batch_id - 1}", self.schema).unionByName(rows.withColumn("__since", time))
        both.write.mode("overwrite").parquet(f"{self.folder}/all-{batch_id}")
        both = self._read(f"all-{batch_id}", self.schema)
        closed = self._read(f"closed-{batch_id - 1}", self.numbers)
        place = F.row_number().over(Window.partitionBy(self.key).orderBy("__since", *self.order)) - 1
        ranked = both.withColumn("__group", F.floor(place / self.size).cast("long"))
        # Of each key and group whether it is full, or its first row has waited long enough.
        count = F.count("*").over(Window.partitionBy(self.key, "__group"))
        first = F.min("__since").over(Window.partitionBy(self.key, "__group"))
        overdue = F.lit(False) if self.within_s is None else F.unix_micros(first) + round(self.within_s * 1_000_000) <= F.unix_micros(time)
        done = ranked.withColumn("__done", F.lit(last) | (count == self.size) | overdue)
        before = F.broadcast(closed)  # one row a key
        out = done.where("__done").join(before, self.key, "left").withColumn("group_nr", F.col("__group") + F.coalesce("__closed", F.lit(0)))
        done.where("NOT __done").select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/open-{batch_id}")
        more = out.groupBy(self.key).agg((F.max("group_nr") + 1).alias("__now"))
        closed.join(more, self.key, "full").select(self.key, F.coalesce("__now", "__closed").alias("__closed")).write.mode("overwrite").parquet(f"{self.folder}/closed-{batch_id}")
        return out.select(*rows.columns, "group_nr")
