"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only where none is named and all run on one machine, as in tests, a folder of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: cuts the lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared checkpoint folder and read again: a cut for wide rows, compressed on disk.

    A checkpoint also keeps what the optimiser knew of its rows, which grows from round to round in a loop; a table doesn't.
    """
    with Scratch(df.sparkSession) as kept:
        return kept.keep(df)


class Scratch:
    """Tables in the shared checkpoint folder that go when the block ends, except those that keep() wrote.

    What leaves the block must not depend on the tables that go: keep() it, or cut it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        ensure_checkpoint_dir(self.spark)
        return self

    def __exit__(self, *failure: object) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _written(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = f"{self.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """df written and read again, for good."""
        return self._written(df)[1]

    def store(self, df: DataFrame) -> DataFrame:
        """df written and read again, until the block ends."""
        path, kept = self._written(df)
        self.paths.append(path)
        return kept


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import the package even where only the driver's sys.path has it; clusters ship it with --py-files."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark
