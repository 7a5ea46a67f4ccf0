import pytest
from pyspark.sql import functions as F

from tests.test_streaming import folder, projection  # noqa: F401
from tidemark.streaming.metrics import Meter, ProgressListener
from tidemark.streaming.projection import Delivery, Runner, run_once
from tidemark.streaming.telemetry import Recorder, ensemble


def consumed():
    return F.timestamp_micros(F.unix_micros("ts") + F.col("seq_nr"))


def whole(spark, path):
    return spark.read.parquet(str(path / "in"))


@pytest.mark.parametrize("delivery", list(Delivery))
def test_rows_lag_and_backlog(spark, folder, delivery):  # noqa: F811
    """Each micro-batch once, with what the next run adds; the offset of the first run is taken up by a new meter."""
    path, add = folder
    late = lambda s: whole(s, path).unionByName(s.range(30, 31).select(F.lit("p|0").alias("pid"), F.col("id").alias("seq_nr"), F.lit(0).alias("slice"), F.timestamp_seconds("id").alias("ts"), F.lit(False).alias("filtered")))
    recorder = Recorder()
    for lo, rows, filtered, lags in ((0, 10, 2, range(10)), (10, 15, 3, range(10, 25))):
        if lo:
            add(10, 25)
        meter = Meter(consumed, late)
        Runner(spark, str(path / "store"), projection(path, lambda r, b: r.select("seq_nr"), delivery=delivery, meter=meter, telemetry=ensemble([recorder]))).run()
        (m,) = meter.measures
        top = max(lags)
        assert (m.projection, m.n_rows, m.n_filtered, m.newest_us, m.lag_sum_us, m.lag_max_us) == ("n-k", rows, filtered, top * 1_000_000, sum(lags), top)
        assert (m.offset_us, m.backlog_us) == (top * 1_000_000, (30 - top) * 1_000_000)
    assert recorder.count("measured") == 2


def test_empty_and_older_batches(spark, tmp_path, folder):  # noqa: F811
    """An empty batch has no times; a batch of older events doesn't set the offset back; a batch seen before isn't measured."""
    path, _ = folder
    meter = Meter(consumed)
    p = projection(path, lambda r, b: None, meter=meter)
    store = run_once(spark, str(path / "store"), p, whole(spark, path))
    p.process(store, whole(spark, path).where("seq_nr < 0"), 1)
    p.process(store, whole(spark, path).where("seq_nr = 3"), 2)
    p.process(store, whole(spark, path), 2)
    assert [(m.batch, m.n_rows, m.newest_us, m.lag_sum_us, m.offset_us, m.backlog_us) for m in meter.measures] == [(0, 10, 9_000_000, 45, 9_000_000, None), (1, 0, None, None, 9_000_000, None), (2, 1, 3_000_000, 3, 9_000_000, None)]
    assert meter.table(spark).count() == 3


def test_progress(spark, folder):  # noqa: F811
    path, _ = folder
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        Runner(spark, str(path / "store"), projection(path, lambda r, b: r.select("seq_nr"))).run()
        assert listener.wait_for_end("n-k", 30)
    finally:
        spark.streams.removeListener(listener)
    done = {r["batch"]: r for r in listener.table(spark).where("query = 'n-k' AND n_rows > 0").collect()}
    assert set(done) == {0} and done[0]["n_rows"] >= 10 and done[0]["took_ms"] > 0 and done[0]["rows_per_second"] > 0
    assert ("n-k", None) in listener.ended
