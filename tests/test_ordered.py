"""Limits of a stream in the order of its events, whatever order they come in."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import admission
from lodestone.streaming import ordered

SCHEMA = "key long, event_id long, at double"


@pytest.fixture
def store(spark):
    before = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)
    yield
    spark.conf.set(ordered.PROVIDER, before)


def fed(spark, place, rows, *, limit, window, late):
    """Adds ``rows`` as one more file and runs the stream until it has nothing left; a run begins where the last one ended."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    out = ordered.limited_in_order(stream, limit, window, late).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/marks")
    q = out.outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return {r["event_id"]: (r["admitted"], r["retry_after"]) for r in spark.read.schema(ordered.OUTPUT).parquet(f"{place}/out").collect()}


def test_shuffled_batches_and_restarts_decide_as_the_whole_log(spark, store, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), i, round(rng.uniform(0, 300), rng.choice([0, 2, 5]))) for i in range(400)]
    rng.shuffle(rows)
    end = (9, 10_000, 2_000.0)
    for some in (rows[:150], rows[150:300], [*rows[300:], (1, 9_999, None)]):
        got = fed(spark, tmp_path, some, limit=5, window=30.0, late=400.0)
        assert not got  # an earlier one may still come
    got = fed(spark, tmp_path, [end], limit=5, window=30.0, late=400.0)
    want = admission.limited(spark.createDataFrame(rows, SCHEMA), 5, 30.0)
    assert got == {r["event_id"]: (r["admitted"], r["retry_after"]) for r in want.collect()}
    assert 0 < sum(fine for fine, _ in got.values()) < len(rows)


def test_admissions_are_held_over_batches_and_late_rows_dropped(spark, store, tmp_path):
    kind = {"limit": 2, "window": 50.0, "late": 10.0}
    assert set(fed(spark, tmp_path, [(1, 1, 0.0), (1, 2, 1.0), (1, 4, 30.0)], **kind)) == {1, 2}
    fed(spark, tmp_path, [(1, 3, 25.0), (1, 5, 5.0), (1, 6, 52.0)], **kind)  # 3 is within ten seconds, 5 is not
    got = fed(spark, tmp_path, [(2, 7, 500.0)], **kind)
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 25), 4: (False, 20), 6: (True, 0)}


def test_other_stores_are_refused(spark):
    if spark.conf.get(ordered.PROVIDER) == ordered.ROCKSDB:
        pytest.skip("the session has the store that is needed")
    with pytest.raises(ValueError, match="RocksDB"):
        ordered.limited_in_order(spark.range(1).select(F.lit(1).alias("key"), "id", F.lit(0.0).alias("at")), 1)
