import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayq.streaming.increments import increments, into_tensor, stream_q
from tests.helpers import array, tensor

SCHEMA = "ts timestamp, i int, x double"


@pytest.fixture
def source(spark, tmp_path):
    for k in range(3):
        rows = [(datetime.datetime(2024, 1, 1, 0, 5 * k + j), (k + j) % 4, float(j)) for j in range(4)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def want():
    out = np.zeros(4)
    for k in range(3):
        for j in range(4):
            out[(k + j) % 4] += j
    return out


def drained(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_running_cells(spark, source):
    rows = drained(increments(source, ["i"], "x"), "cells", "complete").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.i0)] == want().tolist()


def test_comprehension_over_a_stream(spark, source):
    out = stream_q(spark, "dataset[ (i, x*w) | (t,i,x) <- S, (j,w) <- V, j == i, x > 1.0 ]", S=source, V=tensor(spark, np.arange(4.0)))
    got = sorted(map(tuple, drained(out, "mapped", "append").collect()))
    assert got == sorted(((k + j) % 4, j * float((k + j) % 4)) for k in range(3) for j in (2, 3))
    with pytest.raises(TypeError):
        stream_q(spark, "1 + 1")


def test_windows_close_behind_the_watermark(spark, source):
    out = increments(source, ["i"], "x", event_time="ts", late="1 minute", window="5 minutes")
    assert drained(out, "windows", "append").select(F.col("window.start").alias("s")).distinct().count() >= 1


def test_tensor_folds_batches(spark, source, tmp_path):
    seen = []
    query = into_tensor(source, tensor(spark, np.ones(4)), ["i"], "x", "+", lambda t, k: seen.append(array(t)), str(tmp_path / "check"))
    query.awaitTermination()
    assert len(seen) == 3 and np.array_equal(seen[-1], want() + 1)
