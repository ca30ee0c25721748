"""Programs over streams: comprehensions on unbounded frames, and tensors that streams increment.

A comprehension whose generators range over one stream and any number of bounded
frames or tensors is an ordinary streaming plan.  A tensor that a stream
increments is a running aggregate by index under a monoid.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arrayq.functions.monoids import BUILT_IN
from arrayq.operators import algebra
from arrayq.session import q
from arrayq.tensor import VALUE, Tensor


def stream_q(spark: SparkSession, text: str, **bindings: Any) -> DataFrame:
    """A program whose last expression is a frame over a stream."""
    out = q(spark, text, **bindings)
    if not isinstance(out, DataFrame) or not out.isStreaming:
        raise TypeError("the program's result does not depend on a stream")
    return out


def increments(stream: DataFrame, indices: list[str], value: str, monoid: str = "+", event_time: str | None = None, late: str = "10 minutes", window: str | None = None) -> DataFrame:
    """Running cells (i0.., v) of the tensor that the rows increment.

    With ``event_time`` and ``window`` there is a tensor for each window, closed
    once the watermark has passed it; later rows are dropped.
    """
    keys = [F.col(c).cast("int").alias(f"i{k}") for k, c in enumerate(indices)]
    if event_time and window:
        stream = stream.withWatermark(event_time, late)
        keys = [F.window(event_time, window).alias("window"), *keys]
    return stream.groupBy(*keys).agg(BUILT_IN[monoid].aggregate(F.col(value)).alias(VALUE))


def _after(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose tensor is complete in ``folder``, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    done = [n for n in found if n.startswith("batch=") and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def into_tensor(stream: DataFrame, start: Tensor, indices: list[str], value: str, monoid: str, sink: Any, checkpoint: str) -> StreamingQuery:
    """Folds every micro-batch into a tensor and hands it to ``sink(tensor, batch)``.

    Each batch is aggregated by index before it is merged.  The merged tensor is
    written beside the stream's own checkpoint, under the batch's number, so a
    query that starts again goes on from the last tensor, and a batch that runs
    again starts from the tensor before it and counts once.  The last two
    tensors are kept.
    """
    spark, folder = stream.sparkSession, f"{checkpoint.rstrip('/')}/tensors"
    schema = start.values().schema

    def at(number: int) -> Tensor:
        return Tensor(spark.read.schema(schema).parquet(f"{folder}/batch={number}"), start.dims, start.n_dense, start.kind)

    def fold(batch: DataFrame, number: int) -> None:
        before = [n for n in _after(spark, folder) if n < number]
        cells = batch.groupBy(*[F.col(c).cast("int").alias(f"i{k}") for k, c in enumerate(indices)]).agg(BUILT_IN[monoid].aggregate(F.col(value)).alias(VALUE))
        merged = algebra.merged(at(before[-1]) if before else start, Tensor(cells, start.dims, 0, start.kind), monoid)
        merged.values().select(*schema.names[:-1], F.col(VALUE).cast(start.kind).alias(VALUE)).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        sink(at(number), number)
        for n in before[:-1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
