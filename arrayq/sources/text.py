"""Text and Parquet in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arrayq.tensor import Tensor


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (number, line), numbered from 0 in file order.

    Numbers are a line's place in its split plus the lines in the splits before
    it; only those counts, one for each split, meet in one place.
    """
    lines = spark.read.text(path).select(F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    counts = lines.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_before"))
    return lines.join(F.broadcast(starts), "_part").select((F.col("_before") + F.col("_id") - F.col("_first")).cast("bigint").alias("number"), "line")


def read_tensor(spark: SparkSession, path: str, dims: tuple[int, ...], n_dense: int | None = None) -> Tensor:
    """A tensor from Parquet rows ``i0.., v``."""
    return Tensor.of(spark.read.parquet(path), dims, n_dense)


def write_tensor(t: Tensor, path: str) -> None:
    """Cells as Parquet rows, range-partitioned by the first index so that readers can skip files."""
    t.df.repartitionByRange(*t.indices[:1]).sortWithinPartitions(*t.indices).write.parquet(path)
