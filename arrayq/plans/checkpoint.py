"""Cuts in the lineage of iterative programs, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="arrayq-checkpoints-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` from reliable files: an iteration's plan does not grow with the iterations before it, and a lost executor does not undo them.

    With ``keys`` it is partitioned by them first and stays so: joins on these
    keys do not shuffle it again.
    """
    spark = df.sparkSession
    where = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return (df.repartition(*keys) if keys else df).checkpoint()


def dropped(df: DataFrame) -> None:
    """Deletes the files of a checkpointed frame that nothing reads any more; another frame is left as it is."""
    try:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    except Py4JError:
        return
    if file.isDefined():
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
