"""Sharding by a two-pass external shuffle (DataFrame operations only).

Pass one scatters the rows uniformly into buckets with a seeded hash of their
key and content, as many as keep a bucket near ``bucket_bytes``.  Pass two takes one bucket
at a time, in key order, and shuffles it in memory (Spark's ``shuffle`` is a
seeded Fisher-Yates).  Bucket after bucket makes one random order of all rows;
the row at place ``p`` goes to shard ``p mod n_shards``, slot ``p div
n_shards``, so shards differ by one row at most and slots have no gaps.

The order depends on the seed, the rows and the number of buckets alone, and
that number on their bytes, not on the cluster: every
bucket lies in a known partition and is sorted before it is shuffled, so a task
that runs again after a lost executor writes the same rows.

Defined results: null text has size 1 and the CRC of the empty string; rows
with equal text are dealt out like any others; repeated rows stay as many as
they are, and only rows that are equal in everything must share a bucket;
buckets are sized by the measured bytes of whole rows; an empty table gives an
empty table; extra columns are carried in a struct, so their names may be
``shard`` or ``slot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from arrayq.llm.shared import new_path

SHARDS = 8
SEED = 20240611
BUCKET_BYTES = 16 << 20
#: Buckets whose sizes one task adds up when their starts are worked out.
_BLOCK = 1024


def _starts(sizes: DataFrame) -> DataFrame:
    """``_start`` of each ``_bucket``: sums within blocks of buckets, then over the blocks."""
    blocked = sizes.withColumn("_block", F.expr(f"_bucket div {_BLOCK}"))
    within = F.sum("_n").over(Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    inner = blocked.select("_block", "_bucket", F.coalesce(within, F.lit(0)).alias("_inner"))
    totals = blocked.groupBy("_block").agg(F.sum("_n").alias("_total"))
    ahead = F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each 1024 buckets
    outer = totals.select("_block", F.coalesce(ahead, F.lit(0)).alias("_outer"))
    return inner.join(outer, "_block").select("_bucket", (F.col("_inner") + F.col("_outer")).alias("_start"))


def _weight(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: of texts their own, of anything else about eight, of lists eight an element."""
    if isinstance(kind, T.StructType):
        own = [_weight(value[f.name], f.dataType) for f in kind.fields]
        return sum(own[1:], own[0]) if own else F.lit(8)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    return F.greatest(F.size(value), F.lit(1)).cast("long") * 8 if isinstance(kind, (T.ArrayType, T.MapType)) else F.lit(8).cast("long")


def measured_bytes(rows: DataFrame) -> int:
    """What all rows weigh."""
    return rows.agg(F.sum(_weight(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), rows.schema))).first()[0] or 0


def external_shuffle(rows: DataFrame, key: list[str], n_shards: int = SHARDS, seed: int = SEED, n_buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``rows`` as struct ``row``, with ``shard`` and ``slot``.

    ``key`` names columns that tell rows apart.  Without ``n_buckets`` the rows
    are weighed once, and there are as many as keep a bucket near ``bucket_bytes``.
    """
    if n_buckets is None:
        n_buckets = max(1, -(-measured_bytes(rows) // bucket_bytes))
    # content counts too: null or equal keys must not pile up in one bucket
    content = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(n_buckets))
    sizes = rows.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    packed = rows.select(bucket.alias("_bucket"), F.struct(F.struct(*[F.col(f"`{k}`") for k in key]).alias("k"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")).alias("_r"))
    # an explicit number of partitions: adaptive execution leaves it alone, so a bucket's partition is known
    scattered = packed.repartition(n_buckets, "_bucket")
    sorted_buckets = scattered.groupBy("_bucket").agg(F.sort_array(F.collect_list("_r")).alias("_rows")).sortWithinPartitions("_bucket")
    shuffled = sorted_buckets.select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    placed = shuffled.join(F.broadcast(_starts(sizes)), "_bucket")  # two longs a bucket of bucket_bytes
    spread = placed.select("_start", F.posexplode("_rows").alias("_i", "_r"))
    place = F.col("_start") + F.col("_i")
    return spread.select(F.col("_r.row").alias("row"), (place % n_shards).cast("int").alias("shard"), F.expr(f"(_start + _i) div {n_shards}").alias("slot"))


def write_shards(rows: DataFrame, key: list[str], path: str, n_shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes the shuffled rows as ``path/shard=k/*.parquet``: each as struct ``row`` with its ``slot``, in slot order."""
    external_shuffle(rows, key, n_shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document, as read back from the shards.

    The shards hold whole documents; ``written_at`` of the result is their folder.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_shards(docs, ["doc_id"], path, n_shards, seed)
    shards = spark.read.schema(T.StructType([T.StructField("row", docs.schema), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("string")
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    out = shards.select(F.col("row.doc_id").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    out.written_at = path
    return out
