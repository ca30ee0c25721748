"""Exact dedup: two-pass Bloom filtering (DataFrame operations only).

Pass one hashes every text and counts, for each bit of a blocked Bloom filter,
whether it was set at least twice.  A hash that occurs twice has set all its
bits twice, so a row with any bit that was set once is certainly unique.  Pass
two probes that "set twice" filter by a broadcast join: rows that miss pass
straight through, and only possible repeats are shuffled, grouped by their full
SHA-256 and joined to the row that stays.

A filter never has more than ``max_bits`` bits.  Beyond the number of rows for
which these are ``bits_per_row`` a row, the narrow table of keys is dealt into
ranges of hashes, written apart, and both passes run range by range, each with a
filter of its own.  :func:`exact_dedup` then probes the texts with a filter over
the hashes that truly repeat; where these outgrow it, more unique rows are
regrouped in vain, with the same result.

Defined results: null text counts as empty; empty texts are equal to each
other; of rows with equal text the least ``doc_id`` stays (null ids last); of
repeated rows with the same id and text one stays; an empty table gives an
empty table; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrayq.llm.shared import discard, materialise, new_path

BITS_PER_ROW = 16
MAX_BITS = 1 << 26
_WORD = 64


def normalised(text: Column) -> Column:
    """Every run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _slots(digest: Column, n_words: int) -> tuple[Column, Column, Column]:
    """Filter word, and two bits in it, from a digest that is uniform already."""
    part = lambda at, n: F.conv(F.hex(F.substring(digest, at, n)), 16, 10).cast("long")
    return part(1, 7) % n_words, part(9, 1) % _WORD, part(10, 1) % _WORD


def _set_twice(slots: DataFrame) -> DataFrame:
    """The filter's words: one bit for each position that at least two rows set.

    Positions are counted with map-side combining; the count saturates into a
    bit, so the result has at most ``max_bits / 64`` rows.
    """
    bits = slots.select("_w", F.explode(F.array_distinct(F.array("_b1", "_b2"))).alias("_b"))
    twice = bits.groupBy("_w", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.groupBy("_w").agg(F.expr("bit_or(shiftleft(1L, cast(_b as int)))").alias("_bits"))


def _keys(docs: DataFrame) -> DataFrame:
    return materialise(docs.select(F.col("doc_id").alias("_id"), _digest(docs["text"]).alias("_h"), F.monotonically_increasing_id().alias("_row")), "dedup-keys")


def _slotted(keys: DataFrame, n_words: int) -> DataFrame:
    w, b1, b2 = _slots(F.col("_h"), n_words)
    return keys.select("_id", "_h", "_row", w.alias("_w"), b1.alias("_b1"), b2.alias("_b2"))


def _words(n: int, bits_per_row: int, max_bits: int) -> int:
    return max(64, min(max_bits, n * bits_per_row) // _WORD)


def _probed(docs: DataFrame, bits_per_row: int, max_bits: int) -> DataFrame:
    """_id, _h, _row and whether the text may repeat, for every row."""
    keys = _keys(docs)
    n = keys.count()  # from the files' footers
    ranges = max(1, -(-n * bits_per_row // max(max_bits, 64 * _WORD)))
    n_words = _words(-(-n // ranges), bits_per_row, max_bits)

    def one(part: DataFrame) -> DataFrame:
        slotted = _slotted(part, n_words)
        # at most max_bits / 64 rows of two longs: a proven bound
        return slotted.join(F.broadcast(_set_twice(slotted)), "_w", "left").select("_id", "_h", "_row", _maybe().alias("_maybe"))

    if ranges == 1:
        return one(keys)
    number = F.conv(F.hex(F.substring("_h", 11, 4)), 16, 10).cast("long") % ranges
    dealt = new_path(docs.sparkSession, "dedup-ranges")
    keys.withColumn("_range", number).write.partitionBy("_range").parquet(dealt)
    discard(keys)
    spark, out = docs.sparkSession, new_path(docs.sparkSession, "dedup-probed")
    schema = T.StructType([*keys.schema.fields, T.StructField("_range", T.LongType())])
    for k in range(ranges):
        one(spark.read.schema(schema).parquet(dealt).where(F.col("_range") == k)).write.parquet(f"{out}/part={k}")
    return spark.read.schema(T.StructType([*keys.schema.fields, T.StructField("_maybe", T.BooleanType())])).parquet(*[f"{out}/part={k}" for k in range(ranges)])


def _maybe(bits: str = "_bits") -> Column:
    return F.coalesce(F.expr(f"((shiftright({bits}, cast(_b1 as int)) & 1L) & (shiftright({bits}, cast(_b2 as int)) & 1L)) = 1L"), F.lit(False))


def _best() -> Column:
    """Orders the rows of a group: least id, null ids last, then the first copy of a repeated row."""
    return F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))


def exact_groups(docs: DataFrame, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256."""
    probed = _probed(docs, bits_per_row, max_bits)
    alone = probed.where(~F.col("_maybe")).select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_h")
    again = probed.where("_maybe")
    # written first, so that the join below shuffles both sides anew and can split a hot group
    groups = materialise(again.groupBy("_h").agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("_keep")), "dedup-groups")
    joined = again.join(groups, "_h").select("_id", F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_keep._row") == F.col("_row")).alias("kept"), "_h")
    return alone.unionByName(joined).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_h")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose hash is not in the filter of repeated hashes stream from the scan
    to the output.  The others meet the ids that stay; a hash that no group has
    was in the filter by chance, and its row stays.
    """
    again = _probed(docs, bits_per_row, max_bits).where("_maybe")
    groups = again.groupBy("_h").agg(F.min(_best()).alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    stay = materialise(groups.select("_h", F.col("_keep._id").alias("_id")), "dedup-stay")
    n_words = _words(stay.count(), bits_per_row, max_bits)
    w, b1, b2 = _slots(F.col("_h"), n_words)
    bits = stay.select(w.alias("_w"), b1.alias("_b1"), b2.alias("_b2"))
    # at most max_bits / 64 rows of two longs
    filter_words = materialise(bits.groupBy("_w").agg(F.expr("bit_or(shiftleft(1L, cast(_b1 as int)) | shiftleft(1L, cast(_b2 as int)))").alias("_bits")), "dedup-filter")
    names = docs.columns
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("doc_id").alias("_doc_id"), _digest(docs["text"]).alias("_hash"))
    w, b1, b2 = _slots(F.col("_hash"), n_words)
    mine = mine.select("_doc", "_doc_id", "_hash", w.alias("_w"), b1.alias("_b1"), b2.alias("_b2"))
    probed = mine.join(F.broadcast(filter_words), "_w", "left").withColumn("_maybe", _maybe())
    alone = probed.where(~F.col("_maybe")).select("_doc")
    met = probed.where("_maybe").join(stay, F.col("_hash") == stay["_h"], "left")
    chance = met.where(F.col("_h").isNull()).select("_doc")
    kept = met.where(F.col("_h").isNotNull() & F.col("_doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_h", "_id"]).select("_doc")
    return alone.unionByName(chance).unionByName(kept).select("_doc.*")


#: The query's rows in plain SQL.
ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256 FROM n JOIN g USING (h)
"""
