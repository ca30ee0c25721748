"""Tensors over the driver's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayq.session import q
from arrayq.tensor import Tensor


class Data:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*columns) if columns else df

    def size(self, name: str) -> int:
        """Rows of a table whose keys are 0, 1, ..: the extent of the key's dimension."""
        return self.table(name).count()

    def run(self, text: str, **bindings: object) -> object:
        return q(self.spark, text, **bindings)

    @cached_property
    def suppliers(self) -> int:
        return self.size("supplier")

    @cached_property
    def parts(self) -> int:
        return self.size("part")

    @cached_property
    def customers(self) -> int:
        return self.size("customer")

    @cached_property
    def quantity(self) -> Tensor:
        """Supplier x part: quantity sold (sparse)."""
        cells = self.table("lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"))
        return Tensor.of(cells, (self.suppliers, self.parts), 0, ["l_suppkey", "l_partkey"])

    @cached_property
    def price(self) -> Tensor:
        """Supplier x part: number of lines with a discount above 5 % (sparse)."""
        cells = self.table("lineitem", "l_suppkey", "l_partkey", "l_discount").where("l_discount > 0.05").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("v"))
        return Tensor.of(cells, (self.suppliers, self.parts), 0, ["l_suppkey", "l_partkey"])

    @cached_property
    def sold(self) -> Tensor:
        """Supplier x part: whether anything was sold (boolean)."""
        cells = self.table("lineitem", "l_suppkey", "l_partkey").distinct()
        return Tensor.of(cells, (self.suppliers, self.parts), 0, ["l_suppkey", "l_partkey"], None)

    @cached_property
    def embeddings(self) -> Tensor:
        """Vector x component (dense)."""
        cells = self.table("embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("c", "v")).select("vec_id", "c", F.col("v").cast("double").alias("v"))
        return Tensor(cells.select(F.col("vec_id").cast("int").alias("i0"), F.col("c").alias("i1"), "v"), (self.size("embeddings"), 64), 2, "double")

    @cached_property
    def sizes(self) -> Tensor:
        """Part: its size (dense)."""
        return Tensor.of(self.table("part", "p_partkey", "p_size").withColumn("p_size", F.col("p_size").cast("double")), (self.parts,), 1, ["p_partkey"], "p_size")

    @cached_property
    def event_types(self) -> list[str]:
        return [r[0] for r in self.table("events", "event_type").distinct().orderBy("event_type").collect()]

    @property
    def event_number(self) -> Column:
        """An event type's place among all in order."""
        return (F.array_position(F.lit(self.event_types), F.col("event_type")) - 1).cast("int")

    @cached_property
    def activity(self) -> Tensor:
        """User x event type: number of events (dense)."""
        users = self.table("events", "user_id").agg(F.max("user_id")).first()[0] + 1
        cells = self.table("events", "user_id", "event_type").select("user_id", self.event_number.alias("k")).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("v"))
        return Tensor.of(cells, (users, len(self.event_types)), 2, ["user_id", "k"])

    @cached_property
    def per_nation(self) -> Tensor:
        """Nation: number of suppliers (dense, with zeros)."""
        cells = self.table("supplier", "s_nationkey").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("v"))
        return Tensor.of(cells, (25,), 1, ["s_nationkey"])

    @cached_property
    def balances(self) -> Tensor:
        """Customer: account balance (dense)."""
        return Tensor.of(self.table("customer", "c_custkey", "c_acctbal"), (self.customers,), 1, ["c_custkey"], "c_acctbal")

    @cached_property
    def edges(self) -> DataFrame:
        """Customer to supplier, distinct; suppliers are numbered after the customers."""
        joined = self.table("lineitem", "l_orderkey", "l_suppkey").join(self.table("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(F.col("o_custkey").cast("int").alias("src"), (F.col("l_suppkey") + self.customers).cast("int").alias("dst")).distinct()
