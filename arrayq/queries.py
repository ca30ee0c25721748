"""One query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayq import workloads
from arrayq.data import Data
from arrayq.functions.monoids import user
from arrayq.operators import algebra, block, layouts
from arrayq.plans.checkpoint import checkpoint_dir
from arrayq.sources.text import text_file
from arrayq.tensor import Tensor

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[Data], DataFrame]], Callable[[Data], DataFrame]]:
    """Registers a query under its function's name."""

    def add(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def flat(x: Any, *names: str) -> DataFrame:
    """A tensor's cells, or a frame, with these column names; nested tuples are opened."""
    if isinstance(x, Tensor):
        return x.named(*names) if names else x.named(*x.indices, "v")
    columns = []
    for f in x.schema.fields:
        kind = f.dataType.simpleString()
        columns += [F.col(f"`{f.name}`.`{n}`") for n in f.dataType.names] if kind.startswith("struct") else [F.col(f"`{f.name}`")]
    out = x.select(*columns)
    return out.toDF(*names) if names else out


_A = "A AS (SELECT CAST(l_suppkey AS INT) i, CAST(l_partkey AS INT) j, SUM(l_quantity) v FROM lineitem GROUP BY 1, 2)"
_B = "B AS (SELECT CAST(l_suppkey AS INT) i, CAST(l_partkey AS INT) j, CAST(COUNT(*) AS DOUBLE) v FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2)"
_E = "E AS (SELECT CAST(vec_id AS INT) i, CAST(unnest(range(64)) AS INT) j, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings)"
_T = "T AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) k FROM (SELECT DISTINCT event_type FROM events))"
_U = _T + ", UU AS (SELECT CAST(unnest(range((SELECT max(user_id) + 1 FROM events))) AS INT) i), U AS (SELECT UU.i, T.k j, CAST(count(e.event_id) AS BIGINT) v FROM UU CROSS JOIN T LEFT JOIN events e ON e.user_id = UU.i AND e.event_type = T.event_type GROUP BY 1, 2)"
_N = "N AS (SELECT CAST(n_nationkey AS INT) i, CAST(count(s_suppkey) AS BIGINT) v FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)"
_BAL = "Bal AS (SELECT CAST(c_custkey AS INT) i, c_acctbal v FROM customer)"


# --- generators, projections, filters
@query("SELECT CAST(i AS INT) i, CAST(2 * i AS BIGINT) v FROM generate_series(3, 40) t(i)")
def range_gen(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (i, 2*i) | i <- 3..40 ]"), "i", "v")


@query("SELECT CAST(i AS INT) i, CAST(i * i AS BIGINT) v FROM generate_series(2, 50, 7) t(i)")
def range_step(d: Data) -> DataFrame:
    return flat(d.run("var W = tensor(60)[ (i, 0) | i <- 0..59 ]; for i = 2, 50, 7 do W[i] = i*i; tensor()(60)(W)"), "i", "v").withColumn("v", F.col("v").cast("bigint"))


@query("SELECT c_custkey AS k, round(c_acctbal * 2 + 1, 4) AS v FROM customer WHERE c_acctbal > 5000")
def proj_filter_let(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, round(w, 4)) | (k, b) <- C, b > 5000.0, let w = b*2 + 1 ]", C=d.table("customer", "c_custkey", "c_acctbal")), "k", "v")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 2 ELSE 0 END AS v FROM orders")
def match_case(d: Data) -> DataFrame:
    text = 'dataset[ (k, (s, p) match { case ("F", _) => 1; case ("O", x) if x > 200000.0 => 2; case _ => 0 }) | (k, s, p) <- O ]'
    return flat(d.run(text, O=d.table("orders", "o_orderkey", "o_orderstatus", "o_totalprice")), "k", "v")


@query("SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_acctbal < 0 THEN -s_acctbal ELSE s_acctbal END AS v FROM supplier")
def struct_access(d: Data) -> DataFrame:
    text = "dataset[ (r#key, r#name, if (r#bal < 0.0) -r#bal else r#bal) | x <- S, let r = <key = x#s_suppkey, name = x#s_name, bal = x#s_acctbal> ]"
    return flat(d.run(text, S=d.table("supplier", "s_suppkey", "s_name", "s_acctbal")), "k", "name", "v")


@query("SELECT p_partkey AS k, CAST(p_size // 7 AS BIGINT) AS q, CAST(p_size % 7 AS INT) AS r, CAST(greatest(p_size, 25) AS INT) AS m FROM part")
def int_arithmetic(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, s / 7, s % 7, max(s, 25)) | (k, s) <- P ]", P=d.table("part", "p_partkey", "p_size")), "k", "q", "r", "m")


@query("SELECT p_partkey AS k, len(string_split(p_name, ' ')) AS n, lower(p_brand) AS b FROM part")
def string_functions(d: Data) -> DataFrame:
    return flat(d.run('dataset[ (k, n.split(" ").length, b.toLowerCase) | (k, n, b) <- P ]', P=d.table("part", "p_partkey", "p_name", "p_brand")), "k", "n", "b")


@query("SELECT c_custkey AS k, round(c_acctbal * 0.5 + 10, 4) AS v FROM customer WHERE c_acctbal >= 0")
def language_function(d: Data) -> DataFrame:
    text = "def f(x: Double, y: Double): Double = { var z = x*y; return z + 10; }; var ok = (x) => x >= 0.0; dataset[ (k, round(f(b, 0.5), 4)) | (k, b) <- C, ok(b) ]"
    return flat(d.run(text, C=d.table("customer", "c_custkey", "c_acctbal")), "k", "v")


@query("SELECT c_custkey AS k, round(c_acctbal * c_acctbal, 3) AS v, upper(c_mktsegment) AS s FROM customer")
def host_functions(d: Data) -> DataFrame:
    out = d.run("dataset[ (k, round3(square(b)), shout(s)) | (k, b, s) <- C ]", C=d.table("customer", "c_custkey", "c_acctbal", "c_mktsegment"), square=lambda c: c * c, round3=lambda c: F.round(c, 3), shout=lambda c: F.upper(c))
    return flat(out, "k", "v", "s")


@query("SELECT r_regionkey AS k, length(r_name) * 10 AS v FROM region")
def host_udf(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, weight(n)) | (k, n) <- R ]", R=d.table("region", "r_regionkey", "r_name"), weight=lambda s: len(s) * 10, returns={"weight": "bigint"}), "k", "v")


# --- joins
@query("SELECT c_custkey AS c, o_orderkey AS o, o_totalprice AS v FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def equi_join(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (c, o, p) | (c, b) <- C, b > 9000.0, (o, cc, p) <- O, cc == c ]", C=d.table("customer", "c_custkey", "c_acctbal"), O=d.table("orders", "o_orderkey", "o_custkey", "o_totalprice")), "c", "o", "v")


@query("SELECT n_name AS n, CAST(count(*) AS BIGINT) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey AND CAST(s_suppkey % 5 AS INT) = CAST(c_custkey % 5 AS INT) GROUP BY 1")
def multi_key_join(d: Data) -> DataFrame:
    text = "dataset[ (n, c.length) | (c, cn) <- C, (nk, n) <- N, nk == cn, (s, sn) <- S, sn == nk, s % 5 == c % 5, group by n ]"
    return flat(d.run(text, C=d.table("customer", "c_custkey", "c_nationkey"), N=d.table("nation", "n_nationkey", "n_name"), S=d.table("supplier", "s_suppkey", "s_nationkey")), "n", "v")


@query("SELECT c_mktsegment AS s, sum(l_quantity) AS v FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def three_way_join(d: Data) -> DataFrame:
    text = "dataset[ (s, +/qty) | (c, s) <- C, (o, oc) <- O, oc == c, (lo, qty) <- L, lo == o, group by s ]"
    return flat(d.run(text, C=d.table("customer", "c_custkey", "c_mktsegment"), O=d.table("orders", "o_orderkey", "o_custkey"), L=d.table("lineitem", "l_orderkey", "l_quantity")), "s", "v")


@query("SELECT CAST(vec_id AS BIGINT) AS k, CAST(unnest(range(64)) AS INT) AS j, round(CAST(unnest(embedding) AS DOUBLE), 5) AS v FROM embeddings WHERE label = 1")
def dependent_join(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, j, round5(x: Double)) | (k, e, l) <- E, l == 1, (j, x) <- e ]", E=d.table("embeddings", "vec_id", "embedding", "label"), round5=lambda c: F.round(c.cast("double"), 5)), "k", "j", "v")


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM generate_series(0, 30) t(i), LATERAL (SELECT unnest(generate_series(i, least(i + 3, 30))) AS j)")
def dependent_range(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (i, j) | i <- 0..30, j <- i..min(i+3, 30) ]"), "i", "j")


@query("SELECT c_custkey AS c, coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 0) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def nested_correlated_sum(d: Data) -> DataFrame:
    text = "dataset[ (c, cents(+/[ p | (o, oc, p) <- O, oc == c, p > 100000.0 ])) | (c, b) <- C ]"
    out = d.run(text, C=d.table("customer", "c_custkey", "c_acctbal"), O=d.table("orders", "o_orderkey", "o_custkey", "o_totalprice"), cents=lambda c: F.round(c, 2))
    return flat(out, "c", "v")


_SQL["nested_correlated_sum"] = "SELECT c_custkey AS c, round(coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 0), 2) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


@query("SELECT c_custkey AS c, coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)), CAST([] AS BIGINT[])) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def nested_correlated_bag(d: Data) -> DataFrame:
    out = flat(d.run("dataset[ (c, [ o | (o, oc) <- O, oc == c ]) | (c, b) <- C ]", C=d.table("customer", "c_custkey", "c_acctbal"), O=d.table("orders", "o_orderkey", "o_custkey")), "c", "v")
    return out.withColumn("v", F.array_sort("v"))


@query("SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def nested_exists(d: Data) -> DataFrame:
    return flat(d.run("dataset[ n | (k, n) <- N, ||/[ b > 9000.0 | (sn, b) <- S, sn == k ] ]", N=d.table("nation", "n_nationkey", "n_name"), S=d.table("supplier", "s_nationkey", "s_acctbal")), "n")


@query("SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation")
def cross_product(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (r, n) | (rk, r) <- R, (nk, n) <- N ]", R=d.table("region", "r_regionkey", "r_name"), N=d.table("nation", "n_nationkey", "n_name")), "r", "n")


@query("SELECT r.r_regionkey AS r, n.n_nationkey AS n FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey")
def theta_join(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (r, n) | (r, rn) <- R, (n, nr) <- N, r < nr ]", R=d.table("region", "r_regionkey", "r_name"), N=d.table("nation", "n_nationkey", "n_regionkey")), "r", "n")


# --- aggregation
def _total(name: str, text: str, sql: str, kind: str) -> None:
    def run(d: Data) -> DataFrame:
        value = d.run(text, L=d.table("lineitem", "l_quantity", "l_discount"), S=d.table("region", "r_regionkey"))
        return d.spark.createDataFrame([(value,)], f"v {kind}")

    run.__name__ = f"total_agg_{name}"
    query(sql)(run)


_total("sum", "+/[ q | (q, x) <- L ]", "SELECT sum(l_quantity) AS v FROM lineitem", "double")
_total("prod", "*/[ k + 1.0 | k <- S ]", "SELECT product(r_regionkey + 1) AS v FROM region", "double")
_total("min", "min/[ x | (q, x) <- L ]", "SELECT min(l_discount) AS v FROM lineitem", "double")
_total("max", "max/[ q | (q, x) <- L ]", "SELECT max(l_quantity) AS v FROM lineitem", "double")
_total("and", "&&/[ q > 0.0 | (q, x) <- L ]", "SELECT bool_and(l_quantity > 0) AS v FROM lineitem", "boolean")
_total("or", "||/[ q > 49.5 | (q, x) <- L ]", "SELECT bool_or(l_quantity > 49.5) AS v FROM lineitem", "boolean")


@query("SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS q, max(l_discount) AS m, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def group_multi_agg(d: Data) -> DataFrame:
    text = "dataset[ (f, s, +/q, max/x, q.length) | (f, s, q, x) <- L, group by (f, s) ]"
    return flat(d.run(text, L=d.table("lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")), "f", "s", "q", "m", "n")


@query("SELECT l_suppkey AS k, round(sum(l_quantity) / count(*), 6) AS v FROM lineitem GROUP BY 1")
def group_avg_expr(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, round6((+/q) / q.length)) | (k, q) <- L, group by k ]", L=d.table("lineitem", "l_suppkey", "l_quantity"), round6=lambda c: F.round(c, 6)), "k", "v")


@query("SELECT event_type AS t, CAST(count(*) AS BIGINT) AS v FROM events GROUP BY 1")
def group_count(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (t, e.length) | (e, t) <- E, group by t ]", E=d.table("events", "event_id", "event_type")), "t", "v")


@query("SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 900 AND count(*) > 30")
def group_having(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, s) | (k, q) <- L, group by k, let s = +/q, s > 900.0, q.length > 30 ]", L=d.table("lineitem", "l_partkey", "l_quantity")), "k", "v")


@query("SELECT CAST(l_partkey % 10 AS BIGINT) AS k, l_returnflag AS f, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def group_expr_key(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, f, +/q) | (p, fl, q) <- L, group by (k, f): (p % 10, fl) ]", L=d.table("lineitem", "l_partkey", "l_returnflag", "l_quantity")), "k", "f", "v")


@query("SELECT n_regionkey AS k, list_sort(list(n_name)) AS v FROM nation GROUP BY 1")
def group_bag(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, n) | (k, n) <- N, group by k ]", N=d.table("nation", "n_regionkey", "n_name")), "k", "v").withColumn("v", F.array_sort("v"))


@query("SELECT CAST(k % 3 AS BIGINT) AS m, max(s) AS v FROM (SELECT l_suppkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1) GROUP BY 1")
def group_nested(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (m, max/s) | (k, q) <- L, group by k, let s = +/q, group by m: k % 3 ]", L=d.table("lineitem", "l_suppkey", "l_quantity")), "m", "v")


@query("SELECT l_suppkey AS k, sum(CASE WHEN l_discount > 0.05 THEN l_quantity * l_quantity ELSE 0 END) AS v FROM lineitem GROUP BY 1")
def group_map_reduce(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, +/[ y*y | (y, x) <- w, x > 0.05 ]) | (k, q, dis) <- L, let w = (q, dis), group by k ]", L=d.table("lineitem", "l_suppkey", "l_quantity", "l_discount")), "k", "v")


@query("SELECT sum(l_quantity) AS v FROM lineitem")
def group_constant_key(d: Data) -> DataFrame:
    return flat(d.run("dataset[ +/q | q <- L, group by k: 1 ]", L=d.table("lineitem", "l_quantity")), "v")


@query("SELECT s_nationkey AS k, arg_max(s_acctbal, abs(s_acctbal)) AS v FROM supplier GROUP BY 1")
def user_monoid(d: Data) -> DataFrame:
    larger = user("larger", lambda a, b: F.when(F.abs(a) >= F.abs(b), a).otherwise(b))
    return flat(d.run("dataset[ (k, larger/b) | (k, b) <- S, group by k ]", S=d.table("supplier", "s_nationkey", "s_acctbal"), monoids={"larger": larger}), "k", "v")


@query("SELECT n_regionkey AS k, max(n_nationkey) AS v FROM nation GROUP BY 1")
def reduce_by_key(d: Data) -> DataFrame:
    return flat(d.run("N.reduceByKey((a, b) => max(a, b))", N=d.table("nation", "n_regionkey", "n_nationkey")), "k", "v")


# --- stores and scans
@query(f"WITH {_A} SELECT i, j, v FROM A WHERE v <> 0")
def sparse_store(d: Data) -> DataFrame:
    text = "tensor()(n,m)[ ((s,p), +/q) | (s,p,q) <- L, group by (s,p) ]"
    return flat(d.run(text, L=d.table("lineitem", "l_suppkey", "l_partkey", "l_quantity"), n=d.suppliers, m=d.parts), "i", "j", "v")


@query(f"WITH {_N} SELECT i, v FROM N")
def dense_store(d: Data) -> DataFrame:
    return flat(d.run("tensor(25)[ (n, k.length) | (k, n) <- S, group by n ]", S=d.table("supplier", "s_suppkey", "s_nationkey")), "i", "v")


@query("SELECT DISTINCT CAST(l_suppkey AS INT) AS i, CAST(l_partkey AS INT) AS j, true AS v FROM lineitem WHERE l_quantity > 45")
def bool_store(d: Data) -> DataFrame:
    text = "tensor()(n,m)[ ((s,p), ||/b) | (s,p,q) <- L, let b = q > 45.0, group by (s,p) ]"
    return flat(d.run(text, L=d.table("lineitem", "l_suppkey", "l_partkey", "l_quantity"), n=d.suppliers, m=d.parts), "i", "j", "v")


@query("SELECT CAST(i // 4 AS INT) AS i, CAST(i % 4 AS INT) AS j, CASE WHEN i % 4 > i // 4 THEN (i // 4) * 10.0 + i % 4 ELSE 0.0 END AS v FROM generate_series(0, 19) t(i)")
def mixed_layout(d: Data) -> DataFrame:
    return flat(d.run("var M = tensor(5)(4)[ ((i,j), i*10.0 + j) | i <- 0..4, j <- 0..3, j > i ]; tensor(5,4)(M)"), "i", "j", "v")


@query(f"WITH {_U}, R AS (SELECT user_id i, T.k j, count(*) c FROM events JOIN T USING (event_type) WHERE value > 50 GROUP BY 1, 2) SELECT U.i, U.j, CAST(3 * U.v - 2 * coalesce(R.c, 0) AS BIGINT) AS v FROM U LEFT JOIN R USING (i, j)")
def full_scan_add(d: Data) -> DataFrame:
    text = "tensor(n,m)[ ((u,t), 3*all - 2*some) | ((w,k),some) <= R, ((u,t),all) <= S, t == k, u == w ]"
    some = d.table("events").where("value > 50").groupBy("user_id", d.event_number.alias("k")).agg(F.count(F.lit(1)).alias("v"))
    n, m = d.activity.dims
    return flat(d.run(text, S=d.activity.sparse(), R=Tensor.of(some, (n, m), 0, ["user_id", "k"]), n=n, m=m), "i", "j", "v")


# --- tensor algebra
def _cellwise(name: str, op: str) -> None:
    def run(d: Data) -> DataFrame:
        return flat(d.run(f"A {op} B", A=d.quantity, B=d.price), "i", "j", "v").withColumn("v", F.round("v", 6))

    run.__name__ = f"cellwise_{name}"
    query(f"WITH {_A}, {_B} SELECT i, j, round(v, 6) AS v FROM (SELECT A.i, A.j, A.v {op} B.v AS v FROM A JOIN B ON A.i = B.i AND A.j = B.j) WHERE v <> 0")(run)


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    _cellwise(_name, _op)


@query(f"WITH {_N} SELECT i, CAST((v * 2 + 3) AS BIGINT) AS v FROM N")
def scalar_ops(d: Data) -> DataFrame:
    return flat(d.run("2*V + 3", V=d.per_nation), "i", "v")


@query(f"WITH {_A}, {_B} SELECT A.i AS i, B.i AS j, sum(A.v * B.v) AS v FROM A JOIN B ON A.j = B.j GROUP BY 1, 2 HAVING sum(A.v * B.v) <> 0")
def matmul_sparse(d: Data) -> DataFrame:
    """Suppliers that sell the same parts: quantities of one against discounted lines of the other."""
    return flat(d.run("Sold @ Discounted.t", Sold=d.quantity, Discounted=d.price), "i", "j", "v")


@query(f"WITH {_A}, P AS (SELECT CAST(p_partkey AS INT) j, CAST(p_size AS DOUBLE) v FROM part) SELECT A.i, sum(A.v * P.v) AS v FROM A JOIN P USING (j) GROUP BY 1")
def matvec(d: Data) -> DataFrame:
    return flat(d.run("A @ V", A=d.quantity, V=d.sizes), "i", "v")


@query(f"WITH {_A} SELECT j AS i, i AS j, v FROM A")
def transpose(d: Data) -> DataFrame:
    return flat(d.run("A.t", A=d.quantity), "i", "j", "v")


@query(f"WITH {_U} SELECT i, CAST((v * 2 + 1 - v) * v AS BIGINT) AS v, j FROM U")
def chain_expr(d: Data) -> DataFrame:
    return flat(d.run("(U*2 + 1 - U) * U", U=d.activity), "i", "j", "v")


@query(f"WITH {_U} SELECT x.j AS i, y.j AS j, CAST(sum((x.v - 1) * (y.v + 2)) AS BIGINT) AS v FROM U x JOIN U y ON x.i = y.i GROUP BY 1, 2")
def chain_matmul(d: Data) -> DataFrame:
    return flat(d.run("(U - 1).t @ (U + 2)", U=d.activity), "i", "j", "v")


@query(f"WITH {_U} SELECT CAST(i - 2 AS INT) AS i, CAST(j - 1 AS INT) AS j, v FROM U WHERE i BETWEEN 2 AND 9 AND j BETWEEN 1 AND 3")
def slice(d: Data) -> DataFrame:
    return flat(d.run("U[2:9, 1:3]", U=d.activity), "i", "j", "v")


@query(f"WITH {_U} SELECT CAST((i - 1) // 3 AS INT) AS i, v FROM U WHERE i BETWEEN 1 AND 20 AND (i - 1) % 3 = 0 AND j = 2")
def slice_stride(d: Data) -> DataFrame:
    return flat(d.run("U[1:20:3, 2]", U=d.activity), "i", "v")


@query(f"WITH {_U} SELECT CAST((i + 7) % (SELECT max(i) + 1 FROM UU) AS INT) AS i, CAST((j + 2) % 5 AS INT) AS j, v FROM U")
def rotate(d: Data) -> DataFrame:
    text = "tensor(n,5)[ (((user + 7) % n, (kind + 2) % 5), times) | ((user,kind),times) <- U ]"
    return flat(d.run(text, U=d.activity, n=d.activity.dims[0]), "i", "j", "v")


@query(f"WITH {_N} SELECT CAST(i + 3 AS INT) AS i, v FROM N WHERE i < 22 UNION ALL SELECT CAST(k AS INT), CAST(0 AS BIGINT) FROM generate_series(0, 2) t(k)")
def shift(d: Data) -> DataFrame:
    return flat(algebra.shifted(d.per_nation, (3,), wrap=False), "i", "v")


@query(f"WITH {_A} SELECT i, j, v FROM A WHERE i = j")
def diag(d: Data) -> DataFrame:
    return flat(d.run("tensor()(n,m)[ ((i,j),a) | ((i,j),a) <- A, i == j ]", A=d.quantity, n=d.suppliers, m=d.parts), "i", "j", "v")


@query(f"WITH {_A} SELECT i, j, v FROM A WHERE j >= i AND j - i <= 5")
def banded(d: Data) -> DataFrame:
    return flat(d.run("tensor()(n,m)[ ((i,j),a) | ((i,j),a) <- A, j >= i, j - i <= 5 ]", A=d.quantity, n=d.suppliers, m=d.parts), "i", "j", "v")


@query(f"WITH {_U} SELECT i, CAST(sum(v) AS BIGINT) AS v FROM U GROUP BY 1")
def row_sum(d: Data) -> DataFrame:
    return flat(d.run("[ (i, +/a) | ((i,j),a) <- U, group by i ]", U=d.activity), "i", "v")


@query(f"WITH {_U} SELECT j AS i, max(v) AS v FROM U GROUP BY 1")
def col_max(d: Data) -> DataFrame:
    return flat(algebra.reduced(d.activity, "max", [1]), "i", "v")


@query(f"WITH {_A}, S AS (SELECT CAST(p_partkey AS INT) j, CAST(p_size AS DOUBLE) s FROM part) SELECT A.i, A.j, A.v * S.s AS v FROM A JOIN S USING (j) WHERE S.s > 40")
def vec_bcast(d: Data) -> DataFrame:
    """A vector over parts against every supplier's row."""
    text = "dataset[ (supplier, part, sold * size) | ((supplier,part),sold) <- A, (k,size) <- Sizes, k == part, size > 40.0 ]"
    return flat(d.run(text, A=d.quantity, Sizes=d.sizes), "i", "j", "v")


@query(f"WITH {_A}, S AS (SELECT CAST(p_partkey AS INT) j, CAST(p_size AS DOUBLE) s FROM part), Q AS (SELECT n i, coalesce(v, 0.0) v FROM range(25) r(n) LEFT JOIN (SELECT s_nationkey n, sum(A.v * S.s) v FROM A JOIN S USING (j) JOIN supplier ON s_suppkey = A.i GROUP BY 1) USING (n)) SELECT CAST(i AS INT) AS i, v FROM Q")
def contract3(d: Data) -> DataFrame:
    """A matrix against a vector on one side and a matrix on the other, summed over both shared indices."""
    home = Tensor.of(d.table("supplier", "s_suppkey", "s_nationkey").withColumn("v", F.lit(1.0)), (d.suppliers, 25), 0, ["s_suppkey", "s_nationkey"])
    text = "tensor(25)[ (nation, +/x) | ((s,p),sold) <- A, (k,size) <- Sizes, k == p, ((m,nation),one) <- Home, m == s, let x = sold*size*one, group by nation ]"
    return flat(d.run(text, A=d.quantity, Sizes=d.sizes, Home=home), "i", "v")


@query(f"WITH {_U} SELECT x.j AS i, y.j AS j, max(x.v + y.v) AS v FROM U x JOIN U y ON x.i = y.i GROUP BY 1, 2")
def maxplus(d: Data) -> DataFrame:
    text = "tensor(5,5)[ ((i,j), max/v) | ((n,i),a) <- U, ((m,j),b) <- W, m == n, let v = a+b, group by (i,j) ]"
    return flat(d.run(text, U=d.activity, W=Tensor(d.activity.df, d.activity.dims, 2, d.activity.kind)), "i", "j", "v")


@query(f"WITH {_A}, {_B} SELECT A.j AS i, max(A.v - 5 * B.v) AS v FROM A JOIN B USING (i, j) GROUP BY 1")
def fused_three(d: Data) -> DataFrame:
    """Three tensors met and reduced in one comprehension."""
    text = "dataset[ (part, max/gap) | ((s,part),sold) <- A, ((m,k),lines) <- B, m == s, k == part, ((o,l),yes) <- C, o == m, l == k, yes, let gap = sold - 5.0*lines, group by part ]"
    return flat(d.run(text, A=d.quantity, B=d.price, C=d.sold), "i", "v")


@query(f"WITH {_E} SELECT x.i AS i, y.i AS j, round(sum(x.v * y.v), 4) AS v FROM E x JOIN E y ON x.j = y.j GROUP BY 1, 2")
def gram_embeddings_coo(d: Data) -> DataFrame:
    return flat(d.run("E @ E.t", E=d.embeddings), "i", "j", "v").withColumn("v", F.round("v", 4))


@query(f"WITH {_E} SELECT x.i AS i, y.i AS j, round(sum(x.v * y.v), 4) AS v FROM E x JOIN E y ON x.j = y.j GROUP BY 1, 2")
def gram_embeddings_block(d: Data) -> DataFrame:
    e = d.embeddings
    return flat(block.matmul(e, e.t), "i", "j", "v").withColumn("v", F.round("v", 4))


@query(f"WITH {_E} SELECT i, j, round(v, 5) AS v FROM E")
def block_layout(d: Data) -> DataFrame:
    return flat(block.blocked(d.embeddings, 100), "i", "j", "v").withColumn("v", F.round("v", 5))


@query(f"WITH {_A}, {_B} SELECT coalesce(A.i, B.i) AS i, coalesce(A.j, B.j) AS j, CASE WHEN A.v IS NULL THEN B.v WHEN B.v IS NULL THEN A.v ELSE greatest(A.v, B.v) END AS v FROM A FULL JOIN B ON A.i = B.i AND A.j = B.j")
def merge_tensors(d: Data) -> DataFrame:
    return flat(algebra.merged(d.quantity, d.price, "max"), "i", "j", "v")


@query(f"WITH {_A}, {_B} SELECT coalesce(A.i, B.i) AS i, coalesce(A.j, B.j) AS j, coalesce(B.v, A.v) AS v FROM A FULL JOIN B ON A.i = B.i AND A.j = B.j")
def merge_override(d: Data) -> DataFrame:
    return flat(algebra.overridden(d.quantity, d.price), "i", "j", "v")


@query("SELECT DISTINCT CAST(l_suppkey AS INT) AS i, CAST(l_partkey AS INT) AS j, true AS v FROM lineitem WHERE l_discount > 0.05")
def bool_and(d: Data) -> DataFrame:
    some = d.table("lineitem").where("l_discount > 0.05").select("l_suppkey", "l_partkey").distinct()
    other = Tensor.of(some, d.sold.dims, 0, ["l_suppkey", "l_partkey"], None)
    return flat(d.run("A && B", A=d.sold, B=other), "i", "j", "v")


# --- updates and loops
@query(f"WITH {_N} SELECT i, CASE WHEN i BETWEEN 5 AND 12 THEN CAST(i * 100 AS BIGINT) ELSE v END AS v FROM N")
def update_array(d: Data) -> DataFrame:
    return flat(d.run("for i = 5, 12 do V[i] = i*100; V", V=d.per_nation), "i", "v")


@query(f"WITH {_N}, C AS (SELECT c_nationkey i, CAST(count(*) AS BIGINT) c FROM customer GROUP BY 1) SELECT N.i, CAST(N.v + coalesce(C.c, 0) AS BIGINT) AS v FROM N LEFT JOIN C USING (i)")
def increment_array(d: Data) -> DataFrame:
    return flat(d.run("for (c, n) in C do V[n] += 1; V", V=d.per_nation, C=d.table("customer", "c_custkey", "c_nationkey")), "i", "v")


@query("SELECT CAST(n_nationkey AS INT) AS i, CAST(n_nationkey AS BIGINT) AS a, CAST(count(s_suppkey) AS BIGINT) AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def nested_update(d: Data) -> DataFrame:
    cells = d.table("nation", "n_nationkey").select(F.col("n_nationkey").alias("i0"), F.struct(F.col("n_nationkey").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("v"))
    out = d.run("for (k, n) in S do V[n]#b += 1; V", V=Tensor.of(cells, (25,), 0), S=d.table("supplier", "s_suppkey", "s_nationkey"))
    return flat(out.named("i", "x"), "i", "a", "b")


@query(f"WITH {_N} SELECT i, CAST(CASE WHEN v > 3 THEN 0 ELSE v + 10 END AS BIGINT) AS v FROM N")
def guarded_update(d: Data) -> DataFrame:
    return flat(d.run("for i = 0, 24 do if (V[i] > 3) V[i] = 0; else V[i] = V[i] + 10; V", V=d.per_nation), "i", "v")


@query("SELECT CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS v FROM customer")
def scalar_increment(d: Data) -> DataFrame:
    value = d.run("var s = 0; for i = 0, n do if (B[i] > 0.0) s += 1; s", B=d.balances, n=d.customers - 1)
    return d.spark.createDataFrame([(int(value),)], "v bigint")


@query(f"WITH {_U} SELECT x.j AS i, y.j AS j, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM U x JOIN U y ON x.i = y.i GROUP BY 1, 2")
def loop_matmul(d: Data) -> DataFrame:
    text = """
    var R = tensor(5,5)[ ((i,j), 0L) | i <- 0..4, j <- 0..4 ];
    for i = 0, 4 do for j = 0, 4 do { R[i,j] = 0L; for k = 0, n-1 do R[i,j] += U[k,i]*W[k,j]; };
    R"""
    return flat(d.run(text, U=d.activity, W=Tensor(d.activity.df, d.activity.dims, 2, d.activity.kind), n=d.activity.dims[0]), "i", "j", "v")


@query(f"WITH {_N} SELECT i, CAST(v * 8 AS BIGINT) AS v FROM N")
def seq_for_power(d: Data) -> DataFrame:
    return flat(d.run("for k = 1, 3 do V = V*2; V", V=d.per_nation), "i", "v")


@query(f"WITH {_N} SELECT i, CAST(v + 4 AS BIGINT) AS v FROM N")
def while_loop(d: Data) -> DataFrame:
    return flat(d.run("var k = 0; while (k < 4) { V = V + 1; k += 1; }; V", V=d.per_nation), "i", "v")


# --- rewrites
@query(f"WITH {_A} SELECT i, j, v * v + v AS v FROM A")
def selfjoin_elim(d: Data) -> DataFrame:
    return flat(d.run("tensor()(n,m)[ ((i,j), a*b+a) | ((i,j),a) <- A, ((ii,jj),b) <- A, ii == i, jj == j ]", A=d.quantity, n=d.suppliers, m=d.parts), "i", "j", "v")


@query(f"WITH {_BAL} SELECT CAST((i - 1) / 2 AS INT) AS i, v FROM Bal WHERE i % 2 = 1 AND i <= 199")
def range_elim(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (i, b) | i <- 0..99, (j, b) <- B, j == 2*i + 1 ]", B=d.balances), "i", "v")


@query(f"WITH {_A} SELECT i, j, v FROM A")
def unique_group_elim(d: Data) -> DataFrame:
    return flat(d.run("tensor()(n,m)[ ((i,j), +/a) | ((i,j),a) <- A, group by (i,j) ]", A=d.quantity, n=d.suppliers, m=d.parts), "i", "j", "v")


# --- workloads
_G = "C0 AS (SELECT count(*) n FROM customer), M AS (SELECT (SELECT n FROM C0) + (SELECT count(*) FROM supplier) n), G AS (SELECT DISTINCT o_custkey i, l_suppkey + (SELECT n FROM C0) j FROM lineitem JOIN orders ON l_orderkey = o_orderkey), D AS (SELECT i, count(*) c FROM G GROUP BY 1), NODES AS (SELECT unnest(range((SELECT n FROM M))) i), P0 AS (SELECT i, 1.0 / (SELECT n FROM M) v FROM NODES)"


def _rank(k: int) -> str:
    return f"P{k} AS (SELECT NODES.i, 0.85 * coalesce(s.v, 0) + 0.15 / (SELECT n FROM M) AS v FROM NODES LEFT JOIN (SELECT G.j, sum(p.v / D.c) v FROM G JOIN D USING (i) JOIN P{k - 1} p USING (i) GROUP BY 1) s ON s.j = NODES.i)"


@query(f"WITH {_G}, {_rank(1)}, {_rank(2)}, {_rank(3)} SELECT CAST(i AS INT) AS i, round(v, 8) AS v FROM P3")
def pagerank3(d: Data) -> DataFrame:
    out = workloads.pagerank(d.spark, d.edges, d.customers + d.suppliers, 3)
    return flat(out, "i", "v").withColumn("v", F.round("v", 8))


_X = "X AS (SELECT i, j, v / 100.0 AS v FROM U)"


@query(
    f"WITH {_U}, {_X}, T0 AS (SELECT k j, 0.5 v FROM T), Y AS (SELECT i, sum(v) v FROM X GROUP BY 1), "
    + ", ".join(f"R{k} AS (SELECT X.i, sum(X.v * t.v) - any_value(Y.v) v FROM X JOIN T{k - 1} t USING (j) JOIN Y USING (i) GROUP BY 1), T{k} AS (SELECT t.j, t.v - 0.001 * g.v AS v FROM T{k - 1} t JOIN (SELECT X.j, sum(X.v * R{k}.v) v FROM X JOIN R{k} USING (i) GROUP BY 1) g USING (j))" for k in (1, 2))
    + " SELECT CAST(j AS INT) AS i, round(v, 6) AS v FROM T2"
)
def linreg2(d: Data) -> DataFrame:
    x = d.activity * 0.01
    y = algebra.reduced(x, "+", [0])
    theta = d.run("tensor(5)[ (i, 0.5) | i <- 0..4 ]")
    return flat(workloads.regress(d.spark, x, y, theta, 2, 0.001), "i", "v").withColumn("v", F.round("v", 6))


@query(
    "WITH R AS (SELECT CAST(l_suppkey AS INT) i, CAST(l_partkey AS INT) j, round(sum(l_quantity) / 100.0, 3) v FROM lineitem GROUP BY 1, 2), "
    "P AS (SELECT CAST(s_suppkey AS INT) i, CAST(b AS INT) k, CAST(s_suppkey % 7 + b + 1 AS DOUBLE) / 50 v FROM supplier, range(2) y(b)), Q AS (SELECT CAST(b AS INT) k, CAST(p_partkey AS INT) j, CAST(b + p_partkey % 9 + 1 AS DOUBLE) / 40 v FROM range(2) y(b), part), "
    "E AS (SELECT R.i, R.j, R.v - s.v AS v FROM R JOIN (SELECT P.i, Q.j, sum(P.v * Q.v) v FROM P JOIN Q USING (k) GROUP BY 1, 2) s USING (i, j)), "
    "DP AS (SELECT E.i, Q.k, sum(2 * 0.01 * E.v * Q.v) v FROM E JOIN Q USING (j) GROUP BY 1, 2) "
    "SELECT P.i, P.k AS j, round(P.v + coalesce(DP.v, 0) - 0.01 * 0.02 * P.v, 8) AS v FROM P LEFT JOIN DP USING (i, k)"
)
def factor1(d: Data) -> DataFrame:
    r = d.quantity.with_df(d.quantity.df.withColumn("v", F.round(F.col("v") / 100.0, 3)))
    p = d.run("tensor(n,2)[ ((i,k), (i % 7 + k + 1)/50.0) | i <- 0..n-1, k <- 0..1 ]", n=d.suppliers)
    w = d.run("tensor(2,m)[ ((k,j), (k + j % 9 + 1)/40.0) | k <- 0..1, j <- 0..m-1 ]", m=d.parts)
    out, _ = workloads.factorise(d.spark, r, p, w, 1, 0.01, 0.02)
    return flat(out, "i", "j", "v").withColumn("v", F.round("v", 8))


@query(f"WITH {_E}, W AS (SELECT CAST(a AS INT) j, CAST(b AS INT) k, ((a * 7 + b * 3) % 11 - 5) / 10.0 v FROM range(64) x(a), range(6) y(b)) SELECT E.i, W.k AS j, round(greatest(0, sum(E.v * W.v)), 5) AS v FROM E JOIN W USING (j) GROUP BY 1, 2")
def relu_layer(d: Data) -> DataFrame:
    w = d.run("tensor(64,6)[ ((i,j), ((i*7 + j*3) % 11 - 5)/10.0) | i <- 0..63, j <- 0..5 ]")
    return flat(d.run("[ ((i,j), max(0.0, z)) | ((i,j),z) <- Z ]", Z=d.embeddings @ w), "i", "j", "v").withColumn("v", F.round("v", 5))


@query(
    f"WITH {_U}, {_X}, W1 AS (SELECT a j, b k, (a + b + 1) / 20.0 v FROM range(5) x(a), range(3) y(b)), W2 AS (SELECT b k, (b + 1) / 10.0 v FROM range(3) y(b)), "
    "Z AS (SELECT X.i, W1.k, sum(X.v * W1.v) v FROM X JOIN W1 USING (j) GROUP BY 1, 2), E AS (SELECT Z.i, sum(greatest(0, Z.v) * W2.v) - 1 v FROM Z JOIN W2 USING (k) GROUP BY 1), "
    "DZ AS (SELECT Z.i, Z.k, CASE WHEN Z.v > 0 THEN E.v * W2.v ELSE 0 END v FROM Z JOIN E USING (i) JOIN W2 USING (k)), DW AS (SELECT X.j, DZ.k, sum(X.v * DZ.v) v FROM X JOIN DZ USING (i) GROUP BY 1, 2) "
    "SELECT CAST(W1.j AS INT) AS i, CAST(W1.k AS INT) AS j, round(W1.v - 0.0001 * DW.v, 6) AS v FROM W1 JOIN DW USING (j, k)"
)
def network_step(d: Data) -> DataFrame:
    x, y = d.activity * 0.01, d.run("tensor(n,1)[ ((i,j), 1.0) | i <- 0..n-1, j <- 0..0 ]", n=d.activity.dims[0])
    w1 = d.run("tensor(5,3)[ ((i,j), (i+j+1)/20.0) | i <- 0..4, j <- 0..2 ]")
    w2 = d.run("tensor(3,1)[ ((i,j), (i+1)/10.0) | i <- 0..2, j <- 0..0 ]")
    out, _ = workloads.train_network(d.spark, x, y, w1, w2, 1, 0.0001)
    return flat(out, "i", "j", "v").withColumn("v", F.round("v", 6))


# --- text, maps, ragged vectors, user layouts
@query("SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def text_wordcount(d: Data) -> DataFrame:
    return flat(d.run('dataset[ (w, t.length) | t <- D, w <- t.split(" "), group by w ]', D=d.table("documents", "text")), "w", "n").withColumn("n", F.col("n").cast("bigint"))


@query("SELECT n_regionkey AS k, n_name AS name, CAST(n_nationkey AS INT) AS v FROM nation")
def map_layout(d: Data) -> DataFrame:
    held = layouts.as_map(d.table("nation"), "n_name", "n_nationkey", "n_regionkey")
    return flat(d.run("dataset[ (r, k, v) | (r, m) <- M, (k, v) <- m ]", M=held), "k", "name", "v")


@query("SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS p, o_orderkey AS v FROM orders")
def ragged_layout(d: Data) -> DataFrame:
    held = layouts.ragged(d.table("orders", "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "o_orderkey")
    return flat(d.run("dataset[ (k, p, x) | (k, row) <- F, (p, x) <- row ]", F=held), "k", "p", "v")


@query("SELECT n_nationkey AS i, CAST(n_regionkey * 2 AS BIGINT) AS v FROM nation")
def user_layout(d: Data) -> DataFrame:
    text = """
    typemap pairs[T] ( n: Int ): vector[T] {
      def view ( S: list[T] ) = [ (i, v) | (i, v) <- S ];
      def store ( L: list[T] ) = [ (i, v*2) | (i, v) <- L ];
    };
    var P = pairs([ (i, v) | (i, v) <- N ]);
    dataset[ (i, v) | (i, v) <- lift(pairs, P) ]"""
    return flat(d.run(text, N=d.table("nation", "n_nationkey", "n_regionkey")), "i", "v")


@query("SELECT n_nationkey AS k, 'nation ' || n_name || ' of region ' || n_regionkey AS v FROM nation")
def format_strings(d: Data) -> DataFrame:
    return flat(d.run('dataset[ (k, "nation %s of region %d".format(n, r)) | (k, n, r) <- N ]', N=d.table("nation", "n_nationkey", "n_name", "n_regionkey")), "k", "v")


@query("SELECT CAST(i AS INT) AS i, CAST(3 * i AS BIGINT) AS v FROM (SELECT unnest([9, 7, 5, 3, 1]) AS i)")
def range_falling(d: Data) -> DataFrame:
    return flat(d.run("var R = range(9, 1, -2); dataset[ (i, 3*i) | i <- R ]"), "i", "v")


@query("SELECT n_nationkey AS k, x AS m FROM nation CROSS JOIN (SELECT unnest([2, 3, 5]) AS x) WHERE n_nationkey % x = 0")
def list_source(d: Data) -> DataFrame:
    return flat(d.run("var P = [2, 3, 5]; dataset[ (k, p) | k <- N, p <- P, k % p == 0 ]", N=d.table("nation", "n_nationkey")), "k", "m")


@query("SELECT r_regionkey AS k, (SELECT CAST(count(*) AS BIGINT) FROM nation WHERE n_nationkey > 20) + r_regionkey AS v FROM region")
def uncorrelated_bag(d: Data) -> DataFrame:
    out = d.run("dataset[ (r, bag) | r <- R, let bag = [ n | n <- N, n > 20 ] ]", R=d.table("region", "r_regionkey"), N=d.table("nation", "n_nationkey"))
    held = flat(out, "k", "bag")
    return held.select("k", (F.size("bag").cast("bigint") + F.col("k")).alias("v"))


@query("SELECT l_returnflag AS k, round(sqrt(sum(l_quantity * l_quantity)), 4) AS v FROM lineitem GROUP BY 1")
def finished_monoid(d: Data) -> DataFrame:
    """A user aggregate with partial aggregation and a last step, over groups of a third of all rows."""
    norm = user("norm", lambda a, b: a + b, finish=lambda s: F.round(F.sqrt(s), 4), kind="double")
    return flat(d.run("dataset[ (f, norm/x) | (f, q) <- L, let x = q*q, group by f ]", L=d.table("lineitem", "l_returnflag", "l_quantity"), monoids={"norm": norm}), "k", "v")


@query("SELECT CAST(max(o_orderkey) AS BIGINT) AS v FROM orders")
def reduce_method(d: Data) -> DataFrame:
    value = d.run("O.reduce((a, b) => if (a > b) a else b)", O=d.table("orders", "o_orderkey"))
    return d.spark.createDataFrame([(value,)], "v bigint")


@query("SELECT n_regionkey AS k, CAST(count(*) AS INT) AS v FROM nation GROUP BY 1")
def group_by_key(d: Data) -> DataFrame:
    return flat(d.run("N.groupByKey()", N=d.table("nation", "n_regionkey", "n_nationkey")), "k", "v").withColumn("v", F.size("v"))


@query(f"WITH {_U} SELECT CAST(sum(v) AS BIGINT) AS v FROM U")
def total_of_tensor(d: Data) -> DataFrame:
    return d.spark.createDataFrame([(int(d.run("+/U", U=d.activity)),)], "v bigint")


@query(f"WITH {_N} SELECT i, true AS v FROM N")
def random_unit(d: Data) -> DataFrame:
    """Random numbers belong to their keys: read twice, they are the same."""
    text = "var R = [ (i, random()) | (i,v) <- V ]; dataset[ (i, a == b && a >= 0.0 && a < 1.0) | (i,a) <- R, (j,b) <- S, j == i ]"
    first = d.run("[ (i, random()) | (i,v) <- V ]", V=d.per_nation)
    return flat(d.run(text, V=d.per_nation, S=first.with_df(first.df.repartition(7))), "i", "v")


@query(f"WITH {_E} SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 4) AS v FROM E x JOIN E y ON x.i = y.i GROUP BY 1, 2")
def block_summa(d: Data) -> DataFrame:
    """A tall matrix against itself: one result tile, its work dealt out along the shared dimension."""
    e = d.embeddings
    return flat(block.matmul(e.t, e, 64, 2), "i", "j", "v").withColumn("v", F.round("v", 4))


@query(f"WITH {_E} SELECT i, j, round(2 * v - v * v, 4) AS v FROM E")
def block_store(d: Data) -> DataFrame:
    """A starred store holds tiles; arithmetic on equal tilings stays on them."""
    text = "var T = tensor*(n, 64) [ ((r,c), x) | ((r,c),x) <- E ]; 2*T - T*T"
    return flat(d.run(text, E=d.embeddings, n=d.embeddings.rows, edge=48), "i", "j", "v").withColumn("v", F.round("v", 4))


@query(f"WITH {_E} SELECT j AS i, round(max(v), 5) AS top, round(sum(v * v), 4) AS energy FROM E WHERE v > 0 GROUP BY 1")
def block_group(d: Data) -> DataFrame:
    """A group-by over tiles: each is folded where it lies, then what tiles of a column yield is merged."""
    text = "dataset[ (c, max/x, +/y) | ((r,c),x) <- tensor*(n, 64) E, x > 0.0, let y = x*x, group by c ]"
    found = flat(d.run(text, E=d.embeddings, n=d.embeddings.rows, edge=48), "i", "top", "energy")
    return found.withColumn("top", F.round("top", 5)).withColumn("energy", F.round("energy", 4))


@query(f"WITH {_E} SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 4) AS v FROM E x JOIN E y ON x.i = y.i GROUP BY 1, 2")
def block_product(d: Data) -> DataFrame:
    """A product of tiled matrices, one of them transposed tile by tile."""
    text = "var T = tensor*(n, 64) E; T.t @ T"
    return flat(d.run(text, E=d.embeddings, n=d.embeddings.rows, edge=48), "i", "j", "v").withColumn("v", F.round("v", 4))


@query(f"WITH {_BAL} SELECT i, v, CAST(count(o_orderkey) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS spent FROM Bal JOIN orders ON o_custkey = i GROUP BY 1, 2")
def block_own_key(d: Data) -> DataFrame:
    """A group-by on the key of a tiled vector that other generators follow."""
    text = "dataset[ (i, max/v, o.length, +/p) | (i,v) <- tensor*(n) B, (o,c,p) <- orders, c == i, group by i ]"
    return flat(d.run(text, B=d.balances, n=d.customers, orders=d.table("orders", "o_orderkey", "o_custkey", "o_totalprice")), "i", "v", "n", "spent").withColumn("spent", F.round("spent", 2))


@query("SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(n_name, '_')) AS k FROM nation) GROUP BY 1")
def text_lines(d: Data) -> DataFrame:
    """Lines of a text file, split into fields."""
    path = f"{checkpoint_dir(d.spark)}/lines-{uuid.uuid4().hex}"
    d.table("nation", "n_name").write.text(path)
    return flat(d.run('dataset[ (w, t.length) | (k, t) <- lines, w <- t.split("_"), group by w ]', lines=text_file(d.spark, path)), "k", "n").withColumn("n", F.col("n").cast("bigint"))


@query("SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region")
def bag_union(d: Data) -> DataFrame:
    return flat(d.run("A ++ B", A=d.table("nation", "n_name").toDF("n"), B=d.table("region", "r_name").toDF("n")), "n")


@query("SELECT n_regionkey AS k, list_sort(list_concat([-1], list(n_nationkey), [99])) AS v FROM nation GROUP BY 1")
def list_functions(d: Data) -> DataFrame:
    return flat(d.run("dataset[ (k, (-1 :: n) :+ 99) | (k, n) <- N, group by k ]", N=d.table("nation", "n_regionkey", "n_nationkey")), "k", "v").withColumn("v", F.array_sort("v"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
