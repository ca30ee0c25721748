"""The rewrites show in the optimized plans."""

import numpy as np
from pyspark.sql import functions as F

from arrayq import q
from tests.helpers import array, tensor


def plan(t):
    df = t.df if hasattr(t, "df") else t
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_tensor_read_twice_is_not_joined(spark):
    a = tensor(spark, np.arange(12.0).reshape(3, 4), 0)
    out = q(spark, "tensor()(3,4)[ ((r,c), 2.0*x - y/4.0) | ((r,c),x) <- M, ((s,d),y) <- M, d == c, s == r, x > 3.0 ]", M=a)
    cells = np.arange(12.0).reshape(3, 4)
    assert "Join" not in plan(out) and np.array_equal(array(out), np.where(cells > 3, 1.75 * cells, 0))


def test_ranges_tied_to_indices_are_filters(spark):
    v = tensor(spark, np.arange(20.0), 0)
    out = q(spark, "dataset[ (i, x) | i <- 0..4, (j,x) <- V, j == 2*i + 1 ]", V=v)
    assert "Join" not in plan(out) and "Range" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(i, 2.0 * i + 1) for i in range(5)]


def test_unique_keys_are_not_grouped(spark):
    a = tensor(spark, np.arange(6.0).reshape(2, 3), 0)
    assert "Aggregate" not in plan(q(spark, "tensor()(2,3)[ ((i,j),+/a) | ((i,j),a) <- A, group by (i,j) ]", A=a))
    assert "Aggregate" in plan(q(spark, "tensor()(2)[ (i,+/a) | ((i,j),a) <- A, group by i ]", A=a))


def test_loops_are_joins_without_ranges(spark):
    a, b = (tensor(spark, np.ones((3, 3)), 0) for _ in range(2))
    out = q(spark, "var T = Y; for r = 0, 2 do for c = 0, 2 do for d = 0, 2 do T[c,d] += 2.0*X[r,c] + Y[r,d]; T", X=a, Y=b)
    assert "Range" not in plan(out) and np.array_equal(array(out), np.ones((3, 3)) + 9)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), F.lit("unused").alias("y")).write.parquet(path)
    out = q(spark, "dataset[ x | (k,x,y) <- D, k > 90 ]", D=spark.read.parquet(path))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,90)]" in text and "unused" not in text and "ReadSchema: struct<k:bigint,x:bigint>" in text


def test_full_dense_results_are_not_filled_again(spark):
    a, b = tensor(spark, np.arange(6.0).reshape(2, 3)), tensor(spark, np.ones((2, 3)))
    one = q(spark, "[ ((j,i), x*2) | ((i,j),x) <- A ]", A=a)
    assert plan(one).count("Join") == plan(a).count("Join") and np.array_equal(array(one), np.arange(6.0).reshape(2, 3).T * 2)
    two = q(spark, "[ ((i,j), x+y) | ((i,j),x) <- A, ((k,l),y) <- B, k == i, l == j ]", A=a, B=b)
    assert plan(two).count("Join") == plan(a).count("Join") + plan(b).count("Join") + 1
    rows = q(spark, "[ (i, +/x) | ((i,j),x) <- A, group by i ]", A=a)
    assert plan(rows).count("Join") == plan(a).count("Join") and array(rows).tolist() == [3, 12]
    # a filter leaves gaps, which are filled
    some = q(spark, "[ ((i,j), x) | ((i,j),x) <- A, x > 2.0 ]", A=a)
    assert plan(some).count("Join") > plan(a).count("Join") and array(some).tolist() == [[0, 0, 0], [3, 4, 5]]
    # so do indices that follow each other within one tensor
    diagonal = q(spark, "tensor(2,3)[ ((i,j), x) | ((i,j),x) <- A, i == j ]", A=a)
    assert array(diagonal).tolist() == [[0, 0, 0], [0, 4, 0]]
    square = q(spark, "tensor(3,3)[ ((i,i), x) | (i,x) <- V ]", V=tensor(spark, np.ones(3)))
    assert array(square).tolist() == np.eye(3).tolist()


def test_tiles_are_folded_where_they_lie(spark):
    a = np.arange(35.0).reshape(7, 5)
    held = q(spark, "tensor*(7,5) A", A=tensor(spark, a), edge=3).persisted()
    out = q(spark, "[ (c, +/x) | ((r,c),x) <- T, group by c ]", T=held)
    steps = out.df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].splitlines()
    at = lambda x: [k for k, line in enumerate(steps) if x in line]
    # from the bottom up: read tiles, take cells out, add them up, and only then shuffle
    assert at("partial_sum") and max(at("Exchange hashpartitioning")) < min(at("partial_sum")) < min(at("posexplode")) < min(at("InMemoryTableScan"))
    assert np.array_equal(array(out), a.sum(0))


def test_groups_by_a_generators_own_key_reuse_its_join(spark):
    v, w = (tensor(spark, np.arange(30.0), 0).persisted() for _ in range(2))
    text = "dataset[ (i, +/y) | (i,x) <- V, (j,y) <- W, j == i, group by i ]"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = q(spark, text, V=v, W=w)
        steps = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "partial_sum" in steps and sum("Exchange" in line for line in steps.split("Join")[0].splitlines()) == 0
        assert sorted(map(tuple, out.collect())) == [(i, float(i)) for i in range(1, 30)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counted_joins_meet_counts_not_rows(spark):
    a = [(k % 7, None if k % 5 == 0 else k % 3, k) for k in range(40)] * 2
    b = [(k % 3, "x" if k % 2 else None, k % 4) for k in range(30)]
    left, right = spark.createDataFrame(a, "g int, j int, r int"), spark.createDataFrame(b, "j int, n string, r int")
    text = "dataset[ (g, x.length * 2, m.size) | (g, i, x) <- A, x > 3, (j, n, m) <- B, j == i, m % 2 == x % 2, group by g, n.length > 0 ]"
    want = {}
    for g, i, x in a:
        for j, _, m in b:
            if x > 3 and i == j and m % 2 == x % 2:
                want[g] = want.get(g, 0) + 1
    out = q(spark, text, A=left, B=right)
    assert sorted(tuple(r) for r in out.collect()) == sorted((g, 2 * n, n) for g, n in want.items())
    # both sides are grouped before they meet
    assert plan(out).count("Aggregate") == 3
    # a key of both sides, with nulls; a key that is null
    both = q(spark, "dataset[ (k, x.length) | (g, i, x) <- A, (j, n, m) <- B, j == i, group by k: (n, x % 2) ]", A=left, B=right)
    pairs = {}
    for _, i, x in a:
        for j, n, _ in b:
            if i is not None and i == j:
                pairs[n, x % 2] = pairs.get((n, x % 2), 0) + 1
    assert {tuple(r[0]) if len(r) == 2 else tuple(r[:-1]): r[-1] for r in both.collect()} == pairs
    # other reductions see the rows themselves
    sums = q(spark, "dataset[ (g, x.length, +/m) | (g, i, x) <- A, (j, n, m) <- B, j == i, group by g ]", A=left, B=right)
    assert plan(sums).count("Aggregate") == 1
    # sides that nothing ties, one of them empty
    none = q(spark, "dataset[ (g, x.length) | (g, i, x) <- A, (j, n, m) <- B, m > 9, group by g ]", A=left, B=right)
    assert none.count() == 0
    loose = q(spark, "dataset[ (g, m.length) | (g, i, x) <- A, (j, n, m) <- B, m < 2, group by g ]", A=left, B=right)
    near = sum(m < 2 for *_, m in b)
    assert sorted(map(tuple, loose.collect())) == sorted((g, near * sum(r[0] == g for r in a)) for g in {r[0] for r in a})
