import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayq import Tensor, q, workloads
from arrayq.functions.monoids import user
from arrayq.operators import block
from arrayq.plans.values import CompileError
from tests.helpers import array, tensor

RNG = np.random.default_rng(4)


def plan(t):
    return t.df._jdf.queryExecution().optimizedPlan().toString()


def test_pagerank_against_power_iteration(spark):
    edges = [(i, j) for i in range(8) for j in range(8) if (3 * i + 5 * j) % 7 == 1]
    move = np.zeros((9, 9))
    for i, j in edges:
        move[j, i] = 0.85 / sum(a == i for a, _ in edges)
    rank = np.full(9, 1 / 9)
    for _ in range(4):
        rank = move @ rank + 0.15 / 9
    out = workloads.pagerank(spark, spark.createDataFrame(edges, "src int, dst int"), 9, 4)
    assert np.allclose(array(out), rank)


def test_factorisation_against_numpy(spark):
    r, p, w = RNG.random((6, 5)) * (RNG.random((6, 5)) < 0.6), RNG.random((6, 2)), RNG.random((2, 5))
    got = workloads.factorise(spark, tensor(spark, r, 0), tensor(spark, p), tensor(spark, w), 3, 0.05, 0.1)
    for _ in range(3):
        e = np.where(r != 0, r - p @ w, 0)
        p, w = p + 0.1 * e @ w.T - 0.005 * p, w + 0.1 * p.T @ e - 0.005 * w
    assert np.allclose(array(got[0]), p) and np.allclose(array(got[1]), w)


def test_regression_against_numpy(spark):
    a, b, theta = RNG.random((12, 3)), RNG.random(12), np.full(3, 0.5)
    got = workloads.regress(spark, tensor(spark, a), tensor(spark, b), tensor(spark, theta), 3, 0.02)
    for _ in range(3):
        theta = theta - 0.02 * a.T @ (a @ theta - b)
    assert np.allclose(array(got), theta)


def test_loops_do_not_go_back_to_the_sources(spark, tmp_path):
    path = str(tmp_path / "cells")
    tensor(spark, RNG.random((5, 5)), 0).df.write.parquet(path)
    held = Tensor.of(spark.read.parquet(path), (5, 5), 0)
    out = q(spark, "var V = [ (i, 1.0) | i <- 0..4 ]; var k = 0; while (k < 3) { var W = M @ V; V = W + 1.0; k += 1; }; V", M=held)
    v, m = np.ones(5), array(held)
    for _ in range(3):
        v = m @ v + 1
    assert np.allclose(array(out), v) and not re.search(r"FileScan|Relation .*parquet", plan(out))


@pytest.mark.parametrize(("edge", "depth"), [(4, 64), (4, 1), (3, 2), (50, 1)])
def test_block_products_of_any_shape(spark, edge, depth):
    for n, m, p in ((7, 30, 5), (1, 40, 1), (30, 2, 9)):
        a, b = RNG.random((n, m)), RNG.random((m, p))
        assert np.allclose(array(block.matmul(tensor(spark, a), tensor(spark, b), edge, depth)), a @ b)
    with pytest.raises(ValueError):
        block.matmul(tensor(spark, np.ones((2, 3))), tensor(spark, np.ones((2, 3))))


def test_user_monoids_fold_in_steps_and_finish(spark):
    rows = spark.range(0, 999, 1, 7).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
    far = user("far", lambda a, b: F.greatest(a, b), finish=lambda c: c * 10, kind="double")
    out = q(spark, "dataset[ (k, far/x, +/x, x.length, min/x) | (k,x) <- R, group by k ]", R=rows, monoids={"far": far})
    assert sorted(map(tuple, out.collect())) == [(0, 9980.0, float(sum(range(0, 999, 2))), 500, 0.0), (1, 9970.0, float(sum(range(1, 999, 2))), 499, 1.0)]
    assert q(spark, "far/[ x | (k,x) <- R ]", R=rows, monoids={"far": far}) == 9980.0
    assert "SPARK_PARTITION_ID" in out._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        user("none", lambda a, b: a, finish=lambda c: c)


def test_indices_beyond_32_bits(spark):
    far = 5_000_000_000
    cells = spark.createDataFrame([(far, 2, 1.5), (7, 0, 2.0)], "i0 long, i1 int, v double")
    t = Tensor.of(cells, (far + 1, 3), 0)
    assert sorted(map(tuple, t.t.df.collect())) == [(0, 7, 2.0), (2, far, 1.5)]
    assert [tuple(r) for r in q(spark, "tensor()(3)[ (j, +/x) | ((i,j),x) <- T, i > 100, group by j ]", T=t).df.collect()] == [(2, 1.5)]
    moved = q(spark, "tensor()(n)[ (i - 1, x) | ((i,j),x) <- T, j > 0 ]", T=t, n=far)
    assert [tuple(r) for r in moved.df.collect()] == [(far - 1, 1.5)]


def test_layout_and_edge_are_parameters(spark):
    a, b = RNG.random((5, 6)), RNG.random((6, 4))
    assert np.allclose(array(q(spark, "A @ B", layout="block", edge=2, A=tensor(spark, a), B=tensor(spark, b))), a @ b)


def test_formats_ranges_and_bags(spark):
    assert q(spark, 'format("%s-%d", "a", 3)') == "a-3" and q(spark, '"%.1f".format(2.0)') == "2.0"
    assert list(q(spark, "range(5, 1, -2)")) == [5, 3, 1] and q(spark, "+/range(1, 4)") == 10
    rows = spark.range(3).toDF("k")
    assert [r[0] for r in q(spark, 'dataset[ format("<%d>", k) | k <- R ]', R=rows).collect()] == ["<0>", "<1>", "<2>"]
    with pytest.raises(CompileError, match="format"):
        q(spark, "dataset[ format(k, k) | k <- R ]", R=rows)
    bags = q(spark, "dataset[ (k, [ x | x <- R, x > 0 ]) | k <- R ]", R=rows).collect()
    assert [sorted(b[1]) for b in bags] == [[1, 2]] * 3
