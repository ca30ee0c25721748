import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayq import Tensor, q
from arrayq.functions.monoids import user
from arrayq.plans.values import CompileError
from tests.helpers import array, tensor

RNG = np.random.default_rng(0)
A = RNG.integers(-3, 4, (5, 4)).astype(float)
B = RNG.integers(-3, 4, (4, 6)).astype(float)
C = RNG.integers(0, 4, (5, 4)).astype(float)
V = np.arange(5.0)


@pytest.fixture(scope="module")
def env(spark):
    return {"A": tensor(spark, A), "B": tensor(spark, B), "C": tensor(spark, C), "V": tensor(spark, V), "S": tensor(spark, A, 0), "T": tensor(spark, C, 0)}


CASES = {
    "tensor(4,4)[ ((p,q), +/w) | ((r,p),x) <- A, p < 3, ((s,q),y) <- C, s == r, p <= q, let w = x*y - x, group by (p,q) ]": np.triu(A.T @ C - A.sum(0)[:, None]) * np.array([1, 1, 1, 0])[:, None],
    "A @ B": A @ B,
    "S @ B": A @ B,
    "A + C*2 - 1": A + C * 2 - 1,
    "S + T": np.where((A != 0) & (C != 0), A + C, 0),
    "tensor(5,4)[ ((r,c), 3.0*x - y/2.0) | ((m,k),y) <= T, ((r,c),x) <= S, c == k, r == m ]": 3 * A - C / 2,
    "A.t": A.T,
    "A[1:3,0:3:2]": A[1:4, 0:4:2],
    "A[1:3,2]": A[1:4, 2],
    "tensor(4)[ (c, +/y) | ((r,c),y) <- C, r >= 1, group by c ]": C[1:].sum(0),
    "[ (i,+/a) | ((i,j),a) <- A, group by i, +/a > 0.0 ]": np.where(A.sum(1) > 0, A.sum(1), 0),
    "tensor(5)[ (i,(+/a)/a.length) | ((i,j),a) <- A, group by i ]": A.mean(1),
    "tensor(5,4)[ ((r,c), y / (w + 1.0)) | ((r,c),y) <- C, (m,w) <- V, m == r ]": C / (V + 1)[:, None],
    "tensor(3,4)[ ((i,j), i*j*1.0) | i <- 0..2, j <- 0..3, i < j ]": np.fromfunction(lambda i, j: np.where(i < j, i * j, 0), (3, 4)),
    "tensor(5,4)[ ((4-r, (c+3) % 4), -x) | ((r,c),x) <- A ]": -np.roll(A[::-1], 3, 1),
    "var W = C; for r = 0, 4 do for c = 1, 3 do W[r,c] = C[r,c]*A[r,c] - 1.0; W": np.c_[C[:, :1], (C * A - 1)[:, 1:]],
    "var G = tensor(4,4)[ ((p,q), 5.0) | p <- 0..3, q <- 0..3 ]; for r = 0, 4 do for p = 0, 3 do for q = 0, 3 do G[p,q] -= A[r,p]*C[r,q]; G": 5 - A.T @ C,
    "var P = V; var k = 0; while (k < 3) { P = [ (i,v*2) | (i,v) <- P ]; k += 1; }; P": V * 8,
    "var P = V; for k = 0, 2 do P = P + k; P": V + 3,
    "[ (i, +/[ b | ((r,c),b) <- B, r == i ]) | (i,v) <- V ]": np.r_[B.sum(1), 0],
    "[ (i, v match { case 0.0 => 10.0; case x if x > 2.0 => 1.0; case _ => 0.5 }) | (i,v) <- V ]": np.array([10, 0.5, 0.5, 1, 1]),
    "[ (i, <a=v, b=v+1>#b) | (i,v) <- V ]": V + 1,
    "def f(x: Double): Double = { if (x > 2.0) return 0.0; return x; }; [ (i, f(v)) | (i,v) <- V ]": np.where(V > 2, 0, V),
    "var g = (x,y) => x + y; [ (i, g(v, 2.0)) | (i,v) <- V ]": V + 2,
    "tensor(5,6)[ ((i,j),max/c) | ((i,k),a) <- A, ((kk,j),b) <- B, k == kk, let c = a+b, group by (i,j) ]": (A[:, :, None] + B[None]).max(1),
    "var W = V; for c = 0, 3 do for r = 0, 4 do W[r] += C[r,c] - A[r,c]; W": V + (C - A).sum(1),
    "var W = V; for i = 0, 4 do for j = 0, 3 do W[i] max= A[i,j]; W": np.maximum(V, A.max(1)),
    "var W = V; for i = 0, 4 do if (W[i] > 2.0) W[i] = 0.0; else W[i] = 9.0; W": np.where(V > 2, 0, 9.0),
    "var W = V; for i = 0, 3 do W[i+1] = A[i,0]; W": np.r_[V[0], A[:4, 0]],
    "var W = V; for i = 0, 9 do W[i] = 7.0; W": np.full(5, 7.0),
    "(C/2 - 1).t @ (A*A)": (C / 2 - 1).T @ (A * A),
    "tensor(5)[ (i, +/[ x*x | x <- a, x > 0.0 ]) | ((i,j),a) <- A, group by i ]": (np.where(A > 0, A, 0) ** 2).sum(1),
}


@pytest.mark.parametrize("text", CASES)
def test_against_numpy(spark, env, text):
    assert np.allclose(array(q(spark, text, **env)), CASES[text])


def test_scalars(spark, env):
    assert q(spark, "+/[ a | ((i,j),a) <- A ]", **env) == A.sum()
    assert q(spark, "max/[ a | ((i,j),a) <- A, i > 1 ]", **env) == A[2:].max()
    assert q(spark, "var s = 0.0; for i = 0, 4 do for j = 0, 3 do s += A[i,j]; s", **env) == A.sum()
    assert q(spark, "A[2,3]", **env) == A[2, 3]
    assert q(spark, "7/2 + (0-7)/2") == 0 and q(spark, "(0-7) % 3") == -1
    assert q(spark, "(3, 4) match { case (a, b) if a > b => 1; case (a, b) => b }") == 4


def test_monoid_identities(spark):
    negative = tensor(spark, np.array([[-3, -1, 0], [0, 0, 0], [-2, -2, -2]]), 0)
    out = q(spark, "dataset[ (i, max/a, min/a, */a) | ((i,j),a) <- N, group by i ]", N=negative)
    assert sorted(map(tuple, out.collect())) == [(0, -1, -3, 3), (2, -2, -2, -8)]
    assert q(spark, "*/[ a | ((i,j),a) <- N, i > 9 ]", N=negative) == 1
    assert q(spark, "max/[ a | ((i,j),a) <- N, i > 9 ]", N=negative) is None


def test_strided_slices(spark):
    m = np.fromfunction(lambda i, j: 10 * i + j, (7, 5))
    t = tensor(spark, m)
    out = q(spark, "M[1:5:2, 0:4:3]", M=t)
    assert out.dims == (3, 2) and np.array_equal(array(out), m[1:6:2, 0:5:3])
    assert np.array_equal(array(t[0:6:2, 3]), m[0:7:2, 3])


def test_full_outer_update_creates_cells(spark):
    s = Tensor.of(spark.createDataFrame([(0, 1.0)], "i0 int, v double"), (4,), 0)
    out = q(spark, "for i = 1, 2 do S[i] = 5.0; S", S=s)
    assert np.array_equal(array(out), [1, 5, 5, 0]) and out.df.count() == 3


def test_functions_and_udfs(spark, env):
    assert np.allclose(array(q(spark, "[ (i, h(v)) | (i,v) <- V ]", h=lambda c: c * c, **env)), V**2)
    assert np.allclose(array(q(spark, "[ (i, h(v)) | (i,v) <- V ]", h=lambda x: x * x, returns={"h": "double"}, **env)), V**2)
    far = user("far", lambda a, b: F.when(F.abs(a) >= F.abs(b), a).otherwise(b))
    out = array(q(spark, "tensor(5)[ (i, far/a) | ((i,j),a) <- A, group by i ]", monoids={"far": far}, **env))
    assert np.array_equal(np.abs(out), np.abs(A).max(1))


def test_illegal_loops(spark, env):
    with pytest.raises(CompileError, match="affine"):
        q(spark, "for i = 0, 4 do V[i*i] = 1.0; V", **env)
    with pytest.raises(CompileError, match="another index"):
        q(spark, "for i = 1, 4 do V[i] = V[i-1]; V", **env)
    with pytest.raises(CompileError):
        q(spark, "[ x | x <- nothing ]")


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, x double")
    assert q(spark, "+/[ x | (k,x) <- E ]", E=empty) == 0
    assert q(spark, "dataset[ (k, +/x) | (k,x) <- E, group by k ]", E=empty).count() == 0
    assert np.array_equal(array(q(spark, "tensor(3)[ (k, +/x) | (k,x) <- E, group by k ]", E=empty)), np.zeros(3))
