import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from arrayq import Tensor, workloads
from arrayq.operators import algebra, block, layouts
from arrayq.sources.text import read_tensor, text_file, write_tensor
from tests.helpers import array, tensor

FAST = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
matrices = st.integers(0, 2**32).map(lambda s: np.random.default_rng(s))


@FAST
@given(rng=matrices)
def test_laws(spark, rng):
    a, b = rng.integers(-2, 3, (4, 3)).astype(float), rng.integers(-2, 3, (3, 5)).astype(float)
    x, y = tensor(spark, a, rng.choice([0, 1, 2])), tensor(spark, b, rng.choice([0, 2]))
    assert np.array_equal(array((x @ y).t), array(y.t @ x.t))
    assert np.array_equal(array(x @ y), a @ b)
    assert np.array_equal(array(algebra.cellwise("+", x, x.dense(), "full")), a + a)
    assert np.array_equal(array(x.dense()), array(x.sparse()))


def test_layouts_drop_and_fill_zeros(spark):
    a = np.array([[0, 1.0], [2, 0]])
    assert tensor(spark, a).df.count() == 4 and tensor(spark, a, 0).df.count() == 2 and tensor(spark, a, 1).dense().df.count() == 4
    flags = Tensor.of(spark.createDataFrame([(0, 1)], "a int, b int"), (2, 2), 0, ["a", "b"], None)
    assert flags.df.columns == ["i0", "i1"] and flags.dense().df.count() == 4


def test_indices_outside_are_dropped(spark):
    t = Tensor.of(spark.createDataFrame([(0, 1.0), (7, 2.0), (-1, 3.0)], "i0 int, v double"), (3,), 0)
    assert array(t).tolist() == [1, 0, 0]


@pytest.mark.parametrize("edge", [2, 3, 10])
def test_blocks(spark, edge):
    rng = np.random.default_rng(1)
    a, b = rng.random((7, 5)), rng.random((5, 4))
    x, y = tensor(spark, a), tensor(spark, b)
    assert np.allclose(array(block.blocked(x, edge)), a)
    assert np.allclose(array(block.matmul(x, y, edge)), a @ b)


def _plan(t):
    return t.df._jdf.queryExecution().executedPlan().toString()


def test_narrow_products_copy_nothing_for_each_result_tile(spark):
    rng = np.random.default_rng(5)
    wide = [rng.random((n, 3)) for n in (24, 48)]
    a, b = tensor(spark, wide[0]), tensor(spark, wide[1].T)
    out = block.matmul(a, b, 4)
    assert "CartesianProduct" in _plan(out) and "explode(sequence(" not in _plan(out)
    assert np.allclose(array(out), wide[0] @ wide[1].T)
    # absent rows and nulls count as zero
    holes = a.with_df(a.df.where("i0 <> 7 and i0 < 20").selectExpr("i0", "i1", "if(i0 = 3, null, v) v"))
    kept = wide[0] * ~np.isin(np.arange(24), [3, 7, 20, 21, 22, 23])[:, None]
    assert np.allclose(array(block.matmul(holes, b, 4)), kept @ wide[1].T)


def test_coordinate_products_with_few_shared_indices_are_not_joined_on_them(spark):
    rng = np.random.default_rng(6)
    x, y = rng.random((block.EDGE + 3, 2)), rng.random((2, block.EDGE + 1))
    out = tensor(spark, x) @ tensor(spark, y)
    assert type(out).__name__ == "Tensor" and out.is_dense and "CartesianProduct" in _plan(out)
    assert np.allclose(array(out), x @ y)


def test_sparse_products_are_dealt_out_by_their_number(spark, monkeypatch):
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 3, shape).astype(float) for shape in ((9, 6), (6, 8)))
    a[:, 1] = b[1] = 2
    monkeypatch.setattr(algebra, "HELD", 10)
    monkeypatch.setattr(algebra, "PRODUCTS", 20)
    out = tensor(spark, a, 0) @ tensor(spark, b, 0)
    parts = -(-int((a > 0).sum(0) @ (b > 0).sum(1)) // 20)
    assert _plan(out).count(f", {parts}), REPARTITION_BY_NUM") == 3
    assert np.array_equal(array(out), a @ b)
    # a result that a task can hold is combined before the shuffle
    monkeypatch.setattr(algebra, "HELD", 1000)
    held = tensor(spark, a, 0) @ tensor(spark, b, 0)
    assert "REPARTITION_BY_NUM" not in _plan(held) and np.array_equal(array(held), a @ b)


@pytest.mark.parametrize("edge", [2, 3, 10])
def test_tiled_tensors(spark, edge):
    rng = np.random.default_rng(2)
    a, b, v = rng.random((7, 5)), rng.random((7, 5)), rng.integers(0, 9, 7)
    x, y, z = (block.blocked(tensor(spark, c), edge) for c in (a, b, v))
    made = [(x + y, a + b), (x - y * 2, a - 2 * b), (1 - x, 1 - a), (x / (y + 1), a / (b + 1)), (x.t, a.T), (x.t @ y, a.T @ b), (z * z, v * v)]
    for got, want in made:
        assert isinstance(got, block.Blocks) and np.allclose(array(got), want)
    assert z.kind == "bigint" and (z * z).kind == (tensor(spark, v) * tensor(spark, v)).kind
    assert np.allclose(array(x + tensor(spark, b)), a + b) and np.allclose(array(x @ tensor(spark, b.T)), a @ b.T)
    assert np.allclose(array(tensor(spark, a.T) @ y), a.T @ b) and np.allclose(array(x @ tensor(spark, v[:5])), a @ v[:5])
    assert np.allclose(array(x[1:4, 0:2]), a[1:5, 0:3]) and np.allclose(array(x.persisted()), a)
    other = block.blocked(tensor(spark, b), edge + 1)
    assert np.allclose(array(x + other), a + b) and np.allclose(array(x.t @ other), a.T @ b)


def test_tiles_of_flags_and_empty_tiles(spark):
    flags = np.array([[True, False], [False, False], [True, True]])
    held = block.blocked(tensor(spark, flags), 2)
    assert held.kind == "boolean" and np.array_equal(array(held & block.blocked(tensor(spark, ~flags), 2)), flags & ~flags)
    assert block.blocked(Tensor.of(spark.createDataFrame([], "i0 int, v double"), (0,)), 4).df.count() == 0


def test_merge_override_shift(spark):
    a, b = np.array([1.0, 0, 3]), np.array([0, 5.0, 1])
    x, y = tensor(spark, a, 0), tensor(spark, b, 0)
    assert array(algebra.merged(x, y, "+")).tolist() == [1, 5, 4]
    assert array(algebra.overridden(x, y)).tolist() == [1, 5, 1]
    assert array(algebra.shifted(tensor(spark, a), (1,))).tolist() == [3, 1, 0]
    assert array(algebra.shifted(tensor(spark, a), (1,), wrap=False)).tolist() == [0, 1, 0]


def test_ragged_and_maps(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "k int, p int, x string")
    held = layouts.ragged(rows, "k", "p", "x")
    assert {r.k: r.row for r in held.collect()} == {1: ["a", "b"], 2: ["c"]}
    assert layouts.unragged(held, "k", "row").count() == 3
    assert {r.k: r.entries for r in layouts.as_map(rows, "x", "p", "k").collect()}[1] == {"a": 2, "b": 5}


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n\nc\n")
    assert [tuple(r) for r in text_file(spark, str(tmp_path / "t.txt")).orderBy("number").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]
    t = tensor(spark, np.arange(6.0).reshape(2, 3))
    write_tensor(t, str(tmp_path / "t"))
    assert np.array_equal(array(read_tensor(spark, str(tmp_path / "t"), (2, 3))), array(t))


def test_workloads(spark):
    edges = spark.createDataFrame([(i, j) for i in range(4) for j in range(4) if i != j], "a int, b int")
    assert np.allclose(array(workloads.pagerank(spark, edges, 4, 2)), 0.25)
    rng = np.random.default_rng(2)
    a, theta = rng.random((6, 3)), rng.random(3)
    b = a @ np.ones(3)
    want = theta.copy()
    for _ in range(2):
        want = want - 0.1 * (a.T @ (a @ want - b))
    assert np.allclose(array(workloads.regress(spark, tensor(spark, a), tensor(spark, b), tensor(spark, theta), 2, 0.1)), want)
    x, y, w1, w2 = rng.random((5, 3)), rng.random((5, 1)), rng.random((3, 4)) - 0.5, rng.random((4, 1))
    h = np.maximum(0, x @ w1)
    dz2 = h @ w2 - y
    got = workloads.train_network(spark, *(tensor(spark, m) for m in (x, y, w1, w2)), 1, 0.1)
    assert np.allclose(array(got[1]), w2 - 0.1 * h.T @ dz2)
    assert np.allclose(array(got[0]), w1 - 0.1 * x.T @ (np.where(x @ w1 > 0, dz2 @ w2.T, 0)))
