"""Iterative workloads: PageRank, matrix factorisation, linear regression, a two-layer network.

What a loop does not change is computed once, written to the checkpoint folder
and kept partitioned by the index that each step joins on; a step reads that and
what the step before wrote, never the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayq.operators import algebra
from arrayq.plans.checkpoint import checkpointed, dropped
from arrayq.session import q
from arrayq.tensor import VALUE, Tensor, index_space

NETWORK = """
var k = 0;
while (k < steps) {
    k += 1;
    var Z1 = X @ w1;
    var H = [ ((i,j), max(0.0, z)) | ((i,j),z) <- Z1 ];
    var Z2 = H @ w2;
    var dZ2 = Z2 - Y;
    var dW2 = H.t @ dZ2;
    var dH = dZ2 @ w2.t;
    var dZ1 = [ ((i,j), if (z > 0.0) d else 0.0) | ((i,j),d) <- dH, ((ii,jj),z) <- Z1, ii == i, jj == j ];
    w2 = w2 - rate*dW2;
    w1 = w1 - rate*(X.t @ dZ1);
};
(w1, w2)
"""


def _filled(spark: SparkSession, dims: tuple[int, ...], value: float) -> Tensor:
    return Tensor(index_space(spark, dims).withColumn(VALUE, F.lit(value)), dims, len(dims), "double")


def pagerank(spark: SparkSession, edges: DataFrame, n: int, steps: int, damping: float = 0.85) -> Tensor:
    """Ranks of ``n`` nodes after ``steps`` power iterations over ``edges(from, to)``; nodes without links out give nothing away.

    With ``M[to, from] = damping / links out``, a step is ``M @ rank + (1 - damping) / n``.
    """
    source, target = edges.columns
    out = edges.groupBy(source).agg(F.count(F.lit(1)).alias("_out"))
    weights = edges.join(out, source).select(F.col(target).alias("i0"), F.col(source).alias("i1"), (F.lit(damping) / F.col("_out")).alias(VALUE))
    moves = Tensor.of(weights, (n, n), 0)
    moves = moves.with_df(checkpointed(moves.df, "i1"))
    rank, rest = _filled(spark, (n,), 1.0 / n), (1.0 - damping) / n
    for step in range(steps):
        before, rank = rank, moves @ rank + rest
        rank = rank.with_df(checkpointed(rank.df))
        if step:
            dropped(before.df)
    dropped(moves.df)
    return rank


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _packed(t: Tensor, row: str, column: str) -> DataFrame:
    """(at, vec): the cells along one index of a dense matrix as an array, in the order of the other."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), F.col(VALUE).alias("x"))))
    return t.values().groupBy(F.col(row).alias("at")).agg(F.transform(cells, lambda c: c["x"]).alias("vec"))


def _opened(vectors: DataFrame, dims: tuple[int, int], flipped: bool) -> Tensor:
    cells = vectors.select("at", F.posexplode("vec").alias("k", VALUE))
    names = ("k", "at") if flipped else ("at", "k")
    return Tensor(cells.select(*[F.col(c).cast("int").alias(f"i{n}") for n, c in enumerate(names)], VALUE), dims, 2, "double")


def factorise(spark: SparkSession, r: Tensor, p: Tensor, w: Tensor, steps: int, rate: float = 0.002, decay: float = 0.02) -> tuple[Tensor, Tensor]:
    """Gradient steps on ``r`` (its stored cells only) as ``p @ w``.

    A row of ``p`` and a column of ``w`` are one array each, so the error of a
    cell is a scalar product next to the cell and ``p @ w`` is never made whole.
    """
    rated = checkpointed(r.named("i", "j", "seen"))
    rows, columns = (checkpointed(x) for x in (_packed(p, "i0", "i1"), _packed(w, "i1", "i0")))

    def moved(held: DataFrame, errors: DataFrame, own: str, other: str) -> DataFrame:
        """``x + 2 rate * sum(error * other) - rate * decay * x``; vectors without a cell only decay."""
        pulls = errors.select(F.col(own).alias("at"), F.posexplode(F.transform(other, lambda x: x * F.col("error"))).alias("k", "pull"))
        summed = pulls.groupBy("at", "k").agg(F.sum("pull").alias("pull")).groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("k", "pull"))).alias("pulls"))
        new = F.transform("vec", lambda x, k: x * (1 - rate * decay) + F.coalesce(F.get(F.map_values(F.map_filter("pulls", lambda q, _: q == k)), F.lit(0)), F.lit(0.0)) * (2 * rate))
        return held.join(summed, "at", "left").select("at", new.alias("vec"))

    for _ in range(steps):
        met = rated.join(rows.select(F.col("at").alias("i"), F.col("vec").alias("x")), "i").join(columns.select(F.col("at").alias("j"), F.col("vec").alias("y")), "j")
        errors = checkpointed(met.withColumn("error", F.col("seen") - _dot(F.col("x"), F.col("y"))))
        before = (rows, columns, errors)
        rows, columns = checkpointed(moved(rows, errors, "i", "y")), checkpointed(moved(columns, errors, "j", "x"))
        for df in before:
            dropped(df)
    dropped(rated)
    return _opened(rows, p.dims, False), _opened(columns, w.dims, True)


def regress(spark: SparkSession, a: Tensor, b: Tensor, theta: Tensor, steps: int, rate: float) -> Tensor:
    """Full-batch gradient descent of ``a @ theta`` towards ``b``.

    The gradient is ``(a.t @ a) @ theta - a.t @ b``: both products are made once,
    and a step costs the square of the number of columns, however many rows there are.
    """
    gram, aim = (t.with_df(checkpointed(t.df, *keys)) for t, keys in ((algebra.matmul(a.t, a), ["i1"]), (algebra.matmul(a.t, b), [])))
    for step in range(steps):
        before, theta = theta, theta - (gram @ theta - aim) * rate
        theta = theta.with_df(checkpointed(theta.df))
        if step:
            dropped(before.df)
    for t in (gram, aim):
        dropped(t.df)
    return theta


def train_network(spark: SparkSession, x: Tensor, y: Tensor, w1: Tensor, w2: Tensor, steps: int, rate: float) -> tuple[Tensor, Tensor]:
    """Gradient descent of a ReLU layer and a linear layer on squared error."""
    return q(spark, NETWORK, X=x, Y=y, w1=w1, w2=w2, steps=steps, rate=rate)
