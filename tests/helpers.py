"""Tensors from and to NumPy."""

import numpy as np

from arrayq import Tensor


def tensor(spark, a, n_dense=None):
    a = np.asarray(a)
    rows = [(*map(int, at), x.item()) for at, x in np.ndenumerate(a)]
    df = spark.createDataFrame(rows, [*(f"i{k}" for k in range(a.ndim)), "v"])
    return Tensor.of(df, a.shape, n_dense)


def array(t):
    out = np.zeros(t.dims)
    for row in t.values().collect():
        assert all(0 <= i < d for i, d in zip(row[:-1], t.dims))
        out[tuple(row[:-1])] = row[-1]
    return out
