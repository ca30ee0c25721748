"""``q``: run a program with Python values bound to its names."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from arrayq.plans.program import Program


def q(spark: SparkSession, text: str, *, layout: str = "coo", edge: int | None = None, trace: bool = False, returns: dict[str, str] | None = None, monoids: dict[str, Any] | None = None, seed: int = 42, **bindings: Any) -> Any:
    """The value of the program's last expression: a Tensor, a DataFrame or a plain value.

    ``bindings`` may be tensors, frames, lists, dictionaries, numbers, strings
    and functions.  A function of columns is inlined; one that is not needs its
    result type in ``returns`` and runs as an Arrow UDF.  With ``layout="block"``
    dense products run on tiles of ``edge`` by ``edge`` cells.  ``trace`` prints
    the physical plan of a result.
    """
    program = Program(spark, bindings, monoids, returns, set(returns or ()), seed, layout, edge)
    out = program.run(text)
    if trace and hasattr(out, "df"):
        out.df.explain("formatted")
    elif trace and hasattr(out, "explain"):
        out.explain("formatted")
    return out
