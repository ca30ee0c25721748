"""``python -m arrayq program args..``: runs a program file; its arguments are ``args``."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from arrayq.session import q


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("arrayq").getOrCreate()
    out = q(spark, Path(argv[0]).read_text(), args=lambda k: argv[1 + k])
    if hasattr(out, "df"):
        print(f"tensor {out.dims}")
        out.df.show(20)
    elif hasattr(out, "show"):
        out.show(20)
    elif out is not None:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
