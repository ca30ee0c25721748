"""Connected components of a link table, by alternating large and small stars.

A table of at most ``LOCAL_LINKS`` links, counted first, is closed in one task.
Beyond that every round replaces each link by links to the least neighbour, so long chains
shrink quickly and the result is a star around each component's least node.
Groups are folded with map-side minima and joined back, never collected; each
round starts from a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayq.llm.shared import arrow_map, discard, materialise

MAX_ROUNDS = 60
#: Links (16 bytes each) that one task closes.
LOCAL_LINKS = 1_000_000


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least labels spread along all links, and labels of labels, until none changes."""
    held = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held, 1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, label[end], least)  # a label's own node stands for all that bear it
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[label[i : i + (1 << 16)]])], ["node", "comp"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v), u > v, each link once."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, comp) for every node of ``links(a, b)``; comp is the least node of its component."""
    current = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    current, before = materialise(current, "links"), None
    if current.count() <= local:
        out = materialise(arrow_map(current.coalesce(1), _closed, "node long, comp long"), "components")
        discard(current)
        return out
    for _ in range(MAX_ROUNDS):
        last, current = current, materialise(_star(_star(current, True), False), "links")
        discard(last)
        mark = current.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = current.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    out = materialise(stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct()), "components")
    discard(current)
    return out
