"""Connected components of an edge table, by contraction.

Each partition replaces its edges by stars (union-find of what it holds). A node that stands in stars of several
partitions then points to the smallest of its roots, and the other roots are joined to that one: a smaller graph, over
roots only, on which the same is done until what is left fits one task. Labels are carried back level by level. A hub
has one row for each partition at most, and nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, stash

#: Edges that one task finishes (16 bytes each).
LAST = 400_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            return nodes, nodes[root]
        x, y = x[differ], y[differ]
        lo, hi = np.minimum(rx, ry)[differ], np.maximum(rx, ry)[differ]
        np.minimum.at(root, hi, lo)
        while not (root[root] == root).all():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((column_of(batch, "a").to_numpy(), column_of(batch, "b").to_numpy()))
        n += batch.num_rows
        if n > max(LAST, 2 * len(a)):  # keep a forest: no more edges than nodes
            a, b = union_find(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            a, b, held, n = a[a != b], b[a != b], [], 0
    a, b = union_find(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
    a, b = a[a != b], b[a != b]
    for k in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[k : k + 100_000]), "b": pa.array(b[k : k + 100_000])})


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long, in any order, loops and repeats allowed. Returns node, label (its component's smallest
    node) for every node whose label is another; no edges give no rows."""
    levels = []
    stars = stash(edges.select("a", "b").mapInArrow(_stars, "a long, b long"), "stars")
    while stars.count() > LAST:
        roots = stars.groupBy("a").agg(F.min("b").alias("to"))
        levels.append(stash(roots.select(F.col("a").alias("node"), "to"), "level"))
        linked = stars.join(levels[-1].withColumnRenamed("node", "a"), "a").filter("b <> to").select(F.greatest("b", "to").alias("a"), F.least("b", "to").alias("b"))
        # a node that is a root elsewhere must stay tied to where it points
        both = levels[-1].join(stars.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("to").alias("b"))
        stars = stash(linked.unionByName(both).distinct().mapInArrow(_stars, "a long, b long"), "stars")
    labels = stars.coalesce(1).mapInArrow(_stars, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("label"))
    for level in reversed(levels):
        labels = stash(labels, "labels")
        down = level.join(labels.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("label", "to").alias("label"))
        labels = down.unionByName(labels.join(level, "node", "left_anti"))
    return stash(labels, "labels")
