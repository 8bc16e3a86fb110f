"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one shuffle by node; labels only fall, and the result is the smallest id of each component. Nothing
is collected: the driver sees one changed-edge count per round. Before the first round every partition replaces
its edges by a spanning forest, which turns dense groups of copies into one edge per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest reachable node over the edges (a, b), without roots themselves."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; long ids, repeated edges and self-edges allowed."""
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = stash(pairs.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    while True:
        # Large star: each node links its larger neighbours to its smallest neighbour.
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node links itself and its smaller neighbours to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = stash(small, "edges")
        changed = small.join(pairs, ["a", "b"], "left_anti").limit(1).count() + pairs.join(small, ["a", "b"], "left_anti").limit(1).count()
        pairs = small
        if not changed:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
