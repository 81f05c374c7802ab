"""Connected components: spanning forests in one task by numpy, stars across tasks by DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashlode.llm.shared import drop_stored, stored


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the links (a[i], b[i])."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another node.

    Alternates large-star and small-star (Kiveris et al. 2014) until no edge changes. Each round is written
    to the shared folder; a hub's edges are aggregated map-side before they meet.
    Null ends and loops are ignored; no edges give no rows.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                now.select(F.col("u"), F.col("u")).distinct()
            )
        seen = mark
        both = now.union(now.select("u", "v")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = stored(large, "edges")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.toDF("v", "u"))
        after = stored(small.where("v != u").distinct(), "edges")
        drop_stored(large)
        drop_stored(now)
        now = after
