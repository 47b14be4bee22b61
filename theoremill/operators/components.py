"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.plans.scratch import materialize

#: Edges that one task joins at once (16 bytes each); larger graphs go by rounds.
HELD_EDGES = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> (node, component). Each root is hooked to its smallest neighbour, paths are cut short, and the
    edges between different roots are kept, until there are none."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([x[0] for x in held] + [x[1] for x in held]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    while len(u):
        u, v = label[u], label[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    for i in range(0, len(nodes), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65_536]), pa.array(nodes[label[i : i + 65_536]])], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge to another one are absent,
    except those with a self-loop.

    Alternates large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, until all edges point to a root. Each step is a pair of aggregations and joins on slim
    rows; a hub's edges are never gathered in one row. Rounds grow with the logarithm of the longest path. Up to
    HELD_EDGES edges between numbers are joined by one task instead, as every round costs a dozen small jobs.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if {kind for _, kind in pairs.dtypes} == {"bigint"} and pairs.count() <= HELD_EDGES:
        return materialize(pairs.coalesce(1).mapInArrow(_stars, "node long, component long"), "components")
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = pairs.where("a <> b")
    stamp = None
    while True:
        last, stamp = stamp, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if stamp == last or not stamp[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc")
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        hooked = large.join(smallest, F.col("a") == F.col("k")).select("a", "b", "m")
        small = hooked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(smallest.select(F.col("k").alias("a"), F.col("m").alias("b")))
        now = materialize(small.distinct(), "cc")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = stars.unionAll(roots)
    return found.unionAll(loops.join(found.select("node"), "node", "left_anti").distinct())
