"""Graph statistics: degrees, shape, centralities, components, cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from theoremill.operators.graph import reachable
from theoremill.plans.scratch import materialize


def clamped(value: Column) -> Column:
    """Negative and tiny values become 0."""
    return F.when(value < 1e-16, F.lit(0.0)).otherwise(value.cast("double"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: id, in_degree, out_degree, degree; missing weights count 1, isolated nodes 0. One exchange: both ends of an
    edge are summed at once."""
    w = F.coalesce("w", F.lit(1)).cast("double")
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0.0).alias("i"), w.alias("o")), F.struct(F.col("dst").alias("id"), w.alias("i"), F.lit(0.0).alias("o")))))
    summed = ends.unionAll(nodes.select("id", F.lit(0.0).alias("i"), F.lit(0.0).alias("o"))).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return summed.select("id", clamped(F.col("i")).alias("in_degree"), clamped(F.col("o")).alias("out_degree"), clamped(F.col("i") + F.col("o")).alias("degree"))


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """star_shape_level, tendency_to_make_hub (one row)."""
    top = edges.agg(F.max(F.coalesce("w", F.lit(1)).cast("double")).alias("alpha"))
    d = degrees(nodes, edges).agg(F.max("degree").alias("m"), F.count("*").alias("n"), F.sum("degree").alias("s"), F.sum(F.col("degree") * F.col("degree")).alias("s2"))
    n, alpha = F.col("n"), F.coalesce("alpha", F.lit(0.0))
    h = alpha * (n - 1) * (n - 2)
    star = F.when(n == 0, 0.0).when(h == 0, (alpha > 0).cast("double")).otherwise((F.col("m") * n - F.col("s")) / F.when(h == 0, None).otherwise(h))
    return d.crossJoin(top).select(clamped(star).alias("star_shape_level"), clamped(F.coalesce(F.try_divide("s2", "s"), F.lit(0.0))).alias("tendency_to_make_hub"))  # one row each


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Id, pagerank; weighted, parallel edges summed, dangling mass spread evenly, stops when the L1 change is below
    n * tolerance. Ranks are written every round, so lineage stays short and lost executors are made good."""
    w = edges.groupBy("src", "dst").agg(F.sum(F.coalesce("w", F.lit(1)).cast("double")).alias("w"))
    out = w.groupBy(F.col("src").alias("k")).agg(F.sum("w").alias("total"))
    share = materialize(w.join(out, F.col("src") == F.col("k")).select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "pagerank-share")
    base = materialize(nodes.select("id").distinct().join(out.select(F.col("k").alias("id"), F.lit(1).alias("linked")), "id", "left").select("id", F.col("linked").isNull().alias("dangling")), "pagerank-nodes")
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("pagerank"))
    rank = base.select("id", "dangling", F.lit(1.0 / n).alias("pagerank"))
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.sum("pagerank")).first()[0] or 0.0
        sent = rank.join(share, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        new = rank.join(sent, F.col("id") == F.col("dst"), "left")
        value = F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)
        rank = materialize(new.select("id", "dangling", value.alias("pagerank"), F.abs(value - F.col("pagerank")).alias("change")), "pagerank")
        if tolerance and rank.agg(F.sum("change")).first()[0] < n * tolerance:
            break
    return rank.select("id", clamped(F.col("pagerank")).alias("pagerank"))


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Id, value: left eigenvector centrality by power iteration on A + I, normalised to length 1."""
    w = materialize(edges.groupBy("src", "dst").agg(F.sum(F.coalesce("w", F.lit(1)).cast("double")).alias("w")), "eigen-edges")
    n = nodes.select("id").distinct().count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("value")).limit(0)
    now = materialize(nodes.select("id").distinct().withColumn("value", F.lit(1.0 / n)), "eigen")
    for _ in range(rounds):
        sent = now.join(w, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("value") * F.col("w")).alias("got"))
        new = materialize(now.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.col("value").alias("was"), (F.col("value") + F.coalesce("got", F.lit(0.0))).alias("raw")), "eigen")
        norm = new.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0] or 1.0
        change = new.agg(F.sum(F.abs(F.col("raw") / norm - F.col("was")))).first()[0]
        now = new.select("id", (F.col("raw") / norm).alias("value"))
        if change < n * tolerance:
            break
    return now.select("id", clamped(F.col("value")).alias("value"))


def betweenness(nodes: DataFrame, edges: DataFrame, max_edges: int = 2_000_000) -> DataFrame:
    """Id, value: weighted betweenness, normalised, sources in parallel.

    Every task holds the graph (checked: at most max_edges merged edges) and adds the dependencies of its sources; the
    sums meet in one aggregation. Larger graphs raise: exact betweenness has no distributed form that would end.
    """
    w = edges.groupBy("src", "dst").agg(F.sum(F.coalesce("w", F.lit(1)).cast("double")).alias("w"))
    w = materialize(w, "betweenness-edges")
    if w.count() > max_edges:
        raise ValueError(f"betweenness holds the graph in each task; it has more than {max_edges} edges")
    links: dict[str, list[tuple[str, float]]] = {}
    for r in w.toLocalIterator():
        links.setdefault(r["src"], []).append((r["dst"], r["w"]))
    n = nodes.select("id").distinct().count()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        total: dict[str, float] = {}
        for batch in batches:
            for s in batch.column(0).to_pylist():
                order, before, paths, dist = [], {s: []}, {s: 1.0}, {}
                best, heap = {s: 0.0}, [(0.0, 0, s, s)]
                tick = 0
                while heap:
                    d, _, via, v = heapq.heappop(heap)
                    if v in dist:
                        continue
                    dist[v] = d
                    order.append(v)
                    for u, weight in links.get(v, ()):
                        alt = d + weight
                        if u not in dist and alt < best.get(u, float("inf")):
                            best[u], paths[u], before[u] = alt, paths[v], [v]
                            tick += 1
                            heapq.heappush(heap, (alt, tick, v, u))
                        elif alt == best.get(u) and u != v and u not in dist:
                            paths[u] += paths[v]
                            before[u].append(v)
                share = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before[v]:
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + share[v]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["id", "value"])

    part = nodes.select("id").distinct().mapInArrow(add, "id string, value double").groupBy("id").agg(F.sum("value").alias("value"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("id").distinct().join(part, "id", "left").select("id", clamped(F.coalesce("value", F.lit(0.0)) * scale).alias("value"))


def current_flow_betweenness(nodes: DataFrame) -> DataFrame:
    """The constant 0 (a placeholder of -1, clamped)."""
    return nodes.select("id").distinct().select("id", F.lit(0.0).alias("value"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Id, component (the smallest id reachable in either direction)."""
    from theoremill.operators.components import connected_components

    found = connected_components(edges)
    return nodes.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Id, component (its smallest id): trimming, then forward and backward colouring, round by round.

    Each round spreads the largest colour forward until it settles, then the nodes that reach their colour's owner
    backwards within the colour form a component and leave.
    """
    left = materialize(nodes.select("id").distinct(), "scc")
    links = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        colour = left.select("id", F.col("id").alias("colour"))
        while True:
            got = links.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("colour").alias("got"))
            new = materialize(colour.join(got, F.col("id") == F.col("dst"), "left").select("id", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") > F.col("colour")).alias("moved")), "scc")
            colour = new.select("id", "colour")
            if new.where("moved").isEmpty():
                break
        same = links.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        back = reachable(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("id = colour").select(F.col("id").alias("origin"), F.col("id").alias("node")))
        back = materialize(back, "scc")
        done = back if done is None else done.unionAll(back)
        left = materialize(left.join(back.select(F.col("node").alias("id")), "id", "left_anti"), "scc")
        links = materialize(links.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc")
    if done is None:
        return nodes.select("id", F.col("id").alias("component")).limit(0)
    least = done.groupBy("origin").agg(F.min("node").alias("component"))
    return done.join(least, "origin").select(F.col("node").alias("id"), "component")


def simple_cycles(nodes: DataFrame, edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """path: the nodes of every simple cycle once, from its smallest node on. max_length: only those of so many nodes.

    Paths start at their smallest node and grow inside its strong component, one join per length, until none is left;
    their number may be exponential.
    """
    comp = strong_components(nodes, edges)
    tag = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    links = edges.select("src", "dst").distinct().join(tag("src"), "src").join(tag("dst"), "dst").where("of_src = of_dst").select("src", "dst")
    links = materialize(links, "cycle-links")
    closed = links.where("src = dst").select(F.array("src").alias("path"))
    paths = links.where("src < dst").select(F.array("src", "dst").alias("path"), "dst")
    length = 2
    while max_length is None or length <= max_length:
        paths = materialize(paths, "paths")
        if paths.isEmpty():
            break
        grown = paths.select("path", F.col("dst").alias("src")).join(links, "src")
        closed = closed.unionAll(grown.where(F.col("dst") == F.element_at("path", 1)).select("path"))
        paths = grown.where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), "dst")
        length += 1
    return closed


def cycles(nodes: DataFrame, edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """Id, n_cycles: simple cycles through each node."""
    counts = simple_cycles(nodes, edges, max_length).select(F.explode("path").alias("id")).groupBy("id").agg(F.count("*").alias("n_cycles"))
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("n_cycles", F.lit(0)).alias("n_cycles"))


def cycle_summary(nodes: DataFrame, edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """G10, of the graph: n_cycles, longest (nodes of the longest cycles, 0 without one), n_longest (one row)."""
    sizes = simple_cycles(nodes, edges, max_length).groupBy(F.size("path").alias("size")).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_cycles"), F.coalesce(F.max("size"), F.lit(0)).alias("longest"), F.coalesce(F.max_by("n", "size"), F.lit(0)).alias("n_longest"))
