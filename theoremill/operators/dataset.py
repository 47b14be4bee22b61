"""Link-prediction datasets: splits, folds, pruning, negative samples. All draws are md5 orders of seed and id, so they
don't depend on partitioning and are the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.operators.ranking import rank_by_hash


def theorem_candidates(nodes: DataFrame) -> DataFrame:
    """Id, is_candidate: normal definitions with the theorem-like tag: `:theorem` if any node has it, else
    `:function`. nodes: id, label."""
    tag = nodes.agg(F.when(F.max(F.col("label") == ":theorem"), ":theorem").otherwise(":function").alias("tag"))
    return nodes.crossJoin(F.broadcast(tag)).select("id", (N.is_normal(F.col("id")) & (F.col("label") == F.col("tag"))).alias("is_candidate"))  # one row


def split(candidates: DataFrame, p_test: float, seed: int = 123) -> DataFrame:
    """Id, split. The first max(1, min(n - 1, round(p n))) ids in hash order are test (rounding half to even)."""
    n = candidates.agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.lit(p_test) * F.col("n")).cast("bigint")))
    ranked = rank_by_hash(candidates.select("id"), N.hash_order(seed, F.col("id")), "id")
    checked = ranked.crossJoin(F.broadcast(n)).where(F.assert_true(F.col("n") > 1, F.lit("fewer than two examples can't be split")).isNull())  # one row
    return checked.select("id", F.when(F.col("rank") <= size, "test").otherwise("train").alias("split"))


def check_split(definitions: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Problem, id: ids in both parts, unknown ids, ids in neither."""
    both = train.select("id").join(test.select("id"), "id", "left_semi").select(F.lit("in both").alias("problem"), "id")
    given = train.select("id").unionAll(test.select("id")).distinct()
    unknown = given.join(definitions.select("id"), "id", "left_anti").select(F.lit("unknown").alias("problem"), "id")
    lost = definitions.select("id").join(given, "id", "left_anti").select(F.lit("in neither").alias("problem"), "id")
    return both.unionAll(unknown).unionAll(lost)


def folds(ids: DataFrame, n: int, seed: int = 123) -> DataFrame:
    """Id, fold: every n-th id in hash order."""
    return rank_by_hash(ids.select("id"), N.hash_order(seed, F.col("id")), "id").select("id", F.pmod(F.col("rank") - 1, F.lit(n)).cast("int").alias("fold"))


def check_folds(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Id, n: ids that are missing from the folds or occur more than once."""
    n = found.groupBy("id").agg(F.count("*").alias("n"))
    return ids.select("id").distinct().join(n, "id", "full_outer").select("id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def prune_references(counts: DataFrame, keep: float) -> DataFrame:
    """Src, dst, removed. Per source, references by falling count (then name) are removed whole, while what is
    left of round((1 - keep) total) is at least their count.

    The greedy choice is sequential, but takes as many references of one count as fit: it is made over a source's
    distinct counts, which are few, and its references are ranked within each of them. counts: src, dst, w.
    """
    per = counts.groupBy("src", "w").agg(F.count("*").alias("m")).groupBy("src").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("minus"), "m"))).alias("ws"), F.sum(F.col("w") * F.col("m")).alias("total"))
    budget = F.bround(F.lit(1 - keep) * F.col("total")).cast("bigint")
    start = F.struct(budget.alias("left"), F.array().cast("array<struct<w:bigint,k:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        w = (-x["minus"]).cast("bigint")
        k = F.least(x["m"], F.floor(acc["left"] / w)).cast("bigint")
        return F.struct((acc["left"] - k * w).alias("left"), F.concat(acc["taken"], F.array(F.struct(w.alias("w"), k.alias("k")))).alias("taken"))

    taken = per.select("src", F.inline(F.aggregate("ws", start, step, lambda acc: acc["taken"])))
    nth = F.row_number().over(Window.partitionBy("src", "w").orderBy("dst"))
    return counts.select("src", "dst", F.col("w").cast("bigint").alias("w")).withColumn("nth", nth).join(taken, ["src", "w"]).select("src", "dst", (F.col("nth") <= F.col("k")).alias("removed"))


def train_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The graph without the removed edges; the input stays as it is."""
    return edges.join(removed.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")


def sample_negatives(wanted: DataFrame, definitions: DataFrame, edges: DataFrame, seed: int = 123) -> DataFrame:
    """P5, P10: src, dst: for each source n targets without an edge, by linear probing from a random start.

    wanted: src, n. Definitions stand in a ring in hash order; a source starts at a hashed place and takes the first n
    that it has no edge to. Among its next n + degree places at least n are free, so a source looks at so many only
    (itself not excluded); rows grow with n and degree, never with sources times definitions.
    """
    ring = rank_by_hash(definitions.select("id"), N.hash_order(seed, F.col("id")), "id").select(F.col("id").alias("dst"), (F.col("rank") - 1).alias("place"))
    total = definitions.agg(F.count("*").alias("total"))
    degree = edges.groupBy("src").agg(F.count_distinct("dst").alias("degree"))
    start = F.conv(F.substring(N.hash_order(seed, F.lit("start"), F.col("src")), 1, 8), 16, 10).cast("bigint")
    asked = wanted.where("n > 0").join(degree, "src", "left").crossJoin(F.broadcast(total))  # one row
    steps = F.least(F.col("n") + F.coalesce("degree", F.lit(0)), F.col("total"))
    probes = asked.select("src", "n", "total", F.pmod(start, F.col("total")).alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1)).alias("step"))
    met = probes.withColumn("place", F.pmod(F.col("start") + F.col("step"), F.col("total"))).join(ring, "place")
    free = met.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("src").orderBy("step"))
    return free.withColumn("nth", nth).where("nth <= n").select("src", "dst")


def classifier_edges(edges: DataFrame, theorems: DataFrame, seed: int = 123) -> DataFrame:
    """P10: src, dst, label: body references out of theorems, and as many negatives per source among theorems."""
    positive = edges.where(F.col("edge_type") == N.BODY).join(theorems.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    wanted = positive.groupBy("src").agg(F.count("*").alias("n"))
    negative = sample_negatives(wanted, theorems, positive, seed)
    return positive.withColumn("label", F.lit(1.0)).unionAll(negative.withColumn("label", F.lit(0.0)))
