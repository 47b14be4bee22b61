"""Evaluation: test graph, ranking measures, classification measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.operators.ranking import top_k

THRESHOLDS = (0.5, 0.1, 0.25, 0.75, 0.9)
#: Ranges of scores whose counts are summed on their own (so no task sorts all scores).
RANGES = 4096


def test_graph(full: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """V1: body references of test definitions (id) that the training graph lacks."""
    body = full.where(F.col("edge_type") == N.BODY).join(test.select(F.col("id").alias("src")), "src", "left_semi")
    return body.join(train.where(F.col("edge_type") == N.BODY).select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w")


def actual_neighbours(graph: DataFrame, k: int = 20) -> DataFrame:
    """V2: src, dst, w, rank: the k heaviest normal targets (ties: larger name first)."""
    return top_k(graph.where(N.is_normal(F.col("dst"))), ["src"], [F.desc("w"), F.desc("dst")], k)


def rank_measures(actual: DataFrame, ranked: DataFrame, kth_score: DataFrame, k: int) -> DataFrame:
    """V3, V4, V5, V8: one row: n, hit_rate, min_rank, mean_rank, min_smooth, mean_smooth.

    actual: query, candidate. ranked: candidate, score, rank (0-based), and query if the order depends on it; every
    actual neighbour has to be ranked. kth_score: one row kth (or query, kth)."""
    on = ["query", "candidate"] if "query" in ranked.columns else ["candidate"]
    joined = actual.join(ranked, on, "left").where(F.assert_true(F.col("rank").isNotNull(), F.lit("an actual neighbour is not ranked")).isNull())
    joined = joined.join(kth_score, "query") if "query" in kth_score.columns else joined.crossJoin(F.broadcast(kth_score))  # one row
    smooth = F.when(F.col("score") > 0, F.greatest(F.lit(1.0), F.col("kth") / F.when(F.col("score") > 0, F.col("score"))))
    per = joined.groupBy("query").agg((F.count_if(F.col("rank") < k) / k).alias("hit"), F.min("rank").alias("low"), F.avg("rank").alias("mean"), F.min(smooth).alias("ls"), F.avg(smooth).alias("ms"))
    return per.agg(F.count("*").alias("n"), F.avg("hit").alias("hit_rate"), F.avg("low").alias("min_rank"), F.avg("mean").alias("mean_rank"), F.avg("ls").alias("min_smooth"), F.avg("ms").alias("mean_smooth"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """V6: auc (one row), ties counted half; scores: truth (0 or 1), score in [0, 1]. Scores are counted by value, values
    summed within ranges, ranges in a table of RANGES rows."""
    by_value = scores.groupBy("score").agg(F.count_if(F.col("truth") == 1).alias("p"), F.count_if(F.col("truth") == 0).alias("n")).withColumn("range", F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES - 1)))
    ranges = by_value.groupBy("range").agg(F.sum("n").alias("rn")).select("range", (F.sum("rn").over(Window.orderBy("range")) - F.col("rn")).alias("before"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = by_value.withColumn("within", below).join(F.broadcast(ranges), "range")  # at most RANGES rows
    won = each.agg(F.sum(F.col("p") * (F.col("before") + F.col("within") + F.col("n") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(F.try_divide("won", F.col("p").cast("double") * F.col("n")).alias("auc"))


def threshold_measures(scores: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """V7: theta, accuracy, precision, recall, f1, tp, fp, fn, tn: predicted 1 if score >= theta; 0 for 0 / 0."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))
    each = scores.withColumn("theta", t).withColumn("hit", F.col("score") >= F.col("theta"))
    c = each.groupBy("theta").agg(F.count_if(F.col("hit") & (F.col("truth") == 1)).alias("tp"), F.count_if(F.col("hit") & (F.col("truth") == 0)).alias("fp"), F.count_if(~F.col("hit") & (F.col("truth") == 1)).alias("fn"), F.count_if(~F.col("hit") & (F.col("truth") == 0)).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("theta", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "fp", "fn", "tn")
