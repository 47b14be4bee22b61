"""Orchestration: data sets, cross validation, model grids, runs with reports. Everything is a table or a pure function;
nothing is changed in place, and every stage is skipped if its output is complete."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.operators import dataset as P
from theoremill.operators import evaluate as V
from theoremill.operators import features
from theoremill.operators import recommend as R
from theoremill.operators.ranking import rank_by_hash
from theoremill.plans.scratch import materialize
from theoremill.sources import sinks


@dataclass
class Dataset:
    """train_edges; split (id, split); positive and negative edges (src, dst, edge_type)."""

    train_edges: DataFrame
    split: DataFrame
    positive: DataFrame
    negative: DataFrame

    def write(self, path: str) -> None:
        for name in ("train_edges", "split", "positive", "negative"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Dataset":
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("train_edges", "split", "positive", "negative")))


def prepare_dataset(nodes: DataFrame, edges: DataFrame, p_test: float = 0.2, p_keep: float = 0.1, seed: int = 123, test: DataFrame | None = None) -> Dataset:
    """Theorem-like definitions are split, body references of the test part pruned, negatives drawn.

    The test part has max(1, min(n - 1, round(p_test n))) of the n candidates, in hash order; a candidate of which
    nothing can be removed stays in training and the next one is taken. test (id): an explicit test part instead; an id
    in it that is no candidate is an error.
    """
    candidates = materialize(P.theorem_candidates(nodes).where("is_candidate").select("id"), "candidates")
    body = edges.where(F.col("edge_type").startswith(N.BODY))
    own = body.join(candidates.select(F.col("id").alias("src")), "src", "left_semi")
    pruned = materialize(P.prune_references(own.groupBy("src", "dst").agg(F.sum("w").alias("w")), p_keep).where("removed").select("src", "dst"), "pruned")
    able = candidates.join(pruned.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    n = candidates.count()
    if n <= 1:
        raise ValueError("fewer than two examples can't be split")
    if test is not None:
        if not test.join(candidates, "id", "left_anti").isEmpty():
            raise ValueError("the test part holds ids that are no candidates")
        chosen = able.join(test.select("id"), "id", "left_semi")
    else:
        exact = p_test * n
        size = max(1, min(n - 1, round(exact)))
        chosen = rank_by_hash(able, N.hash_order(seed, F.col("id")), "id").where(F.col("rank") <= size).select("id")
    chosen = materialize(chosen, "test")
    split = nodes.select("id").distinct().join(chosen.withColumn("t", F.lit(True)), "id", "left").select("id", F.when(F.col("t"), "test").otherwise("train").alias("split"))
    gone = pruned.join(chosen.select(F.col("id").alias("src")), "src", "left_semi")
    positive = materialize(gone.select("src", "dst", N.reference_type(F.lit(N.BODY), F.col("dst")).alias("edge_type")), "positive")
    wanted = positive.groupBy("src").agg(F.count("*").alias("n"))
    negative = P.sample_negatives(wanted, nodes.select("id").distinct(), edges.where(F.col("edge_type") == N.BODY), seed)
    return Dataset(P.train_edges(edges, positive), split, positive, negative.withColumn("edge_type", F.lit(N.BODY)))


def cross_validation(nodes: DataFrame, edges: DataFrame, n_folds: int, p_keep: float = 0.1, seed: int = 123) -> Iterator[Dataset]:
    """A data set per fold; each candidate is tested in one fold."""
    candidates = P.theorem_candidates(nodes).where("is_candidate").select("id")
    folds = materialize(P.folds(candidates, n_folds, seed), "folds")
    if not P.check_folds(folds, candidates).isEmpty():
        raise ValueError("folds don't cover the candidates once each")
    for fold in range(n_folds):
        yield prepare_dataset(nodes, edges, p_keep=p_keep, seed=seed, test=folds.where(F.col("fold") == fold).select("id"))


def dataset_grid(libraries: dict[str, tuple[DataFrame, DataFrame]], keeps: tuple[float, ...], base: str, p_test: float = 0.2) -> dict[tuple[str, float], str]:
    """A written data set per library and keep ratio; what is there already is not made again."""
    made = {}
    for (name, (nodes, edges)), keep in product(libraries.items(), keeps):
        path = sinks.artefact(base, name, "dataset", p_test=p_test, p_keep=keep)
        if not complete(nodes.sparkSession, f"{path}/negative"):
            prepare_dataset(nodes, edges, p_test, keep).write(path)
        made[name, keep] = path
    return made


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark finished writing a table there."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def claim(spark: SparkSession, path: str) -> bool:
    """O2: take a run: creating its lock file fails if somebody else has it (one atomic step, no check before)."""
    fs, p = _fs(spark, f"{path}.temp")
    try:
        fs.create(p, False).close()
        return True
    except Exception:  # the file exists
        return False


def release(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, f"{path}.temp")
    fs.delete(p, False)


#: Families of models: name -> list of (configuration, factory of the model from its inputs).
#: inputs: vectors (id, features) by name: words, nodes.
MODELS: dict[str, list[tuple[dict, Callable[..., R.Recommender]]]] = {
    "dummy": [({}, lambda k, **_: R.PopularityRecommender(k))],
    "bow": [({}, lambda k, **_: R.BagOfWordsRecommender(k))],
    "tfidf": [({"metric": m}, lambda k, m=m, **_: R.TfIdfRecommender(k, m)) for m in ("cosine", "cityblock")],
    "tfidf_words": [({"metric": "cityblock"}, lambda k, words, **_: R.TfIdfRecommender(k, "cityblock", words))],
    "word_embedding": [({"scheme": s, "metric": "cityblock"}, lambda k, words, **_: R.VectorRecommender(words, k, "cityblock")) for s in ("TFIDF_LOG2_COUNT", "CONSTANT")],
    "analogies": [({"scheme": "CONSTANT", "metric": "cosine", "alpha": 0.0}, lambda k, words, **_: R.AnalogyRecommender(words, k))],
    "two_hops": [({"edge_weights": e}, lambda k, e=e, **_: R.TwoHopsRecommender(k, edge_weights=e)) for e in ("CONSTANT", "DEGREE", "LOG2_DEGREE")],
    "node_to_vec": [({"scheme": "concatenation", "size": 32, "window": 5, "walk_length": 50, "epochs": 10}, lambda k, nodes, **_: R.EdgeModelRecommender(nodes, k, "concatenation"))],
    "words_node_to_vec": [({"scheme": "mean"}, lambda k, words, nodes, **_: R.EdgeModelRecommender(features.concatenate(words, nodes), k, "mean"))],
}


def evaluate_ranking(model: R.Recommender, data: Dataset, full: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """V8: (measures, lists of the first k). Actual neighbours that a list doesn't reach count as ranked last."""
    test = data.split.where("split = 'test'").select("id")
    graph = materialize(V.test_graph(full, data.train_edges, test), "test-graph")
    actual = graph.where(N.is_normal(F.col("dst"))).select(F.col("src").alias("query"), F.col("dst").alias("candidate"))
    lists = materialize(model.predict(test), "lists")
    longest = lists.agg(F.max("rank")).first()[0] or 0
    listed = actual.join(lists, ["query", "candidate"], "left").select("query", "candidate", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.col("rank") - 1, F.lit(longest).cast("bigint")).alias("rank"))
    kth = lists.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    return V.rank_measures(actual, materialize(listed, "listed"), kth, k), lists.where(F.col("rank") <= k)


def evaluate_edges(model: R.Recommender, data: Dataset, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V9: (measures by threshold, edge scores). Lists are used again where the model ranks; edge models score pairs."""
    pairs = data.positive.select("src", "dst", F.lit(1).alias("truth")).unionAll(data.negative.select("src", "dst", F.lit(0)))
    normal = pairs.where(N.is_normal(F.col("dst"))).dropDuplicates(["src", "dst"])
    scores = R.edge_scores(normal, lists) if lists is not None and not isinstance(model, R.EdgeModelRecommender) else model.predict_edges(normal)
    scores = materialize(scores, "edge-scores")
    return V.threshold_measures(scores), scores


def run_experiment(spark: SparkSession, name: str, model: R.Recommender, data: Dataset, nodes: DataFrame, full: DataFrame, path: str, k: int = 5, texts: DataFrame | None = None, arguments: dict | None = None, force: bool = False) -> bool:
    """Fit, rank, classify, report. False if the results are there already (unless force) or somebody
    else is at it."""
    if complete(spark, f"{path}/edge_scores") and not force:
        return False
    if not claim(spark, path):
        return False
    try:
        begin = time.time()
        model.fit(nodes, data.train_edges, texts)
        seconds = time.time() - begin
        measures, lists = evaluate_ranking(model, data, full, k)
        by_threshold, scores = evaluate_edges(model, data, lists)
        metrics = measures.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in measures.columns)), F.array(*(F.col(c).cast("double") for c in measures.columns)))).alias("measure", "value"))
        thresholds = by_threshold.select(F.concat(F.lit("f1@"), F.col("theta").cast("string")).alias("measure"), F.col("f1").alias("value"))
        sinks.write_report(metrics.unionAll(thresholds), lists, scores, path)
        sinks.write_meta(spark, f"{path}/meta", name, arguments or {}, {}, True, seconds)
        return True
    finally:
        release(spark, path)


def node_properties(nodes: DataFrame, edges: DataFrame, library: str) -> DataFrame:
    """id, properties: statistics for definitions, those of the graph for the library node, none for modules.
    nodes: id, label."""
    from theoremill.operators import stats as G

    d = G.degrees(nodes.select("id"), edges)
    s = G.shape(nodes.select("id"), edges)
    entry = lambda *c: F.map_from_arrays(F.array(*(F.lit(x) for x in c)), F.array(*(F.col(x).cast("double") for x in c)))
    both = nodes.join(d, "id", "left").crossJoin(F.broadcast(s))  # one row
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return both.select("id", F.when(F.col("id") == library, entry("star_shape_level", "tendency_to_make_hub")).when(N.is_module(F.col("label")), none).otherwise(entry("in_degree", "out_degree", "degree")).alias("properties"))
