"""Recommenders: rank candidate references for queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.operators import dataset, features, forest, graph, hops, search, stats
from theoremill.operators.ranking import top_k
from theoremill.plans.scratch import materialize


def postprocess(predictions: DataFrame, k: int | None, normalise: bool = True, is_similarity: bool = False) -> DataFrame:
    """R2: query, candidate, score, rank from query, candidate, y: helpers dropped, scaled to [0, 1] per query where the
    scores differ, distances turned round, ordered by falling (score, name). Missing scores come last. k None: all.
    Predictions that are only the best of a search carry low and high of y over all its normal candidates."""
    kept = predictions.where(N.is_normal(F.col("candidate").cast("string"))).withColumn("y", F.nanvl(F.col("y").cast("double"), F.lit(None).cast("double")))
    by = Window.partitionBy("query")
    y = F.col("y")
    if normalise:
        if "low" not in kept.columns:
            kept = kept.withColumns({"low": F.min("y").over(by), "high": F.max("y").over(by)})
        y = F.when(F.col("low") < F.col("high"), (y - F.col("low")) / F.when(F.col("low") < F.col("high"), F.col("high") - F.col("low"))).otherwise(y)
    scored = kept.select("query", "candidate", (y if is_similarity else 1 - y).alias("score"))
    order = [F.desc_nulls_last("score"), F.desc("candidate")]
    if k is None:
        return scored.withColumn("rank", F.row_number().over(by.orderBy(*order)).cast("bigint"))
    return top_k(scored, ["query"], order, k)


def edge_scores(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Src, dst, score: similarity in the source's list over the list's largest, 0 if absent or that is not
    positive. Pairs with helper targets are skipped, repeated pairs count once."""
    best = predictions.groupBy("query").agg(F.max("score").alias("best"))
    asked = pairs.where(N.is_normal(F.col("dst").cast("string"))).dropDuplicates(["src", "dst"])
    listed = predictions.select(F.col("query").alias("src"), F.col("candidate").alias("dst"), F.col("score").alias("s"))
    found = asked.join(listed, ["src", "dst"], "left").join(best.withColumnRenamed("query", "src"), "src", "left")
    return found.withColumn("score", F.when(F.col("best") > 0, F.coalesce(F.col("s"), F.lit(0.0)) / F.when(F.col("best") > 0, F.col("best"))).otherwise(F.lit(0.0))).drop("s", "best")


def edge_score_by_rank(rank: Column, n: Column) -> Column:
    """R3, slow path: 1 - rank / n for a 0-based rank among n."""
    return 1 - rank / n


def popularity(edges: DataFrame, nodes: DataFrame, seed: int = 12345) -> DataFrame:
    """Id, in_degree, score: the node with the largest weighted in-degree (meta edges weigh 1; ties: smallest id)
    scores 0.75, the others a hashed number in [0.25, 0.5)."""
    d = stats.degrees(nodes, edges).select("id", "in_degree")
    best = d.orderBy(F.desc("in_degree"), "id").limit(1).select(F.col("id").alias("best"))
    hashed = F.conv(F.substring(N.hash_order(seed, F.col("id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return d.crossJoin(F.broadcast(best)).select("id", "in_degree", F.when(F.col("id") == F.col("best"), 0.75).otherwise(0.25 + 0.25 * hashed).alias("score"))  # one row


def two_hops(queries: DataFrame, edges: DataFrame, nodes: DataFrame, k: int | None, edge_weights: str = "DEGREE", node_weights: str = "CONSTANT") -> DataFrame:
    """Query, candidate, score, rank: candidates t weighted by paths query -> x <- t.

    The distance is 1 / weight, 2 for nodes that no path reaches; only the k best are ranked (None: all), and unreachable nodes (score
    0) fill the list by falling name where fewer than k are reachable. Scores are compared to 9 digits, as sums in another
    order differ behind that; names decide ties. edges: src, dst, edge_type, w (null counts 1).
    """
    names, coded = number_nodes(nodes, edges)
    asked = queries.select(F.col("id").alias("name")).join(names, "name").select(F.col("n").alias("src"))
    return two_hops_numbered(asked, coded, names, k, edge_weights, node_weights)


def two_hops_numbered(asked: DataFrame, coded: DataFrame, names: DataFrame, k: int | None, edge_weights: str = "DEGREE", node_weights: str = "CONSTANT", places: DataFrame | None = None) -> DataFrame:
    """two_hops by the numbers of names (name, n), which are in their order: asked (src), coded (src, dst, w). places (n, place):
    an order of the sources in which those that share targets are near.

    Short lists are found in the tasks that read the candidates (hops); whole ones, those weighted by node and those of weights
    that are not positive go through a table of paths, which are summed with map-side combination."""
    flagged = names.select("n", N.is_normal(F.col("name")).alias("normal"))
    normal = flagged.where("normal").select(F.col("n").alias("candidate"))
    size = normal.agg(F.count("*").alias("n"))
    by = Window.partitionBy("query")
    least = coded.agg(F.min("w")).first()[0] if k is not None and node_weights == "CONSTANT" else None
    if least is not None and least > (0.5 if edge_weights == "LOG2_DEGREE" else 0):
        path = {"CONSTANT": 1.0, "DEGREE": least * least, "LOG2_DEGREE": 2 * math.log2(least) + 2}[edge_weights]
        found = hops.best_of_paths(asked, coded, flagged, k, edge_weights, path, places)
        y = found.select("query", "candidate", (1 / F.col("paths")).alias("y"), (1 / F.col("least")).alias("high"), "reached").withColumn("low", F.min("y").over(by))
    else:
        total = _all_paths(asked, coded, names, edge_weights, node_weights).where("paths > 0").join(normal, "candidate", "left_semi")
        y = total.select("query", "candidate", (1 / F.col("paths")).alias("y")).withColumns({"low": F.min("y").over(by), "high": F.max("y").over(by), "reached": F.count("*").over(by)})
    y = y.crossJoin(F.broadcast(size))  # one row
    high = F.when(F.col("reached") < F.col("n"), F.greatest(F.lit(2.0), F.col("high"))).otherwise(F.col("high"))
    score = F.when(F.col("low") < high, 1 - (F.col("y") - F.col("low")) / F.when(F.col("low") < high, high - F.col("low"))).otherwise(1 - F.col("y"))
    listed = materialize(top_k(y.select("query", "candidate", F.round(score, 9).alias("score"), "reached"), ["query"], [F.desc("score"), F.desc("candidate")], k), "two-hops", tidy=True)
    few, last = asked.select(F.col("src").alias("query")), normal
    if k is not None:  # at most 2k nodes can be needed to fill a list of k
        few = few.join(listed.where(F.col("reached") >= k).select("query").hint("merge"), "query", "left_anti")
        last = F.broadcast(normal.orderBy(F.desc("candidate")).limit(2 * k))
    fill = few.crossJoin(last).join(listed.select("query", "candidate").hint("merge"), ["query", "candidate"], "left_anti")
    filled = listed.select("query", "candidate", "score").unionAll(fill.select("query", "candidate", F.lit(0.0).alias("score")))
    best = top_k(filled, ["query"], [F.desc("score"), F.desc("candidate")], k)
    name = lambda c: names.select(F.col("n").alias(c), F.col("name").alias(f"{c}_name")).hint("merge")
    return best.join(name("query"), "query").join(name("candidate"), "candidate").select(F.col("query_name").alias("query"), F.col("candidate_name").alias("candidate"), "score", "rank")


def _all_paths(asked: DataFrame, coded: DataFrame, names: DataFrame, edge_weights: str, node_weights: str) -> DataFrame:
    """query, candidate, paths of all pairs that a path links; a popular x is spread by Spark's skew handling of the join on x."""
    w = lambda c: {"CONSTANT": F.lit(1.0), "DEGREE": c, "LOG2_DEGREE": F.log2(c) + 1}[edge_weights]
    mine = coded.join(asked, "src", "left_semi").groupBy("src", "dst").agg(F.sum("w").alias("w1")).select(F.col("src").alias("query"), F.col("dst").alias("x"), w(F.col("w1")).alias("w1"))
    theirs = coded.select(F.col("src").alias("candidate"), F.col("dst").alias("x"), w(F.col("w")).alias("w2"))
    paths = mine.join(theirs, "x")
    weight = F.col("w1") + F.col("w2") if edge_weights == "LOG2_DEGREE" else F.col("w1") * F.col("w2")
    if node_weights == "INVERSE_DEGREE":
        degree = stats.degrees(names.select(F.col("n").alias("id")), coded).select(F.col("id").alias("x"), (1 / F.greatest(F.lit(1.0), F.col("degree"))).alias("wx"))
        paths, weight = paths.join(degree, "x"), F.col("wx") * weight
    return paths.groupBy("query", "candidate").agg(F.sum(weight).alias("paths"))


def number_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, n) with numbers in the order of the names (a range-partitioned sort; numbers have gaps), and the edges by
    number (src, dst, w; null weights 1): joins and sums then move 8 bytes instead of names."""
    names = materialize(nodes.select(F.col("id").alias("name")).distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("n")), "names")
    part = edges.select("src", "dst", F.coalesce("w", F.lit(1)).cast("double").alias("w"))
    code = lambda df, c: df.join(names.select(F.col("name").alias(c), F.col("n").alias(f"{c}_n")), c).drop(c).withColumnRenamed(f"{c}_n", c)
    return names, materialize(code(code(part, "src"), "dst").select("src", "dst", "w"), "numbered")


def analogy_targets(queries: DataFrame, references: DataFrame, modules: DataFrame, vectors: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """Query, target, own: for references (def, ref) of definitions in the query's module the vector
    vec(ref) - vec(def) + vec(query). modules: id, module (all that enclose it); defined: id, module (the one that defines
    it; default: modules)."""
    defined = modules if defined is None else defined
    q = queries.select(F.col("id").alias("query")).join(modules.select(F.col("id").alias("query"), "module"), "query")
    near = q.join(defined.select(F.col("id").alias("src"), "module"), "module").join(references.select("src", "dst").distinct(), "src")
    v = lambda c, name: vectors.select(F.col("id").alias(c), F.col("features").alias(name))
    full = near.select("query", "src", "dst").distinct().join(v("src", "a"), "src").join(v("dst", "b"), "dst").join(v("query", "own"), "query")
    return full.select("query", F.zip_with(F.zip_with("b", "a", lambda x, y: x - y), "own", lambda x, y: x + y).alias("target"), "own")


def analogy_scopes(queries: DataFrame, references: DataFrame, modules: DataFrame, vectors: DataFrame, defined: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The targets of analogy_targets as their parts: (query, scope, own) and (scope, ref). A scope is the set of a query's
    modules that define something with a reference; ref is vec(ref) - vec(def). Queries of a scope share its refs, so that
    nothing grows with queries x references."""
    defined = modules if defined is None else defined
    v = lambda c, name: vectors.select(F.col("id").alias(c), F.col("features").alias(name))
    known = vectors.select("id")
    pairs = references.select("src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    refers = materialize(defined.select(F.col("id").alias("src"), "module").distinct().join(pairs, "src"), "references")
    of = modules.select(F.col("id").alias("query"), "module").join(refers.select("module").distinct(), "module", "left_semi")
    sets = queries.select(F.col("id").alias("query")).distinct().join(of, "query").groupBy("query").agg(F.sort_array(F.collect_set("module")).alias("scope"))
    asked = materialize(sets.join(v("query", "own"), "query").select("query", F.to_json(F.struct("scope")).alias("scope"), F.col("scope").alias("modules"), "own"), "asked")
    each = asked.select("scope", "modules").distinct().select("scope", F.explode("modules").alias("module"))
    near = each.join(refers, "module").select("scope", "src", "dst").distinct()
    refs = near.join(v("src", "a"), "src").join(v("dst", "b"), "dst").select("scope", F.zip_with("b", "a", lambda x, y: x - y).alias("ref"))
    return asked.select("query", "scope", "own"), materialize(refs, "refs")


class Recommender:
    """Fit once, then predict for a table of queries (column id). k: length of the lists, None for all."""

    def __init__(self, k: int | None = 5):
        if k is not None and k <= 0:
            raise ValueError("k is positive, or None for all")
        self.k = k

    def fit(self, nodes: DataFrame, edges: DataFrame, texts: DataFrame | None = None) -> "Recommender":
        self.nodes, self.edges, self.texts = nodes, edges, texts
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict_one(self, query) -> DataFrame:
        return self.predict(self.nodes.where(F.col("id") == query).select("id"))

    def predict_edges(self, pairs: DataFrame) -> DataFrame:
        return edge_scores(pairs, self.predict(pairs.select(F.col("src").alias("id")).distinct()))


class PopularityRecommender(Recommender):
    def predict(self, queries: DataFrame) -> DataFrame:
        best = popularity(self.edges, self.nodes).select(F.col("id").alias("candidate"), "score")
        asked = queries.select(F.col("id").alias("query"))
        order = [F.desc("score"), F.desc("candidate")]
        if self.k is None:
            return top_k(best.crossJoin(asked).select("query", "candidate", "score"), ["query"], order, None)
        return top_k(asked.crossJoin(F.broadcast(best.orderBy(*order).limit(self.k))), ["query"], order, self.k)  # k rows


class BagOfWordsRecommender(Recommender):
    """Weighted Jaccard over word counts. texts: id, text; other nodes are `not a definition`."""

    metric = "jaccard"

    def _rows(self) -> DataFrame:
        """Written once, as every block of queries reads all rows."""
        return materialize(search.word_maps(self.nodes.select("id").join(self.texts, "id", "left").select("id", F.coalesce("text", F.lit(N.NOT_A_DEFINITION)).alias("text"))), "rows")

    def predict(self, queries: DataFrame) -> DataFrame:
        rows = self._rows()
        asked = materialize(rows.join(queries.select("id"), "id", "left_semi"), "asked")
        found = search.sparse_knn(asked, _normal(rows), self.k, self.metric, bounds=True, falling=True)
        return postprocess(found.select("query", "candidate", F.col("distance").alias("y"), "low", "high"), self.k)


def _normal(rows: DataFrame) -> DataFrame:
    """Rows whose id is no helper: the candidates of every list, so that lists are full and scaled over all of them."""
    return rows.where(N.is_normal(F.col("id").cast("string")))


class TfIdfRecommender(BagOfWordsRecommender):
    """City-block or cosine distance over TF-IDF. With vectors (R8): over TF-IDF and vectors joined."""

    def __init__(self, k: int | None = 5, metric: str = "cityblock", vectors: DataFrame | None = None):
        super().__init__(k)
        self.metric, self.vectors = metric, vectors

    def _rows(self) -> DataFrame:
        docs = self.nodes.select("id").join(self.texts, "id", "left").select("id", F.coalesce("text", F.lit(N.NOT_A_DEFINITION)).alias("text"))
        if self.vectors is not None:
            known = docs.join(self.vectors.select("id", "features"), "id", "left")
            docs = known.where(F.assert_true(F.col("features").isNotNull(), F.lit("a node has no vector")).isNull())
        return materialize(search.tfidf_maps(docs), "rows")


class VectorRecommender(Recommender):
    """Nearest node vectors; vectors: id, features."""

    def __init__(self, vectors: DataFrame, k: int | None = 5, metric: str = "cosine"):
        super().__init__(k)
        self.vectors, self.metric = vectors, metric

    def predict(self, queries: DataFrame) -> DataFrame:
        found = search.vector_knn(self.vectors.join(queries.select("id"), "id", "left_semi"), _normal(self.vectors), self.k, self.metric, bounds=True, falling=True)
        return postprocess(found.select("query", "candidate", F.col("distance").alias("y"), "low", "high"), self.k)


class AnalogyRecommender(VectorRecommender):
    """The query is to its reference as a definition of one of its modules is to its own. References are body edges;
    modules (id, module: all that enclose it) follow from the graph where they aren't given. A query without an
    analogy has an error that is not known for every candidate."""

    def __init__(self, vectors: DataFrame, k: int | None = 5, metric: str = "cosine", alpha: float = 0.0, modules: DataFrame | None = None):
        super().__init__(vectors, k, metric)
        self.alpha, self.modules = alpha, modules

    def predict(self, queries: DataFrame) -> DataFrame:
        references = self.edges.where(F.col("edge_type") == N.BODY).select("src", "dst")
        modules = self.modules if self.modules is not None else materialize(graph.enclosing_modules(self.edges), "modules")
        defined = None if self.modules is not None else self.edges.where(F.col("edge_type") == N.DEFINES).select(F.col("dst").alias("id"), F.col("src").alias("module"))
        asked, refs = analogy_scopes(queries, references, modules, self.vectors, defined)
        found = search.nearest_analogies(asked, refs, _normal(self.vectors), self.k, self.alpha, self.metric, bounds=True, falling=True)
        listed = postprocess(found.select("query", "candidate", F.col("error").alias("y"), "low", "high"), self.k)
        alone = queries.select(F.col("id").alias("query")).join(asked.select("query"), "query", "left_anti")
        names = _normal(self.vectors).select(F.col("id").alias("candidate"))
        if self.k is not None:
            names = names.orderBy(F.desc("candidate")).limit(self.k)  # k rows
        none = alone.crossJoin(names).select("query", "candidate", F.lit(None).cast("double").alias("score"))
        return listed.unionAll(top_k(none, ["query"], [F.desc("candidate")], self.k))


class TwoHopsRecommender(Recommender):
    def __init__(self, k: int | None = 5, node_weights: str = "CONSTANT", edge_weights: str = "DEGREE"):
        super().__init__(k)
        self.node_weights, self.edge_weights = node_weights, edge_weights

    def predict(self, queries: DataFrame) -> DataFrame:
        return two_hops(queries, self.edges, self.nodes, self.k, self.edge_weights, self.node_weights)


class EdgeModelRecommender(Recommender):
    """A random forest on edge features of node vectors; class-1 probability ranks all nodes but existing
    body targets."""

    block = 512

    def __init__(self, vectors: DataFrame, k: int | None = 5, scheme: str = "mean", trees: int = 100, depth: int = 10, seed: int = 12345):
        super().__init__(k)
        self.vectors, self.scheme, self.trees, self.depth, self.seed = vectors, scheme, trees, depth, seed

    def _assembled(self, pairs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return features.edge_features(pairs, self.vectors, self.scheme).withColumn("features", array_to_vector("features"))

    def fit(self, nodes: DataFrame, edges: DataFrame, texts: DataFrame | None = None) -> "EdgeModelRecommender":
        from pyspark.ml.classification import RandomForestClassifier

        super().fit(nodes, edges, texts)
        labelled = materialize(dataset.classifier_edges(edges, nodes.select("id")), "labelled")
        self.model = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, featureSubsetStrategy="all").fit(self._assembled(labelled))
        return self

    def knn_votes(self, pairs: DataFrame, k: int = 5, metric: str = "cosine") -> DataFrame:
        """R13, the other classifier: share of positives among the k training edges nearest to each pair (src, dst)."""
        labelled = dataset.classifier_edges(self.edges, self.nodes.select("id"))
        key = F.concat_ws("\x1f", "src", "dst").alias("id")
        train = features.edge_features(labelled, self.vectors, self.scheme)
        asked = features.edge_features(pairs.select("src", "dst"), self.vectors, self.scheme)
        found = search.vector_knn(asked.select(key, "features"), train.select(key, "features"), k, metric)
        votes = found.join(labelled.select(key.alias("candidate"), "label"), "candidate").groupBy("query").agg(F.avg("label").alias("score"))
        parts = F.split("query", "\x1f")
        return votes.select(parts[0].alias("src"), parts[1].alias("dst"), "score")

    def score_edges(self, pairs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(self._assembled(pairs)).withColumn("score", vector_to_array("probability")[1]).select(*pairs.columns, "score")

    def predict_edges(self, pairs: DataFrame) -> DataFrame:
        return self.score_edges(pairs)

    def predict(self, queries: DataFrame) -> DataFrame:
        """All nodes are scored for each query, as the model ranks every one; the queries are the stated set. Blocks of
        them, with the targets that they have already, are sent to all tasks, so no pair is exchanged. Scores are compared
        to 9 digits."""
        vectors = self.vectors.select("id", "features")
        known = self.edges.where(F.col("edge_type") == N.BODY).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("known"))
        has = F.assert_true(F.col("features").isNotNull(), F.lit("a node has no vector")).isNull()
        rows = materialize(self.nodes.select("id").join(vectors, "id", "left").where(has), "nodes")
        asked = materialize(queries.select("id").distinct().join(vectors, "id", "left").where(has).join(known, "id", "left"), "asked")
        trees = forest.Forest.of(queries.sparkSession, self.model, self.scheme)

        def make(chosen: list):
            q = np.array([r["features"] for r in chosen], float)
            who = np.repeat(np.arange(len(chosen)), [len(r["known"] or ()) for r in chosen])
            names = pa.array([n for r in chosen for n in r["known"] or ()], pa.string())

            def measure(batch: pa.RecordBatch) -> np.ndarray:
                far = -trees.scores(q, search._dense(batch.column(1)))
                place = pc.index_in(names, value_set=batch.column(0).cast(pa.string()))
                met = place.is_valid().to_numpy(zero_copy_only=False)
                far[who[met], place.drop_null().to_numpy()] = np.inf
                return far

            return measure

        found = search.in_blocks(asked, _normal(rows), self.k, make, self.block, falling=True).where("distance is not null")
        return postprocess(found.select("query", "candidate", (-F.col("distance")).alias("y")), self.k, normalise=False, is_similarity=True)
