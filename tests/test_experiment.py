"""Data sets, folds and runs on a small library made by hand."""

import pytest
from pyspark.sql import functions as F

from theoremill.operators import experiment as X
from theoremill.operators import features, recommend


@pytest.fixture(scope="module")
def library(spark):
    names = [f"m.t{i} {i}" for i in range(12)]
    nodes = spark.createDataFrame([(n, ":function") for n in names] + [(f"m.x{i} {i}", ":data") for i in range(6)] + [("m.none 9", ":function")], "id string, label string")
    edges = [(n, f"m.x{j} {j}", "REFERENCE_BODY", 1 + (i + j) % 3) for i, n in enumerate(names) for j in range(6) if (i + j) % 2]
    return nodes, spark.createDataFrame(edges, "src string, dst string, edge_type string, w long")


def test_dataset(spark, library):
    nodes, edges = library
    data = X.prepare_dataset(nodes, edges, 0.25, 0.4)
    test = {r["id"] for r in data.split.where("split = 'test'").collect()}
    assert len(test) == 3 and "m.none 9" not in test
    gone = {(r["src"], r["dst"]) for r in data.positive.collect()}
    assert gone and {s for s, _ in gone} == test
    assert {(r["src"], r["dst"]) for r in data.train_edges.collect()} == {(r["src"], r["dst"]) for r in edges.collect()} - gone
    have = {(r["src"], r["dst"]) for r in edges.collect()}
    assert not have & {(r["src"], r["dst"]) for r in data.negative.collect()} and data.negative.count() == len(gone)
    with pytest.raises(ValueError):
        X.prepare_dataset(nodes, edges, test=spark.createDataFrame([("m.x0 0",)], "id string"))


def test_folds_test_each_candidate_once(spark, library):
    seen = []
    for data in X.cross_validation(*library, 3, p_keep=0.4):
        seen += [r["id"] for r in data.split.where("split = 'test'").collect()]
    assert len(seen) == len(set(seen)) == 12


def test_run_and_skip(spark, library, tmp_path):
    nodes, edges = library
    made = X.dataset_grid({"lib": library}, (0.4,), str(tmp_path))
    data = X.Dataset.read(spark, made["lib", 0.4])
    out = str(tmp_path / "run")
    texts = nodes.select("id", F.concat(F.lit("word "), F.substring_index("id", " ", -1)).alias("text"))
    for family in ("dummy", "bow", "two_hops"):
        arguments, make = X.MODELS[family][0]
        place = f"{out}-{family}"
        assert X.run_experiment(spark, family, make(5), data, nodes, edges, place, texts=texts, arguments=arguments)
        assert not X.run_experiment(spark, family, make(5), data, nodes, edges, place, texts=texts)
        got = {r["measure"]: r["value"] for r in spark.read.parquet(f"{place}/metrics").collect()}
        assert got["n"] == 3 and 0 <= got["hit_rate"] <= 1 and "f1@0.5" in got
    assert X.claim(spark, out) and not X.claim(spark, out)
    X.release(spark, out)


def test_node_properties(spark, library):
    nodes, edges = library
    more = nodes.unionAll(spark.createDataFrame([("library_l", ":library"), ("m", ":module")], "id string, label string"))
    got = {r["id"]: r["properties"] for r in X.node_properties(more, edges, "library_l").collect()}
    assert set(got["library_l"]) == {"star_shape_level", "tendency_to_make_hub"} and got["m"] == {} and set(got["m.t0 0"]) == {"in_degree", "out_degree", "degree"}


def test_edge_models(spark, library):
    nodes, edges = library
    vectors = nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(100)).cast("double")).alias("features"))
    model = recommend.EdgeModelRecommender(vectors, 3, "sum", trees=5, depth=3).fit(nodes, edges)
    pairs = spark.createDataFrame([("m.t0 0", "m.x0 0"), ("m.t0 0", "m.x1 1")], "src string, dst string")
    assert all(0 <= r["score"] <= 1 for r in [*model.predict_edges(pairs).collect(), *model.knn_votes(pairs, 3).collect()])
    assert model.predict_one("m.t0 0").count() == 3


@pytest.mark.parametrize("scheme", ["concatenation", "sum", "mean"])
def test_edge_models_rank_as_the_model_scores(spark, library, scheme):
    """Every pair's score as Spark's model has it, existing body targets left out; no pair is joined for it."""
    nodes, edges = library
    vectors = nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(100)).cast("double")).alias("features"))
    model = recommend.EdgeModelRecommender(vectors, None, scheme, trees=7, depth=4).fit(nodes, edges)
    model.block = 3
    known = {(r["src"], r["dst"]) for r in edges.where("edge_type = 'REFERENCE_BODY'").collect()}
    pairs = nodes.select(F.col("id").alias("src")).crossJoin(nodes.select(F.col("id").alias("dst")))
    want = {(r["src"], r["dst"]): r["score"] for r in model.score_edges(pairs).collect() if (r["src"], r["dst"]) not in known and ".with-" not in r["dst"]}
    plan = model.predict(nodes.select("id"))
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
    got = {(r["query"], r["candidate"]): r["score"] for r in plan.collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-8) for p in want)
    model.k = 3
    best = {}
    for (q, c), s in want.items():
        best.setdefault(q, []).append((round(s, 9), c))
    top = sorted((q, i + 1, c) for q, x in best.items() for i, (_, c) in enumerate(sorted(x, reverse=True)[:3]))
    assert sorted((r["query"], r["rank"], r["candidate"]) for r in model.predict(nodes.select("id")).collect()) == top


def test_biased_walks(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], "u string, v string, w double")
    w = features.random_walks(e, n_walks=200, length=3, p=1000.0, q=1.0)
    steps = {(r["start"], r["nth"], r["step"]): r["node"] for r in w.collect()}
    back = [steps[s, n, 2] == s for (s, n, i) in steps if i == 2 and steps[s, n, 1] != "d"]
    assert sum(back) / len(back) < 0.05
