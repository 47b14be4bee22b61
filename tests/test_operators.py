"""Golden cases and hand-made graphs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.operators import dataset, evaluate, features, graph, recommend, search, skipgram, stats, trees
from theoremill.operators.components import connected_components
from theoremill.sources import dag, sexp, sinks, vectors

EDGE = "src string, dst string, edge_type string, w long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_split_words(spark):
    df = spark.createDataFrame([("this₂₂Is_aVery-longName_innit12∘21",), ("Brand#13",), ("",)], "t string")
    got = [r[0] for r in df.select(N.split_words(F.col("t"))).collect()]
    assert got == [["this", "₂₂", "is", "a", "very", "long", "name", "innit", "12", "∘", "21"], ["brand", "#", "13"], []]


def test_name_kinds(spark):
    df = spark.createDataFrame([("a.with-123 4",), ("a.with-",), ("myth-123",), ("a.-rewrite1 2",)], "n string")
    n = F.col("n")
    assert [tuple(r) for r in df.select(N.is_with(n), N.is_rewrite(n), N.is_normal(n)).collect()] == [(True, False, False), (False, False, True), (False, False, True), (False, True, False)]


def test_unquoted_name_error(spark):
    df = spark.createDataFrame([(":name", "bare")], "t string, d string")
    with pytest.raises(Exception, match="not a name"):
        df.select(N.unquoted(F.col("t"), F.col("d"))).collect()


@pytest.mark.parametrize(("a", "b", "want"), [({0: 2, 1: 3, 2: 4}, {1: 3, 2: 4, 3: 2}, 1 - 7 / 11), ({1: 2, 2: 3}, {1: 3, 2: 2}, 1 - 4 / 6), ({}, {}, 1.0), ({1: 1}, {}, 1.0), ({1: 1}, {2: 1}, 1.0)])
def test_weighted_jaccard(spark, a, b, want):
    kind = "id long, weights map<string,double>"
    make = lambda i, m: spark.createDataFrame([(i, {str(k): float(v) for k, v in m.items()})], kind)
    got = search.sparse_knn(make(1, a), make(2, b), 1).first()["distance"]
    assert got == pytest.approx(want)


def helper_graph(spark):
    e = [("r", "m.with-1 1", "REFERENCE_BODY_TO_WITH", 2), ("m.with-1 1", "m.with-2 2", "REFERENCE_BODY_TO_WITH", 3), ("r", "m.with-2 2", "REFERENCE_BODY_TO_WITH", 5), ("m.with-2 2", "x", "REFERENCE_BODY", 1)]
    order = [("r", 0), ("m.with-1 1", 1), ("m.with-2 2", 2), ("x", 3)]
    return spark.createDataFrame(e, EDGE), spark.createDataFrame(order, "id string, ord long")


def test_helper_weights_and_lift(spark):
    edges, order = helper_graph(spark)
    owners = graph.helper_owners(edges, order)
    assert rows(owners, "helper", "owner") == [("m.with-1 1", "r"), ("m.with-2 2", "m.with-1 1")]
    roots = graph.helper_roots(owners)
    assert {r[1] for r in rows(roots, "helper", "root")} == {"r"}
    tw = graph.helper_total_weights(edges, roots)
    assert rows(tw, "helper", "tw") == [("m.with-1 1", 2), ("m.with-2 2", 11)]
    assert rows(graph.lift_from_helpers(edges, roots, tw), "src", "dst", "edge_type", "w") == [("r", "x", "REFERENCE_BODY", 11)]


def test_helper_cycle_is_an_error(spark):
    owners = spark.createDataFrame([("a", "b"), ("b", "a")], "helper string, owner string")
    with pytest.raises(ValueError, match="cycle"):
        graph.helper_roots(owners)


def test_unique_definitions(spark):
    kind = "def_id string, ord long, def_type string, module_name string, is_internal boolean"
    ok = spark.createDataFrame([("other.c", 1, ":constructor", "m", True), ("other.c", 2, ":constructor", "m", True)], kind)
    assert graph.unique_definitions(ok).count() == 1
    bad = spark.createDataFrame([("m.c", 1, ":function", "m", True), ("m.c", 2, ":function", "m", True)], kind)
    with pytest.raises(Exception, match="defined twice"):
        graph.unique_definitions(bad).collect()


def test_components_and_strong_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "e"), ("f", "f"), (None, "a")], "src string, dst string")
    assert rows(connected_components(e), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")]
    full = e.where("src is not null").withColumn("edge_type", F.lit("REFERENCE_BODY")).withColumn("w", F.lit(1).cast("long"))
    nodes = stats.nodes_of(full)
    assert rows(stats.strong_components(nodes, full), "id", "component") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "f")]
    assert rows(stats.cycles(nodes, full), "id", "n_cycles") == [("a", 1), ("b", 1), ("c", 0), ("d", 0), ("e", 0), ("f", 1)]


def test_long_path_components(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r[1] for r in rows(connected_components(e), "node", "component")} == {0}


def test_components_of_a_small_graph_take_no_rounds(spark, monkeypatch):
    from theoremill.operators import components

    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: written.append(name) or f(df, name))
    drawn = [(h % 97, h * h % 89 + (h % 3) * 100) for h in range(40)] + [(500 - i, 501 - i) for i in range(60)] + [(7, 7), (900, 900)]
    e = spark.createDataFrame([*drawn, (None, 3)], "src long, dst long")
    small = rows(connected_components(e), "node", "component")
    assert written == ["cc", "components"]
    monkeypatch.setattr(components, "HELD_EDGES", 0)
    assert rows(connected_components(e), "node", "component") == small
    assert {c for n, c in small if 441 <= n <= 501} == {441} and (900, 900) in small
    assert connected_components(e.where("src < 0")).count() == 0


def test_empty_graph(spark):
    e = spark.createDataFrame([], EDGE)
    nodes = stats.nodes_of(e)
    assert connected_components(e).count() == 0
    assert stats.shape(nodes, e).first()["star_shape_level"] == 0
    assert stats.pagerank(nodes, e).count() == 0


def test_betweenness_path(spark):
    e = spark.createDataFrame([("a", "b", "REFERENCE_BODY", 1), ("b", "c", "REFERENCE_BODY", 1)], EDGE)
    assert rows(stats.betweenness(stats.nodes_of(e), e), "id", "value") == [("a", 0.0), ("b", 0.5), ("c", 0.0)]


def test_greedy_pruning(spark):
    counts = spark.createDataFrame([("s", "a", 4), ("s", "b", 3), ("s", "c", 3)], "src string, dst string, w long")
    got = rows(dataset.prune_references(counts, 0.3).where("removed"), "dst")
    assert got == [("a",), ("b",)]


def test_splits_and_folds(spark):
    ids = spark.range(50).select(F.col("id").cast("string").alias("id"))
    s = dataset.split(ids, 0.25)
    assert s.where("split = 'test'").count() == 12  # 12.5, half to even
    f = dataset.folds(ids, 5)
    assert [r[0] for r in rows(f.groupBy("fold").count(), "count")] == [10] * 5
    assert dataset.check_folds(f, ids).count() == 0
    with pytest.raises(Exception, match="fewer than two"):
        dataset.split(ids.limit(1), 0.5).collect()
    assert rows(dataset.check_split(ids, ids.limit(40), ids.limit(1)), "problem")[0] == ("in both",)


def test_negatives_have_no_edges(spark):
    defs = spark.range(10).select(F.col("id").cast("string").alias("id"))
    edges = spark.createDataFrame([("0", str(i)) for i in range(6)], "src string, dst string")
    got = rows(dataset.sample_negatives(spark.createDataFrame([("0", 4)], "src string, n long"), defs, edges), "dst")
    assert got == [("6",), ("7",), ("8",), ("9",)]


def test_sexp_strings_and_errors(spark):
    text = r'(:entry (:name "a \" ( b") (:type) (:function (:apply x)))'
    n = sexp.parse(text)
    assert [(x[3], x[4]) for x in n] == [(":entry", ""), (":name", r'"a \" ( b"'), (":type", ""), (":function", ""), (":apply", "x")]
    for bad in ("(:entry", ":entry)", "(:nosuch)", ""):
        with pytest.raises(ValueError):
            sexp.parse(bad)
    assert sexp.split_entries("(:module (:module-name m) (:entry (:name a)) (:entry (:name b)))") == ["(:module (:module-name m) (:entry (:name a)))", "(:module (:module-name m) (:entry (:name b)))"]


def test_shared_nodes_count_per_path(spark):
    nodes = spark.createDataFrame([("e", 0, None), ("e", 1, 0), ("e", 2, 0), ("e", 3, 1)], "entry string, node_id long, parent_id long")
    edges = spark.createDataFrame([("e", 0, 1), ("e", 0, 2), ("e", 1, 3), ("e", 2, 3)], "entry string, parent_id long, child_id long")
    assert rows(trees.sizes(nodes, edges), "n_nodes", "depth") == [(5, 3)]
    assert rows(trees.is_tree(edges), "is_tree") == [(False,)]
    assert trees.dangling(nodes, edges).count() == 0


def test_topological_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        trees.topological_levels(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def test_library_files(spark, tmp_path):
    (tmp_path / "entries").mkdir()
    (tmp_path / "entries" / "a.dag").write_text('NODE ID\tNODE TYPE\tNODE DESCRIPTION\tCHILDREN IDS\n7\t:entry\t\t[1, 2, 3]\n1\t:name\t"n"\t[]\n2\t:type\t\t[4]\n3\t:function\t\t[4, 5]\n4\t:apply\t\t[6, 6]\n5\t:name\t"q"\t[]\n6\t:name\t"p"\t[]\n')
    (tmp_path / "entries" / "scripts.runLinter.dag").write_text("x\n")
    (tmp_path / "network.csv").write_text("node\tm\t{'label': ':module'}\nlink\tm\tm.a 1\tDEFINES\t{}\nlink\tm.a 1\tm.b 2\tREFERENCE_BODY\t{'w': 3}\n")
    nodes, ids, links = dag.load_library(spark, str(tmp_path))
    assert rows(nodes.where("root"), "node_id") == [(7,)]
    assert rows(nodes.where("node_id = 4"), F.size("child_ids")) == [(1,)]
    kept = dag.essential(nodes)
    assert rows(kept.where("node_type = ':name'"), "node_id", "section") == [(1, 0), (5, 2), (6, 2)]
    assert rows(ids, "id", F.col("properties")["label"]) == [("m", ":module")]
    assert rows(links.where("edge_type = 'REFERENCE_BODY'"), "src", F.col("properties")["w"]) == [("m.a 1", "3")]
    assert all(df.count() == 0 for df in dag.load_library(spark, str(tmp_path / "missing")))


def test_zipped_entries(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "entries.zip", "w") as z:
        z.writestr("deep/a.dag", "NODE ID\tNODE TYPE\tNODE DESCRIPTION\tCHILDREN IDS\n0\t:entry\t\t[]\n")
        z.writestr("deep/readme.txt", "no")
    nodes, _, _ = dag.load_library(spark, str(tmp_path))
    assert rows(nodes, "file", "node_id", "root") == [("a.dag", 0, True)]


def test_text_formats(spark, tmp_path):
    p = lambda name, text: str((tmp_path / name).write_text(text) and tmp_path / name)
    assert rows(vectors.read_vectors(spark, p("v", "2 3\na 1 2 3\nb 4 5 6\n")), "word", F.col("vec")[2]) == [("a", 3.0), ("b", 6.0)]
    with pytest.raises(Exception, match="wrong size"):
        vectors.read_vectors(spark, p("w", "1 3\na 1 2\n")).collect()
    assert rows(vectors.read_vocabulary(spark, p("vo", "WORD\tCOUNT\na\t5\nb\n")), "word", "cnt") == [("a", 5), ("b", 1)]
    t = vectors.read_translations(spark, p("t", "x;1;1;a;b;0.25;0.75\ny;1;1;a;b\nz;1;1\n"))
    assert rows(t, "word", "pos", "part", "weight") == [("x", 0, "a", 0.25), ("x", 1, "b", 0.75), ("y", 0, "a", 0.5), ("y", 1, "b", 0.5)]
    f = vectors.read_false_positives(spark, p("f", "NODE;n1\n0.5;a\n\nNODE;n2\n0.25;b"))
    assert rows(f, "node", "candidate", "score") == [("n1", "a", 0.5), ("n2", "b", 0.25)]
    assert rows(vectors.read_words(spark, p("wd", "a 1\nb 2\n")), "word") == [("a",), ("b",)]
    import struct

    (tmp_path / "bin").write_bytes(b"2 2\nab " + struct.pack("<2f", 1, 2) + b"\nc " + struct.pack("<2f", 3, 4))
    assert rows(vectors.read_binary_vectors(spark, str(tmp_path / "bin")), "word", F.col("vec")[1]) == [("ab", 2.0), ("c", 4.0)]
    vectors.write_vocabulary(spark.createDataFrame([("a", 2), ("b", 9), ("c", 1)], "word string, cnt long"), str(tmp_path / "out"), spark.createDataFrame([("c",)], "word string"))
    assert rows(vectors.read_vocabulary(spark, str(tmp_path / "out")), "word", "cnt") == [("a", 2), ("b", 9)]


def test_graph_dump(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "REFERENCE_BODY", 2)], EDGE)
    nodes = spark.createDataFrame([("a", ":function"), ("b", ":data")], "id string, label string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = sinks.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.count() == 1
    lines = sinks.graph_lines(nodes, edges, stats.degrees(nodes, edges))
    assert rows(lines, "value") == [("E;a;b;REFERENCE_BODY;2",), ("N;a;:function;2.0",), ("N;b;:data;2.0",)]
    assert sinks.artefact("/b", "lib", "kg", k=1, a=2) == "/b/lib/kg@a=2@k=1"


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([("0", "1", 1.0), ("1", "2", 2.0), ("0", "2", 3.0)], "u string, v string, w double")
    w = features.random_walks(e, n_walks=400, length=2)
    step = {r[0]: r[1] for r in rows(w.where("start = '0' and step = 1").groupBy("node").count(), "node", "count")}
    assert set(step) == {"1", "2"} and step["1"] / 400 == pytest.approx(0.25, abs=0.08)


def test_neighbours_are_packed_in_short_rows():
    rng = np.random.default_rng(5)
    at = np.sort(np.concatenate([rng.integers(0, 3000, 90_000), np.full(100_000, 1500), np.full(70_000, 4000)]))
    to, w = np.arange(len(at)), rng.integers(1, 9, len(at)) / 4
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000]) for x in (at, to, w)], names=["at", "to", "w"]) for i in range(0, len(at), 10_000)]
    got = [r for b in features._pack(iter(batches)) for r in b.to_pylist()]
    assert [t for r in got for t in r["tos"]] == to.tolist() and max(len(r["tos"]) for r in got) == features.PACKED
    upto = {}
    for r in got:
        assert r["base"] == upto.get(r["at"], 0.0) and r["upto"] == pytest.approx(r["base"] + sum(r["ws"]))
        upto[r["at"]] = r["upto"]
    assert all(upto[n] == pytest.approx(w[at == n].sum()) for n in (0, 1500, 4000))


def test_walks_take_the_neighbour_drawn(spark):
    """A hub with 500 neighbours: every step is the neighbour whose interval holds the draw, also from quarters."""
    import hashlib

    e = spark.createDataFrame([("hub", f"n{i:03}", 1.0 + i % 3) for i in range(500)] + [("a", "a", 2.0), ("a", "hub", 1.0), ("z", "hub", 0.0)], "u string, v string, w double")
    near = {}
    for u, v, w in sorted(tuple(r) for r in e.collect()):
        if w:
            near.setdefault(u, {})[v] = w
            near.setdefault(v, {})[u] = w

    def step(start, node, i):
        x = (int(hashlib.md5(f"1234:{start}:0:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 * sum(near[node].values())
        for to, w in sorted(near[node].items()):
            if x < w:
                return to
            x -= w

    for quartered in (features.QUARTERED, 0):
        features.QUARTERED, was = quartered, features.QUARTERED
        got = {(r["start"], r["step"]): r["node"] for r in features.random_walks(e, n_walks=1, length=4).collect()}
        features.QUARTERED = was
        assert len(got) == 4 * len(near)
        assert all(got[s, i] == step(s, got[s, i - 1], i) for s, i in got if i)


def test_numbered_walks_are_the_named_ones(spark):
    names = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "name string, n long")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (2, 3, 1.0)], "u long, v long, w double")
    for p in (1.0, 4.0):
        shown = features.random_walks(e, n_walks=3, length=4, p=p, names=names)
        coded = features.random_walks(e, n_walks=3, length=4, p=p, names=names, numbered=True)
        assert rows(shown, "start", "nth", "step", "node") == rows(coded.withColumn("node", F.element_at(F.array(*map(F.lit, "abcd")), (F.col("node") + 1).cast("int"))), "start", "nth", "step", "node")
    with pytest.raises(ValueError, match="names"):
        features.random_walks(e, numbered=True)


def group_walks(spark, n, groups, length):
    """A walk from each of n nodes that stays among the nodes with its remainder."""
    node = F.pmod(F.xxhash64("start", "step"), F.lit(n // groups)) * groups + F.col("start") % groups
    steps = spark.range(n).select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))
    name = lambda c: F.format_string("n%06d", c)
    return steps.select(name(F.col("start")).alias("start"), F.lit(0).alias("nth"), "step", name(F.when(F.col("step") == 0, F.col("start")).otherwise(node)).alias("node"))


def test_node2vec_query_takes_no_less_than_the_operators(spark, sf_dir, monkeypatch):
    """Walks, their length, dimensions, window and epochs are the defaults of E12 to E14."""
    from inspect import signature

    from theoremill.plans import queries_learning

    of = lambda f, *names: {n: signature(f).parameters[n].default for n in names}
    walking, learning = of(features.random_walks, "n_walks", "length"), of(features.node_vectors, "size", "window", "epochs")
    taken = {}
    monkeypatch.setattr(queries_learning.E, "random_walks", lambda edges, **more: taken.update(more))
    monkeypatch.setattr(queries_learning.E, "node_vectors", lambda walks, **more: taken.update(more))
    queries_learning.Q["node2vec_vectors"](spark, sf_dir)
    assert walking | learning == {n: taken[n] for n in walking | learning}


def test_node_vectors_are_not_gathered_on_the_driver(spark):
    """No job of 30,000 nodes may send more than 200 kB to the driver; names alone are more."""
    walks = group_walks(spark, 30_000, 10, 4)
    conf, key, join = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(join)
    conf.set(key, "200k")
    spark.conf.set(join, "-1")
    try:
        made = features.node_vectors(walks, size=8, window=2, epochs=1)
        got = made.agg(F.count("*"), F.count_distinct("id"), F.min(F.size("features")), F.max(F.size("features"))).first()
    finally:
        conf.remove(key)
        spark.conf.set(join, before)
    assert tuple(got) == (30_000, 30_000, 8, 8)


def test_node_vectors_do_not_depend_on_partitioning(spark, monkeypatch):
    """Four blocks or one: every node has a vector, its nearest ones are of its group; partitions change nothing."""
    walks = group_walks(spark, 400, 4, 60)
    for block in (16 * 120, skipgram.BLOCK):
        monkeypatch.setattr(skipgram, "BLOCK", block)
        first = {r["id"]: r["features"] for r in features.node_vectors(walks, size=16, window=3, epochs=2).collect()}
        again = {r["id"]: r["features"] for r in features.node_vectors(walks.repartition(7, "node"), size=16, window=3, epochs=2).collect()}
        assert first == again and len(first) == 400
        ids = sorted(first)
        x = np.array([first[i] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = np.argsort(-(x @ x.T), axis=1)[:, 1:6]
        assert np.mean(near % 4 == np.arange(400)[:, None] % 4) > 0.9


def test_node_vectors_of_odd_walks(spark):
    kind = "start string, nth int, step int, node string"
    assert features.node_vectors(spark.createDataFrame([], kind), size=4).collect() == []
    lone = features.node_vectors(spark.createDataFrame([("a", 0, 0, "a"), ("b", 0, 0, "b"), ("b", 0, 1, "b"), ("b", 1, 0, "b")], kind), size=4, epochs=2).collect()
    assert sorted(r["id"] for r in lone) == ["a", "b"] and all(np.isfinite(r["features"]).all() for r in lone)


def test_rounds_share_out_all_pairs():
    """The pairs of all rounds are those of the windows drawn, each once; a pair goes to the round and block of its ends."""
    rng = np.random.default_rng(3)
    blocks, window = 5, 4
    begins = rng.random(500) < 0.2
    begins[0] = True
    code = rng.integers(0, blocks, 500) * 2**32 + rng.integers(0, 30, 500)
    got = []
    for shift in range(blocks):
        for at, payload in skipgram._pairs_of(7, code.tobytes(), begins.tobytes(), blocks, shift, window, 1, 2):
            node, context = np.frombuffer(payload, np.int32).reshape(2, -1)
            got += [(at, n, (at + shift) % blocks, c) for n, c in zip(node.tolist(), context.tolist(), strict=True)]
    reach, walk = np.random.default_rng([1, 2, 7]).integers(1, window + 1, 500), np.cumsum(begins)
    place = lambda i: (int(code[i] >> 32), int(code[i] & 0xFFFFFFFF))
    assert set(reach) == set(range(1, window + 1))
    assert sorted(got) == sorted(place(i) + place(j) for i in range(500) for j in range(500) if i != j and walk[i] == walk[j] and abs(i - j) <= reach[i])


def test_a_batch_follows_the_gradient():
    """Changes of a batch by hand: positive and drawn contexts; of more than ADDED changes of a vector, the mean counts ADDED times."""
    rng = np.random.default_rng(4)
    own = skipgram._Learner({0: 50, 1: 40}, 2, 1, 0, 6, 3, 1, 0)
    own.give(skipgram.COUNTS, 0, pa.scalar(rng.integers(1, 9, 40).tobytes(), pa.binary()))
    own.give(skipgram.OUTER, 0, pa.scalar(rng.normal(size=(25, 6)).astype(np.float32).tobytes(), pa.binary()))
    own.give(skipgram.OUTER, 25, pa.scalar(rng.normal(size=(15, 6)).astype(np.float32).tobytes(), pa.binary()))
    own.start()
    own.inner *= 10
    node, context = np.where(rng.random(200) < 0.5, 3, rng.integers(0, 50, 200)).astype(np.int32), rng.integers(0, 40, 200).astype(np.int32)
    u, v = own.inner.astype(float), own.outer.astype(float)
    draws = np.random.default_rng([1, 0, 1, 0, 1])
    drawn = draws.permutation(np.searchsorted(own.share, np.sort(draws.random(600)), side="right")).reshape(200, 3)
    to_u, to_v = [[] for _ in u], [[] for _ in v]
    for n, c, negatives in zip(node, context, drawn, strict=True):
        terms = [(c, 1)] + [(x, 0) for x in negatives]
        steps = [(x, 0.0 if i and x == c else 0.5 * (label - 1 / (1 + np.exp(-u[n] @ v[x])))) for i, (x, label) in enumerate(terms)]
        to_u[n].append(sum(g * v[x] for x, g in steps))
        for x, g in steps:
            to_v[x].append(g * u[n])
    want = lambda table, to: [row + sum(c) * min(1, skipgram.ADDED / max(1, len(c))) for row, c in zip(table, to, strict=True)]
    own.learn(node, context, np.float32(0.5))
    assert len(to_u[3]) > skipgram.ADDED
    assert np.allclose(own.inner, want(u, to_u), atol=1e-4) and np.allclose(own.outer, want(v, to_v), atol=1e-4)


def test_postprocess_keeps_order_without_spread(spark):
    p = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("q", "m.with-1 1", 0.0), ("q", "c", float("nan"))], "query string, candidate string, y double")
    assert rows(recommend.postprocess(p, None), "rank", "candidate", "score") == [(1, "b", 0.0), (2, "a", 0.0), (3, "c", None)]


def test_two_hops_fills_lists(spark):
    e = spark.createDataFrame([("q", "x", "REFERENCE_BODY", 1), ("t", "x", "REFERENCE_BODY", 2)], EDGE)
    got = rows(recommend.two_hops(spark.createDataFrame([("q",)], "id string"), e, stats.nodes_of(e), 4), "rank", "candidate", "score")
    assert got == [(1, "t", 1.0), (2, "q", pytest.approx(1 - 0.5 / 1.5)), (3, "x", 0.0)]


def test_two_hops_ties_to_nine_digits(spark):
    many = [("q", f"x{i:02}", "REFERENCE_BODY", w) for i, w in enumerate((3, 5, 7, 11, 13))]
    weights = (3, 5, 7, 11, 13)
    e = spark.createDataFrame(many + [(t, f"x{i:02}", "REFERENCE_BODY", weights[i]) for t in ("a", "b", "c") for i in ((0, 1, 2) if t != "b" else (2, 1, 0))], EDGE)
    got = rows(recommend.two_hops(spark.createDataFrame([("q",)], "id string"), e, stats.nodes_of(e), 4, "LOG2_DEGREE"), "rank", "candidate", "score")
    assert [c for _, c, _ in got] == ["q", "c", "b", "a"] and all(s == round(s, 9) for _, _, s in got)


def test_two_hops_query_counts_references_only(spark, tmp_path):
    """Customers 0 and 1 share a part whose module is linked with it too: the module is no candidate before them."""
    from theoremill.plans import registry

    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("region", [(0, "R")], "r_regionkey int, r_name string")
    put("nation", [(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(0, 0), (1, 0)], "c_custkey long, c_nationkey int")
    put("supplier", [(0, 0)], "s_suppkey long, s_nationkey int")
    put("part", [(0, "B")], "p_partkey long, p_brand string")
    put("orders", [(0, 0, "F"), (1, 1, "F")], "o_orderkey long, o_custkey long, o_orderstatus string")
    put("lineitem", [(0, 0, 0, 1), (1, 0, 0, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    for name in ("two_hops_constant", "two_hops_degree", "two_hops_log2"):
        got = [(r["candidate"], r["score"]) for r in registry.QUERIES[name](spark, str(tmp_path)).where("score > 0").orderBy("rank").collect()]
        assert got == [("R.N.cust1 1", 1.0), ("R.N.cust0 0", 1.0)]


def test_two_hops_queries_list_every_customer(spark, sf_dir):
    """A list for each customer with an order, not for one in twenty."""
    from theoremill.plans import registry

    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct().count()
    for name in ("two_hops_constant", "two_hops_degree", "two_hops_log2"):
        assert registry.QUERIES[name](spark, sf_dir).select("query").distinct().count() == asked


@pytest.mark.parametrize("weights", ["CONSTANT", "DEGREE", "LOG2_DEGREE"])
def test_two_hops_in_blocks_are_those_of_all_paths(spark, monkeypatch, weights):
    """Short lists are the beginnings of whole ones, in many blocks, with ties, an edge of each type to one node and a hub."""
    import random

    from theoremill.operators import hops

    monkeypatch.setattr(hops, "QUERIES", 30)
    monkeypatch.setattr(hops, "EDGES", 60)
    draw = random.Random(5)
    e = {(f"q{draw.randrange(150):03}", f"x{draw.randrange(200):03}", t): draw.choice([1, 1, 1, 2, 7, 900]) for t in ("REFERENCE_BODY", "REFERENCE_TYPE") for _ in range(900)}
    e.update({(f"q{i:03}", "hub", "REFERENCE_BODY"): 1 for i in range(0, 150, 2)})
    e.update({("q001", f"y{i}", "REFERENCE_BODY"): 30000 for i in range(3)} | {("q003", f"y{i}", "REFERENCE_BODY"): 30000 + i for i in range(3)})
    edges = spark.createDataFrame([(*key, w) for key, w in e.items()], EDGE)
    asked = edges.select(F.col("src").alias("id")).distinct().where("id <> 'q007'")
    got = rows(recommend.two_hops(asked, edges, stats.nodes_of(edges), 4, weights), "query", "rank", "candidate", "score")
    whole = recommend.two_hops(asked, edges, stats.nodes_of(edges), None, weights).where("rank <= 4")
    assert len(got) > 500 and got == rows(whole, "query", "rank", "candidate", "score")


@pytest.mark.parametrize("name", ["bow_recommend", "combined_recommend"])
def test_text_recommenders_list_every_document(spark, sf_dir, name):
    """A list for each document, not for one in twenty."""
    from theoremill.plans import registry

    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r["query"] for r in registry.QUERIES[name](spark, sf_dir).select("query").collect()} == ids


@pytest.mark.parametrize("metric", ["cityblock", "cosine", "jaccard"])
def test_many_blocks_of_queries_are_written_in_groups(spark, monkeypatch, metric):
    """Blocks that are written in groups, rows in small slices and lists of any length give what one block gives; ties at the k-th place too."""
    import random

    draw = random.Random(3)
    data = [(i, {f"w{draw.randrange(40)}": float(draw.choice([1, 1, 2, 3])) for _ in range(draw.randrange(30))}) for i in range(300)]
    table = spark.createDataFrame(data, "id long, weights map<string,double>").repartition(3)
    names = ("query", "rank", "candidate", "distance", "low", "high")
    whole = rows(search.sparse_knn(table, table, 5, metric, 300, bounds=True, falling=True), *names)
    monkeypatch.setattr(search, "TOGETHER", 2)
    parts = rows(search.sparse_knn(table, table, 5, metric, 40, bounds=True, falling=True), *names)
    assert len(whole) == 1500 and [r[:3] for r in parts] == [r[:3] for r in whole]
    same = [tuple(x if x is None else round(x, 12) for x in r[3:]) for r in whole]
    assert same == [tuple(x if x is None else round(x, 12) for x in r[3:]) for r in parts]


def test_betweenness_with_empty_tasks(spark):
    """Tasks without a node, or whose nodes lie on no path, return no rows."""
    e = spark.createDataFrame([("a", "b", "REFERENCE_BODY", 1), ("b", "c", "REFERENCE_BODY", 1)], EDGE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(stats.betweenness(stats.nodes_of(e).repartition(16, "id"), e), "id", "value")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [("a", 0.0), ("b", 0.5), ("c", 0.0)]


def test_analogies_by_scope(spark):
    """As over a table of all targets, of which none is made; zero vectors and other metrics too."""
    import numpy as np

    from theoremill.operators import search

    made = np.random.default_rng(5).normal(size=(300, 6)).round(3)
    made[7] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(made)], "id long, features array<double>")
    modules = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(i, 9) for i in range(0, 300, 2)], "id long, module long")
    refs = spark.createDataFrame([(i, (i * 7 + 1) % 300) for i in range(300)], "src long, dst long")
    q = spark.createDataFrame([(20,), (33,), (40,), (41,)], "id long")
    targets = recommend.analogy_targets(q, refs, modules, v)
    for rows_, metric, alpha in ((v, "cosine", 0.0), (v.where("id <> 7"), "cosine", 0.0), (v, "cityblock", 0.5)):
        asked, each = recommend.analogy_scopes(q, refs, modules, v)
        got = rows(search.nearest_analogies(asked, each, rows_, 4, alpha, metric, block=2, bounds=True), "query", "rank", "candidate", "error", "low", "high")
        want = rows(search.nearest_targets(targets, rows_, 4, alpha, metric, bounds=True), "query", "rank", "candidate", "error", "low", "high")
        assert len(got) == 16 and [x[:3] for x in got] == [x[:3] for x in want]
        assert all(x[3:] == pytest.approx(y[3:], abs=1e-8) for x, y in zip(got, want, strict=True))
    assert each.count() < 4 * 300  # refs of a scope, not of a query


def test_sparse_search_by_steps(spark, monkeypatch):
    """Frequent words by matrix product, counts above the steps, rare words and broken weights: as by hand."""
    import numpy as np

    from theoremill.operators import search

    monkeypatch.setattr(search, "STEPS", 3)
    rng = np.random.default_rng(3)
    maps = [{f"w{j}": int(rng.integers(1, 9)) for j in range(30) if rng.random() < 1 / (1 + j)} for _ in range(60)]
    rare = [m | {"w0": 1.5} for m in maps]
    posts = search._Postings(maps[:20], counts=True)
    assert posts.steps.any() and (posts.steps == 0).any() and len(posts.x)

    def frame(some):
        return spark.createDataFrame([(i, {k: float(x) for k, x in m.items()}) for i, m in enumerate(some)], "id long, weights map<string,double>")

    for some in (maps, rare):
        got = {(r["query"], r["candidate"]): r["distance"] for r in search.sparse_knn(frame(maps).where("id < 20"), frame(some), None).collect()}
        assert len(got) == 20 * 60
        for (q, c), d in got.items():
            a, b = maps[q], some[c]
            low, high = (sum(f(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}) for f in (min, max))
            assert d == pytest.approx(1 - low / high if high else 1.0)


def test_rows_are_written_once(spark, monkeypatch):
    """Texts are tokenised once, however many blocks of queries there are."""
    from theoremill.operators import search

    made = []
    monkeypatch.setattr(recommend, "materialize", lambda df, name, put=recommend.materialize: made.append(name) or put(df, name))
    nodes = spark.createDataFrame([(i, f"w{i} common") for i in range(4)], "id long, text string")
    model = recommend.BagOfWordsRecommender(2).fit(nodes.select("id"), None, nodes)
    assert model.predict(nodes.select("id")).count() == 8 and made == ["rows", "asked"]
    monkeypatch.setattr(search.sparse_knn, "__defaults__", (*search.sparse_knn.__defaults__[:1], 2, *search.sparse_knn.__defaults__[2:]))
    made.clear()
    assert recommend.TfIdfRecommender(2).fit(nodes.select("id"), None, nodes).predict(nodes.select("id")).count() == 8 and made == ["rows", "asked"]
    plan = search.tfidf_maps(nodes)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan  # counts stay in their rows
    got = {(r["id"], w): x for r in search.tfidf_maps(nodes).collect() for w, x in r["weights"].items()}
    assert got == pytest.approx({(r["id"], r["word"]): r["tfidf"] for r in features.tfidf(nodes).collect()})


def test_metrics(spark):
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "truth int, score double")
    assert evaluate.roc_auc(s).first()["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    m = {r["theta"]: r for r in evaluate.threshold_measures(s).collect()}
    assert (m[0.5]["tp"], m[0.5]["fp"], m[0.5]["fn"], m[0.5]["tn"]) == (1, 1, 1, 1) and m[0.9]["f1"] == 0.5
    actual = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, candidate string")
    ranked = spark.createDataFrame([("a", 0.8, 0), ("b", 0.4, 3)], "candidate string, score double, rank long")
    r = evaluate.rank_measures(actual, ranked, spark.createDataFrame([(0.6,)], "kth double"), 2).first()
    assert (r["hit_rate"], r["min_rank"], r["mean_rank"], r["mean_smooth"]) == (0.5, 0.0, 1.5, 1.25)
    with pytest.raises(Exception, match="not ranked"):
        evaluate.rank_measures(actual, ranked.limit(1), spark.createDataFrame([(0.6,)], "kth double"), 2).collect()


def test_metapath_raises():
    with pytest.raises(NotImplementedError):
        features.MetapathToVec()


def test_recommenders(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "c", "REFERENCE_BODY", 2), ("b", "c", "REFERENCE_BODY", 1)], EDGE)
    texts = spark.createDataFrame([("a", "red cat"), ("b", "red dog"), ("c", "blue")], "id string, text string")
    q = nodes.where("id = 'a'")
    assert rows(recommend.PopularityRecommender(1).fit(nodes, edges).predict(q), "candidate") == [("c",)]
    assert rows(recommend.BagOfWordsRecommender(2).fit(nodes, edges, texts).predict(q), "rank", "candidate")[0] == (1, "a")
    assert recommend.TfIdfRecommender(2).fit(nodes, edges, texts).predict(q).count() == 2
    assert rows(recommend.TwoHopsRecommender(2).fit(nodes, edges).predict(q), "rank", "candidate")[0] == (1, "a")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 0.0])], "id string, features array<double>")
    assert rows(recommend.VectorRecommender(vec, 2).fit(nodes, edges).predict(q), "rank", "candidate") == [(1, "a"), (2, "b")]
    pairs = spark.createDataFrame([("a", "b"), ("a", "x")], "src string, dst string")
    assert rows(recommend.TwoHopsRecommender(3).fit(nodes, edges).predict_edges(pairs), "dst", "score")[1] == ("x", 0.0)
    with pytest.raises(ValueError):
        recommend.TwoHopsRecommender(0)


def test_embedding_probe(spark):
    v = spark.createDataFrame([("Cat", [1.0, 0.0]), ("cat", [1.0, 1.0]), ("king", [2.0, 0.0]), ("man", [1.0, 0.0]), ("woman", [1.0, 3.0]), ("queen", [2.0, 3.0])], "word string, vec array<double>")
    groups = features.case_variants(v)
    assert rows(groups, "lower", "size") == [("cat", 2)]
    assert rows(features.group_distances(groups, v, "cityblock"), "a", "b", "distance") == [("Cat", "cat", 0.5)]
    assert features.random_pair_distances(v, 3).count() == 3
    quads = spark.createDataFrame([("q", "king", "man", "woman")], "query string, x0 string, y0 string, y1 string")
    assert features.analogies(quads, v, 1, "cityblock").first()["candidate"] == "queen"
    sample = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert features.quantile_of(sample, spark.createDataFrame([(3.0,)], "value double")).first()["quantile"] == 0.5


def test_pretty_text(spark):
    n = sexp.parse_nodes(spark.createDataFrame([("e", "(:entry (:name a) (:type (:apply)))")], "entry string, text string"))
    assert trees.pretty(n, 2).first()["text"] == "(:entry )\n  (:name a)\n  (:type )"
    assert trees.full_text(n).first()["text"] == "(:entry  (:name a) (:type  (:apply )))"


def test_vector_vocabulary(spark, tmp_path):
    (tmp_path / "v").write_text("2 2\na 1 2\nb\t-3\n")
    assert rows(vectors.vector_vocabulary(spark, str(tmp_path / "v")), "word") == [("a",), ("b",)]
    (tmp_path / "w").write_text("\n".join(["nonsense"] * 20))
    with pytest.raises(ValueError):
        vectors.vector_vocabulary(spark, str(tmp_path / "w"))


def test_lists_of_all_candidates_have_no_end(spark):
    n = 1100
    nodes = spark.createDataFrame([(f"n{i:04d}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([("n0000", "n0001", "REFERENCE_BODY", 1), ("n0002", "n0001", "REFERENCE_BODY", 2)], "src string, dst string, edge_type string, w long")
    texts = spark.createDataFrame([(f"n{i:04d}", f"w{i % 7} x{i}") for i in range(n)], "id string, text string")
    vectors = spark.createDataFrame([(f"n{i:04d}", [1.0, float(i)]) for i in range(n)], "id string, features array<double>")
    queries = nodes.where("id in ('n0000', 'n0005')")
    for r in (recommend.PopularityRecommender(None), recommend.BagOfWordsRecommender(None), recommend.TfIdfRecommender(None), recommend.VectorRecommender(vectors, None, "euclidean"), recommend.TwoHopsRecommender(None)):
        got = r.fit(nodes, edges, texts).predict(queries).collect()
        for q in ("n0000", "n0005"):
            mine = [x for x in got if x["query"] == q]
            assert sorted(x["rank"] for x in mine) == list(range(1, n + 1)) and len({x["candidate"] for x in mine}) == n, type(r)


def words_by_hand(name):
    """A1 by its rule: a cut before every character but between two numbers, or two letters that are no small one before a
    capital one."""
    out = []
    for i, c in enumerate(name):
        p = name[i - 1] if i else ""
        joined = p and (p.isnumeric() and c.isnumeric() or p.isalpha() and c.isalpha() and not (c.upper() == c and p.lower() == p))
        if c in "_-." or c.isspace():
            out.append("")
        elif joined:
            out[-1] += c
        else:
            out.append(c)
    return [w.lower() for w in out if w]


def test_word_split_over_all_letters(spark):
    """Every assigned character beside characters of each kind, and some words of scripts without case."""
    import unicodedata

    from pyspark.sql import functions as F

    from theoremill.functions import names as N

    # Lowering is that of the JVM; characters that it lowers by its own, or by context, are left out, and its white space.
    fine = [chr(c) for c in range(33, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc", "Zs", "Zl", "Zp") and chr(c) not in "Σİ"]
    cased = [c for c in fine if c.lower() == c]
    texts = ["".join(f"{c}{x}{c}_" for x in "aA1ₐ一漢-½") for c in cased[:: 7]] + ["".join(c + c for c in fine if ord(c) < 0x250)]
    texts += ["xₐ", "ℕℤ", "漢字", "this₂₂Is_aVery-longName_innit12∘21", "Straßenbahn ÖBB", "x一二3", "Ǆǅǆ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    got = {r["id"]: r["w"] for r in rows.select("id", N.split_words(F.col("text")).alias("w")).collect()}
    wrong = [(t, got[i], words_by_hand(t)) for i, t in enumerate(texts) if [w.lower() for w in got[i]] != words_by_hand(t)]
    assert wrong == [], (len(wrong), [(t, set(a) ^ set(b)) for t, a, b in wrong[:4]])
    assert got[len(texts) - 7] == ["x", "ₐ"] and got[len(texts) - 6] == ["ℕ", "ℤ"] and got[len(texts) - 5] == ["漢", "字"]
