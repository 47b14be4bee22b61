"""Registered queries on syntax trees and on the file formats, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.operators import trees as T
from theoremill.plans.projection import Library
from theoremill.plans.queries_graph import Q, SQL, register
from theoremill.plans.scratch import materialize, scratch_dir
from theoremill.plans.sql import library
from theoremill.sources import dag, sexp, vectors

__all__ = ["Q", "SQL"]

_LINES = "lc AS (SELECT l_orderkey, o_custkey, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _place(lib: Library, kind: str) -> str:
    return f"{scratch_dir(lib.spark).rstrip('/')}/theoremill/{kind}-{uuid.uuid4().hex}"


def _nodes(lib: Library) -> DataFrame:
    return sexp.parse_nodes(lib.entries())


@register("sexp_nodes", library("SELECT 'order ' || l_orderkey AS entry, unnest([':entry', ':name', ':type', ':function', ':apply']) AS node_type, unnest([1, n + 2, 1, 1, 1])::BIGINT AS cnt FROM lc", _LINES))
def sexp_nodes(lib: Library) -> DataFrame:
    files = lib.entries().select(F.col("entry").alias("source"), F.concat(F.lit('(:module (:module-name "m") '), "text", F.lit(")")).alias("text"))
    entries = sexp.explode_entries(files).select(F.col("source").alias("entry"), "text")
    return sexp.parse_nodes(entries).where("node_type not in (':module', ':module-name')").groupBy("entry", "node_type").agg(F.count("*").alias("cnt"))


@register("tree_size_depth", library("SELECT 'order ' || l_orderkey AS entry, n + 6 AS n_nodes, 4::BIGINT AS depth FROM lc", _LINES))
def tree_size_depth(lib: Library) -> DataFrame:
    n = materialize(_nodes(lib), "nodes")
    return T.sizes(n, T.tree_edges(n))


@register("tree_is_tree", library("SELECT 'order ' || l_orderkey AS entry, n < 3 AS is_tree FROM lc", _LINES))
def tree_is_tree(lib: Library) -> DataFrame:
    n = materialize(_nodes(lib), "nodes")
    edges = T.tree_edges(n)
    third = n.where("level = 4 and child_pos = 2").select("entry", F.col("node_id").alias("child_id"))
    root = n.where("parent_id is null").select("entry", F.col("node_id").alias("parent_id"))
    shared = third.join(root, "entry").select("entry", "parent_id", "child_id", F.lit(9).alias("child_pos"))
    return T.is_tree(edges.unionAll(shared))


@register("topo_level", library("SELECT id, max(level)::INT AS level FROM (SELECT r_name AS id, 0 AS level FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 1 FROM nation UNION ALL SELECT c_name, 2 FROM customer UNION ALL SELECT 'order ' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY id"))
def topo_level(lib: Library) -> DataFrame:
    t = lib.table
    up = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    mid = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.col("c_name").alias("dst"))
    low = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("src"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("dst"))
    return T.topological_levels(up.unionAll(mid).unionAll(low))


@register("sharing_expansion", library("SELECT 'order ' || l_orderkey AS entry, n + 4 AS n_names FROM lc", _LINES))
def sharing_expansion(lib: Library) -> DataFrame:
    body = F.regexp_replace("text", r"\(:function \(:apply (.*)\)\)\)$", r'(:function (:node a (:name "x") (:node b (:name "y") (:apply $1 (:ref a) (:ref b))))))')
    n = materialize(sexp.parse_nodes(lib.entries().withColumn("text", body)), "nodes")
    kept, edges = T.expand_sharing(n)
    kept = materialize(kept, "kept")
    met = T.path_levels(kept, materialize(edges, "edges"))
    names = met.join(kept.where("node_type = ':name'").select("entry", "node_id"), ["entry", "node_id"], "left_semi")
    return names.groupBy("entry").agg(F.sum("paths").alias("n_names"))


@register("module_name_normal", library("SELECT 'order ' || l_orderkey AS entry, '\"order ' || l_orderkey || '\"' AS description FROM lc", _LINES))
def module_name_normal(lib: Library) -> DataFrame:
    wrapped = lib.entries().select("entry", F.concat(F.lit("(:module (:module-name (:name \""), "entry", F.lit("\")) "), "text", F.lit(")")).alias("text"))
    n = materialize(sexp.parse_nodes(wrapped), "nodes")
    return T.normalise_module_names(n).where("node_type = ':module-name'").select("entry", "description")


_TEXT = "et AS (SELECT 'order ' || l_orderkey AS entry, '(:entry  (:name \"order ' || l_orderkey || '\") (:type  (:name \"cust ' || any_value(o_custkey) || '\")) (:function  (:apply  ' || string_agg('(:name \"part ' || l_partkey || '\")', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) || ')))' AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"


@register("full_text", library("SELECT * FROM et", _TEXT))
def full_text(lib: Library) -> DataFrame:
    return T.full_text(_nodes(lib))


@register("section_references", library("SELECT 'order ' || l_orderkey AS entry, 'type' AS section, 'cust ' || o_custkey AS name, 1::BIGINT AS cnt FROM lc UNION ALL SELECT 'order ' || l_orderkey, 'body', 'part ' || l_partkey, count(*)::BIGINT FROM sold JOIN lineitem USING (l_partkey) WHERE false GROUP BY 1, 3 UNION ALL SELECT 'order ' || o_orderkey, 'body', 'part ' || l_partkey, count(*)::BIGINT FROM sold GROUP BY 1, 3", _LINES))
def section_references(lib: Library) -> DataFrame:
    return T.section_names(materialize(_nodes(lib), "nodes"))


@register("contraction", library("SELECT 'order ' || l_orderkey AS entry, n + 2 AS n_edges FROM lc", _LINES))
def contraction(lib: Library) -> DataFrame:
    n = materialize(_nodes(lib), "nodes")
    return T.contract(n, T.tree_edges(n), (":entry", ":name")).groupBy("entry").agg(F.count("*").alias("n_edges"))


@register("nested_entries", library("SELECT 'order ' || l_orderkey AS entry, 1::BIGINT AS n FROM lc", _LINES))
def nested_entries(lib: Library) -> DataFrame:
    twice = lib.entries().select("entry", F.concat(F.lit('(:entry (:name "outer") (:type) '), "text", F.lit(")")).alias("text"))
    return T.nested_entries(materialize(sexp.parse_nodes(twice), "nodes")).groupBy("entry").agg(F.count("*").alias("n"))


@register("light_to_heavy", library("SELECT 'order ' || l_orderkey AS entry, n + 8 AS n_nodes FROM lc", _LINES))
def light_to_heavy(lib: Library) -> DataFrame:
    n = materialize(_nodes(lib), "nodes")
    return T.light_to_heavy(n, n.select("entry").distinct().withColumn("module", F.lit("m"))).groupBy("entry").agg(F.count("*").alias("n_nodes"))


@register("leaf_prune")
def leaf_prune(lib: Library) -> DataFrame:
    return T.prune_leaves(materialize(_nodes(lib).withColumn("description", F.when(F.col("child_pos") % 2 == 1, F.col("description")).otherwise("")), "nodes"), 0.5)


_BY_NATION = "bn AS (SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"


@register("dag_roundtrip", library("SELECT n_name AS entry, unnest([':entry', ':name', ':type', ':function', ':apply']) AS node_type, unnest([1, n + 2, 1, 1, 1])::BIGINT AS cnt FROM bn", _BY_NATION))
def dag_roundtrip(lib: Library) -> DataFrame:
    who = lib.table("customer").join(lib.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = who.groupBy("n_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda k: F.concat(F.lit('(:name "cust '), k.cast("string"), F.lit('")'))), " ").alias("names"))
    entries = parts.select(F.col("n_name").alias("entry"), F.concat(F.lit('(:entry (:name "'), "n_name", F.lit('") (:type (:name "t")) (:function (:apply '), "names", F.lit(")))")).alias("text"))
    n = materialize(sexp.parse_nodes(entries), "nodes")
    children = T.tree_edges(n).groupBy("entry", F.col("parent_id").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("child_pos", "child_id"))), lambda c: c["child_id"]).alias("child_ids"))
    rows = n.join(children, ["entry", "node_id"], "left").select("entry", F.col("node_id").alias("pos"), "node_id", "node_type", "description", F.coalesce("child_ids", F.array().cast("array<bigint>")).alias("child_ids"))
    path = _place(lib, "dag")
    dag.write_dag(rows, path)
    return dag.read_dag_text(lib.spark, path).groupBy("entry", "node_type").agg(F.count("*").alias("cnt"))


@register("network_roundtrip", library("SELECT src, dst, edge_type, w FROM edges"))
def network_roundtrip(lib: Library) -> DataFrame:
    path = _place(lib, "network")
    dag.write_network(lib.definitions().select(F.col("def_id").alias("id"), F.col("def_type").alias("label")), lib.edges(), path)
    _, links = dag.read_network(lib.spark, path)
    return links.select("src", "dst", "edge_type", F.try_element_at("properties", F.lit("w")).cast("bigint").alias("w"))


@register("vectors_roundtrip", "SELECT 'v' || vec_id AS word, len(embedding)::INT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vectors_roundtrip(lib: Library) -> DataFrame:
    path = _place(lib, "vectors")
    vectors.write_vectors(lib.vectors().select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("word"), F.col("features").alias("vec")), path)
    back = vectors.read_vectors(lib.spark, path)
    return back.select("word", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
