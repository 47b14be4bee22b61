"""Registered round trips: what sinks write is read back by the sources, and compared with the rows it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.operators import dataset as P
from theoremill.operators import experiment as O
from theoremill.operators import features as E
from theoremill.operators import stats as G
from theoremill.plans.projection import Library
from theoremill.plans.queries_graph import Q, SQL, _DEG, _NODES, register
from theoremill.plans.queries_learning import _PW
from theoremill.plans.queries_trees import _place
from theoremill.plans.scratch import materialize
from theoremill.plans.sql import library, split_words
from theoremill.sources import dag, sexp, sinks, vectors
from theoremill.functions import names as N

__all__ = ["Q", "SQL"]


def _named_vectors(lib: Library) -> DataFrame:
    return lib.vectors().select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("word"), F.col("features").alias("vec"))


@register("vocabulary_roundtrip", f"SELECT word, count(*)::BIGINT AS cnt FROM ({_PW}) WHERE word NOT IN (SELECT unnest({split_words('p_brand')}) FROM part) GROUP BY word")
def vocabulary_roundtrip(lib: Library) -> DataFrame:
    """W9, S15."""
    part, path = lib.table("part"), _place(lib, "vocabulary")
    brands = part.select(F.explode(N.split_words(F.col("p_brand"))).alias("word")).distinct()
    vectors.write_vocabulary(E.vocabulary(part.select(F.col("p_name").alias("text"))), path, brands)
    return vectors.read_vocabulary(lib.spark, path)


@register("word_list", "SELECT 'v' || vec_id AS word FROM embeddings UNION ALL SELECT count(*)::VARCHAR FROM embeddings")
def word_list(lib: Library) -> DataFrame:
    """The first field of each line of a vector file, its header's too."""
    path = _place(lib, "words")
    vectors.write_vectors(_named_vectors(lib), path)
    return vectors.read_words(lib.spark, path)


@register("vector_vocabulary", "SELECT 'v' || vec_id AS word FROM embeddings")
def vector_vocabulary(lib: Library) -> DataFrame:
    """Words of a text vector file, its header being none."""
    path = _place(lib, "words")
    vectors.write_vectors(_named_vectors(lib), path)
    return vectors.vector_vocabulary(lib.spark, path)


@register("translations_roundtrip", "SELECT 'p' || p_partkey AS word, unnest([0, 1])::INT AS pos, unnest([p_brand, 'size ' || p_size]) AS part, unnest(CASE WHEN p_partkey % 2 = 1 THEN [0.25, 0.75] ELSE [0.5, 0.5] END)::DOUBLE AS weight FROM part")
def translations_roundtrip(lib: Library) -> DataFrame:
    """Odd parts have weights, even ones none."""
    path = _place(lib, "translations")
    key = F.col("p_partkey")
    line = F.concat_ws(";", F.concat(F.lit("p"), key.cast("string")), F.lit("3"), F.lit("9"), "p_brand", F.concat(F.lit("size "), F.col("p_size").cast("string")), F.when(key % 2 == 1, "0.25;0.75"))
    lib.table("part").select(line.alias("value")).write.mode("overwrite").text(path)
    return vectors.read_translations(lib.spark, path)


@register("false_positives_roundtrip", library("SELECT 'v' || a.id AS node, 'v' || b.id AS candidate, (0.5 + (b.id - a.id) / 8.0)::DOUBLE AS score FROM vec a JOIN vec b ON b.id BETWEEN a.id + 1 AND a.id + 3"))
def false_positives_roundtrip(lib: Library) -> DataFrame:
    """A block per node; the last one is kept."""
    path = _place(lib, "false-positives")
    ids = lib.vectors().select("id")
    pairs = ids.select(F.col("id").alias("a"), F.explode(F.array(*(F.struct((F.col("id") + i).alias("b"), F.lit(0.5 + i / 8).alias("s")) for i in (1, 2, 3)))).alias("p"))
    known = pairs.select("a", "p.b", "p.s").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    line = F.concat(F.col("s").cast("string"), F.lit(";v"), F.col("b").cast("string"))
    blocks = known.groupBy("a").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    blocks.select(F.concat(F.lit("NODE;v"), F.col("a").cast("string"), F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
    return vectors.read_false_positives(lib.spark, path)


@register("definition_texts_roundtrip", library("SELECT module_name AS module, def_type || ' ' || def_id AS text FROM defs"))
def definition_texts_roundtrip(lib: Library) -> DataFrame:
    """A folder per module; written twice, as a second run replaces the first."""
    path = _place(lib, "texts")
    texts = lib.definitions().select(F.col("module_name").alias("module"), F.concat_ws(" ", "def_type", "def_id").alias("text"))
    for _ in range(2):
        sinks.write_definition_texts(texts.repartition("module"), path)
    return lib.spark.read.text(path).select(F.col("module").cast("string").alias("module"), F.col("value").alias("text"))


@register("graph_text", library("SELECT 'N;' || id || ';' || def_type || ';' || round(degree)::BIGINT || '.0' AS value FROM deg JOIN defs ON id = def_id UNION ALL SELECT 'E;' || src || ';' || dst || ';' || edge_type || ';' || coalesce(w::VARCHAR, '') FROM edges", _NODES, _DEG))
def graph_text(lib: Library) -> DataFrame:
    """The lines of the dump."""
    edges, path = materialize(lib.edges(), "edges"), _place(lib, "graph-text")
    nodes = lib.definitions().select(F.col("def_id").alias("id"), F.col("def_type").alias("label"))
    used = nodes.join(G.nodes_of(edges), "id", "left_semi")
    sinks.write_graph_text(used, edges, G.degrees(used, edges).select("id", "degree"), path)
    return lib.spark.read.text(path)


@register("graph_tables_roundtrip", library("SELECT src, dst, edge_type, w FROM edges"))
def graph_tables_roundtrip(lib: Library) -> DataFrame:
    """W6, S19."""
    path = _place(lib, "graph")
    sinks.write_graph(lib.definitions(), lib.edges(), path)
    return sinks.read_graph(lib.spark, path)[1]


@register("library_resolver", library("SELECT 'link' AS kind, edge_type AS name, count(*)::BIGINT AS n FROM edges GROUP BY 2 UNION ALL SELECT 'node', def_type, count(*)::BIGINT FROM defs GROUP BY 2 UNION ALL SELECT 'entry', '', 0"))
def library_resolver(lib: Library) -> DataFrame:
    """A library with a network and no entries."""
    path = _place(lib, "library")
    dag.write_network(lib.definitions().select(F.col("def_id").alias("id"), F.col("def_type").alias("label")), lib.edges(), f"{path}/network.csv")
    entries, nodes, links = dag.load_library(lib.spark, path)
    n = F.count("*").alias("n")
    label = F.try_element_at("properties", F.lit("label"))
    counted = links.groupBy(F.lit("link").alias("kind"), F.col("edge_type").alias("name")).agg(n).unionAll(nodes.groupBy(F.lit("node"), label).agg(n))
    return counted.unionAll(entries.agg(n).select(F.lit("entry"), F.lit(""), "n"))


@register("internal_sources", library("SELECT DISTINCT module_name AS source, module_name AS module, is_internal FROM defs"))
def internal_sources(lib: Library) -> DataFrame:
    """Files of modules that the library's folder lists are internal."""
    modules = lib.definitions().select("module_name", "is_internal").distinct()
    files = modules.select(F.col("module_name").alias("source"), F.col("module_name").alias("module"))
    return sexp.internal_sources(files, modules.where("is_internal").select(F.col("module_name").alias("module"))).select("source", "module", "is_internal")


@register("node_properties", library("""SELECT id, unnest(['in_degree', 'out_degree', 'degree']) AS property, unnest([in_degree, out_degree, degree])::DOUBLE AS value FROM deg JOIN defs ON id = def_id
 UNION ALL SELECT 'library_tpch', 'star_shape_level', star_shape_level FROM ({shape}) UNION ALL SELECT 'library_tpch', 'tendency_to_make_hub', tendency_to_make_hub FROM ({shape})""".format(shape=SQL["graph_shape"]), _NODES, _DEG))
def node_properties(lib: Library) -> DataFrame:
    """statistics for definitions, those of the graph for the library, none for modules."""
    edges = materialize(lib.edges(), "edges")
    labels = lib.definitions().select(F.col("def_id").alias("id"), F.col("def_type").alias("label"))
    nodes = G.nodes_of(edges).join(labels, "id", "left").select("id", F.coalesce("label", F.when(F.col("id") == "library_tpch", ":library").otherwise(":module")).alias("label"))
    made = O.node_properties(nodes, edges, "library_tpch")
    return made.select("id", F.explode("properties").alias("property", "value")).select("id", "property", F.round("value", 6).alias("value"))


@register("classifier_edges", library("SELECT src, sum(label)::BIGINT AS n_positive, sum(1 - label)::BIGINT AS n_negative, 0::BIGINT AS n_wrong FROM (SELECT src, unnest([1, 0]) AS label FROM body) GROUP BY src"))
def classifier_edges(lib: Library) -> DataFrame:
    """P10: as many negatives as positives per theorem, no negative being an edge or repeated."""
    body = materialize(lib.body_references(), "body")
    theorems = lib.definitions().select(F.col("def_id").alias("id"))
    made = materialize(P.classifier_edges(body, theorems), "classifier-edges")
    met = made.groupBy("src", "dst").agg(F.count("*").alias("n"))
    wrong = met.where("n > 1").groupBy("src").agg(F.count("*").alias("n_wrong"))
    counts = made.groupBy("src").agg(F.sum("label").cast("bigint").alias("n_positive"), F.sum(1 - F.col("label")).cast("bigint").alias("n_negative"))
    return counts.join(wrong, "src", "left").select("src", "n_positive", "n_negative", F.coalesce("n_wrong", F.lit(0)).cast("bigint").alias("n_wrong"))


@register("artefact_names", "SELECT 'lib/' || n_name || '/dataset@p_keep=0.1@p_test=0.2' AS path FROM nation")
def artefact_names(lib: Library) -> DataFrame:
    """Places do not depend on the order of parameters. Nations are a dimension table."""
    names = [r["n_name"] for r in lib.table("nation").select("n_name").collect()]
    return lib.spark.createDataFrame([(sinks.artefact("lib", n, "dataset", p_test=0.2, p_keep=0.1),) for n in names], "path string")
