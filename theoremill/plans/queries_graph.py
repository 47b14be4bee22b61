"""Registered queries on names, graph building and graph statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.operators import graph as K
from theoremill.operators import stats as G
from theoremill.plans.projection import Library
from theoremill.plans.scratch import materialize
from theoremill.plans.sql import library

Q, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Library(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


@register("edge_merge", library("SELECT * FROM refs"))
def edge_merge(lib: Library) -> DataFrame:
    sold = lib.sold()
    rows = sold.select("o_custkey", F.inline(F.array(F.struct(F.col("l_partkey").alias("key"), F.lit("BODY").alias("section")), F.struct(F.col("l_suppkey").alias("key"), F.lit("TYPE").alias("section")))))
    counted = rows.groupBy("o_custkey", "key", "section").agg(F.count("*").alias("n"))
    named = lib.named(counted, "o_custkey", lib.customers(), "src")
    target = lib.parts().select("key", "id", F.lit("BODY").alias("section")).unionAll(lib.suppliers().select("key", "id", F.lit("TYPE").alias("section")))
    return K.reference_edges(named.join(target.withColumnRenamed("id", "dst"), ["key", "section"]).select("src", "dst", "section", "n"))


@register("node_upsert", library("SELECT id, arg_min(label, (ord, label)) AS label FROM (SELECT def_id AS id, def_type AS label, ord FROM defs UNION ALL SELECT def_id, ':external', ord + 1 FROM defs) GROUP BY id"))
def node_upsert(lib: Library) -> DataFrame:
    d = K.unique_definitions(lib.definitions())
    again = d.select(F.col("def_id").alias("id"), F.lit(":external").alias("label"), (F.col("ord") + 1).alias("ord"))
    return K.upsert_nodes(d.select(F.col("def_id").alias("id"), F.col("def_type").alias("label"), "ord").unionAll(again))


@register("missing_nodes", library("SELECT DISTINCT dst AS id, ':external' AS label FROM refs WHERE dst NOT IN (SELECT id FROM cust UNION ALL SELECT id FROM supp)"))
def missing_nodes(lib: Library) -> DataFrame:
    return K.missing_nodes(lib.references(), lib.definitions().where("is_internal"))


@register("name_kind_flags", library(r"""SELECT id, regexp_matches(id, '(^|\.)with-[0-9]+ [0-9]+$') AS is_with, regexp_matches(id, '(^|\.)-rewrite[0-9]+ [0-9]+$') AS is_rewrite,
 NOT regexp_matches(id, '(^|\.)(with-|-rewrite)[0-9]+ [0-9]+$') AS is_normal, id AS name FROM (SELECT id FROM cust UNION ALL SELECT first FROM helps UNION ALL SELECT replace(first, '.with-', '.-rewrite') FROM helps)"""))
def name_kind_flags(lib: Library) -> DataFrame:
    h = lib.order_helpers()
    ids = lib.customers().select("id").unionAll(h.select("first")).unionAll(h.select(F.replace("first", F.lit(".with-"), F.lit(".-rewrite"))))
    n = F.col("id")
    nodes = ids.select("id", F.lit(":name").alias("tag"), F.concat(F.lit('"'), n, F.lit('"')).alias("d")).where(N.is_name_tag(F.col("tag")))
    return nodes.select("id", N.is_with(n).alias("is_with"), N.is_rewrite(n).alias("is_rewrite"), N.is_normal(n).alias("is_normal"), N.unquoted(F.col("tag"), F.col("d")).alias("name"))


@register("edge_type_flags", r"""SELECT edge_type, starts_with(edge_type, 'REFERENCE') AS is_reference, edge_type IN ('REFERENCE_TYPE', 'REFERENCE_BODY', 'DEFINES', 'CONTAINS') AS is_normal,
 regexp_replace(edge_type, '_TO_(WITH|REWRITE)$', '') AS normal_form FROM (SELECT unnest(['DEFINES', 'CONTAINS', 'REFERENCE_TYPE', 'REFERENCE_BODY', 'REFERENCE_TYPE_TO_WITH', 'REFERENCE_BODY_TO_WITH', 'REFERENCE_TYPE_TO_REWRITE', 'REFERENCE_BODY_TO_REWRITE']) AS edge_type)""")
def edge_type_flags(lib: Library) -> DataFrame:
    return N.edge_type_dimension(lib.spark)


@register("parent_name", library(r"SELECT def_id AS id, regexp_extract(def_id, '^(.*)\.[^.]*$', 1) AS parent, list_last(string_split(string_split(def_id, ' ')[1], '.')) AS display FROM defs"))
def parent_name(lib: Library) -> DataFrame:
    n = F.col("def_id")
    return lib.definitions().select(n.alias("id"), N.parent_name(n).alias("parent"), N.display_name(n).alias("display"))


@register("export_labels", library("SELECT id, list_filter(['module_like', replace(replace(tag, ':', ''), '-', '_'), CASE WHEN ext THEN 'external' END], lambda x: x IS NOT NULL AND (x <> 'module_like' OR meta)) AS labels FROM (SELECT def_id AS id, def_type AS tag, NOT is_internal AS ext, false AS meta FROM defs UNION ALL SELECT DISTINCT module_name, ':module', NOT is_internal, true FROM defs)"))
def export_labels(lib: Library) -> DataFrame:
    d = lib.definitions()
    rows = d.select(F.col("def_id").alias("id"), F.col("def_type").alias("tag"), "is_internal").unionAll(d.select("module_name", F.lit(":module"), "is_internal").distinct())
    return rows.select("id", N.export_labels(F.col("tag"), ~F.col("is_internal")).alias("labels"))


@register("module_chain", library("SELECT * FROM meta"))
def module_chain(lib: Library) -> DataFrame:
    return lib.module_edges()


@register("external_closure", library("SELECT def_id AS id, is_internal FROM defs"))
def external_closure(lib: Library) -> DataFrame:
    return K.internal_flags(lib.module_edges())


@register("helper_owner", library("SELECT helper, owner FROM owners"))
def helper_owner(lib: Library) -> DataFrame:
    return K.helper_owners(lib.helper_edges(), lib.helper_order())


def _helpers(lib: Library) -> tuple[DataFrame, DataFrame]:
    """The library's edges with helpers, and each helper's root; both are written once, as several steps read them."""
    edges = materialize(lib.helper_edges(), "helper-edges")
    return edges, K.helper_roots(K.helper_owners(edges, lib.helper_order()))


@register("helper_root", library("SELECT helper, root FROM owners"))
def helper_root(lib: Library) -> DataFrame:
    return K.helper_roots(K.helper_owners(lib.helper_edges(), lib.helper_order()))


@register("helper_total_weight", library("SELECT helper, 'REFERENCE_BODY_TO_WITH' AS edge_type, 1::BIGINT AS tw FROM owners"))
def helper_total_weight(lib: Library) -> DataFrame:
    return K.helper_total_weights(*_helpers(lib))


@register("helper_lift", library("SELECT * FROM body"))
def helper_lift(lib: Library) -> DataFrame:
    edges, roots = _helpers(lib)
    return K.lift_from_helpers(edges, roots, K.helper_total_weights(edges, roots))


@register("cross_helper_lift", library("SELECT s.id AS src, h.customer AS dst, 'REFERENCE_BODY' AS edge_type, count(*)::BIGINT AS w FROM sold JOIN supp s ON l_suppkey = s.key JOIN helps h ON h.o_orderkey = sold.o_orderkey GROUP BY 1, 2"))
def cross_helper_lift(lib: Library) -> DataFrame:
    rows = lib.sold().groupBy("o_orderkey", "l_suppkey").agg(F.count("*").alias("w"))
    h = lib.order_helpers()
    cross = lib.named(rows, "l_suppkey", lib.suppliers(), "src").join(h.select("o_orderkey", F.col("first").alias("dst")), "o_orderkey").select("src", "dst", F.lit(N.BODY + N.TO_WITH).alias("edge_type"), "w")
    own = h.select(F.col("customer").alias("src"), F.col("first").alias("dst"), F.lit(N.BODY + N.TO_WITH).alias("edge_type"), F.lit(1).cast("bigint").alias("w"))
    return K.lift_cross_references(cross.unionAll(own), K.helper_roots(K.helper_owners(lib.helper_edges(), lib.helper_order())))


@register("rewrite_lift", library("SELECT c.id AS src, p.id AS dst, 'REFERENCE_BODY' AS edge_type, count(*)::BIGINT AS w FROM sold JOIN cust c ON o_custkey = c.key JOIN parts p ON l_partkey = p.key WHERE o_orderstatus = 'F' GROUP BY 1, 2"))
def rewrite_lift(lib: Library) -> DataFrame:
    edges = lib.rewrite_edges()
    order = lib.customers().select("id", F.col("key").alias("ord")).unionAll(edges.where(N.is_rewrite(F.col("dst"))).select(F.col("dst").alias("id"), F.lit(10**12).alias("ord")))
    return K.lift_from_rewrites(edges, K.helper_owners(edges, order))


@register("node_remap", library("SELECT * FROM tref"))
def node_remap(lib: Library) -> DataFrame:
    edges = lib.references().where(F.col("edge_type") == N.TYPE)
    alias = F.concat("src", F.lit("'"))
    both = edges.unionAll(edges.select(alias.alias("src"), "dst", "edge_type", (F.col("w") + 1).alias("w")))
    return K.merge_nodes(both, lib.customers().select(F.concat("id", F.lit("'")).alias("alias"), "id"))


@register("graph_checks", library("SELECT 'node_without_label' AS \"check\", count(*) FILTER (WHERE def_type IS NULL)::BIGINT AS violations FROM defs UNION ALL SELECT 'reference_without_weight', count(*) FILTER (WHERE edge_type LIKE 'REF%' AND w IS NULL)::BIGINT FROM edges UNION ALL SELECT 'meta_with_weight', count(*) FILTER (WHERE edge_type NOT LIKE 'REF%' AND w IS NOT NULL)::BIGINT FROM edges"))
def graph_checks(lib: Library) -> DataFrame:
    return K.graph_checks(lib.definitions().select(F.col("def_id").alias("id"), F.col("def_type").alias("label")), lib.edges())


@register("helper_closure", library("SELECT root AS def, helper FROM owners"))
def helper_closure(lib: Library) -> DataFrame:
    return K.helper_closure(lib.helper_edges())


_NODES = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
_DEG = """deg AS (SELECT n.id, coalesce(i.d, 0)::DOUBLE AS in_degree, coalesce(o.d, 0)::DOUBLE AS out_degree, (coalesce(i.d, 0) + coalesce(o.d, 0))::DOUBLE AS degree FROM nodes n
 LEFT JOIN (SELECT dst, sum(coalesce(w, 1)) AS d FROM edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, sum(coalesce(w, 1)) AS d FROM edges GROUP BY src) o ON o.src = n.id)"""


@register("degrees", library("SELECT * FROM deg", _NODES, _DEG))
def degrees(lib: Library) -> DataFrame:
    edges = materialize(lib.edges(), "edges")
    return G.degrees(G.nodes_of(edges), edges)


@register("graph_shape", library("SELECT round((max(degree) * count(*) - sum(degree)) / ((SELECT max(coalesce(w, 1)) FROM edges) * (count(*) - 1) * (count(*) - 2)), 6) AS star_shape_level, round(sum(degree * degree) / sum(degree), 6) AS tendency_to_make_hub FROM deg", _NODES, _DEG))
def graph_shape(lib: Library) -> DataFrame:
    edges = materialize(lib.edges(), "edges")
    return G.shape(G.nodes_of(edges), edges).select(F.round("star_shape_level", 6).alias("star_shape_level"), F.round("tendency_to_make_hub", 6).alias("tendency_to_make_hub"))


@register("weak_components")
def weak_components(lib: Library) -> DataFrame:
    edges = materialize(lib.edges(), "edges")
    return G.weak_components(G.nodes_of(edges), edges).groupBy("component").agg(F.count("*").alias("size"))


SQL["weak_components"] = library(
    "SELECT component, count(*)::BIGINT AS size FROM (SELECT id, min(r) AS component FROM reach GROUP BY id) GROUP BY component",
    "links AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)",
    # Modules and suppliers tie all regions together through customers; labels spread from the smallest node.
    "reach AS (SELECT src AS id, (SELECT min(least(src, dst)) FROM edges) AS r FROM links UNION SELECT l.dst, r.r FROM reach r JOIN links l ON l.src = r.id)",
    recursive=True,
)


@register("pagerank_10", None)
def pagerank_10(lib: Library) -> DataFrame:
    edges = materialize(lib.references(), "edges")
    return G.pagerank(G.nodes_of(edges), edges, rounds=10, tolerance=0).select("id", F.round("pagerank", 9).alias("pagerank"))


def _pagerank_sql() -> str:
    steps = ["pn AS (SELECT src AS id FROM refs UNION SELECT dst FROM refs)", "pw AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM refs GROUP BY 1, 2)", "ps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM pw)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS v FROM pn)"]
    for i in range(10):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT n.id, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(v), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM pw)) / (SELECT count(*) FROM pn)) + 0.15 / (SELECT count(*) FROM pn) AS v"
            f" FROM pn n LEFT JOIN (SELECT dst, sum(v * share) AS got FROM r{i} JOIN ps ON src = id GROUP BY dst) g ON g.dst = n.id)"
        )
    return library("SELECT id, round(v, 9) AS pagerank FROM r10", *steps)


SQL["pagerank_10"] = _pagerank_sql()


def _nation_graph(lib: Library) -> tuple[DataFrame, DataFrame]:
    """Nations, an edge customer's nation -> supplier's nation for each pair whose trade exceeds the mean."""
    who = lambda df, k: df.select(F.col("key").alias(k), F.col("module").alias(f"{k}_m"))
    counted = lib.sold().groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("w")).join(who(lib.customers(), "o_custkey"), "o_custkey").join(who(lib.suppliers(), "l_suppkey"), "l_suppkey")
    flow = counted.groupBy(F.col("o_custkey_m").alias("src"), F.col("l_suppkey_m").alias("dst")).agg(F.sum("w").alias("w")).where("src <> dst")
    mean = flow.agg(F.avg("w").alias("mean"))
    edges = flow.crossJoin(F.broadcast(mean)).where("w > mean * 1.3").select("src", "dst", F.lit("REFERENCE_BODY").alias("edge_type"), "w")  # one row
    return lib.modules().select(F.col("module").alias("id")), edges


_FLOW = """flow AS (SELECT c.module AS src, s.module AS dst, count(*)::BIGINT AS w FROM sold JOIN cust c ON o_custkey = c.key JOIN supp s ON l_suppkey = s.key WHERE c.module <> s.module GROUP BY 1, 2),
ne AS (SELECT * FROM flow WHERE w > (SELECT avg(w) FROM flow) * 1.3)"""


@register("strong_components", library("SELECT m.module AS id, least(m.module, coalesce((SELECT min(a.dst) FROM nr a JOIN nr b ON a.src = b.dst AND a.dst = b.src WHERE a.src = m.module), m.module)) AS component FROM mods m", _FLOW, "nr AS (SELECT src, dst FROM ne UNION SELECT r.src, e.dst FROM nr r JOIN ne e ON r.dst = e.src)", recursive=True))
def strong_components(lib: Library) -> DataFrame:
    return G.strong_components(*_nation_graph(lib))


_CYCLES = (
    "pa AS (SELECT [src, dst] AS path, src AS a, dst AS z, 2 AS n FROM ne WHERE src < dst UNION ALL SELECT list_append(path, e.dst), a, e.dst, n + 1 FROM pa JOIN ne e ON e.src = z WHERE e.dst > a AND NOT list_contains(path, e.dst))",
    "cyc AS (SELECT path FROM pa JOIN ne e ON e.src = z AND e.dst = a)",
)


@register("cycles", library("SELECT m.module AS id, count(p.path)::BIGINT AS n_cycles FROM mods m LEFT JOIN cyc p ON list_contains(p.path, m.module) GROUP BY 1", _FLOW, *_CYCLES, recursive=True))
def cycles(lib: Library) -> DataFrame:
    return G.cycles(*_nation_graph(lib))


@register("cycle_summary", library("SELECT count(*)::BIGINT AS n_cycles, coalesce(max(len(path)), 0)::INT AS longest, (SELECT count(*) FROM cyc WHERE len(path) = (SELECT max(len(path)) FROM cyc))::BIGINT AS n_longest FROM cyc", _FLOW, *_CYCLES, recursive=True))
def cycle_summary(lib: Library) -> DataFrame:
    return G.cycle_summary(*_nation_graph(lib))


def _distances(rounds: int) -> list[str]:
    """Shortest distances between nations after that many steps of relaxation (as many as there are nations will do)."""
    steps = ["d0 AS MATERIALIZED (SELECT module AS s, module AS v, 0::DOUBLE AS d FROM mods)"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT s, v, min(d) AS d FROM (SELECT * FROM d{i - 1} UNION ALL SELECT s, dst, d + w FROM d{i - 1} JOIN ne ON src = v) GROUP BY 1, 2)")
    return steps


_PATHS = (
    "tight AS MATERIALIZED (SELECT a.s, src AS u, dst AS v FROM d24 a JOIN ne ON src = a.v JOIN d24 b ON b.s = a.s AND b.v = dst AND b.d = a.d + w)",
    "sp AS (SELECT module AS s, module AS z, [module] AS path FROM mods UNION ALL SELECT sp.s, t.v, list_append(path, t.v) FROM sp JOIN tight t ON t.s = sp.s AND t.u = sp.z)",
    "np AS (SELECT s, z, count(*) AS n FROM sp GROUP BY 1, 2)",
    "bt AS (SELECT id, sum(1.0 / n) AS b FROM (SELECT unnest(path[2:-2]) AS id, n FROM sp JOIN np USING (s, z) WHERE len(path) > 2) GROUP BY id)",
)


@register("betweenness", library("SELECT module AS id, round(coalesce(b, 0) / ((SELECT count(*) FROM mods) - 1) / ((SELECT count(*) FROM mods) - 2), 6)::DOUBLE AS value FROM mods LEFT JOIN bt ON id = module", _FLOW, *_distances(24), *_PATHS, recursive=True))
def betweenness(lib: Library) -> DataFrame:
    return G.betweenness(*_nation_graph(lib)).select("id", F.round("value", 6).alias("value"))


def _eigen_sql(rounds: int) -> str:
    steps = ["e0 AS MATERIALIZED (SELECT module AS id, 1.0::DOUBLE / (SELECT count(*) FROM mods) AS v FROM mods)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT id, e.v + coalesce((SELECT sum(x.v * ne.w) FROM e{i - 1} x JOIN ne ON src = x.id WHERE dst = e.id), 0) AS v FROM e{i - 1} e)")
        steps.append(f"e{i} AS MATERIALIZED (SELECT id, v / (SELECT CASE WHEN sum(v * v) = 0 THEN 1 ELSE sqrt(sum(v * v)) END FROM r{i}) AS v FROM r{i})")
    return library(f"SELECT id, round(CASE WHEN v < 1e-16 THEN 0 ELSE v END, 6)::DOUBLE AS value FROM e{rounds}", _FLOW, *steps)


@register("eigenvector", _eigen_sql(40))
def eigenvector(lib: Library) -> DataFrame:
    """Settled to twelve digits, so that the SQL's fixed number of rounds agrees."""
    return G.eigenvector(*_nation_graph(lib), tolerance=1e-12).select("id", F.round("value", 6).alias("value"))


@register("current_flow", library("SELECT module AS id, 0.0::DOUBLE AS value FROM mods"))
def current_flow(lib: Library) -> DataFrame:
    return G.current_flow_betweenness(lib.modules().select(F.col("module").alias("id")))
