"""Building the typed, weighted reference graph: merging, helper resolution, lifting, module hierarchy, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.plans.scratch import materialize

#: Longest chain of helpers; beyond it a cycle is assumed and reported.
MAX_DEPTH = 64


def merge_edges(edges: DataFrame) -> DataFrame:
    """K4: one row per (src, dst, edge_type); weights add up."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.sum("w").alias("w"))


def reference_edges(references: DataFrame) -> DataFrame:
    """K5: references (src, dst, section in TYPE or BODY) as weighted edges; a row is one occurrence, or n of them where
    there is a column n (so that occurrences can be counted by short keys before names are joined)."""
    section = F.concat(F.lit("REFERENCE_"), F.col("section"))
    w = F.col("n") if "n" in references.columns else F.lit(1)
    return merge_edges(references.select("src", "dst", N.reference_type(section, F.col("dst")).alias("edge_type"), w.cast("bigint").alias("w")))


def upsert_nodes(candidates: DataFrame) -> DataFrame:
    """K1: id, label; the first label by `ord` wins."""
    return candidates.groupBy("id").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))


def unique_definitions(definitions: DataFrame) -> DataFrame:
    """K2: the first definition of a name by `ord`. A repeated name is allowed only for constructors whose name does not
    begin with their module; any other repetition is an error."""
    w = Window.partitionBy("def_id").orderBy("ord")
    seen = definitions.withColumns({"nth": F.row_number().over(w), "first_type": F.first("def_type").over(w)})
    allowed = (F.col("nth") == 1) | ((F.col("def_type") == ":constructor") & (F.col("first_type") == ":constructor") & ~F.col("def_id").startswith(F.col("module_name")))
    checked = seen.withColumn("ok", F.assert_true(allowed, F.concat(F.lit("defined twice: "), F.col("def_id"))))
    return checked.where(F.col("ok").isNull() & (F.col("nth") == 1)).drop("nth", "first_type", "ok")


def missing_nodes(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Referenced names without a definition become external dummies (id, label)."""
    return references.select(F.col("dst").alias("id")).distinct().join(definitions.select(F.col("def_id").alias("id")), "id", "left_anti").select("id", F.lit(N.EXTERNAL).alias("label"))


def helper_owners(edges: DataFrame, order: DataFrame) -> DataFrame:
    """K6, K7: helper, owner. The owner is the source of the last reference that was seen before the helper itself, self
    references excluded. order: id, ord (position in the forest)."""
    refs = edges.where(F.col("src") != F.col("dst")).where(~N.is_normal(F.col("dst"))).select("src", F.col("dst").alias("helper"))
    placed = refs.join(order.select(F.col("id").alias("src"), F.col("ord").alias("src_ord")), "src").join(order.select(F.col("id").alias("helper"), F.col("ord").alias("own_ord")), "helper")
    return placed.where("src_ord < own_ord").groupBy("helper").agg(F.max_by("src", F.struct("src_ord", "src")).alias("owner"))


def helper_roots(owners: DataFrame) -> DataFrame:
    """K8: helper, root: owners are followed until one is not a with helper (pointer jumping, so the rounds grow with
    the logarithm of the longest chain). A cycle is an error."""
    now = materialize(owners.select("helper", F.col("owner").alias("root")), "owners")
    for _ in range(MAX_DEPTH.bit_length() + 1):
        up = now.select(F.col("helper").alias("k"), F.col("root").alias("next"))
        step = materialize(now.join(up, F.col("root") == F.col("k"), "left").select("helper", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("helper", "root")
        if step.where("moved").isEmpty():
            return now
    raise ValueError("helpers form a cycle, or a chain longer than the depth bound")


def helper_total_weights(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Helper, edge_type, tw: sum over paths from the root of the product of weights, the path staying within
    one root; the type is that of the edge that leaves the root. Frontiers are added up level by level."""
    to_helper = edges.join(roots.select(F.col("helper").alias("dst"), "root"), "dst")
    front = to_helper.where("src = root").groupBy(F.col("dst").alias("helper"), "edge_type").agg(F.sum("w").alias("tw"))
    steps = to_helper.where("src <> root").join(roots.select(F.col("helper").alias("src"), F.col("root").alias("src_root")), "src").where("root = src_root")
    steps = materialize(steps.groupBy("src", "dst").agg(F.sum("w").alias("w")), "helper-steps")
    front = materialize(front, "front")
    levels = [front]
    for _ in range(MAX_DEPTH):
        if front.isEmpty():
            break
        front = materialize(front.join(steps, F.col("helper") == F.col("src")).groupBy(F.col("dst").alias("helper"), "edge_type").agg(F.sum(F.col("tw") * F.col("w")).alias("tw")), "front")
        levels.append(front)
    else:
        raise ValueError("helpers form a cycle, or a chain longer than the depth bound")
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    return every.groupBy("helper", "edge_type").agg(F.sum("tw").alias("tw"))


def lift_from_helpers(edges: DataFrame, roots: DataFrame, weights: DataFrame) -> DataFrame:
    """References of helpers, given to their roots: the type is that of the edge from the root, made normal."""
    out = edges.where(~N.is_with(F.col("dst")) & N.edge_type_is_reference(F.col("edge_type"))).groupBy(F.col("src").alias("helper"), "dst").agg(F.sum("w").alias("w"))
    lifted = out.join(roots, "helper").join(weights, "helper")
    return merge_edges(lifted.select(F.col("root").alias("src"), "dst", N.to_normal(F.col("edge_type")).alias("edge_type"), (F.col("w") * F.col("tw")).alias("w")))


def lift_cross_references(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """References to helpers from elsewhere go to the helper's root; same root and helper to helper are skipped."""
    to = edges.join(roots.select(F.col("helper").alias("dst"), F.col("root").alias("to")), "dst").where(~N.is_with(F.col("src")) & (F.col("src") != F.col("to")))
    return merge_edges(to.select("src", F.col("to").alias("dst"), N.to_normal(F.col("edge_type")).alias("edge_type"), "w"))


def lift_from_rewrites(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Normal references of rewrite helpers, given to their owner; other types are skipped."""
    own = edges.where(N.edge_type_is_normal_reference(F.col("edge_type"))).join(owners.where(N.is_rewrite(F.col("helper"))), F.col("src") == F.col("helper"))
    return merge_edges(own.select(F.col("owner").alias("src"), "dst", "edge_type", "w"))


def module_hierarchy(definitions: DataFrame, library: str, external: str = "external source") -> DataFrame:
    """Src, dst, edge_type: modules DEFINE definitions and CONTAIN modules, the top ones hanging below the library
    or the external source."""
    modules = definitions.select("module_name", "is_internal").distinct()
    chain = modules.select("is_internal", F.explode(N.module_prefixes(F.col("module_name"))).alias("dst"))
    above = N.parent_name(F.col("dst"))
    root = F.when(F.col("is_internal"), library).otherwise(external)
    contains = chain.select(F.when(above == "", root).otherwise(above).alias("src"), "dst", F.lit(N.CONTAINS).alias("edge_type")).distinct()
    return definitions.select(F.col("module_name").alias("src"), F.col("def_id").alias("dst"), F.lit(N.DEFINES).alias("edge_type")).unionAll(contains)


def enclosing_modules(edges: DataFrame) -> DataFrame:
    """Id, module: for each definition its module and all that contain that. The closure is taken over modules, which
    are few to a definition, with a join per level of nesting."""
    inside = materialize(edges.where(F.col("edge_type") == N.CONTAINS).select(F.col("dst").alias("m"), F.col("src").alias("above")).distinct(), "contains")
    level = inside.select("m", F.col("above").alias("module"))
    found = level
    while not level.isEmpty():
        level = materialize(level.join(inside.select(F.col("m").alias("module"), "above"), "module").select("m", F.col("above").alias("module")).join(found, ["m", "module"], "left_anti"), "enclosing")
        found = found.unionAll(level)
    own = edges.where(F.col("edge_type") == N.DEFINES).select(F.col("dst").alias("id"), F.col("src").alias("module")).distinct()
    return own.unionAll(own.withColumnRenamed("module", "m").join(found, "m").select("id", "module")).distinct()


def merge_nodes(edges: DataFrame, same: DataFrame) -> DataFrame:
    """Nodes `alias` become `id` (same: alias, id); their edges move unless the target has one of that type."""
    to = lambda df, c: df.join(same.select(F.col("alias").alias(f"k_{c}"), F.col("id").alias(f"id_{c}")), F.col(c) == F.col(f"k_{c}"), "left")
    moved = to(to(edges, "src"), "dst")
    was = F.col("id_src").isNotNull() | F.col("id_dst").isNotNull()
    new = moved.select(F.coalesce("id_src", "src").alias("src"), F.coalesce("id_dst", "dst").alias("dst"), "edge_type", "w", was.alias("was"))
    return new.groupBy("src", "dst", "edge_type").agg(F.min_by("w", F.struct("was", "w")).alias("w"))


def graph_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Check, violations: nodes without label, references without weight, meta edges with one."""
    is_ref = N.edge_type_is_reference(F.col("edge_type"))
    label = nodes.agg(F.count_if(F.col("label").isNull()).alias("violations")).select(F.lit("node_without_label").alias("check"), "violations")
    both = edges.agg(F.count_if(is_ref & F.col("w").isNull()).alias("r"), F.count_if(~is_ref & F.col("w").isNotNull()).alias("m"))
    return label.unionAll(both.select(F.inline(F.array(F.struct(F.lit("reference_without_weight").alias("check"), F.col("r").alias("violations")), F.struct(F.lit("meta_with_weight").alias("check"), F.col("m").alias("violations"))))))


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(origin, node) pairs reached along src -> dst, start included; start: origin, node. Works on cyclic graphs: only
    new pairs are followed."""
    edges = materialize(edges.select("src", "dst").distinct(), "reach-edges")
    seen = front = materialize(start.select("origin", "node").distinct(), "reach")
    for _ in range(max_rounds):
        new = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("origin", F.col("dst").alias("node")).distinct()
        front = materialize(new.join(seen, ["origin", "node"], "left_anti"), "reach")
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
    raise ValueError("too many rounds")


def external_modules(edges: DataFrame, start: str = "external source") -> DataFrame:
    """Nodes reachable from the external source along CONTAINS (it included, if it has any)."""
    contains = edges.where(F.col("edge_type") == N.CONTAINS).select("src", "dst")
    begin = contains.where(F.col("src") == start).select(F.lit(start).alias("origin"), F.col("src").alias("node")).limit(1)
    return reachable(contains, begin).select(F.col("node").alias("module"))


def internal_flags(edges: DataFrame) -> DataFrame:
    """Id, is_internal: a definition is internal if its (last) defining module is not an external one."""
    owner = edges.where(F.col("edge_type") == N.DEFINES).groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("module"))
    return owner.join(external_modules(edges).withColumn("external", F.lit(True)), "module", "left").select("id", F.col("external").isNull().alias("is_internal"))


def helper_closure(edges: DataFrame) -> DataFrame:
    """Def, helper: all helpers that a normal definition reaches through helpers."""
    to_helper = edges.where(~N.is_normal(F.col("dst"))).select("src", "dst").distinct()
    start = to_helper.where(N.is_normal(F.col("src"))).select(F.col("src").alias("origin"), F.col("dst").alias("node"))
    return reachable(to_helper, start).select(F.col("origin").alias("def"), F.col("node").alias("helper"))
