"""The star-schema tables seen as a formal library: nodes, references, helpers, entry trees, documents, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremill.functions.names import BODY, CONTAINS, DEFINES, TO_REWRITE, TO_WITH, TYPE


class Library:
    """Lazy DataFrames over the tables in a directory; each query reads only what it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def modules(self) -> DataFrame:
        """n_nationkey, module: dotted module names, no spaces. Region and nation are dimension tables."""
        under = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(under("r_name"), F.lit("."), under("n_name")).alias("module"))

    def _member(self, table: str, key: str, nation: str, tag: str) -> DataFrame:
        k = F.col(key).cast("string")
        return self.table(table).join(self.modules(), F.col(nation) == F.col("n_nationkey")).select(F.col(key).alias("key"), F.concat("module", F.lit(f".{tag}"), k, F.lit(" "), k).alias("id"), "module")

    def customers(self) -> DataFrame:
        return self._member("customer", "c_custkey", "c_nationkey", "cust")

    def suppliers(self) -> DataFrame:
        return self._member("supplier", "s_suppkey", "s_nationkey", "supp")

    def parts(self) -> DataFrame:
        k = F.col("p_partkey").cast("string")
        return self.table("part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("ext."), "p_brand", F.lit(".part"), k, F.lit(" "), k).alias("id"), F.concat(F.lit("ext."), "p_brand").alias("module"))

    def definitions(self) -> DataFrame:
        """def_id, ord, def_type, module_name, is_internal."""
        part = lambda df, tag, base, internal: df.select(F.col("id").alias("def_id"), (F.col("key") + base).alias("ord"), F.lit(tag).alias("def_type"), F.col("module").alias("module_name"), F.lit(internal).alias("is_internal"))
        return part(self.customers(), ":function", 0, True).unionAll(part(self.suppliers(), ":data", 10**12, True)).unionAll(part(self.parts(), ":constructor", 2 * 10**12, False))

    def sold(self) -> DataFrame:
        """One row per line item: keys of customer, order, part, supplier and the line number, and the order's status."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @staticmethod
    def named(df: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
        return df.join(names.select(F.col("key").alias(f"__{out}"), F.col("id").alias(out)), F.col(column) == F.col(f"__{out}")).drop(f"__{out}")

    def references(self) -> DataFrame:
        """src, dst, edge_type, w: customer -> part in bodies, customer -> supplier in types; counted on keys, then
        named, so that names don't go through the first exchange."""
        counted = self.sold().groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("w"))
        body = self.named(self.named(counted, "o_custkey", self.customers(), "src"), "l_partkey", self.parts(), "dst")
        counted = self.sold().groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("w"))
        kind = self.named(self.named(counted, "o_custkey", self.customers(), "src"), "l_suppkey", self.suppliers(), "dst")
        return body.select("src", "dst", F.lit(BODY).alias("edge_type"), "w").unionAll(kind.select("src", "dst", F.lit(TYPE).alias("edge_type"), "w"))

    def body_references(self) -> DataFrame:
        return self.references().where(F.col("edge_type") == BODY)

    def module_edges(self) -> DataFrame:
        from theoremill.operators.graph import module_hierarchy

        return module_hierarchy(self.definitions(), "library_tpch")

    def edges(self) -> DataFrame:
        meta = self.module_edges().select("src", "dst", "edge_type", F.lit(None).cast("bigint").alias("w"))
        return self.references().unionAll(meta)

    def numbered_edges(self) -> tuple[DataFrame, list[DataFrame]]:
        """edges() as scratch tables by the numbers of names (name, n), which are in their order: keys and numbers are exchanged in place of
        names, and each step is written before the next one."""
        from theoremill.operators.features import number_names
        from theoremill.plans.scratch import discard, materialize

        meta = self.module_edges()
        names = materialize(number_names(meta.select(F.col("src").alias("id")).unionAll(meta.select("dst"))), "names", tidy=True)
        sold = materialize(self.sold().select("o_custkey", "l_partkey", "l_suppkey"), "sold", tidy=True)
        code = lambda df, column, ids, out: df.join(ids.select(F.col("key").alias(f"__{out}"), F.col("id").alias("name")).join(names, "name").select(f"__{out}", F.col("n").alias(out)).hint("shuffle_hash"), F.col(column) == F.col(f"__{out}"))
        found = []
        for column, targets, kind in (("l_partkey", self.parts(), BODY), ("l_suppkey", self.suppliers(), TYPE)):
            counted = sold.select("o_custkey", column).repartition(column).groupBy(column, "o_custkey").agg(F.count("*").alias("w"))
            both = code(code(counted, column, targets, "dst"), "o_custkey", self.customers(), "src")
            found.append(materialize(both.select("src", "dst", F.lit(kind).alias("edge_type"), "w"), "references", tidy=True))
        discard(sold)
        named = lambda c: names.select(F.col("name").alias(c), F.col("n").alias(f"{c}_n"))
        numbered = meta.join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "edge_type", F.lit(None).cast("bigint").alias("w"))
        return names, [*found, materialize(numbered, "meta", tidy=True)]

    def order_helpers(self) -> DataFrame:
        """order key, customer key, customer, first and second (nested) helper name, has_second, ord. Helpers come
        after all customers."""
        module = self.customers().select(F.col("key").alias("ck"), "module", F.col("id").alias("customer"))
        per = self.sold().groupBy("o_orderkey", "o_custkey").agg(F.max(F.col("l_linenumber") > 4).alias("has_second"), F.max(F.col("l_linenumber") <= 4).alias("has_first"))
        k = F.col("o_orderkey").cast("string")
        return per.join(module, F.col("o_custkey") == F.col("ck")).select(
            "o_orderkey", "o_custkey", "customer",
            F.concat("module", F.lit(".with-"), k, F.lit(" "), k).alias("first"),
            F.concat("module", F.lit(".with-"), k, F.lit(" 2"), k).alias("second"),
            "has_second", "has_first", (F.col("o_orderkey") + 10**12).alias("ord"),
        )

    def helper_edges(self) -> DataFrame:
        """src, dst, edge_type, w of the library with helpers: customer -> order helper -> parts of lines 1 to 4 and a
        nested helper with the parts of the other lines."""
        h = self.order_helpers()
        to_first = h.select(F.col("customer").alias("src"), F.col("first").alias("dst"), F.lit(BODY + TO_WITH).alias("edge_type"), F.lit(1).cast("bigint").alias("w"))
        to_second = h.where("has_second").select(F.col("first").alias("src"), F.col("second").alias("dst"), F.lit(BODY + TO_WITH).alias("edge_type"), F.lit(1).cast("bigint").alias("w"))
        nested = F.col("l_linenumber") > 4
        counted = self.sold().groupBy("o_orderkey", "l_partkey", nested.alias("nested")).agg(F.count("*").alias("w"))
        uses = self.named(counted.join(h.select("o_orderkey", "first", "second"), "o_orderkey"), "l_partkey", self.parts(), "dst")
        uses = uses.select(F.when(F.col("nested"), F.col("second")).otherwise(F.col("first")).alias("src"), "dst", F.lit(BODY).alias("edge_type"), "w")
        return to_first.unionAll(to_second).unionAll(uses)

    def helper_order(self) -> DataFrame:
        """Processing order of definitions with helpers: id, ord."""
        h = self.order_helpers()
        own = self.customers().select("id", F.col("key").alias("ord"))
        return own.unionAll(h.select(F.col("first").alias("id"), "ord")).unionAll(h.where("has_second").select(F.col("second").alias("id"), (F.col("ord") + 10**12).alias("ord")))

    def rewrite_edges(self) -> DataFrame:
        """Orders of status F as rewrite helpers between customer and parts."""
        module = self.customers().select(F.col("key").alias("ck"), "module", F.col("id").alias("customer"))
        k = F.col("o_orderkey").cast("string")
        lines = self.sold().where("o_orderstatus = 'F'").join(module, F.col("o_custkey") == F.col("ck")).withColumn("helper", F.concat("module", F.lit(".-rewrite"), k, F.lit(" "), k))
        first = lines.select(F.col("customer").alias("src"), F.col("helper").alias("dst")).distinct().select("src", "dst", F.lit(BODY + TO_REWRITE).alias("edge_type"), F.lit(1).cast("bigint").alias("w"))
        uses = self.named(lines.groupBy("helper", "l_partkey").agg(F.count("*").alias("w")), "l_partkey", self.parts(), "dst").select(F.col("helper").alias("src"), "dst", F.lit(BODY).alias("edge_type"), "w")
        return first.unionAll(uses)

    def entries(self) -> DataFrame:
        """entry, text: one s-expression per order with lines: its name, its customer as type, its parts as body."""
        named = lambda tag, c: F.concat(F.lit('(:name "' + tag + ' '), F.col(c).cast("string"), F.lit('")'))
        item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        lines = self.table("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        parts = F.array_join(F.transform("items", lambda i: F.concat(F.lit('(:name "part '), i["l_partkey"].cast("string"), F.lit('")'))), " ")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("entry"),
            F.concat(F.lit("(:entry "), named("order", "o_orderkey"), F.lit(" (:type "), named("cust", "o_custkey"), F.lit(") (:function (:apply "), parts, F.lit(")))")).alias("text"),
        )

    def documents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), "text")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


__all__ = ["Library", "BODY", "CONTAINS", "DEFINES", "TYPE"]
