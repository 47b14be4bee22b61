"""The lightweight library format: `.dag` entry files and `network.csv`, read and written."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "NODE ID\tNODE TYPE\tNODE DESCRIPTION\tCHILDREN IDS"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """S3: whole `.dag` files, linter files left out."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dag").text(path, wholetext=True)
    return read.where(~F.col("_metadata.file_name").contains("scripts.runLinter")).select(F.col("_metadata.file_name").alias("file"), "value")


def read_dag(spark: SparkSession, path: str) -> DataFrame:
    """One row per node: file, pos, node_id, node_type, description, child_ids, root (the first row)."""
    lines = _files(spark, path).select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("pos > 0 and length(line) > 0")
    c = F.split("line", "\t")
    return lines.select("file", "pos", F.get(c, F.lit(0)).cast("bigint").alias("node_id"), F.get(c, F.lit(1)).alias("node_type"), F.get(c, F.lit(2)).alias("description"), F.array_distinct(F.from_json(F.get(c, F.lit(3)), "array<bigint>")).alias("child_ids"), (F.col("pos") == 1).alias("root"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """File, parent_id, child_id, child_pos; a child listed twice counts once."""
    return nodes.select("file", F.col("node_id").alias("parent_id"), F.posexplode("child_ids").alias("child_pos", "child_id"))


def essential(nodes: DataFrame) -> DataFrame:
    """Root, its children and the names, each name hung once below the root child that reaches it first: file,
    node_id, node_type, description, section (position of the root child). The last root child is explored first, so
    of several sections the largest position wins; those shared below differ only in order."""
    from theoremill.operators.graph import reachable

    key = lambda c: F.struct("file", F.col(c))
    edges = edges_of(nodes)
    roots = nodes.where("root").select("file", F.posexplode("child_ids").alias("section", "node_id"))
    links = edges.select(key("parent_id").alias("src"), key("child_id").alias("dst")).select(F.col("src").cast("struct<file:string,id:bigint>").alias("src"), F.col("dst").cast("struct<file:string,id:bigint>").alias("dst"))
    start = roots.select(F.struct("file", "section").cast("struct<file:string,id:bigint>").alias("origin"), key("node_id").cast("struct<file:string,id:bigint>").alias("node"))
    reached = reachable(links, start).groupBy(F.col("node.file").alias("file"), F.col("node.id").alias("node_id")).agg(F.max("origin.id").cast("int").alias("section"))
    own = roots.select("file", "node_id", "section").withColumnRenamed("section", "own")
    found = nodes.select("file", "node_id", "node_type", "description", "root").join(reached, ["file", "node_id"], "left").join(own, ["file", "node_id"], "left")
    return found.where("root or own is not null or node_type = ':name'").select("file", "node_id", "node_type", "description", F.coalesce("own", "section").alias("section"))


def write_dag(nodes: DataFrame, path: str) -> None:
    """One folder of `.dag` text per entry (partition column entry), header first; rewriting a path replaces it.

    nodes: entry, pos, node_id, node_type, description, child_ids. The rows of an entry make one file, so they are
    joined to one text."""
    row = F.concat_ws("\t", F.col("node_id").cast("string"), "node_type", "description", F.concat(F.lit("["), F.array_join(F.transform("child_ids", lambda c: c.cast("string")), ", "), F.lit("]")))
    text = nodes.select("entry", F.struct("pos", row.alias("line")).alias("r")).groupBy("entry").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    out = text.select("entry", F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("value"))
    out.write.mode("overwrite").partitionBy("entry").option("lineSep", "\n").text(path)


def read_dag_text(spark: SparkSession, path: str) -> DataFrame:
    """Read what write_dag wrote: entry and the node columns. Each entry's text begins with the header."""
    lines = spark.read.text(path, wholetext=True).select("entry", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("pos > 0 and length(line) > 0")
    c = F.split("line", "\t")
    return lines.select(F.col("entry").cast("string").alias("entry"), "pos", F.get(c, F.lit(0)).cast("bigint").alias("node_id"), F.get(c, F.lit(1)).alias("node_type"), F.get(c, F.lit(2)).alias("description"), F.from_json(F.get(c, F.lit(3)), "array<bigint>").alias("child_ids"))


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, properties), (links: src, dst, edge_type, properties)."""
    c = F.split("value", "\t")
    lines = spark.read.text(path).where("length(value) > 0")
    prop = lambda i: F.from_json(F.trim(F.get(c, F.lit(i))), "map<string,string>")
    nodes = lines.where(F.col("value").startswith("node")).select(F.trim(F.get(c, F.lit(1))).alias("id"), prop(2).alias("properties"))
    links = lines.where(~F.col("value").startswith("node")).select(F.trim(F.get(c, F.lit(1))).alias("src"), F.trim(F.get(c, F.lit(2))).alias("dst"), F.trim(F.get(c, F.lit(3))).alias("edge_type"), prop(4).alias("properties"))
    return nodes, links


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Rows of the network format; nodes: id, label; edges: src, dst, edge_type, w (null: no properties)."""
    n = nodes.select(F.concat(F.lit("node\t"), "id", F.lit("\t{'label': '"), "label", F.lit("'}")).alias("value"))
    p = F.when(F.col("w").isNull(), "{}").otherwise(F.concat(F.lit("{'w': "), F.col("w").cast("string"), F.lit("}")))
    e = edges.select(F.concat_ws("\t", F.lit("link"), "src", "dst", "edge_type", p).alias("value"))
    n.unionAll(e).write.mode("overwrite").text(path)


def unzip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the `.dag` members of zip files, folders dropped from their names."""
    from theoremill.sources.sexp import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(blob.as_py())) as z:
                    for name in z.namelist():
                        if name.endswith(".dag"):
                            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([z.read(name).decode()])], names=["file", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "file string, value string")


def load_library(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dag nodes, network nodes, network links); inputs that are missing give empty tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))
    dag = "file string, pos int, node_id bigint, node_type string, description string, child_ids array<bigint>, root boolean"
    nodes = spark.createDataFrame([], dag)
    if there(f"{directory}/entries"):
        nodes = read_dag(spark, f"{directory}/entries")
    elif there(f"{directory}/entries.zip"):
        lines = unzip_entries(spark, f"{directory}/entries.zip").select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("pos > 0 and length(line) > 0")
        c = F.split("line", "\t")
        nodes = lines.select("file", "pos", F.get(c, F.lit(0)).cast("bigint").alias("node_id"), F.get(c, F.lit(1)).alias("node_type"), F.get(c, F.lit(2)).alias("description"), F.array_distinct(F.from_json(F.get(c, F.lit(3)), "array<bigint>")).alias("child_ids"), (F.col("pos") == 1).alias("root"))
    if there(f"{directory}/network.csv"):
        return nodes, *read_network(spark, f"{directory}/network.csv")
    return nodes, spark.createDataFrame([], "id string, properties map<string,string>"), spark.createDataFrame([], "src string, dst string, edge_type string, properties map<string,string>")
