"""S-expressions as rows: parsing, entry splitting, and the file sources for them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Known tags: shared ones, Agda's, Lean's, synthetic ones.
TAGS = frozenset(
    ":abstract :apply :axiom :constructor :data :entry :function :lambda :level :literal :max :meta :module :module-name :name :pi :proj :sort :type :var "
    ":anonymous :arg :arg-name :arg-noname :body :bound :case-split :clause :constr :data-or-record :def :dot :generalizable-var :hidden :inserted :instance :internal :interval-apply :interval-arg :irrelevant :no-body :no-type :not-hidden :pattern :pattern-var :plus :primitive :record :reflected :sort-def :sort-dummy :sort-fun :sort-interval :sort-lock :sort-meta :sort-pi :sort-prop :sort-set :sort-set-omega :sort-size :sort-sset :sort-univ :substitution :telescope :user-written "
    ":const :ctor :default :fvar :imax :implicit :ind :inst-implicit :let :lift :lsucc :lzero :node :quot-info :recursor :ref :references :strict-implicit :theorem "
    ":library :module-like :external :external-module :external-library".split()
)
_TOKEN = re.compile(r'[()]|"(?:\\.|[^"\\])*"|[^()"]+', re.S)
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NODE_FIELDS = "node_id long, parent_id long, child_pos int, node_type string, description string, level int"
_NODE_NAMES = [f.strip().split(" ")[0] for f in NODE_FIELDS.split(",")]


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where they share the driver's file system; elsewhere use --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)


def head(text: str) -> tuple[str, str]:
    """(tag, description) of what stands before a node's first child; further tags are dropped."""
    tags, rest = [], text.strip()
    while rest:
        first = rest.split(" ", 1)[0]
        if first not in TAGS:
            break
        tags.append(first)
        rest = rest[len(first) :].strip()
    if not tags:
        raise ValueError(f"no known tag in {text[:80]!r}")
    return tags[0], rest


def parse(text: str) -> list[tuple[int, int | None, int, str, str, int]]:
    """(node_id, parent_id, child_pos, node_type, description, level) in order of their opening; strings may hold
    parentheses and escaped quotes; text after the last child is ignored."""
    nodes: list[list] = []
    heads: list[list[str]] = []
    open_nodes: list[int] = []
    children: list[int] = []
    done = False
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == "(":
            if done:
                raise ValueError("more than one expression")
            parent = open_nodes[-1] if open_nodes else None
            nodes.append([len(nodes), parent, children[parent] if parent is not None else 0, "", "", len(open_nodes) + 1])
            if parent is not None:
                children[parent] += 1
            open_nodes.append(len(nodes) - 1)
            children.append(0)
            heads.append([])
        elif token == ")":
            if not open_nodes:
                raise ValueError("unbalanced")
            at = open_nodes.pop()
            nodes[at][3], nodes[at][4] = head("".join(heads[at]))
            done = not open_nodes
        elif open_nodes and not children[open_nodes[-1]]:
            heads[open_nodes[-1]].append(token)
    if open_nodes or not nodes:
        raise ValueError("unbalanced")
    return [tuple(n) for n in nodes]


def split_entries(text: str) -> list[str]:
    """Each `(:entry ...)` with the module part before it, as a document of its own."""
    depth, entries, begin, prefix_end = 0, [], -1, None
    start_depth = 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == "(":
            following = text[m.end() : m.end() + 12]
            if prefix_end is None and not re.match(r":module-name|:module|:name", following):
                prefix_end = m.start()
            if begin < 0 and following.startswith(":entry"):
                begin, start_depth = m.start(), depth
            depth += 1
        elif token == ")":
            depth -= 1
            if begin >= 0 and depth == start_depth:
                entries.append(text[begin : m.end()])
                begin = -1
    if depth:
        raise ValueError("unbalanced")
    prefix = text[: prefix_end or 0].strip()
    return [f"{prefix} {e})" if prefix else e for e in entries]


def parse_nodes(entries: DataFrame, entry: str = "entry", text: str = "text") -> DataFrame:
    """One row per node: entry and the node's fields. A text that can't be parsed fails the job with its entry."""
    ship(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                at, rows = [], []
                for i in range(a, min(a + 256, batch.num_rows)):
                    try:
                        found = parse(batch.column(1)[i].as_py() or "")
                    except ValueError as e:
                        raise ValueError(f"entry {batch.column(0)[i].as_py()}: {e}") from e
                    at += [i] * len(found)
                    rows += found
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["entry", *_NODE_NAMES])

    return entries.select(F.col(entry).cast("string").alias("entry"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"entry string, {NODE_FIELDS}")


def explode_entries(files: DataFrame, text: str = "text") -> DataFrame:
    """(source, ord, text) of every entry in every file; files: source and the text column."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = split_entries(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["source", "ord", "text"])

    return files.select(F.col("source").cast("string"), F.col(text).cast("string").alias("text")).mapInArrow(run, "source string, ord long, text string")


def read_sexp(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of all `*sexp` files below a path; lines are stripped and joined without a separator."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*sexp").text(path, wholetext=True)
    lines = F.transform(F.split("value", "\n"), lambda line: F.trim(line))
    return files.select(F.col("_metadata.file_path").alias("source"), F.array_join(lines, "").alias("text"))


def internal_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files (source, module) whose module has a source file in the listing (column module) are internal."""
    listed = sources.select("module").distinct().withColumn("listed", F.lit(True))
    return files.join(listed, "module", "left").withColumn("is_internal", F.coalesce("listed", F.lit(False))).drop("listed")
