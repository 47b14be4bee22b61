"""Reports, dumps and artefact names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artefact(base: str, library: str, kind: str, **parameters) -> str:
    """The place of an artefact of a library."""
    from theoremill.functions.names import parameter_key

    key = parameter_key(**parameters)
    return f"{base}/{library}/{kind}{'@' + key if key else ''}"


def write_definition_texts(texts: DataFrame, path: str) -> None:
    """Definition texts (module, text), a folder per module; rewriting a path replaces it."""
    texts.select("module", F.col("text").alias("value")).write.mode("overwrite").partitionBy("module").text(path)


def graph_lines(nodes: DataFrame, edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Lines `N;id;label;degree` by falling degree, then `E;src;dst;type;w`; columns part, degree, value for the
    order (part 0 before 1)."""
    n = nodes.join(degrees, "id", "left").select(F.lit(0).alias("part"), F.coalesce("degree", F.lit(0.0)).alias("degree"), F.concat_ws(";", F.lit("N"), "id", "label", F.coalesce("degree", F.lit(0.0)).cast("string")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.lit(0.0).alias("degree"), F.concat_ws(";", F.lit("E"), "src", "dst", "edge_type", F.coalesce(F.col("w").cast("string"), F.lit(""))).alias("value"))
    return n.unionAll(e)


def write_graph_text(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, path: str) -> None:
    graph_lines(nodes, edges, degrees).orderBy("part", F.desc("degree"), "value").select("value").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_report(metrics: DataFrame, predictions: DataFrame, edge_scores: DataFrame, path: str) -> None:
    """Three tables of an experiment."""
    for name, df in (("metrics", metrics), ("predictions", predictions), ("edge_scores", edge_scores)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_meta(spark, path: str, model: str, arguments: dict, fit_arguments: dict, was_learned: bool, seconds: float) -> None:
    """One row on an experiment."""
    from theoremill.functions.names import parameter_key

    row = [(model, parameter_key(**arguments), parameter_key(**fit_arguments), was_learned, float(seconds))]
    spark.createDataFrame(row, "model string, arguments string, fit_arguments string, was_learned boolean, seconds double").coalesce(1).write.mode("overwrite").parquet(path)
