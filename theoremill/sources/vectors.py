"""Word vectors, vocabularies, translations, false positives: text formats in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word, vec; the header line `N D` (two numbers only) is skipped; a row whose size differs from the header's D
    is an error."""
    lines = spark.read.text(path).where("length(value) > 0")
    header = lines.where(F.col("value").rlike(r"^\d+ \d+$")).select(F.split("value", " ")[1].cast("int").alias("d")).limit(1)
    parts = F.split(F.rtrim("value"), " ")
    rows = lines.where(~F.col("value").rlike(r"^\d+ \d+$")).select(parts[0].alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<double>").alias("vec"))
    checked = rows.crossJoin(F.broadcast(header))  # one row
    return checked.where(F.assert_true(F.size("vec") == F.col("d"), F.concat(F.lit("wrong size: "), F.col("word"))).isNull()).drop("d")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Header and one line per word."""
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
    head = shape.select(F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("value"))
    rows = vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    head.unionAll(rows).write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """The first field of each line; an empty word is an error."""
    word = F.substring_index("value", separator, 1)
    return spark.read.text(path).select(word.alias("word")).where(F.assert_true(F.length("word") > 0, F.lit("empty word")).isNull())


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Word, cnt from TAB separated lines after the header; a plain word counts 1."""
    c = F.split("value", "\t")
    return spark.read.text(path).where("length(value) > 0 and value <> 'WORD\tCOUNT'").select(F.get(c, F.lit(0)).alias("word"), F.coalesce(F.try_element_at(c, F.lit(2)).cast("bigint"), F.lit(1)).alias("cnt"))


def write_vocabulary(counts: DataFrame, path: str, forbidden: DataFrame | None = None) -> None:
    """Words by falling count, forbidden ones left out."""
    kept = counts.join(forbidden.select("word"), "word", "left_anti") if forbidden is not None else counts
    ordered = kept.orderBy(F.desc("cnt"), "word").select(F.concat_ws("\t", "word", F.col("cnt").cast("string")).alias("value"))
    ordered.sparkSession.createDataFrame([("WORD\tCOUNT",)], "value string").unionAll(ordered).write.mode("overwrite").text(path)


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Word, pos, part, weight from `word;count;cum;part...[;weight...]`. There are weights if the last field is a
    number strictly between 0 and 1, else all are equal."""
    c = F.transform(F.split("value", ";"), lambda x: F.trim(x))
    rows = spark.read.text(path).where("length(value) > 0").select(F.get(c, F.lit(0)).alias("word"), F.filter(F.slice(c, F.lit(4), F.greatest(F.size(c) - 3, F.lit(0))), lambda x: x != "").alias("rest"))
    last = F.try_element_at("rest", F.lit(-1)).try_cast("double")
    weighted = F.coalesce((last > 0) & (last < 1), F.lit(False))
    n = F.when(weighted, F.floor(F.size("rest") / 2)).otherwise(F.size("rest")).cast("int")
    parts = F.slice("rest", F.lit(1), n)
    weights = F.when(weighted, F.slice("rest", n + 1, n).cast("array<double>")).otherwise(F.transform(parts, lambda _: F.lit(1.0) / n))
    return rows.where("size(rest) > 0").select("word", F.posexplode(F.arrays_zip(parts.alias("part"), weights.alias("weight"))).alias("pos", "z")).select("word", "pos", F.col("z.part").alias("part"), F.col("z.weight").alias("weight"))


def read_false_positives(spark: SparkSession, path: str) -> DataFrame:
    """Node, candidate, score from blocks `NODE;id` and `score;id` parted by blank lines; a last block without a
    blank line counts as well."""
    block = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("block"))
    rows = block.select(F.filter(F.split("block", "\n"), lambda x: x != "").alias("lines")).where("size(lines) > 0")
    name = F.substring_index(F.col("lines")[0], ";", -1)
    return rows.select(name.alias("node"), F.explode(F.slice("lines", 2, 1_000_000)).alias("line")).select("node", F.substring_index("line", ";", -1).alias("candidate"), F.substring_index("line", ";", 1).cast("double").alias("score"))


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word, vec from binary word-vector files (`N D`, then word, blank, D little-endian floats)."""
    from theoremill.sources.sexp import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for blob in batch.column(0):
                data = blob.as_py()
                at = data.index(b"\n")
                n, d = map(int, data[:at].split())
                at += 1
                for _ in range(n):
                    end = data.index(b" ", at)
                    word = data[at:end].lstrip(b"\n").decode()
                    vec = np.frombuffer(data, "<f4", d, end + 1).astype(float)
                    at = end + 1 + 4 * d
                    yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([vec.tolist()], pa.list_(pa.float64()))], names=["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, vec array<double>")


def vector_vocabulary(spark: SparkSession, path: str, tolerated: int = 10) -> DataFrame:
    """Words of a text vector file: what stands before a blank or TAB and a number; more than `tolerated` lines of
    another form are an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+$") & (F.length("value") > 0))
    word = F.regexp_extract("value", r"^(\S+)[ \t]-?\d", 1)
    bad = lines.where(word == "").limit(tolerated + 1).count()
    if bad > tolerated:
        raise ValueError("this is no vector file")
    return lines.select(word.alias("word")).where("word <> ''")
