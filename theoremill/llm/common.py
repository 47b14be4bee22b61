"""Helpers shared by the text operators: tables, held-out rows, bounded samples."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from theoremill.plans.scratch import materialize, scratch_dir  # noqa: F401

#: Rows of one Arrow batch handed to Python. Texts are long, so batches are kept short to bound worker memory.
ARROW_ROWS = 1000
#: Rows of one batch that the Parquet reader decodes (Spark's default, 4096 texts, is tens of MB at once in each task).
READ_ROWS = 256
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package, and bound the rows of an Arrow batch (texts have any length).

    On a cluster whose workers don't share the driver's file system, pass the package with --py-files.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    # Matrices are small and tasks many: threads inside numpy would only spin.
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_short(spark: SparkSession) -> None:
    """Bound the rows that the Parquet reader decodes at once, for scans of texts; results don't depend on it."""
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def with_row(stored: DataFrame, name: str) -> DataFrame:
    """A table read from Parquet files with a long that tells its rows apart, repeated ones too: a 64-bit hash of the
    row's file and its place there, the same in every scan."""
    return stored.withColumn(name, F.xxhash64("_metadata.file_name", "_metadata.row_index"))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def held_out(doc_id: Column, divisor: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == rest, F.lit(False))


#: Parts of a long text that stand for it in training.
PIECES = 16


def bounded_text(text: Column, doc_id: Column, max_chars: int) -> Column:
    """The text, or, if it has more than max_chars characters, PIECES parts of it from keyed places all over it, each on
    lines of its own: max_chars characters at most. For training only."""
    each = max_chars // PIECES - 1
    start = lambda i: F.pmod(F.xxhash64(doc_id, i), F.length(text) - each + 1).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substring(text, start(i), F.lit(each)))
    return F.when(F.length(text) > max_chars, F.array_join(parts, "\n")).otherwise(text)


def lowest(df: DataFrame, key: str, n: int, salt: int = 0) -> DataFrame:
    """The rows of the n keys with the lowest keyed hash, one row per key: a deterministic sample of bounded size,
    whatever rows repeat. df has the key and columns that follow from it; null keys are left out.

    Where there are many more keys, a bound on the hash lets about 4 n of them into the top-n, so that it is the same
    small step at any size. Keys are counted by a sketch of fixed size (2 % error); should the bound have let too few
    through all the same, it is dropped.
    """
    h = F.xxhash64(F.col(key), F.lit(salt))
    known = df.where(F.col(key).isNotNull())
    about = known.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    if about > 8 * n:
        some = known.where(h < -(2**63) + 2**64 * 4 * n // about)
        if some.select(key).distinct().limit(n).count() == n:
            known = some
    return known.dropDuplicates([key]).orderBy(h, F.col(key)).limit(n)


def lowest_keys(df: DataFrame, key: str, n: int, salt: int = 0) -> list:
    """The keys that `lowest` takes, in the order of their hash. They are gathered as one set, of about 8 n keys at most:
    grouping, sorting and exchanging by key take memory pages of tens of MB in every task, however few its rows are."""
    h = F.xxhash64(F.col(key), F.lit(salt))
    known = df.where(F.col(key).isNotNull()).select(key)
    about = known.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    some = known.where(h < -(2**63) + 2**64 * 4 * n // about) if about > 8 * n else known
    found = some.agg(F.collect_set(F.struct(h.alias("hash"), F.col(key).alias("key")))).first()[0]
    if about > 8 * n and len(found) < n:  # the bound has let too few through
        return [r[0] for r in lowest(known, key, n, salt).collect()]
    return [k for _, k in sorted(map(tuple, found))[:n]]


def lowest_by(df: DataFrame, key: str, group: str, n: int, salt: int = 0) -> list[tuple]:
    """(key, group) of the n keys with the lowest keyed hash of each group: `lowest` for all groups at once, in two scans.
    For columns with few groups: at most n x groups rows reach the driver. Nulls are left out."""
    h = F.xxhash64(F.col(key), F.lit(salt))
    known = df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(key, group)
    about = {r[0]: r[1] for r in known.groupBy(group).agg(F.approx_count_distinct(key, 0.02)).collect()}
    large = {g: -(2**63) + 2**64 * 4 * n // k for g, k in about.items() if k > 8 * n}
    bound = F.lit(2**63 - 1)
    for g, b in large.items():
        bound = F.when(F.col(group) == g, b).otherwise(bound)
    place = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    for some in (known.where(h < bound) if large else known, known):
        rows = some.distinct().withColumn("place", place).where(F.col("place") <= n).collect()
        if all(sum(r[group] == g for r in rows) == n for g in large):
            break
    return sorted((r[key], r[group]) for r in rows)


def _texts_of(docs: DataFrame, chosen: DataFrame, max_chars: int) -> DataFrame:
    """One text (the least, if rows repeat an id) per chosen id, of max_chars characters at most."""
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", bounded_text(F.col("text").cast("string"), F.col("doc_id"), max_chars).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, divisor: int, rest: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class ids per label value 0 and 1, never of held-out rows: a bounded sample.

    Ids are chosen by keyed hash among labels whose id is not held out; an id with both labels has label 1. One text
    per id is fetched, of max_chars characters at most (see bounded_text; scoring reads whole texts).
    """
    fair = labels.where(F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), divisor) != rest)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = lowest(fair.where("y = 0"), "doc_id", per_class).unionAll(lowest(fair.where("y = 1"), "doc_id", per_class))
    label_of = {r["doc_id"]: r["y"] for r in chosen.collect()}  # at most 2 x per_class ids
    return [(r["text"], label_of[r["doc_id"]]) for r in sorted(_texts_of(docs, chosen.select("doc_id"), max_chars).collect())]


def texts_by_id(docs: DataFrame, ids: list, max_chars: int) -> dict:
    """The text of each of the ids that has one, as in _texts_of. Only where ids repeat are the rows grouped by id in the
    cluster; else no more rows than ids are fetched as they are, without a sort in every task."""
    import pyarrow as pa

    if not ids:
        return {}
    schema = docs.select("doc_id").schema
    chosen = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids)}), schema)
    of = docs.join(F.broadcast(chosen), "doc_id", "left_semi")
    if of.count() > len(ids):
        return dict(map(tuple, _texts_of(docs, chosen, max_chars).collect()))
    text: dict = {}
    for k, t in of.where(F.col("text").isNotNull()).select("doc_id", bounded_text(F.col("text").cast("string"), F.col("doc_id"), max_chars)).collect():
        text[k] = min(t, text.get(k, t))
    return text


def text_sample(docs: DataFrame, n: int, divisor: int, rest: int, max_chars: int, salt: int = 1) -> list[str]:
    """At most n texts, one per id, by keyed hash, never of held-out rows, of max_chars characters at most."""
    ids = lowest_keys(docs.where(remainder(F.col("doc_id"), divisor) != rest), "doc_id", n, salt)
    return [t for _, t in sorted(texts_by_id(docs, ids, max_chars).items())]


def with_scores(docs: DataFrame, scorer, between, name: str = "score") -> DataFrame:
    """All columns of docs and the score (double) of every whole text; scorer maps the words of many texts to one number
    each. A column of that name is overwritten."""
    import pyarrow as pa

    from theoremill.llm.textbytes import chunks

    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", name)]
    chosen = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for a, z, words in chunks(batch.column(batch.num_columns - 1), between):
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(words), pa.float64())], names=[*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.mapInArrow(run, f"{schema}, `{name}` double").select(*(f"`{c}`" for c in docs.columns if c != name), name)


def score_texts(docs: DataFrame, scorer, between) -> DataFrame:
    """doc_id and score of every whole text."""
    import pyarrow as pa

    from theoremill.llm.textbytes import chunks

    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, z, words in chunks(batch.column(1), between):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(scorer(words), pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
