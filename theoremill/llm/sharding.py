"""Histogram sort: balanced, globally ordered shards with a single exchange of the data.

Candidate boundaries (probes) are broadcast, every partition counts the exact bytes and rows between them, and the
sums say between which two probes each wanted boundary lies. Only that gap is probed again, so a round multiplies the
resolution by the number of probes, until every splitter is within tolerance (or the gap holds one key only). Then
rows move once. Nothing that grows with the rows reaches the driver: a round returns one line per probe.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from theoremill.llm.common import materialize, prepare, with_row

#: 8 bytes of order (equal texts agree), 8 of the id, 8 that tell repeated rows apart.
KEY_BYTES = 24
#: Rows that one task sorts at most, about; more rows make more (not larger) sort tasks.
ROWS_PER_RANGE = 500_000
#: Probes of one round over all splitters.
PROBES = 4096


@dataclass
class Splitter:
    key: int
    bytes_below: int
    rows_below: int


def text_order_key(text: Column, doc_id: Column) -> Column:
    """16 bytes, unsigned big-endian: hash of the text, then the id. Equal texts are neighbours; ids break the tie, and
    `histogram_sort` tells rows with equal keys apart, so a group of copies of any size can be cut."""
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    i = F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))
    return F.unhex(F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(i), 16, "0")))


def _as_bytes(keys: list[int]) -> np.ndarray:
    raw = b"".join(k.to_bytes(KEY_BYTES, "big") for k in keys)
    return np.frombuffer(raw, dtype=f"S{KEY_BYTES}")


def _keys(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary())
    flat = column.buffers()[2]
    if flat is None or len(column) == 0:
        return np.zeros(0, dtype=f"S{KEY_BYTES}")
    first = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(flat, dtype=f"S{KEY_BYTES}", count=len(column), offset=first)


def _count_between(probes: np.ndarray):
    n = len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low: list[bytes | None] = [None] * n
        high: list[bytes | None] = [None] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch.column(0))
            weight = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            running = np.concatenate([[0], np.cumsum(weight[order])])
            cut = np.concatenate([[0], np.searchsorted(keys, probes, "left"), [len(keys)]])
            size += running[cut[1:]] - running[cut[:-1]]
            rows += np.diff(cut)
            for b in np.flatnonzero(np.diff(cut)):
                a, z = keys[cut[b]].ljust(KEY_BYTES, b"\0"), keys[cut[b + 1] - 1].ljust(KEY_BYTES, b"\0")
                low[b] = a if low[b] is None else min(low[b], a)
                high[b] = z if high[b] is None else max(high[b], z)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(size[full]), pa.array(rows[full]), pa.array([low[b] for b in full], pa.binary()), pa.array([high[b] for b in full], pa.binary())],
            names=["bin", "bytes", "n", "low", "high"],
        )

    return count


def histogram(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bin, bytes, rows, lowest key, highest key) of each non-empty gap between sorted probes: exact counts."""
    found = (
        keyed.select("__key", "__size")
        .mapInArrow(_count_between(_as_bytes(probes)), "bin int, bytes long, n long, low binary, high binary")
        .groupBy("bin")
        .agg(F.sum("bytes"), F.sum("n"), F.min("low"), F.max("high"))
        .orderBy("bin")
        .collect()
    )
    return [(r[0], r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in found]


def find_splitters(keyed: DataFrame, n_ranges: int, tolerance: float) -> tuple[list[Splitter], int, int]:
    """n_ranges - 1 splitters (rows with a key below one lie left of it), total bytes, total rows.

    keyed: __key (binary(KEY_BYTES)) and __size (long), neither null. Rows with equal keys are not parted: their
    splitter lies before or behind all of them. An empty table gives splitters at 0.
    """
    gaps: dict[tuple[int, int], None] = {(0, 2 ** (8 * KEY_BYTES) - 1): None}
    open_targets = list(range(1, n_ranges))
    found: dict[int, Splitter] = {}
    total = rows = 0
    while True:
        each = max(3, PROBES // len(gaps))
        probes = sorted({p for a, z in gaps for p in ({a, *range(a + 1, z + 2)} if z - a <= each else {a, *(a + (z - a) * i // each for i in range(1, each)), z + 1})})
        probes = [p for p in probes if p < 2 ** (8 * KEY_BYTES)]
        bins = histogram(keyed, probes)
        total, rows = sum(b[1] for b in bins), sum(b[2] for b in bins)
        near = max(1, int(tolerance * total / n_ranges))
        left, gaps = [], {}
        k = done = done_rows = 0
        for t in open_targets:
            want = total * t // n_ranges
            while k < len(bins) and done + bins[k][1] < want:
                done, done_rows, k = done + bins[k][1], done_rows + bins[k][2], k + 1
            if k == len(bins):
                found[t] = Splitter(bins[-1][4] + 1 if bins else 0, done, done_rows)
                continue
            _, size, n, low, high = bins[k]
            before, after = want - done, done + size - want
            if min(before, after) <= near or low == high:
                found[t] = Splitter(low, done, done_rows) if before <= after else Splitter(high + 1, done + size, done_rows + n)
            else:
                left.append(t)
                gaps[low, high] = None
        open_targets = left
        if not open_targets:
            return [found[t] for t in range(1, n_ranges)], total, rows


def _range_of(splitters: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(splitters, _keys(batch.column("__key")), "right") if len(splitters) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "__part"])

    return assign


def histogram_sort(keyed: DataFrame, n_shards: int, tolerance: float = 0.001, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Sort rows into n_shards shards of near-equal bytes.

    keyed: columns key (binary(16), not null) and size (long, not null, 1 or more), and any others, which are carried
    along but for `shard` and `slot`, which are overwritten. Adds shard (int) and slot (long: position in key order
    within the shard, gapless from 0). Shards differ from the ideal size by the tolerance (a share of it) plus one row
    at most, whatever the keys: rows with equal keys, repeated ones too, follow their place in the written table, and
    may be cut. An empty table gives an empty result.
    """
    spark = keyed.sparkSession
    prepare(spark)
    own = [c for c in keyed.columns if c not in ("shard", "slot")]
    stored = with_row(materialize(keyed.select(*(f"`{c}`" for c in own)), "histogram-sort"), "__row")
    tie = F.unhex(F.lpad(F.hex("__row"), 16, "0"))
    rows = stored.select(*(f"`{c}`" for c in own), F.concat("key", tie).alias("__key"), F.col("size").alias("__size"))
    n = stored.count()
    if not n:
        return stored.select(*(f"`{c}`" for c in own if c != "key"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shards, _, _ = find_splitters(rows, n_shards, tolerance)
    # Sort tasks are bounded by rows, not bytes: a third of all texts may be null. The two sets of splitters are merged.
    tasks, _, _ = find_splitters(rows.withColumn("__size", F.lit(1).cast("long")), max(2 * n_shards, -(-n // rows_per_range)), 0.1)
    starts = {s.key: s.rows_below for s in (Splitter(0, 0, 0), *shards, *tasks)}
    keys = sorted(starts)
    shard_of = [sum(s.key <= k for s in shards) for k in keys]
    shard_start = [0, *(s.rows_below for s in shards)]
    base = [(p, d, starts[k] - shard_start[d]) for p, (k, d) in enumerate(zip(keys, shard_of, strict=True))]
    first = spark.createDataFrame(base, "__part int, __shard int, __base long")
    high = [k for k in keys[1:] if k < 2 ** (8 * KEY_BYTES)]
    carried = rows.drop("__size", "key")
    dealt = carried.mapInArrow(_range_of(_as_bytes(high)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema) + ", __part int")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__key")).cast("long")
    found = dealt.withColumn("__rank", rank).join(F.broadcast(first), "__part")  # one line per sort range: bounded by rows / rows_per_range
    return found.select(*(f"`{c}`" for c in own if c != "key"), F.col("__shard").alias("shard"), (F.col("__rank") - 1 + F.col("__base")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.001) -> DataFrame:
    """Deal whole documents into shards by histogram sort over (text hash, id).

    Size of a document: UTF-8 bytes of its text (null: none) plus 8. Null texts and null ids are kept; other columns
    are not needed and dropped. Equal texts lie side by side.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_order_key(text, F.col("doc_id")).alias("key"),
    )
    return histogram_sort(keyed, n_shards, tolerance)
