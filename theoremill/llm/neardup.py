"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every whole text becomes its set of word shingles (64-bit hashes), a fingerprint of the set and a MinHash signature
   of `trees x depth` values. Texts with equal sets form a class; one row stands for it from here on.
2. Forest: for each tree the classes are sorted by that tree's part of the signature (one range-partitioned sort, so a
   hot run of signatures is spread over tasks). Rows that share a common prefix of at least `MIN_DEPTH` values form a
   region. Within a region, one byte per signature value estimates the similarity of all pairs, and only a spanning
   set of edges (linear in the rows) leaves it. Regions that the sort cuts in pieces are joined again: a large piece
   is taken as similar as a whole, which leaves its pairs to step 3.
3. Components of these edges are candidate groups. Their texts are fetched and searched breadth-first with exact set
   intersections, so the result is that of comparing all pairs. A group that is too large for one task is dealt in
   blocks, and each pair of blocks is searched so by a task of its own.
4. Components over confirmed links only.

Nothing is capped: regions and blocks only bound what one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import materialize, prepare
from theoremill.llm.textbytes import chunks, mix, shingle_sets
from theoremill.operators.components import connected_components

TREES, DEPTH, MIN_DEPTH = 12, 6, 2
VALUES = TREES * DEPTH
#: Rows of a piece of a region that are handed on one by one, and rows that a sort task holds before it cuts a region.
REGION_ROWS, HELD_ROWS = 256, 32_768
#: Shingles of a candidate group that one task searches.
BLOCK_SHINGLES = 300_000
#: Places of the bitmap that thins the texts before they are sent to their groups, whatever the number of members.
PLACE_BITS = 25
#: How many standard deviations below the threshold an estimate may lie and still be confirmed exactly.
SLACK = 6.0

_rng = np.random.default_rng(41)
_A = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, VALUES) uint32 minima of multiply-shift hashes; rows of empty sets are zero."""
    out = np.zeros((len(sets), VALUES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat(((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, words in chunks(batch.column(1)):
                sets = shingle_sets(words, size)
                sig = signatures(sets)
                wide = sig.astype(">u4").tobytes()
                prints = [b"" if not len(s) else int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(s ^ np.uint64(size)).sum(dtype=np.uint64)).to_bytes(8, "big") for s in sets]
                step = VALUES * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([wide[i * step : i * step + step] if len(sets[i]) else b"" for i in range(z - a)], pa.binary()), pa.array([sig[i].astype(np.uint8).tobytes() for i in range(z - a)], pa.binary())],
                    names=["doc_id", "n_shingles", "print", "signature", "sketch"],
                )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _search(ids: np.ndarray, sketch: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph of rows that agree in `least` values or more: breadth-first search, each step
    against all rows not reached yet, so no pair is left out and the edges are fewer than the rows."""
    rest, left = np.arange(1, len(ids)), np.ascontiguousarray(sketch[1:].T)
    queue = [0]
    while len(rest):
        q = queue.pop()
        hit = (left == sketch[q][:, None]).sum(0, dtype=np.uint8) >= least
        if hit.any():
            new = rest[hit]
            yield from ((int(ids[i]), int(ids[q])) for i in new)
            queue.extend(int(i) for i in new)
            rest, left = rest[~hit], left[:, ~hit]
        if not queue and len(rest):
            queue, rest, left = [int(rest[0])], rest[1:], left[:, 1:]


def _neighbours(least: int):
    """Rows sorted by (tree, key) -> edges (a, b) of each region. A region that may go on in another piece (another
    task, or rows beyond HELD_ROWS) also gives (a, null, part, piece): its rows, or one of them if all are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        piece = (context.partitionId() if context else 0) << 32
        held: list[tuple[np.ndarray, ...]] = []
        opening = True  # the first region held may have begun in another piece

        def close(rows: tuple[np.ndarray, ...], last: bool) -> tuple[tuple[np.ndarray, ...] | None, pa.RecordBatch]:
            nonlocal piece, opening
            tree, keys, ids, sketch = rows
            new = (np.diff(tree) != 0) | (keys[1:, :MIN_DEPTH] != keys[:-1, :MIN_DEPTH]).any(1)
            cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(ids)]])
            size = np.diff(cut)
            early = len(ids) - cut[-2] > HELD_ROWS
            done = len(size) if last or early else len(size) - 1
            edge = np.zeros(done, bool)
            edge[:1] = opening
            edge[len(size) - 1 :] = True
            found: set[tuple[int, int]] = set()
            parts: list[tuple[int, bytes, int]] = []
            two = cut[:-1][:done][(size[:done] == 2) & ~edge]
            for i in two[(sketch[two] == sketch[two + 1]).sum(1) >= least]:
                found.add((int(ids[i]), int(ids[i + 1])))
            for r in np.flatnonzero((size[:done] > 2) | edge):
                a, z = cut[r], cut[r + 1]
                whole = edge[r] and z - a > REGION_ROWS
                found.update(((int(i), int(ids[a])) for i in ids[a + 1 : z]) if whole else _search(ids[a:z], sketch[a:z], least))
                if edge[r]:
                    part = int(tree[a]).to_bytes(2, "big") + keys[a, :MIN_DEPTH].tobytes()
                    parts += [(int(i), part, piece) for i in ids[a : a + 1 if whole else z]]
                    piece += 1
            opening = early or (opening and not done)
            keep = None if last or early else tuple(x[cut[-2] :] for x in rows)
            pairs = [(max(x), min(x), None, None) for x in found if x[0] != x[1]] + [(i, None, part, p) for i, part, p in parts]
            columns = list(zip(*pairs, strict=True)) if pairs else [()] * 4
            return keep, pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "part", "piece"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _matrix(batch.column(1), DEPTH * 4).copy().view(">u4").astype(np.uint32)
            held.append((batch.column(0).to_numpy(), keys, batch.column(2).to_numpy(), _matrix(batch.column(3), VALUES)))
            if sum(len(x[2]) for x in held) >= 4096:
                keep, edges = close(tuple(np.concatenate(x) for x in zip(*held, strict=True)), False)
                held = [keep] if keep is not None else []
                yield edges
        if held:
            yield close(tuple(np.concatenate(x) for x in zip(*held, strict=True)), True)[1]

    return run


def candidates(forest: DataFrame, least: int) -> DataFrame:
    """(a, b): edges whose components hold every pair of rows of (tree, key, doc_id, sketch) that lie in one region and
    agree in `least` sketch bytes. Regions in several pieces are one component each, to be searched exactly later."""
    order = ("tree", "key", "doc_id")
    found = materialize(forest.select(*order, "sketch").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(least), "a long, b long, part binary, piece long"), "neighbours")
    pieces = found.where("part is not null")
    cut = pieces.groupBy("part").agg(F.min("a").alias("b"), F.count_distinct("piece").alias("n")).where("n > 1")
    across = pieces.select("a", "part").join(cut.select("part", "b"), "part").where("a <> b").select("a", "b")
    return materialize(found.where("part is null").select("a", "b").unionAll(across).distinct(), "candidates")


def _similar(inter: np.ndarray, a: np.ndarray, b: int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def link_sets(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each (non-empty) set the index of the first set of its component, links being exact Jaccard similarities of
    at least percent.

    Breadth-first search over an inverted index. Values are ordered from rare to frequent; two sets that are similar
    enough share one of their first |set| - ceil(percent of |set|) + 1 values, so only these are indexed, and only sets
    found through them, and not reached yet, are compared in full. Reached sets leave the index as it is read.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = rank[at]
    flat = flat[np.lexsort((flat, owner))]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    prefix = sizes + 1 + (-percent * sizes) // 100  # size + 1 - ceil(percent / 100 * size)
    indexed = np.arange(len(flat)) - np.repeat(starts, sizes) < np.repeat(prefix, sizes)
    order = np.argsort(flat[indexed], kind="stable")
    value, member = flat[indexed][order], owner[indexed][order]
    cut = np.flatnonzero(np.diff(value, prepend=-1, append=len(times)))
    lists = {int(value[i]): member[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True) if j - i > 1}
    label = np.full(len(sets), -1)
    mark = np.zeros(len(times), np.int32)
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root] = root
        queue = [root]
        while queue:
            q = queue.pop()
            own = flat[starts[q] : ends[q]]
            near = []
            for v in own[: prefix[q]].tolist():
                if v in lists:
                    open_ones = lists[v][label[lists[v]] < 0]
                    if len(open_ones):
                        lists[v] = open_ones
                        near.append(open_ones)
                    else:
                        del lists[v]
            if not near:
                continue
            near = np.unique(np.concatenate(near))
            size = sizes[near]
            fits = (100 * size >= percent * sizes[q]) & (100 * sizes[q] >= percent * size)
            near, size = near[fits], size[fits]
            if not len(near):
                continue
            mark[own] = 1
            first = np.cumsum(size) - size
            values = flat[np.arange(size.sum()) + np.repeat(starts[near] - first, size)]
            inter = np.add.reduceat(mark[values], first)
            mark[own] = 0
            new = near[_similar(inter, size, int(sizes[q]), percent)]
            label[new] = root
            queue.extend(new.tolist())
    return label.tolist()


def _confirm_blocks(size: int, percent: int):
    """Rows sorted by (cluster, pair of blocks): for each row the smallest id that it is linked with inside the pair."""

    def close(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        root = link_sets(sets, percent)
        least: dict[int, int] = {}
        for i, r in zip(ids, root, strict=True):
            least[r] = min(i, least.get(r, i))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([least[r] for r in root], pa.int64())], names=["doc_id", "comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            where = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            numbers = batch.column(3).to_pylist()
            for a, _, words in chunks(batch.column(4)):
                for i, s in enumerate(shingle_sets(words, size), a):
                    if where[i] != now:
                        if ids:
                            yield close(ids, sets)
                        now, ids, sets = where[i], [], []
                    if len(s):
                        ids.append(numbers[i])
                        sets.append(s)
        if ids:
            yield close(ids, sets)

    return run


def only_members(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id may be one of members' (few others pass): a bitmap of fixed size over hashed ids is
    sent to all tasks, so that a join with members, of any number, exchanges no other texts."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - PLACE_BITS)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    words = members.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    met = texts.where("doc_id is not null").join(F.broadcast(words), word == F.col("__word"))  # at most 2 ** (PLACE_BITS - 6) rows
    return met.where(F.getbit("__bits", bit) == 1).drop("__word", "__bits")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles (long), component_id (long), kept (boolean).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of `size`-word shingles (A-Z lowered);
    component_id is the smallest id of the component, kept marks that document. Null and empty texts have empty sets
    and are linked with nothing; so are rows with a null id (component_id null, kept true). Repeated rows fall into
    one class and are each returned; if rows share an id, all of them carry its component. Empty table: empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = materialize(texts.mapInArrow(_describe(size), "doc_id long, n_shingles long, print binary, signature binary, sketch binary"), "signatures")
    counted = slim.where("n_shingles > 0 and doc_id is not null")
    reps = counted.groupBy("n_shingles", "print").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "classes")
    signed = counted.join(reps.select(F.col("n_shingles").alias("rn"), F.col("print").alias("rp"), "rep"), (F.col("rn") == F.col("n_shingles")) & (F.col("rp") == F.col("print")) & (F.col("rep") == F.col("doc_id")), "left_semi")
    trees = signed.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "doc_id", "signature", "sketch")
    forest = trees.select("tree", F.substring("signature", F.col("tree") * (DEPTH * 4) + 1, F.lit(DEPTH * 4)).alias("key"), "doc_id", "sketch")
    p = percent / 100
    least = int(np.floor(VALUES * p - SLACK * np.sqrt(VALUES * p * (1 - p))))
    edges = candidates(forest, least)
    groups = materialize(connected_components(edges, "a", "b").join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node"), "groups")
    total = F.sum("n_shingles")
    blocks = groups.groupBy("component").agg(F.when(total <= block_shingles, 1).otherwise(F.ceil(2 * total / block_shingles)).cast("int").alias("n_blocks"))
    members = groups.join(blocks, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int").alias("block"), "n_blocks")
    # A group of several blocks has a task for every pair of them, each block being half as large.
    others = F.when(F.col("n_blocks") == 1, F.array("block")).otherwise(F.array_except(F.sequence(F.lit(0), F.col("n_blocks") - 1), F.array("block")))
    members = members.withColumn("other", F.explode(others))
    several = not blocks.where("n_blocks > 1").isEmpty()
    members = materialize(members.select("doc_id", "cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")), "members")
    placed = only_members(texts, members).join(members, "doc_id").select("cluster", "one", "two", "doc_id", "text")
    task = ("cluster", "one", "two")
    linked = placed.repartition(*task).sortWithinPartitions(*task, "doc_id").mapInArrow(_confirm_blocks(size, percent), "doc_id long, comp long")
    comps = materialize(linked.distinct(), "confirmed")
    if several:
        comps = connected_components(comps, "doc_id", "comp").select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    classes = reps.join(comps.select(F.col("doc_id").alias("rep"), "comp"), "rep", "left").select("n_shingles", "print", F.coalesce("comp", "rep").alias("component_id"))
    out = slim.select("doc_id", "n_shingles", "print").join(classes, ["n_shingles", "print"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate group, all columns kept: the one with the smallest id. Rows that repeat an id
    are one document; rows with a null id all stay."""
    kept = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    found = docs.join(kept, F.col("doc_id").cast("long") == F.col("__kept"), "left_semi")
    return found.dropDuplicates(["doc_id"]).unionAll(docs.where("doc_id is null"))
