"""Features of nodes: word counts, weights, vectors, undirected weights, walks and node vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from theoremill.functions import names as N
from theoremill.plans.scratch import discard, materialize

# Word weighting schemes.
SCHEMES = ("COUNT", "COUNT_LOG2", "TFIDF", "TFIDF_LOG2_COUNT", "CONSTANT")


def bag_of_words(docs: DataFrame) -> DataFrame:
    """Id, word, cnt. docs: id, text; null texts have no words."""
    return docs.select("id", F.explode(N.vector_tokens(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("cnt"))


def smooth_idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """word, idf = ln((1 + n) / (1 + df)) + 1. n_docs: one row, column n."""
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def tfidf(docs: DataFrame) -> DataFrame:
    """Id, word, tfidf; rows have length 1."""
    counts = materialize(bag_of_words(docs), "words")
    raw = counts.join(smooth_idf(counts, docs.agg(F.count("*").alias("n"))), "word").select("id", "word", (F.col("cnt") * F.col("idf")).alias("x"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "word", (F.col("x") / F.col("norm")).alias("tfidf"))


def word_weight(scheme: Column, cnt: Column, idf: Column) -> Column:
    """Idf is the smooth one; its logarithm is used. An unknown word (null idf) weighs 0 in the schemes that use it."""
    log_idf, log_cnt = F.coalesce(F.log2(idf), F.lit(0.0)), 1 + F.log2(cnt.cast("double"))
    return F.when(scheme == "COUNT", cnt.cast("double")).when(scheme == "COUNT_LOG2", log_cnt).when(scheme == "TFIDF", cnt * log_idf).when(scheme == "TFIDF_LOG2_COUNT", log_cnt * log_idf).when(scheme == "CONSTANT", F.lit(1.0))


def word_weights(docs: DataFrame, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """Id, word, scheme, weight."""
    counts = materialize(bag_of_words(docs), "words")
    known = counts.join(smooth_idf(counts, docs.agg(F.count("*").alias("n"))), "word")
    return known.withColumn("scheme", F.explode(F.array(*(F.lit(s) for s in schemes)))).select("id", "word", "scheme", word_weight(F.col("scheme"), F.col("cnt"), F.col("idf")).alias("weight"))


def document_vectors(weights: DataFrame, vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """E5: id, component, value: weighted sums of word vectors; ids without a known word get zeros. weights: id, word,
    weight; vectors: word, vec."""
    size = vectors.agg(F.max(F.size("vec")).alias("d"))
    known = vectors.select(F.col("word").alias("known"), "vec")
    lowered = weights.select("id", F.lower("word").alias("lower"), "weight")
    each = lowered.join(known, F.col("lower") == F.col("known")).select("id", "weight", F.posexplode("vec").alias("component", "x"))
    summed = each.groupBy("id", "component").agg(F.sum(F.col("weight") * F.col("x")).alias("value"))
    grid = ids.select("id").crossJoin(F.broadcast(size)).select("id", F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("component"))  # one row
    return grid.join(summed, ["id", "component"], "left").select("id", "component", F.coalesce("value", F.lit(0.0)).alias("value"))


def vocabulary(texts: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Word, cnt over all texts (column text), forbidden words (column word) left out."""
    counts = texts.select(F.explode(N.split_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return counts.join(forbidden.select("word").distinct(), "word", "left_anti") if forbidden is not None else counts


def coverage(vocab: DataFrame, known: DataFrame) -> DataFrame:
    """n_missing, cnt_missing: words that the vectors don't know."""
    return vocab.join(known.select("word").distinct(), "word", "left_anti").agg(F.count("*").alias("n_missing"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt_missing"))


def filter_vectors(vectors: DataFrame, wanted: DataFrame, additions: DataFrame) -> DataFrame:
    """Word, vec: vectors of wanted words (compared in lower case), and new words as weighted sums of known ones
    (additions: word, part, weight; an unknown part is an error)."""
    kept = vectors.join(wanted.select(F.lower("word").alias("w")).distinct(), F.lower(vectors["word"]) == F.col("w"), "left_semi")
    parts = additions.join(vectors.select(F.col("word").alias("part"), "vec"), "part", "left")
    checked = parts.where(F.assert_true(F.col("vec").isNotNull(), F.concat(F.lit("unknown word: "), F.col("part"))).isNull())
    summed = checked.select("word", "weight", F.posexplode("vec").alias("c", "x")).groupBy("word", "c").agg(F.sum(F.col("weight") * F.col("x")).alias("v"))
    new = summed.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("vec"))
    return kept.select("word", "vec").unionAll(new)


def component_stats(vectors: DataFrame) -> DataFrame:
    """Component, max, min, mean, std (of the population). vectors: features."""
    x = vectors.select(F.posexplode("features").alias("component", "x"))
    return x.groupBy("component").agg(F.max("x").alias("max"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def norm_histogram(vectors: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Bin (0: below, bins + 1: from high), n of squared lengths."""
    sq = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select(F.width_bucket(sq, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def quantile_of(sample: DataFrame, values: DataFrame) -> DataFrame:
    """Value, quantile: share of sample values (column x) below each of a few values (column value, at most some
    thousand: broadcast)."""
    if values.limit(10_001).count() > 10_000:
        raise ValueError("quantile_of takes at most 10000 values")
    joined = sample.crossJoin(F.broadcast(values))
    return joined.groupBy("value").agg((F.count_if(F.col("x") < F.col("value")) / F.count("*")).alias("quantile"))


def case_variants(words: DataFrame, n: int = 100) -> DataFrame:
    """The n largest groups of words that differ in case only: lower, words, size."""
    return words.groupBy(F.lower("word").alias("lower")).agg(F.sort_array(F.collect_set("word")).alias("words")).select("lower", "words", F.size("words").alias("size")).where("size > 1").orderBy(F.desc("size"), "lower").limit(n)


def pair_distance(a: Column, b: Column, metric: str) -> Column:
    """M3 as a native expression: mean absolute difference (cityblock) or 1 - cosine (null with a zero vector)."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    if metric == "cosine":
        return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return total(F.zip_with(a, b, lambda u, v: F.abs(u - v))) / F.size(a)


def group_distances(groups: DataFrame, vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """Lower, a, b, distance for the pairs of words in each group of case variants (groups are as small as the ways
    to write a word). groups: lower, words; vectors: word, vec."""
    words = groups.select("lower", F.explode("words").alias("a"), "words").select("lower", "a", F.explode("words").alias("b")).where("a < b")
    side = lambda c: vectors.select(F.col("word").alias(c), F.col("vec").alias(f"v{c}"))
    return words.join(side("a"), "a").join(side("b"), "b").select("lower", "a", "b", pair_distance(F.col("va"), F.col("vb"), metric).alias("distance"))


def random_pair_distances(vectors: DataFrame, n: int = 1000, metric: str = "cosine", seed: int = 1) -> DataFrame:
    """A, b, distance of about n random pairs: the words with the lowest hashes, each with the next one."""
    from pyspark.sql import Window

    some = vectors.withColumn("h", N.hash_order(seed, F.col("word"))).orderBy("h", "word").limit(n + 1)  # n + 1 rows
    w = Window.orderBy("h", "word")
    pairs = some.select(F.col("word").alias("a"), F.col("vec").alias("va"), F.lead("word").over(w).alias("b"), F.lead("vec").over(w).alias("vb")).where("b is not null")
    return pairs.select("a", "b", pair_distance(F.col("va"), F.col("vb"), metric).alias("distance"))


def analogies(quads: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Query, candidate, error, rank: the k words nearest to x0 - y0 + y1. quads: query, x0, y0, y1."""
    from theoremill.operators.search import nearest_targets

    side = lambda c: vectors.select(F.col("word").alias(c), F.col("vec").alias(f"v{c}"))
    full = quads.join(side("x0"), "x0").join(side("y0"), "y0").join(side("y1"), "y1")
    minus = F.zip_with("vx0", "vy0", lambda u, v: u - v)
    targets = full.select("query", F.zip_with(minus, "vy1", lambda u, v: u + v).alias("target"), F.col("vx0").alias("own"))
    return nearest_targets(targets, vectors.select(F.col("word").alias("id"), F.col("vec").alias("features")), k, 0.0, metric)


def undirected_weights(edges: DataFrame, n_nodes: int | None = None, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """U, v (u <= v), w. Over normal edges in order of (src, dst, edge_type): the first of a pair starts it at 0,
    later ones add their weight; then every edge adds w * log2(idf(target)), a node's targets (round(w) times each)
    being its document, and n the number of nodes (counted where it isn't given). Edges to nodes that are in no document
    don't count. spent: the scratch tables that edges are made of; they are removed when they have been read, and the
    result is a scratch table, so that less lies on disk at a time."""
    kinds = [N.CONTAINS, N.DEFINES, N.BODY, N.TYPE]  # the normal types, in their order
    kind = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("edge_type")).cast("int")
    normal = edges.where(N.edge_type_is_normal(F.col("edge_type"))).select("src", "dst", kind.alias("kind"), F.coalesce("w", F.lit(1)).cast("double").alias("w"))
    n = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct().count() if n_nodes is None else n_nodes
    # Everything about a target, and about the first node of a pair, is summed up where one exchange has brought it.
    df = normal.where(F.bround("w") >= 1).select("src", "dst").repartition("dst").groupBy("dst", "src").agg(F.count("*")).groupBy("dst").agg(F.count("*").alias("df"))
    idf = materialize(df.select(F.col("dst").alias("target"), F.log2(F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("log_idf")), "idf", tidy=True)
    to_v = F.col("src") <= F.col("dst")
    each = normal.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), to_v.alias("to_v"), F.when(to_v, F.col("kind")).otherwise(F.col("kind") + len(kinds)).alias("nth"), "w")
    pairs = each.repartition("u").groupBy("u", "v").agg(F.sum(F.when(F.col("to_v"), F.col("w"))).alias("wv"), F.sum(F.when(~F.col("to_v"), F.col("w"))).alias("wu"), F.min_by("w", "nth").alias("first"))
    none = F.col("wv").isNull()
    known = lambda c: idf.select(F.col("target").alias(c), F.col("log_idf").alias(f"i{c}")).hint("shuffle_hash")
    part = F.col("wu") - F.when(none, F.col("first")).otherwise(0.0) + F.col("wu") * F.col("iu")
    half = pairs.join(known("u"), "u", "left").select("u", "v", part.alias("part"), (F.col("wv") - F.col("first")).alias("later"), "wv")
    if spent:
        half = materialize(half, "halves", tidy=True)
        discard(*spent)
    whole = F.col("later") + F.col("wv") * F.col("iv")
    full = half.join(known("v"), "v", "left").where(F.coalesce("part", whole).isNotNull())
    full = full.select("u", "v", (F.coalesce("part", F.lit(0.0)) + F.coalesce(whole, F.lit(0.0))).alias("w"))
    if spent:
        full = materialize(full, "weights", tidy=True)
        discard(half, idf)
    return full


def edge_features(pairs: DataFrame, vectors: DataFrame, scheme: str) -> DataFrame:
    """Pairs (src, dst, ...) with `features`: concatenation, sum or mean of the two node vectors; a node without a
    vector is an error."""
    a = vectors.select(F.col("id").alias("src"), F.col("features").alias("fa"))
    b = vectors.select(F.col("id").alias("dst"), F.col("features").alias("fb"))
    both = pairs.join(a, "src", "left").join(b, "dst", "left")
    known = both.where(F.assert_true(F.col("fa").isNotNull() & F.col("fb").isNotNull(), F.lit("a node has no vector")).isNull())
    made = {"concatenation": F.concat("fa", "fb"), "sum": F.zip_with("fa", "fb", lambda x, y: x + y), "mean": F.zip_with("fa", "fb", lambda x, y: (x + y) / 2)}[scheme]
    return known.withColumn("features", made).drop("fa", "fb")


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Id, features of both embedders; their ids must agree (a missing one is an error)."""
    both = first.select("id", F.col("features").alias("fa")).join(second.select("id", F.col("features").alias("fb")), "id", "full_outer")
    ok = F.assert_true(F.col("fa").isNotNull() & F.col("fb").isNotNull(), F.lit("the embedders have different nodes")).isNull()
    return both.where(ok).select("id", F.concat("fa", "fb").alias("features"))


def number_names(ids: DataFrame) -> DataFrame:
    """name, n: the ids (a column id) numbered from 0 in their order, without gaps."""
    from pyspark.sql import Window

    sorted_ids = ids.select(F.col("id").alias("name")).where("name is not null").distinct().orderBy("name")
    placed = materialize(sorted_ids.select("name", F.monotonically_increasing_id().alias("place")), "places", tidy=True)
    part = F.shiftright("place", 33).alias("part")
    before = F.sum("count").over(Window.orderBy("part")) - F.col("count") - F.shiftleft("part", 33)
    offsets = placed.groupBy(part).count().select("part", before.alias("offset"))
    return placed.select("name", "place", part).join(F.broadcast(offsets), "part").select("name", (F.col("place") + F.col("offset")).alias("n"))  # one row a partition


#: Neighbours in a row of the packed table, and pairs of nodes from which that table is made in quarters.
PACKED, QUARTERED = 32, 20_000_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (at, to, w) sorted by (at, to) -> (at, base, upto, tos, ws): at most PACKED neighbours of a node, with the sum of
    the weights before them and up to the last of them."""

    def cut(at: np.ndarray, to: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        heads = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        place = np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))
        starts = np.flatnonzero(place % PACKED == 0)
        ends = np.append(starts[1:], len(at))
        head = starts - place[starts]
        summed = np.concatenate([[0.0], np.cumsum(w)])
        given = np.where(head == 0, before, 0.0)
        offsets = pa.array(np.append(starts, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (to, w)]
        return pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(given + (summed[starts] - summed[head])), pa.array(given + (summed[ends] - summed[head])), *lists], names=["at", "base", "upto", "tos", "ws"])

    held: list[tuple[np.ndarray, ...]] = []
    before = 0.0  # of the first node held: weights that were given out already
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        if sum(len(x[0]) for x in held) >= 65_536:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            stop = last + (len(rows[0]) - last - 1) // PACKED * PACKED  # the last node may go on
            if stop:
                made = cut(*(x[:stop] for x in rows))
                before = made.column(2)[-1].as_py() if stop > last else 0.0
                yield made
            held = [tuple(x[stop:] for x in rows)]
    if sum(len(x[0]) for x in held):
        yield cut(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _packed(edges: DataFrame, number: str) -> list[DataFrame]:
    """The neighbours of each node in rows of at most PACKED, from edges (u, v, w) between numbers (bigint, or int
    where they fit). Large graphs are made in
    quarters, so that only a quarter's exchange is on disk at a time."""
    ways = F.array(F.struct(F.col("u").alias("at"), F.col("v").cast(number).alias("to"), "w"), F.struct(F.col("v").alias("at"), F.col("u").cast(number).alias("to"), "w"))
    both = edges.where("w > 0").select(F.inline(F.when(F.col("u") == F.col("v"), F.slice(ways, 1, 1)).otherwise(ways)))
    parts = 4 if edges.count() > QUARTERED else 1
    made = []
    for i in range(parts):
        some = both.where(F.pmod(F.xxhash64("at"), F.lit(parts)) == i).repartition("at").sortWithinPartitions("at", "to")
        made.append(materialize(some.mapInArrow(_pack, f"at long, base double, upto double, tos array<{number}>, ws array<double>"), "packed", tidy=True))
    return made


def random_walks(edges: DataFrame, n_walks: int = 100, length: int = 100, seed: int = 1234, p: float = 1.0, q: float = 1.0, names: DataFrame | None = None, spent: tuple[DataFrame, ...] = (), numbered: bool = False) -> DataFrame:
    """Walk (start, nth), step, node: weighted random walks on undirected edges (u, v, w), one join per step.

    With p = q = 1 each node's neighbours stand on [0, 1) by cumulated weight; a walk draws a hashed number and joins
    the few neighbours among which it falls. Else the weight of a step back is divided by p and that of a step to a node
    which the previous one isn't linked with by q, and the neighbour with the least hashed exponential wins. No task
    holds the graph. names (name, n): u and v are numbers, in the order of the names that the walks are to show; with
    numbered, start is shown by name and node by number. spent: scratch tables that edges are made of, to be removed when
    they have been read."""
    if numbered and names is None:
        raise ValueError("numbered walks need names")
    drawn = lambda i, *more: (F.conv(F.substring(N.hash_order(seed, F.col("start").cast("string"), F.col("nth").cast("string"), F.lit(str(i)), *more), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    code = lambda df, given, c: df.join(given.select(F.col("name").alias(c), F.col("n").alias(f"{c}_n")), c).drop(c).withColumnRenamed(f"{c}_n", c)
    if p == q == 1:
        if names is None:
            names = materialize(number_names(edges.select(F.col("u").alias("id")).unionAll(edges.select("v"))), "names")
            edges = code(code(edges, names, "u"), names, "v")
        if not spent:
            edges = materialize(edges, "weights", tidy=True)
        quarters = _packed(edges, "int" if names.count() < 2**31 else "bigint")
        packed = reduce(DataFrame.unionAll, quarters)
        discard(*(spent or (edges,)))
        total = materialize(packed.groupBy("at").agg(F.max("upto").alias("total")), "totals", tidy=True)
        first = total.join(names, F.col("at") == F.col("n")).select(F.col("name").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("nth"), F.col("at").alias("node"), F.lit(0).alias("step"))
        front = every = materialize(first, "walks", tidy=True)
        for i in range(1, length):
            aimed = front.join(total, F.col("node") == F.col("at")).select("start", "nth", "node", (drawn(i) * F.col("total")).alias("x"))
            hit = aimed.join(packed, (F.col("node") == F.col("at")) & (F.col("x") >= F.col("base")) & (F.col("x") < F.col("upto")))
            begin = F.struct(F.col("base").alias("sum"), F.lit(1).alias("place"))
            stepped = lambda acc, w: F.struct((acc["sum"] + w).alias("sum"), (acc["place"] + F.when(F.col("x") >= acc["sum"] + w, 1).otherwise(0)).alias("place"))
            place = F.least(F.aggregate("ws", begin, stepped)["place"], F.size("ws"))
            front = materialize(hit.select("start", "nth", F.element_at("tos", place).cast("bigint").alias("node"), F.lit(i).alias("step")), "walks", tidy=True)
            every = every.unionAll(front)
        discard(*quarters, total)
        if numbered:
            return every
        return every.join(names, F.col("node") == F.col("n")).select("start", "nth", "step", F.col("name").alias("node"))

    if names is not None:
        name = lambda df, c: code(df, names.select(F.col("n").alias("name"), F.col("name").alias("n")), c)
        edges = name(name(edges, "u"), "v")
    both = edges.select(F.col("u").alias("at"), F.col("v").alias("to"), "w").unionAll(edges.where("u <> v").select("v", "u", "w")).where("w > 0")
    cum = materialize(both.select("at", "to", "w"), "steps")
    start = cum.select("at").distinct().select(F.col("at").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("nth"), F.col("at").alias("node"), F.lit(None).cast(cum.schema["at"].dataType).alias("before"), F.lit(0).alias("step"))
    front = every = materialize(start, "walks")
    for i in range(1, length):
        near = cum.select(F.col("at").alias("before"), F.col("to").alias("to"), F.lit(True).alias("linked"))
        options = front.join(cum.select("at", "to", "w"), F.col("node") == F.col("at")).join(near, ["before", "to"], "left")
        weight = F.col("w") * F.when(F.col("before").isNull(), 1.0).when(F.col("to") == F.col("before"), 1.0 / p).when(F.col("linked"), 1.0).otherwise(1.0 / q)
        raced = options.withColumn("race", -F.log(drawn(i, F.col("to").cast("string"))) / weight)
        moved = raced.groupBy("start", "nth", F.col("node").alias("was")).agg(F.min_by("to", F.struct("race", "to")).alias("node")).select("start", "nth", "node", F.col("was").alias("before"))
        front = materialize(moved.withColumn("step", F.lit(i)), "walks")
        every = every.unionAll(front.select(*every.columns))
    every = every.select("start", "nth", "step", "node")
    return code(every, names, "node") if numbered else every


def node_vectors(walks: DataFrame, size: int = 64, window: int = 5, epochs: int = 10, seed: int = 1, names: DataFrame | None = None) -> DataFrame:
    """Id, features by skip-gram over the walks (start, nth, step, node), for every node in them; no process holds the
    model. names (name, n): the nodes of the walks are numbers of these (random_walks with numbered)."""
    from theoremill.operators.skipgram import skip_gram

    vectors = skip_gram(walks, size, window, epochs, seed)
    if names is None:
        return vectors.select(F.col("node").cast("string").alias("id"), "features")
    return vectors.join(names, F.col("node") == F.col("n")).select(F.col("name").alias("id"), "features")


class MetapathToVec:
    """Declared only."""

    def __init__(self):
        raise NotImplementedError("metapath embeddings are not available")
