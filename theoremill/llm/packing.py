"""Shortest-pack-first histogram packing of token sequences.

Documents are tokenized (ids, then an end id) and cut into pieces; only the histogram of piece lengths (at most
`max_length` counts) reaches the driver. There, lengths are placed longest first, each time into the shortest pack
built so far, by updating counts of packing patterns. The patterns go back to the pieces by rank: the k-th piece of a
length takes the k-th place that the patterns hold for that length. No piece is dropped or truncated.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from theoremill.llm.common import materialize, prepare, with_row

#: Cuts for what is left of a document after whole sequences, largest first; the first that packs well is used.
CUTS = (1024, 512, 256, 128, 64)
#: Share of padding that is small enough to keep longer pieces.
PADDING = 0.005
#: Texts that both tokenizer libraries surely split alike, at bounded depth: plain Latin characters, no run of white
#: space above 64 and no word above 512 characters. All other texts take the slower library.
_SPACE, _SIGN = "[\t\n\r ]", "[!-~¡-ȳ]"
_PLAIN = re.compile(f"{_SPACE}{{0,64}}+(?:{_SIGN}{{1,512}}+{_SPACE}{{1,64}}+)*+(?:{_SIGN}{{1,512}}+)?")

_encoders: dict[tuple[str, str], object] = {}


def _encoder(json_path: str, ranks_path: str | None):
    """texts -> id lists, as library `tokenizers` gives them.

    With the ranks file (the same vocabulary), texts that match _PLAIN go through the faster library, whose recursion
    grows with runs of white space; tests hold the two against each other.
    """
    if (json_path, ranks_path or "") in _encoders:
        return _encoders[json_path, ranks_path or ""]
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = True
    fast = None
    if ranks_path:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            yield fast.encode_ordinary(text) if fast and _PLAIN.fullmatch(text) else exact.encode(text, add_special_tokens=False).ids

    _encoders[json_path, ranks_path or ""] = encode
    return encode


def tokenizer_paths() -> tuple[str, str]:
    """The installed byte-level BPE: its definition and the same vocabulary as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def tokenize(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens (long, with the end id), ids (binary: little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have the end id alone; texts of any length and runs of any character are encoded whole; rows
    that repeat an id, or have none, are each returned; other columns are dropped; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    if json_path is None:
        json_path, ranks_path = tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, ranks_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                lengths, blobs = [], []
                for ids in encode(["" if t is None else t for t in batch.column(1).slice(a, 64).to_pylist()]):
                    ids.append(end_id)
                    lengths.append(len(ids))
                    blobs.append(np.array(ids, "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 64), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def cut(tokens: DataFrame, max_length: int, rest_cut: int, digest: dict[str, Callable[[Column], Column]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (doc_id, n_tokens, start, length, ids): whole sequences first, then the rest in cuts of rest_cut.

    Each row of tokens gives its own pieces, whether its id is null or repeated; a document has one id at least, so one
    piece at least; an empty table gives an empty result; columns other than `keep` are dropped.
    digest: functions of a piece's ids, computed before the pieces of a document are dealt to rows; ids are then left
    out, so that no row repeats them.
    """
    whole = F.expr(f"n_tokens div {max_length}") * max_length
    longs = F.array().cast("array<bigint>")
    starts = F.concat(
        F.when(whole > 0, F.sequence(F.lit(0).cast("long"), F.greatest(whole, F.lit(1)) - 1, F.lit(max_length).cast("long"))).otherwise(longs),
        F.when(F.col("n_tokens") > whole, F.sequence(whole, F.greatest(F.col("n_tokens") - 1, whole), F.lit(rest_cut).cast("long"))).otherwise(longs),
    )

    def piece(start: Column) -> Column:
        length = F.least(F.when(start < whole, F.lit(max_length)).otherwise(F.lit(rest_cut)).cast("long"), F.col("n_tokens") - start)
        ids = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), *([f(ids).alias(k) for k, f in digest.items()] if digest else [ids.alias("ids")]))

    return tokens.select("doc_id", "n_tokens", *keep, F.inline(F.transform(starts, piece)))


def piece_histogram(totals: dict[int, int], whole: int, max_length: int, rest_cut: int) -> dict[int, int]:
    """Piece lengths from counts of `n_tokens mod max_length` and the number of whole sequences."""
    out: dict[int, int] = defaultdict(int)
    if whole:
        out[max_length] += whole
    for rest, n in totals.items():
        if rest // rest_cut:
            out[rest_cut] += n * (rest // rest_cut)
        if rest % rest_cut:
            out[rest % rest_cut] += n
    return dict(out)


def shortest_pack_first(histogram: dict[int, int], max_length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with the number of sequences of each; lengths longest first, each placed in the
    shortest packs that exist and can take it, else in new ones. As many places per length as pieces."""
    open_packs: dict[int, dict[tuple, int]] = defaultdict(dict)  # filled length -> pattern -> count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            filled = min((f for f in open_packs if f + length <= max_length), default=None)
            if filled is None:
                # A new pack is the shortest one until it is full, so pieces fill it before the next is opened.
                each = max_length // length
                for times, n in ((each, left // each), (left % each, 1 if left % each else 0)):
                    if n:
                        open_packs[length * times][((length, times),)] = open_packs[length * times].get(((length, times),), 0) + n
                break
            pattern, n = next(iter(open_packs[filled].items()))
            take = min(n, left)
            if take == n:
                del open_packs[filled][pattern]
                if not open_packs[filled]:
                    del open_packs[filled]
            else:
                open_packs[filled][pattern] = n - take
            last_length, last_times = pattern[-1]
            new = (*pattern[:-1], (length, last_times + 1)) if last_length == length else (*pattern, (length, 1))
            open_packs[filled + length][new] = open_packs[filled + length].get(new, 0) + take
            left -= take
    return [(pattern, n) for filled in sorted(open_packs, reverse=True) for pattern, n in open_packs[filled].items()]


def padding_share(patterns: list, max_length: int) -> float:
    n = sum(c for _, c in patterns)
    used = sum(c * sum(a * b for a, b in p) for p, c in patterns)
    return 1 - used / (n * max_length) if n else 0.0


def places(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first_rank, last_rank, times, first_sequence, offset) of the places of each length."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, taken[length], taken[length] + n * times - 1, times, sequence, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    return out


def assign(pieces: DataFrame, patterns: list, order: tuple[str, ...], rows_per_bucket: int = 500_000) -> DataFrame:
    """Add sequence_id and offset (long) to pieces that have `length`; other columns are carried along.

    order: columns that tell all rows apart, repeated ones too. Ranks within a length are counted in buckets hashed
    over them, so that a length, or copies, that make up a third of all pieces are ranked by many tasks; the bucket
    sums (lengths x buckets, slim) give each bucket its first rank. Names of helper columns begin with two underscores;
    an empty table gives an empty result; columns sequence_id and offset are overwritten.
    """
    spark = pieces.sparkSession
    total = sum(c * sum(t for _, t in p) for p, c in patterns)
    buckets = max(32, total // rows_per_bucket)
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(*(f"`{c}`" for c in own)).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = salted.groupBy(F.col("length").alias("__l"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    first = counts.select("__l", "__b", F.sum("__n").over(Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    ranked = salted.withColumn("__in", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)))
    ranked = ranked.join(first, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b"))).withColumn("__rank", F.coalesce("__before", F.lit(0)) + F.col("__in") - 1)
    # Places: patterns x distinct lengths in one; patterns follow from the histogram of at most max_length counts.
    spots = spark.createDataFrame(places(patterns), "__pl long, __first long, __last long, __times long, __sequence long, __at long")
    found = ranked.join(F.broadcast(spots), (F.col("length") == F.col("__pl")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") <= F.col("__last")))
    k = F.col("__rank") - F.col("__first")
    sequence, offset = F.col("__sequence") + F.expr("(__rank - __first) div __times"), F.col("__at") + F.pmod(k, F.col("__times")) * F.col("length")
    return found.select(*(f"`{c}`" for c in own), sequence.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, max_length: int = 1024, digest: dict[str, Callable[[Column], Column]] | None = None, **tokenizer) -> DataFrame:
    """Pieces of documents with their place: doc_id, n_tokens, start, length, ids, sequence_id, offset.

    Every id of every document lies in one piece; sequences hold max_length ids at most and pieces fill them from 0
    without gaps. digest: columns to compute from a piece's ids instead of carrying these through the exchange. Null and
    empty texts are documents of one (end) id; rows that repeat an id, or have none, are documents of their own; an
    empty table gives an empty result.
    """
    tokens = with_row(materialize(tokenize(docs, **tokenizer), "tokens"), "__row")
    sums = tokens.groupBy(F.pmod("n_tokens", F.lit(max_length)).alias("rest")).agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {max_length}")).alias("whole")).collect()
    rests, whole = {r["rest"]: r["n"] for r in sums if r["rest"]}, sum(r["whole"] for r in sums)
    for rest_cut in (c for c in CUTS if c <= max_length):
        patterns = shortest_pack_first(piece_histogram(rests, whole, max_length, rest_cut), max_length)
        if padding_share(patterns, max_length) <= PADDING:
            break
    return assign(cut(tokens, max_length, rest_cut, digest, ("__row",)), patterns, ("__row", "start")).drop("__row")
