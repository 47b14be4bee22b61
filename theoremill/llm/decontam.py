"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question asked again with other numbers or names keeps its
template. Windows of template words are hashed and joined between corpus and benchmark; where windows of an item and a
document line up, the values behind the placeholders must map one to one (the slots are consistent), which tells a
re-parameterised question from chance. An item is leaked by a document if enough of its windows are covered so. Items
shorter than a window are one window, found by template or by value; the shortest, by value as a whole sentence or line.

The corpus side of the join is thinned first by a bitmap of fixed size over the benchmark's window hashes; it lets
every true match pass and has the same size for any benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import materialize, prepare
from theoremill.llm.textbytes import NOT_ALNUM, Words, chunks, mix

WINDOW, SHORTEST, COVERED = 8, 4, 0.5
#: The bitmap has 2**BITS places, whatever the benchmark's size.
BITS = 22
#: Share of slot values that must map one to one.
CONSISTENT = 0.8
# Unit words, by quantity.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds ounce ounces oz "
    "ml l liter liters litre litres gallon gallons pint pints cup cups "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent "
    "degree degrees celsius fahrenheit kelvin watt watts kw volt volts amp amps joule joules newton newtons pascal hz mph kmh"
).split()
_NUMBER, _NAME, _UNIT, _LITERAL = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974, 0x6C69746572616C))


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    from theoremill.llm.textbytes import words_in

    return np.sort(words_in(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_ALNUM).hashes())


_units = _unit_hashes()
_ENDS = np.isin(np.arange(256), list(b".!?\n:;\"|"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))


@dataclass
class Tokens:
    """Template words of many texts; a run of names is one of them."""

    template: np.ndarray  # hash, typed for slots
    value: np.ndarray  # hash of the word or of the run of names
    slot: np.ndarray
    begins: np.ndarray  # first of a sentence or line
    text: np.ndarray  # index of the text
    first: np.ndarray  # index at which each text begins, n + 1

    def last(self) -> np.ndarray:
        """Whether a token ends a sentence, line or text."""
        return np.append(self.begins[1:], True)


def templates(words: Words) -> Tokens:
    """Number: starts with a digit. Unit: listed. Name: a capital letter and then a small one, and not the first word of a
    sentence or line; names in a row are one. All else is literal, lowered.
    """
    low = words.data.copy()  # capital letters of Latin-1 are lowered too: C3 80-9E to C3 A0-BE
    low[1:][(low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)] += 0x20
    words.data = low
    value, text = words.hashes(), words.text_of()
    if not len(value):
        none = np.zeros(0, bool)
        return Tokens(value, value, none, none, text, words.first)
    byte = lambda at: words.raw[np.minimum(at, len(words.raw) - 1)]
    wide_at = lambda at: (byte(at) == 0xC3) & (byte(at + 1) >= 0x80) & (byte(at + 1) <= 0x9E) & (byte(at + 1) != 0x97)  # noqa: E731  capital letters of Latin-1
    upper_at = lambda at: _UPPER[byte(at)] | wide_at(at)
    start = byte(words.starts)
    following = words.starts + np.where(wide_at(words.starts), 2, 1)
    capital = upper_at(words.starts) & (following < words.ends) & ~upper_at(following)
    stops = np.concatenate([[0], np.cumsum(_ENDS[words.raw])])
    begins = np.ones(len(value), bool)
    begins[1:] = stops[words.starts[1:]] > stops[words.ends[:-1]]
    begins[words.first[:-1][words.counts() > 0]] = True
    number, unit = (start >= 48) & (start <= 57), np.isin(value, _units)
    name = capital & ~begins & ~number & ~unit
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    kept = np.flatnonzero(~(name & np.append(False, name[:-1])))  # a name does not begin a text, so runs stay in one
    run = np.add.reduceat(mix(value), kept)
    alone = np.diff(kept, append=len(value)) == 1
    slot = (number | unit | name)[kept]
    return Tokens(template[kept], np.where(alone, value[kept], mix(run)), slot, begins[kept], text[kept], np.searchsorted(kept, words.first))


def _places(size: int) -> np.ndarray:
    return mix(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)


def _by_value(tokens: Tokens, at: np.ndarray, size: int) -> np.ndarray:
    h = np.full(len(at), _LITERAL)
    for j, place in enumerate(_places(size)):
        h += tokens.value[at + j] * place
    return mix(h + np.uint64(size))


def window_hashes(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, hash, literal) of every window of `size` tokens of one text. Windows with more than half slots say
    too little as templates: these are literal, hashed with the values of their slots."""
    n = len(tokens.template) - size + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for j, place in enumerate(_places(size)):
        h += tokens.template[j : j + n] * place
    running = np.concatenate([[0], np.cumsum(tokens.slot)])
    at = np.flatnonzero(tokens.text[:n] == tokens.text[size - 1 :])
    literal = (running[at + size] - running[at]) * 2 > size
    h = mix(h[at] + np.uint64(size))
    h[literal] = _by_value(tokens, at[literal], size)
    return at, h, literal


def value_windows(tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash by value) of the windows in which an item of `size` tokens may be found by value: all, or, for
    items below SHORTEST, those that are a whole sentence or line."""
    n = len(tokens.value) - size + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    fits = tokens.text[:n] == tokens.text[size - 1 :]
    if size < SHORTEST:
        fits &= tokens.begins[:n] & tokens.last()[size - 1 :]
    at = np.flatnonzero(fits)
    return at, _by_value(tokens, at, size)


def _windows(sizes: list[int], bitmap: np.ndarray | None, short_too: bool):
    """Arrow function: (id, text) -> id, position, hash, slots, literal, size, total (windows of the text), templates (those
    not literal). With a bitmap only windows that may match; with short_too a text of fewer than WINDOW tokens is one
    window of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in chunks(batch.column(1), NOT_ALNUM, b".,"):
                tokens = templates(words)
                signed, counts = tokens.value.view(np.int64), np.diff(tokens.first)
                found: list[tuple[np.ndarray, ...]] = []
                for size in sizes:
                    made = []
                    if size >= SHORTEST:
                        made.append((*window_hashes(tokens, size), size))
                    if size < WINDOW:  # by value as well, where the template is not by value already
                        at, h = value_windows(tokens, size)
                        new = np.ones(len(at), bool) if not made else ~np.isin(at, made[0][0][made[0][2]])
                        made.append((at[new], h[new], np.ones(int(new.sum()), bool), 0))
                    for at, h, literal, listed in made:
                        some = np.ones(len(at), bool) if bitmap is None else bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)]
                        if short_too and size < WINDOW:
                            some &= counts[tokens.text[at]] == size
                        found.append((at[some], h[some], literal[some], *(np.full(int(some.sum()), x) for x in (size, listed))))
                at, h, literal, size, listed = (np.concatenate(x) for x in zip(*found, strict=True))
                per_text, plain = (np.maximum(0, counts - WINDOW + 1) if len(counts) else counts for _ in range(2))
                if bitmap is None:  # only items need them
                    plain = np.bincount(tokens.text[at[~literal]], minlength=len(counts))
                    per_text = np.where(counts < WINDOW, np.minimum(counts, 1), per_text)
                running = np.concatenate([[0], np.cumsum(tokens.slot)])
                where = np.flatnonzero(tokens.slot)
                slots = [signed[where[running[i] : running[i + s]]] for i, s in zip(at, listed, strict=True)]
                text = tokens.text[at]
                ids = batch.column(0).take(pa.array(a + text, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(at - tokens.first[:-1][text], pa.int64()), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.int64())), pa.array(literal), pa.array(size, pa.int32()), pa.array(per_text[text], pa.int64()), pa.array(plain[text], pa.int64())],
                    names=["id", "pos", "h", "slots", "literal", "size", "total", "templates"],
                )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered, coverage, n_slots, changed): one row per document and item it leaks.

    n_windows: windows of the item; n_covered: those found in the document with consistent slots; changed: some slot
    value differs (the question was re-parameterised). Windows with more than half slots are found with equal values
    only; n_windows and n_covered leave them out where the others alone are covered no less (with new values these
    could not be). Items of 4 to 7 words are one window, found by template or by value; items of fewer are found by value
    where they are a whole sentence or line of the document. Null and empty texts match nothing, rows with a null
    id are not reported, repeated rows add nothing, an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    schema = "id long, pos long, h long, slots array<long>, literal boolean, size int, total long, templates long"
    of = lambda df, key: df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sizes = list(range(1, WINDOW + 1))
    items = materialize(of(benchmark, "item_id").distinct().mapInArrow(_windows(sizes, None, True), schema), "benchmark-windows")
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[[r[0] for r in items.select(F.shiftrightunsigned("h", 64 - BITS).cast("int")).distinct().collect()]] = True  # at most 2**BITS places
    used = sorted(r[0] for r in items.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW sizes
    seen = of(docs, "doc_id").mapInArrow(_windows(used, bitmap, False), schema)
    item = items.select(F.col("id").alias("item_id"), "h", F.col("pos").alias("at"), F.col("slots").alias("values"), "literal", "total", "templates")
    found = seen.select(F.col("id").alias("doc_id"), "pos", "h", "slots").join(item, "h").where(F.size("slots") == F.size("values"))
    # One diagonal holds each window of an item once at most, so a group is as large as the item.
    lines = found.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set(F.struct("at", "literal")).alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("values", "slots")))).alias("pairs"), F.max("total").alias("total"), F.max("templates").alias("templates")
    )
    distinct = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: p[name])))
    n = F.size("pairs")
    lines = lines.where(F.least(distinct("values"), distinct("slots")) >= CONSISTENT * n)
    lines = lines.select("doc_id", "item_id", "total", "templates", n.alias("n_slots"), F.exists("pairs", lambda p: p["values"] != p["slots"]).alias("changed"), F.explode("at").alias("at"))
    at, template = F.col("at.at"), ~F.col("at.literal")
    out = lines.groupBy("doc_id", "item_id").agg(
        F.max("total").alias("total"), F.max("templates").alias("templates"), F.count_distinct(at).alias("all"), F.count_distinct(F.when(template, at)).alias("plain"), F.max("n_slots").cast("long").alias("n_slots"), F.bool_and("changed").alias("changed")
    )
    by_template = F.coalesce(F.col("plain") * F.col("total") >= F.col("all") * F.col("templates"), F.lit(False)) & (F.col("templates") > 0)
    out = out.select("doc_id", "item_id", F.when(by_template, F.col("templates")).otherwise(F.col("total")).alias("n_windows"), F.when(by_template, F.col("plain")).otherwise(F.col("all")).alias("n_covered"), "n_slots", "changed")
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_windows")).where(F.col("coverage") >= covered)


def decontaminate(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The documents that leak no item, all columns kept; rows with a null id are kept, rows that repeat an id go or stay
    together, an empty table gives an empty result."""
    return docs.join(leaks(docs, benchmark, covered).select("doc_id").distinct(), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
