"""Column expressions on qualified names, edge types, node types and words. All native, no Python workers."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edge types; a normal type and its forms for helper targets.
DEFINES, CONTAINS = "DEFINES", "CONTAINS"
TYPE, BODY = "REFERENCE_TYPE", "REFERENCE_BODY"
TO_WITH, TO_REWRITE = "_TO_WITH", "_TO_REWRITE"
EDGE_TYPES = (DEFINES, CONTAINS, TYPE, BODY, TYPE + TO_WITH, BODY + TO_WITH, TYPE + TO_REWRITE, BODY + TO_REWRITE)
# Node tags.
NAME_TAGS = (":name", ":module-name")
MODULE_TAGS = (":module", ":module-like", ":library")
EXTERNAL = ":external"
NOT_A_DEFINITION = "not a definition"


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "\\."), -1)


def is_with(name: Column) -> Column:
    """the last dot segment is `with-N N`."""
    return last_segment(name).rlike(r"^with-\d+ \d+$")


def is_rewrite(name: Column) -> Column:
    """the last dot segment is `-rewriteN N`."""
    return last_segment(name).rlike(r"^-rewrite\d+ \d+$")


def is_normal(name: Column) -> Column:
    """neither kind of helper."""
    return ~is_with(name) & ~is_rewrite(name)


def is_name_tag(tag: Column) -> Column:
    """F4."""
    return tag.isin(*NAME_TAGS)


def unquoted(tag: Column, description: Column) -> Column:
    """a name without its quotes; an unquoted description, or a module name with a space, is an error."""
    ok = (F.length(description) >= 2) & description.startswith('"') & description.endswith('"') & ((tag != ":module-name") | ~description.contains(" "))
    return F.when(F.assert_true(ok, F.concat(F.lit("not a name: "), description)).isNull(), F.substring(description, F.lit(2), F.length(description) - 2))


def edge_type_is_reference(kind: Column) -> Column:
    return kind.startswith("REFERENCE")


def edge_type_is_normal_reference(kind: Column) -> Column:
    return kind.isin(TYPE, BODY)


def edge_type_is_normal(kind: Column) -> Column:
    return kind.isin(TYPE, BODY, DEFINES, CONTAINS)


def to_normal(kind: Column) -> Column:
    """The normal form of a reference type (with and rewrite forms lose their suffix)."""
    return F.regexp_replace(kind, f"({TO_WITH}|{TO_REWRITE})$", "")


def reference_type(section: Column, target: Column) -> Column:
    """Section is TYPE or BODY; the target's name decides the form."""
    return F.concat(section, F.when(is_with(target), TO_WITH).when(is_rewrite(target), TO_REWRITE).otherwise(""))


def edge_type_dimension(spark: SparkSession) -> DataFrame:
    """edge_type, is_reference, is_normal, normal_form."""
    kinds = spark.createDataFrame([(k,) for k in EDGE_TYPES], "edge_type string")
    kind = F.col("edge_type")
    return kinds.select(kind, edge_type_is_reference(kind).alias("is_reference"), edge_type_is_normal(kind).alias("is_normal"), to_normal(kind).alias("normal_form"))


def is_external(tag: Column) -> Column:
    return tag.startswith(EXTERNAL)


def is_module(tag: Column) -> Column:
    return tag.isin(*MODULE_TAGS)


def is_definition_tag(tag: Column) -> Column:
    return ~is_module(tag)


def parent_name(name: Column) -> Column:
    """what stands before the last dot, '' if there is none."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def display_name(name: Column) -> Column:
    """cut at the space, then the last dot segment."""
    return last_segment(F.substring_index(name, " ", 1))


def export_label(tag: Column) -> Column:
    return F.replace(F.replace(tag, F.lit(":"), F.lit("")), F.lit("-"), F.lit("_"))


def export_labels(tag: Column, external: Column) -> Column:
    """label list: meta nodes are also `module_like`, external ones also `external`."""
    return F.array_compact(F.array(F.when(is_module(tag), "module_like"), export_label(tag), F.when(external, "external")))


def module_prefixes(name: Column) -> Column:
    """All dotted prefixes of a module name, shortest first."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def _class(test) -> str:
    """The characters that pass a test, as the inside of a regular expression's class."""
    found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and test(chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}" if a == z else f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in runs)


@lru_cache(1)
def word_classes() -> dict[str, str]:
    """A1's classes, by what characters are and not by a regular expression's idea of them: letters, numbers (some are
    both, as the Han numerals), letters that are their own lower or upper form (caseless ones are both)."""
    return {
        "letter": _class(str.isalpha),
        "number": _class(str.isnumeric),
        "both": _class(lambda c: c.isalpha() and c.isnumeric()),
        "low": _class(lambda c: c.isalpha() and c.lower() == c),
        "up": _class(lambda c: c.isalpha() and c.upper() == c),
    }


def split_words(text: Column) -> Column:
    """A1, A2: words of names and texts: runs of numbers, runs of letters cut where a letter that is its own lower form
    meets one that is its own upper form, other signs alone; `_ - .` and spaces part words; lowered; no empty words."""
    c = word_classes()
    # The listed classes are long: properties of the expression's own rule them out first where they can.
    # Characters that the JVM does not know yet (Cn) are looked up there.
    may_count = r"[\p{N}\p{Lo}\p{Cn}]"
    letter = rf"[\p{{L}}[\p{{Cn}}&&[{c['letter']}]]]"
    one_number = f"(?<={may_count})(?={may_count})(?<=[{c['number']}])(?=[{c['number']}])"
    one_word = rf"(?<={letter})(?={letter})(?!(?![a-zà-öø-ÿ])(?<=[{c['low']}])(?=[{c['up']}]))"
    # The last part never matches; its literal tells the JVM that a character may take two units when it looks behind.
    general = rf"(?<=[\s\S])(?=[\s\S])(?!{one_word})(?!{one_number})(?![^\s\S]\U00010000)".replace("\\U00010000", "\U00010000")
    plain = "(?<=[^0-9A-Za-z])(?=[\\s\\S])|(?<=[0-9])(?=[^0-9])|(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[a-z])(?=[A-Z])"
    s = F.when(text.rlike(r"^[\x00-\x7f]*$"), F.regexp_replace(text, plain, " ")).otherwise(F.regexp_replace(text, general, " "))
    return F.filter(F.split(F.lower(F.regexp_replace(s, "[_.-]", " ")), r"\s+"), lambda w: w != "")


def tree_words_text(text: Column) -> Column:
    """A3: parentheses to spaces, spaces collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[()]", " "), r"\s+", " "))


def vector_tokens(text: Column) -> Column:
    """Lowered tokens of two or more word characters (a coalesced text of no words gives an empty array)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def hash_order(seed: int, *parts: Column) -> Column:
    """A deterministic shuffle key: md5 of the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def parameter_key(**parameters) -> str:
    """A stable key of parameters."""
    return "@".join(f"{k}={parameters[k]}" for k in sorted(parameters))
