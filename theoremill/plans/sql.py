"""The projection of the driver's tables in SQL: shared common table expressions of the oracles."""

from functools import lru_cache

from theoremill.functions.names import _class, word_classes

_MODULES = "mods AS (SELECT n_nationkey, replace(r_name, ' ', '_') || '.' || replace(n_name, ' ', '_') AS module FROM nation JOIN region ON n_regionkey = r_regionkey)"
_CUST = "cust AS (SELECT c_custkey AS key, module || '.cust' || c_custkey || ' ' || c_custkey AS id, module FROM customer JOIN mods ON c_nationkey = n_nationkey)"
_SUPP = "supp AS (SELECT s_suppkey AS key, module || '.supp' || s_suppkey || ' ' || s_suppkey AS id, module FROM supplier JOIN mods ON s_nationkey = n_nationkey)"
_PARTS = "parts AS (SELECT p_partkey AS key, 'ext.' || p_brand || '.part' || p_partkey || ' ' || p_partkey AS id, 'ext.' || p_brand AS module FROM part)"
_DEFS = """defs AS (SELECT id AS def_id, key AS ord, ':function' AS def_type, module AS module_name, true AS is_internal FROM cust
 UNION ALL SELECT id, key + 1000000000000, ':data', module, true FROM supp UNION ALL SELECT id, key + 2000000000000, ':constructor', module, false FROM parts)"""
_SOLD = "sold AS (SELECT o_custkey, o_orderkey, o_orderstatus, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_REFS = """body AS (SELECT c.id AS src, p.id AS dst, 'REFERENCE_BODY' AS edge_type, count(*)::BIGINT AS w FROM sold JOIN cust c ON o_custkey = c.key JOIN parts p ON l_partkey = p.key GROUP BY 1, 2),
tref AS (SELECT c.id AS src, s.id AS dst, 'REFERENCE_TYPE' AS edge_type, count(*)::BIGINT AS w FROM sold JOIN cust c ON o_custkey = c.key JOIN supp s ON l_suppkey = s.key GROUP BY 1, 2),
refs AS (SELECT * FROM body UNION ALL SELECT * FROM tref)"""
_META = """prefixes AS (SELECT DISTINCT is_internal, unnest(list_transform(range(1, len(string_split(module_name, '.')) + 1), lambda i: array_to_string(string_split(module_name, '.')[1:i], '.'))) AS dst FROM defs),
meta AS (SELECT module_name AS src, def_id AS dst, 'DEFINES' AS edge_type FROM defs
 UNION ALL SELECT DISTINCT CASE WHEN contains(dst, '.') THEN regexp_extract(dst, '^(.*)\\.[^.]*$', 1) WHEN is_internal THEN 'library_tpch' ELSE 'external source' END, dst, 'CONTAINS' FROM prefixes),
edges AS (SELECT * FROM refs UNION ALL SELECT src, dst, edge_type, NULL::BIGINT FROM meta)""".replace("\\\\", "\\")
_HELP = """helps AS (SELECT o_orderkey, c.id AS customer, any_value(c.module) || '.with-' || o_orderkey || ' ' || o_orderkey AS first, any_value(c.module) || '.with-' || o_orderkey || ' 2' || o_orderkey AS second,
  bool_or(l_linenumber > 4) AS has_second FROM sold JOIN cust c ON o_custkey = c.key GROUP BY o_orderkey, c.id),
owners AS (SELECT first AS helper, customer AS owner, customer AS root FROM helps UNION ALL SELECT second, first, customer FROM helps WHERE has_second)"""
_VEC = "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings)"


def split_words(column: str) -> str:
    """A1 without look-arounds: pairs of characters are parted, twice, as pairs overlap."""
    c = word_classes()
    not_both = lambda name: f"[{c[name]}]"
    sql = f"regexp_replace({column}, '([^{c['letter']}{c['number']}])', ' \\1 ', 'g')"
    numbers, letters = _without("number"), _without("letter")
    for left, right in ((numbers, letters), (letters, numbers), (_without("low"), not_both("up")), (f"[{c['both']}]", _without("up"))):
        for _ in range(2):
            sql = f"regexp_replace({sql}, '({left})({right})', '\\1 \\2', 'g')"
    plain = f"regexp_replace({column}, '([^A-Za-z0-9])', ' \\1 ', 'g')"
    for pair in ("([0-9])([A-Za-z])", "([A-Za-z])([0-9])", "([a-z])([A-Z])"):
        plain = f"regexp_replace({plain}, '{pair}', '\\1 \\2', 'g')"
    parted = f"CASE WHEN strlen({column}) = length({column}) THEN {plain} ELSE {sql} END"
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({parted}, '[_.-]', ' ', 'g')), '\\s+'), lambda w: w <> '')"


@lru_cache(8)
def _without(name: str) -> str:
    """A class less the characters that are both letters and numbers."""
    tests = {"number": str.isnumeric, "letter": str.isalpha, "low": lambda c: c.isalpha() and c.lower() == c, "up": lambda c: c.isalpha() and c.upper() == c}
    return f"[{_class(lambda c: tests[name](c) and not (c.isalpha() and c.isnumeric()))}]"


def library(body: str, *more: str, recursive: bool = False) -> str:
    """The body after the projection's expressions (unused ones cost nothing)."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join((_MODULES, _CUST, _SUPP, _PARTS, _DEFS, _SOLD, _REFS, _META, _HELP, _VEC, *more)) + "\n" + body
