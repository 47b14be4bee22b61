"""PII surrogates: detected entities get keyed, type-consistent replacements.

Each replacement is a keyed permutation of the entity's own domain (a balanced Feistel network over the classes of its
characters, walked on until the result is valid where the entity was; a domain of one symbol has a keyed cycle): equal
entities have equal surrogates in all documents (coreference), different ones never share one (distinctness), and
format, script and gender stay. No table of entities has to be gathered or joined: it is one narrow pass.

Collisions are checked where each surrogate is made: it is turned back by the inverse permutation and must give its
entity. A map that can be turned back on all entities of a corpus has no two of them on one surrogate. `collisions`
checks the same by aggregation over the whole corpus, and `met_again` names surrogates that other documents hold as
entities of their own.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import prepare

# Common given names by gender, titles by gender, family names written before the given name.
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Ashley Emily Anna Maria Laura Julia Sophie Claire Camille Lucie Ingrid Heike Petra Sabine Carmen Lucia Elena Isabel Olga Irina Fatima Aisha Mei Zofia Agnieszka Katarzyna Giulia Chiara Francesca Helena Astrid Sofia Emma Hannah Marie Isabelle Beatriz Yasmin Priya Yuki".split()
MALE = "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Peter Hans Klaus Jürgen Stefan Pierre Jean Luc Antoine Carlos Miguel Javier Pablo Ivan Dmitri Omar Ahmed Wei Kenji Raj Piotr Tomasz Jakub Marco Luca Giovanni Lars Erik George Edward Henry Jack François Louis Diego Mohammed Ali Arjun Hiroshi".split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
# The same in Cyrillic and Greek script (nominative forms).
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия Анастасия Людмила Галина Надежда Вера Дарья".split()
MALE_CYRILLIC = "Иван Дмитрий Сергей Александр Алексей Андрей Михаил Николай Владимир Павел Пётр Юрий Виктор Олег Игорь Борис".split()
FEMALE_GREEK = "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα Άννα Ειρήνη".split()
MALE_GREEK = "Γεώργιος Ιωάννης Δημήτριος Κωνσταντίνος Νικόλαος Παναγιώτης Βασίλειος Αλέξανδρος Ανδρέας Γιώργος Γιάννης Νίκος".split()
TITLES |= {"Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
HAN_FAMILY = "王李张刘陈杨黄赵周吴徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HAN_TITLES = ("先生", "女士", "小姐", "太太")
# Alphabets whose letters are exchanged among themselves.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñßšžčćđłńśź", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: (alphabet, i) for alphabet in ALPHABETS for i, c in enumerate(alphabet)}
_POOL = {"f": FEMALE, "m": MALE, "f|cyrillic": FEMALE_CYRILLIC, "m|cyrillic": MALE_CYRILLIC, "f|greek": FEMALE_GREEK, "m|greek": MALE_GREEK}
_GENDER = {name: gender for gender, pool in _POOL.items() for name in pool}
ROUNDS = 10


def _stream(key: bytes, label: bytes, n: int) -> list[int]:
    """n keyed 32-bit numbers."""
    out, block = [], 0
    while len(out) < n:
        digest = hashlib.blake2b(label + block.to_bytes(4, "big"), key=key[:64], digest_size=64).digest()
        out += [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 64, 4)]
        block += 1
    return out[:n]


class Inverse(bytes):
    """A key that turns surrogates back."""


@lru_cache(512)
def _cycle(radix: int, key: bytes, shape: bytes) -> tuple[dict[int, int], dict[int, int]]:
    """A keyed cycle through all of radix symbols, and its inverse: no symbol stays unless it is the only one."""
    order = sorted(range(radix), key=lambda i: hashlib.blake2b(shape + i.to_bytes(4, "big"), key=key[:64], digest_size=8).digest())
    follow = dict(zip(order, order[1:] + order[:1], strict=True))
    return follow, {b: a for a, b in follow.items()}


def permute(symbols: list[int], radices: list[int], key: bytes, domain: str) -> list[int]:
    """A keyed bijection of the sequences with these radices: halves are shifted in turn by a keyed function of the
    other half; a single symbol follows a keyed cycle. With an Inverse key, the inverse."""
    s = list(symbols)
    n = len(s)
    back = isinstance(key, Inverse)
    shape = f"{domain}|{','.join(map(str, radices))}|".encode()
    if n == 1:
        return [_cycle(radices[0], bytes(key), shape)[back][s[0]]]
    halves = [range(0, n, 2), range(1, n, 2)]
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        mine, other = halves[r % 2], halves[1 - r % 2]
        shift = _stream(bytes(key), shape + bytes([r]) + b",".join(str(s[i]).encode() for i in other), len(mine))
        for i, by in zip(mine, shift, strict=True):
            s[i] = (s[i] - by if back else s[i] + by) % radices[i]
    return s


def _upper(letter: str) -> str:
    return "ẞ" if letter == "ß" else letter.upper()


def _letters(text: str, key: bytes, domain: str, alphabet_of: Callable[[str], tuple[str, int] | None] = _CLASS.get) -> str:
    """Exchange characters within their alphabets; case and all other characters stay where they are."""
    low = text.lower() if len(text.lower()) == len(text) else text
    found = [(i, alphabet_of(c)) for i, c in enumerate(low)]
    places = [(i, c) for i, c in found if c]
    new = permute([c[1] for _, c in places], [len(c[0]) for _, c in places], key, domain)
    out = list(text)
    for (i, c), v in zip(places, new, strict=True):
        letter = c[0][v]
        out[i] = _upper(letter) if text[i] != low[i] and len(_upper(letter)) == 1 else letter
    return "".join(out)


def _walk(value: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """Apply a permutation until the result is as valid as the value was: a bijection of that subset. A subset's last
    resort, a cycle of one, stays as it is."""
    kind = valid(value)
    new = step(value)
    while valid(new) != kind:
        new = step(new)
    return new


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([int(c) for c in digits])):
        total += c if i % 2 == 0 else c * 2 - 9 * (c > 4)
    return total % 10 == 0


def _digits_apart(text: str, change: Callable[[str], str]) -> str:
    """Change the digits of a text, its other characters staying in place: spellings of one number agree."""
    new = iter(change("".join(c for c in text if c.isascii() and c.isdigit())))
    return "".join(next(new) if c.isascii() and c.isdigit() else c for c in text)


def _fixed_labels(domain: str) -> int:
    """Labels of a domain that stay: the last one, and `example` before it (reserved for examples)."""
    labels = domain.lower().split(".")
    return 2 if labels[-2] == "example" and len(labels) > 2 else 1


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.partition("@")
    labels, fixed = domain.split("."), _fixed_labels(domain)
    head, tail = ".".join(labels[:-fixed]), "." + ".".join(labels[-fixed:])
    # One permutation over the whole address, the public suffix being fixed.
    step = lambda s: _letters(s, key, f"email|{tail.lower()}")
    return _walk(f"{local}@{head}", step, lambda s: _fixed_labels(s.partition("@")[2] + tail) == fixed) + tail


def _ipv4(text: str, key: bytes) -> str:
    usable = lambda s: s.split(".")[0] not in ("0", "127") and int(s.split(".")[0]) < 224
    step = lambda s: ".".join(map(str, permute([int(x) for x in s.split(".")], [256] * 4, key, "ipv4")))
    return _walk(".".join(str(int(x)) for x in text.split(".")), step, usable)


def _is_ipv6(text: str) -> bool:
    """Loopback and unspecified addresses are nobody's, and without a digit it may be a scope (dead::beef)."""
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return _DIGIT.search(text) is not None and not (address.is_loopback or address.is_unspecified)


def _ipv6(text: str, key: bytes) -> str:
    groups = [int(x, 16) for x in ipaddress.IPv6Address(text).exploded.split(":")]
    return ":".join(f"{x:x}" for x in permute(groups, [65536] * 8, key, "ipv6"))


def _card(text: str, key: bytes) -> str:
    return _digits_apart(text, lambda d: _walk(d, lambda s: _letters(s, key, "card"), _luhn))


def _phone(text: str, key: bytes) -> str:
    code = re.match(r"\+\d{1,3}(?=\D)", text)
    head = code[0] if code else ""
    return head + _digits_apart(text[len(head) :], lambda d: _letters(d, key, f"phone|{head}"))


def _iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "").upper()
    check = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if check(plain) == 1:
        body = _letters(plain[4:], key, f"iban|{plain[:2]}|")
        made = plain[:2] + f"{98 - check(plain[:2] + '00' + body):02d}" + body
    else:
        step = lambda s: s[:4] + _letters(s[4:], key, f"iban|{s[:4]}")
        made = _walk(plain, step, lambda s: check(s) == 1)
    new = iter(made)
    return "".join(c if c == " " else next(new) for c in text)


def _secret(text: str, key: bytes) -> str:
    hexes = "0123456789abcdef"
    if all(c in hexes for c in text):
        return _letters(text, key, "hex", lambda c: (hexes, hexes.index(c)))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = [a for a in (lower, upper, digits)]
    places = [(i, a, a.index(c)) for i, c in enumerate(text) for a in sets if c in a]

    def step(value: str) -> str:
        now = [(i, a, a.index(value[i])) for i, a, _ in places]
        new = permute([v for _, _, v in now], [len(a) for _, a, _ in now], key, "secret")
        out = list(value)
        for (i, a, _), v in zip(now, new, strict=True):
            out[i] = a[v]
        return "".join(out)

    return _walk(text, step, lambda s: all(c in hexes for c in s))


def _given(word: str, gender: str, key: bytes) -> str:
    known = _GENDER.get(word)
    if known:
        pool = _POOL[known]
        return pool[permute([pool.index(word)], [len(pool)], key, f"given|{known}")[0]]
    return _walk(word, lambda s: _letters(s, key, f"given|{gender}"), lambda s: s in _GENDER)


def _person(text: str, key: bytes) -> str:
    parts = re.split(r"(\s+)", text)
    out, gender = [], ""
    names = [p for p in parts if p.strip() and p.rstrip(".") not in TITLES]
    for p in parts:
        bare = p.rstrip(".")
        if not p.strip():
            out.append(p)
        elif bare in TITLES:
            gender = TITLES[bare]
            out.append(p)
        elif len(names) > 1 and p is names[0]:
            out.append(_given(p, gender, key))
        else:
            out.append(_letters(p, key, "surname"))
    return "".join(out)


_HAN_GIVEN = "".join(chr(i) for i in range(0x4E00, 0x9FA6) if chr(i) not in HAN_FAMILY)
_HAN_CLASS = {c: (alphabet, i) for alphabet in (HAN_FAMILY, _HAN_GIVEN) for i, c in enumerate(alphabet)}


def _han(text: str, key: bytes) -> str:
    """Family names among themselves, other characters likewise."""
    return _letters(text, key, "han", _HAN_CLASS.get)


_GROUP = "[0-9a-fA-F]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿœšžčćđłńśź'’-]+|[А-ЯЁ][а-яё'’-]+|[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ'’-]+)"
_GIVEN = "|".join(sorted(_GENDER, key=len, reverse=True))
#: kind -> (pattern, group that holds the entity, surrogate), in order of precedence.
DETECTORS: dict[str, tuple[re.Pattern, int, Callable[[str, bytes], str]]] = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), 0, _email),
    "secret": (re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b\s*[:=]\s*[\"']?([A-Za-z0-9_+/-]{12,})"), 1, _secret),
    "hash": (re.compile(r"\b[0-9a-f]{32,128}\b"), 0, _secret),
    "iban": (re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0, _iban),
    "ipv6": (re.compile(rf"(?<!\w)(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?!\w|:[0-9a-fA-F:])"), 0, _ipv6),
    "ipv4": (re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"), 0, _ipv4),
    "ssn": (re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0, lambda t, k: _digits_apart(t, lambda d: _letters(d, k, "ssn"))),
    "phone": (re.compile(r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"), 0, _phone),
    "card": (re.compile(r"(?<![\d-])\d(?:\d{12,18}|(?:[ -]?\d){12,18})(?![\d-])"), 0, _card),
    "person": (re.compile(rf"\b(?:{'|'.join(TITLES)})\.?(?:\s{_NAME}){{1,4}}|\b(?=[A-ZÀ-ÞА-ЯΆ-Ω])(?:{_GIVEN})(?:\s{_NAME}){{1,3}}"), 0, _person),
    "han_person": (re.compile(rf"(?<![\u4e00-\u9fa5])[{HAN_FAMILY}][\u4e00-\u9fa5]{{1,2}}(?![\u4e00-\u9fa5])|[{HAN_FAMILY}][\u4e00-\u9fa5]{{0,2}}?(?=(?:{'|'.join(HAN_TITLES)}))"), 0, _han),
}
_DIGIT = re.compile("[0-9]")
_HAN = re.compile("[\u4e00-\u9fa5]")
_TWO_NAMES = re.compile(rf"{_NAME}\s{_NAME}|(?:{'|'.join(TITLES)})\.\s")


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities in order, not overlapping; earlier kinds take precedence."""
    has_digit = _DIGIT.search(text) is not None
    taken: list[tuple[int, int, str]] = []  # in order of their places
    for kind, (pattern, group, _) in DETECTORS.items():
        if kind == "email":
            if "@" not in text:
                continue
        elif kind == "person":
            if not _TWO_NAMES.search(text):
                continue
        elif kind == "han_person":
            if text.isascii() or not _HAN.search(text):
                continue
        elif kind not in ("secret", "hash") and (not has_digit or kind == "ipv6" and text.count(":") < 2):
            continue
        elif kind == "secret" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            a, z = m.span(group)
            if kind == "ipv6" and not _is_ipv6(m[0]) or kind == "card" and not _luhn("".join(c for c in m[0] if c.isdigit())):
                continue
            at = bisect_left(taken, (a,))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= z):
                taken.insert(at, (a, z, kind))
    return taken


def normal(kind: str, entity: str) -> str:
    """What makes two spellings one entity: no case, spaces or number separators; persons without dots; addresses by
    value."""
    if kind in ("person", "han_person"):
        return re.sub(r"\s+", " ", entity.replace(".", "")).lower()
    if kind == "ipv6":
        return _exploded(entity)
    return entity if kind == "ipv4" else re.sub(r"[\s().-]", "", entity).lower()


class CollisionError(ValueError):
    """A surrogate that can't be turned back to its entity, so that another entity may share it."""


def surrogate(kind: str, entity: str, key: bytes) -> str:
    return DETECTORS[kind][2](entity, key)


def restore(kind: str, replacement: str, key: bytes) -> str:
    """The entity of a surrogate, in the surrogate's spelling."""
    return DETECTORS[kind][2](replacement, Inverse(key))


def replace_entities(text: str, key: bytes) -> tuple[str, list[dict]]:
    out, spans, at, shift = [], [], 0, 0
    for a, z, kind in find_entities(text):
        new = surrogate(kind, text[a:z], key)
        if normal(kind, restore(kind, new, key)) != normal(kind, text[a:z]):
            raise CollisionError(kind)  # the entity itself stays out of logs
        out += [text[at:a], new]
        spans.append({"kind": kind, "start": a, "length": z - a, "new_start": a + shift, "replacement": new})
        shift += len(new) - (z - a)
        at = z
    return ("".join(out) + text[at:] if out else text), spans


SPAN = "array<struct<kind string, start int, length int, new_start int, replacement string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("new_start", pa.int32()), ("replacement", pa.string())]))


def replace_pii(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """All columns of docs with `text` replaced, and `pii_spans`: kind, start and length in the old text, start in the
    new one, replacement.

    Null texts stay null, texts without entities stay as they are; texts have any length. Rows that repeat are each
    returned, equal texts with equal replacements; an empty table gives an empty result. A column named pii_spans is
    overwritten. Every surrogate is checked to turn back to its entity (CollisionError, which fails the job).
    """
    prepare(docs.sparkSession)
    secret = key.encode()
    kept = [f for f in docs.schema.fields if f.name not in ("text", "pii_spans")]
    chosen = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(None, []) if t is None else replace_entities(t, secret) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in made], pa.string()), pa.array([s for _, s in made], _SPAN)], names=[*batch.schema.names, "pii_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    out = chosen.mapInArrow(run, f"{schema}, pii_spans {SPAN}")
    return out.select(*(f"`{c}`" for c in docs.columns if c != "pii_spans"), "pii_spans")


def _exploded(text: str) -> str:
    try:
        return ipaddress.IPv6Address(text).exploded
    except ValueError:
        return text


def _pairs(docs: DataFrame, replaced: DataFrame, key_column: str) -> DataFrame:
    """kind, entity, replacement (both normal) of all spans, each once: slim rows, aggregated by hash."""
    prepare(docs.sparkSession)
    spans = docs.select(key_column, "text").distinct().join(replaced.select(key_column, "pii_spans").distinct().select(key_column, F.explode("pii_spans").alias("s")), key_column)
    ipv6 = F.udf(_exploded, "string")
    joined = lambda c: F.lower(F.regexp_replace(c, r"[\s().-]", ""))
    name = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\.", ""), r"\s+", " "))
    plain = lambda c: F.when(F.col("s.kind") == "ipv4", c).when(F.col("s.kind") == "ipv6", ipv6(c)).when(F.col("s.kind").isin("person", "han_person"), name(c)).otherwise(joined(c))
    return spans.select(F.col("s.kind").alias("kind"), plain(F.expr("substring(text, s.start + 1, s.length)")).alias("entity"), plain(F.col("s.replacement")).alias("replacement")).distinct()


def collisions(docs: DataFrame, replaced: DataFrame, key_column: str = "doc_id") -> DataFrame:
    """Surrogates that stand for more than one entity, and entities with more than one: (kind, entity, replacement,
    n); empty if the promise holds.

    Entities are compared as `normal` has them, which is how coreference sees them; all kinds are covered. The key tells
    documents apart: rows that repeat it count once if they are equal, rows with a null key are not covered. Null texts
    and empty tables give nothing. A check over all documents.
    """
    pairs = _pairs(docs, replaced, key_column)
    shared = pairs.groupBy("kind", "replacement").agg(F.count("*").alias("n"), F.min("entity").alias("entity")).where("n > 1")
    torn = pairs.groupBy("kind", "entity").agg(F.count("*").alias("n"), F.min("replacement").alias("replacement")).where("n > 1")
    return shared.select("kind", "entity", "replacement", "n").unionAll(torn.select("kind", "entity", "replacement", "n"))


def met_again(docs: DataFrame, replaced: DataFrame, key_column: str = "doc_id") -> DataFrame:
    """(kind, entity, replacement): surrogates that the corpus also holds as an entity of its own, elsewhere. They tear no
    reference, as that entity is replaced as well; in small domains (given names) they can't be avoided. Rows and nulls
    as in `collisions`."""
    pairs = _pairs(docs, replaced, key_column)
    return pairs.join(pairs.select("kind", F.col("entity").alias("replacement")).distinct(), ["kind", "replacement"], "left_semi").select("kind", "entity", "replacement")
