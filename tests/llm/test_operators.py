"""Each operator on odd rows (see conftest), on empty tables, and on cases made by hand."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from theoremill.llm import chat, decontam, langid, neardup, packing, pii, quality, sharding, textbytes, tiff, toxicity


def jaccard_components(texts, size, percent):
    """Brute force: smallest id of each component."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate(table)) if x]
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def near_copies(seed=3, bases=12, each=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, each)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[k] = " ".join(copy)
            k += 1
    return texts


def test_texts_are_thinned_before_they_are_sent(spark):
    texts = spark.range(20_000).select((F.col("id") * 7919 - 9_000_000).alias("doc_id"), F.lit("t").alias("text")).unionAll(spark.createDataFrame([(None, "t")], "doc_id long, text string"))
    members = texts.where("doc_id % 10 = 0").select("doc_id")
    left = {r[0] for r in neardup.only_members(texts, members.unionAll(members)).select("doc_id").collect()}
    want = {r[0] for r in members.collect()}
    assert want <= left and len(left - want) < 20 and None not in left


@pytest.mark.parametrize("block", [neardup.BLOCK_SHINGLES, 150])
@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(spark, size, block):
    texts = near_copies()
    want, sizes = jaccard_components(texts, size, 80)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = neardup.near_duplicates(docs, size, 80, block_shingles=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_region(spark):
    """More similar signatures than one region compares at once, with strangers among them."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    texts = {i: " ".join([*base, *(f"x{rng.randrange(10**6)}" for _ in range(2))]) for i in range(700)}
    texts |= {1000 + i: " ".join(base[:30] + [f"y{i}_{j}" for j in range(40)]) for i in range(40)}
    want, _ = jaccard_components(texts, 4, 80)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def family(rng, each, shared, own, swap):
    """Texts that share a block of words, and for each a partner that differs from it in a few words."""
    base, texts = [f"b{i}" for i in range(shared)], {}
    for i in range(each):
        tail = [f"t{i}_{rng.randrange(10**6)}" for _ in range(own)]
        texts[i] = " ".join([*base, *tail])
        texts[each + i] = " ".join([*base, *tail[: own - swap], *(f"p{i}_{j}" for j in range(swap))])
    return texts


def test_link_sets_against_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(30):
        base = [np.unique(rng.integers(0, 60 if trial % 2 else 10**6, rng.integers(1, 40))).astype(np.uint64) for _ in range(8)]
        sets = []
        for _ in range(60):
            s = base[rng.integers(8)]
            keep = s[rng.random(len(s)) < rng.choice([1.0, 0.95, 0.85])]
            sets.append(keep if len(keep) else s)
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                n = len(np.intersect1d(a, b))
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
        assert neardup.link_sets(sets, 80) == [find(i) for i in range(len(sets))]


def test_many_small_sets_are_no_quadratic_work():
    """Tens of thousands of strangers of 16 shingles, some of them frequent, and a few links."""
    import time

    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**62, 13), rng.integers(0, 50, 3)])).astype(np.uint64) for _ in range(40_000)]
    sets[30_000] = sets[5].copy()
    begin = time.perf_counter()
    got = neardup.link_sets(sets, 80)
    assert time.perf_counter() - begin < 60
    assert got[30_000] == 5 and sum(i != g for i, g in enumerate(got)) == 1


def test_links_between_blocks_of_a_large_group(spark):
    """Partners at 0.8 in a family at 0.65, spread over several blocks."""
    texts = family(random.Random(5), 60, 160, 40, 21)
    want, _ = jaccard_components(texts, 4, 80)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 80, block_shingles=2000).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == 60


def crowded(n):
    """(tree, key, doc_id, sketch): strangers in one region of tree 1, i and n + i being alike; a row before and after."""
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 256, (2 * n + 2, neardup.VALUES), dtype=np.uint8)
    sketch[n : 2 * n] = sketch[:n]
    sketch[n : 2 * n, :14] += 1
    key = np.arange(neardup.DEPTH, dtype=">u4").tobytes()
    where = [(1, i) for i in range(2 * n)] + [(0, 2 * n), (2, 2 * n + 1)]
    return sorted((t, key, i, x.tobytes()) for (t, i), x in zip(where, sketch, strict=True))


def roots(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    return {i: find(i) for i in list(root)}


def test_recall_of_a_crowded_family():
    """Texts at 0.37 with each other, each with one partner just above 0.8: most fall into one region of some tree, and
    no pair is missed by the candidate search."""
    rng = np.random.default_rng(9)
    n, base = 1500, rng.integers(0, 2**62, 120).astype(np.uint64)
    own = rng.integers(0, 2**62, (n, 128)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, own[i, :104]])) for i in range(n)] + [np.unique(np.concatenate([base, own[i, 24:]])) for i in range(n)]
    assert all(100 * len(np.intersect1d(sets[i], sets[n + i])) >= 80 * len(np.union1d(sets[i], sets[n + i])) for i in range(50))
    sig = neardup.signatures(sets)
    sketch, pairs, largest = sig.astype(np.uint8), [], 0
    least = int(np.floor(neardup.VALUES * 0.8 - neardup.SLACK * np.sqrt(neardup.VALUES * 0.16)))
    for tree in range(neardup.TREES):
        regions = {}
        for i, key in enumerate(map(bytes, sig[:, tree * neardup.DEPTH : tree * neardup.DEPTH + neardup.MIN_DEPTH])):
            regions.setdefault(key, []).append(i)
        for ids in regions.values():
            largest = max(largest, len(ids))
            if len(ids) > 1:
                pairs += neardup._search(np.array(ids), sketch[ids], least)
    root = roots(pairs)
    assert largest > n / 2 and all(root.get(i, i) == root.get(n + i, n + i) for i in range(n))


@pytest.mark.parametrize("held", [neardup.HELD_ROWS, 2000])
def test_hidden_pairs_of_a_crowded_region(monkeypatch, held):
    monkeypatch.setattr(neardup, "HELD_ROWS", held)
    n = 1500
    columns = [pa.array(c, k) for c, k in zip(zip(*crowded(n), strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)]
    batches = pa.table(columns, names=["tree", "key", "doc_id", "sketch"]).to_batches(1000)
    rows = [r for b in neardup._neighbours(40)(iter(batches)) for r in b.to_pylist()]
    pairs = [(r["a"], r["b"]) for r in rows if r["b"] is not None]
    if held < 2 * n:  # cut rows are joined by their part
        pairs += [(r["a"], ("part", r["part"])) for r in rows if r["part"] is not None]
    else:
        assert len(pairs) == n
    root = roots(pairs)
    assert all(root.get(i, i) == root.get(n + i, n + i) for i in range(n))


def test_hidden_pairs_of_a_region_in_several_tasks(spark):
    n = 600
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neardup.candidates(spark.createDataFrame([(t, bytearray(k), i, bytearray(x)) for t, k, i, x in crowded(n)], "tree int, key binary, doc_id long, sketch binary"), 40)
        root = roots([(r["a"], r["b"]) for r in found.collect()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(root.get(i, i) == root.get(n + i, n + i) for i in range(n))


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs, 4, 80).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert by[4]["component_id"] == 3 and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert all(by[i]["component_id"] == i for i in (0, 1, 2))
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 2


def test_word_hashes_ignore_place():
    raw = [b"alpha beta", b"  beta\talpha ", b"", "größe beta".encode()]
    off = np.cumsum([0, *map(len, raw)])
    w = textbytes.words_in(np.frombuffer(b"".join(raw), np.uint8), off)
    h = w.hashes()
    assert list(w.counts()) == [2, 2, 0, 2] and h[0] == h[3] and h[1] == h[2] == h[5] and len(set(h)) == 3


# ---- PII


def test_permutation_is_a_bijection():
    seen = {tuple(pii.permute([a, b, c], [3, 5, 7], b"k", "d")) for a in range(3) for b in range(5) for c in range(7)}
    assert len(seen) == 105
    assert len({pii.surrogate("ssn", f"{i:09d}"[:3] + "-" + f"{i:09d}"[3:5] + "-" + f"{i:09d}"[5:], b"k") for i in range(3000)}) == 3000


@pytest.mark.parametrize("kind,entity", [("email", "Ann.Lee7@mail.shop.org"), ("phone", "+49 30 1234567"), ("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ipv4", "10.1.200.3"), ("secret", "sk_Live-93ABCdef0000"), ("hash", "0a" * 20)])
def test_format_is_kept(kind, entity):
    new = pii.surrogate(kind, entity, b"key")
    assert new != entity and new == pii.surrogate(kind, entity, b"key") and new != pii.surrogate(kind, entity, b"other")
    if kind != "ipv4":
        assert [c.isalpha() and (c.isupper(), c.islower()) or c.isdigit() or c for c in new] == [c.isalpha() and (c.isupper(), c.islower()) or c.isdigit() or c for c in entity] or kind in ("hash", "iban")
    if kind == "card":
        assert pii._luhn(new.replace(" ", ""))
    if kind == "iban":
        plain = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[:2] == "DE"


def test_gender_script_and_coreference():
    a, _ = pii.replace_entities("Mrs. Anna Petrova met John Miller; later John Miller wrote to anna@x.org and ANNA@X.ORG.", b"k")
    words = a.split()
    assert words[0] == "Mrs." and words[1] in pii.FEMALE and words[1] != "Anna"
    first, second = a.split("met ")[1].split(";")[0], a.split("later ")[1].split(" wrote")[0]
    assert first == second and first.split()[0] in pii.MALE
    mails = [w.strip(".") for w in words if "@" in w]
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper()
    cyrillic = pii._letters("Иванов", b"k", "surname")
    assert all("а" <= c.lower() <= "я" for c in cyrillic) and cyrillic[0].isupper()
    names = pii.FEMALE + pii.MALE
    assert len({pii._given(n, "", b"k") for n in names}) == len(set(names))


def test_pii_odd_rows(spark, odd_docs, no_docs):
    made = pii.replace_pii(odd_docs)
    assert made.columns == [*odd_docs.columns, "pii_spans"]
    assert sorted((r["text"] or "") for r in made.collect()) == sorted((r["text"] or "") for r in odd_docs.collect())
    assert pii.replace_pii(no_docs).count() == 0
    docs = spark.createDataFrame([(i, f"call +1 (212) 555-{i:04d} or mail u{i}@a.org", "x") for i in range(200)] + [(500, "call +1 212 555 0007", "x")], "doc_id long, text string, pii_spans string")
    out = pii.replace_pii(docs)
    assert pii.collisions(docs, out).count() == 0
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert digits(texts[500]) == digits(texts[7].split(" or")[0])


def test_single_symbols_follow_a_keyed_cycle():
    """Given names have no common shift, and none stays."""
    for key in (b"k", b"other", b"third"):
        to = [pii.FEMALE.index(pii._given(n, "f", key)) for n in pii.FEMALE]
        assert sorted(to) == list(range(len(to))) and all(i != t for i, t in enumerate(to))
        assert len({(t - i) % len(to) for i, t in enumerate(to)}) > 5


@pytest.mark.parametrize("kind,pool", [
    ("email", ["a.b@x.org", "A.B@X.ORG", "q@mail.example.com", "z@exampla.com", "zz9@y.example.org", "x@b.co"]),
    ("phone", ["+49 30 1234567", "+1 (212) 555-0007", "212-555-0007"]), ("card", ["4111 1111 1111 1111", "4111111111111111"]),
    ("iban", ["DE89 3704 0044 0532 0130 00", "DE00 3704 0044 0532 0130 00", "GB82WEST12345698765432"]),
    ("ipv4", ["10.1.200.3", "255.0.0.1", "127.0.0.1"]), ("ipv6", ["2001:db8::1", "fe80::1"]), ("ssn", ["123-45-6789"]),
    ("secret", ["sk_Live-93ABCdef0000", "0a" * 20, "abcdef"]), ("hash", ["0b" * 16]),
    ("person", ["Anna Lee", "Mr. James Brown", "Mrs Ünal", "Dr. Zoë Çelik-Straße", "Анна Петрова", "Mr. Иванов", "Γιάννης Παπάς"]), ("han_person", ["王小明", "李", "赵一"]),
])
def test_surrogates_turn_back(kind, pool):
    for entity in pool:
        for key in (b"k", b"q"):
            new = pii.surrogate(kind, entity, key)
            assert pii.normal(kind, pii.restore(kind, new, key)) == pii.normal(kind, entity)


def test_a_collision_fails(monkeypatch):
    pattern, group, _ = pii.DETECTORS["ssn"]
    monkeypatch.setitem(pii.DETECTORS, "ssn", (pattern, group, lambda text, key: "111-11-1111"))
    with pytest.raises(pii.CollisionError):
        pii.replace_entities("id 123-45-6789", b"k")


def test_titles_scripts_and_cards():
    for text, name in [("Yesterday Mary Smith came.", "Mary Smith"), ("Then Mrs Smith came.", "Mrs Smith"), ("Dear James Brown, hi", "James Brown"), ("met Mr. Иванов there", "Mr. Иванов"), ("with Zofia Kowalska now", "Zofia Kowalska")]:
        assert found(text) == [("person", name)]
        assert name.split()[-1] not in pii.replace_entities(text, b"k")[0]
    assert found("姓名: 王小明, 北京") == [("han_person", "王小明")] and found("我见到王小明先生了") == [("han_person", "王小明")]
    new = pii.surrogate("han_person", "王小明", b"k")
    assert len(new) == 3 and new != "王小明" and new[0] in pii.HAN_FAMILY and all("一" <= c <= "龥" for c in new)
    assert found("card 4111 1111 1111 1111 order 4111 1111 1111 1112") == [("card", "4111 1111 1111 1111")]


def test_many_entities_in_one_text():
    import time

    text = " ".join(f"u{i}@a.org" for i in range(20_000))
    begin = time.perf_counter()
    assert len(pii.find_entities(text)) == 20_000
    assert time.perf_counter() - begin < 5


def test_met_again(spark):
    docs = spark.createDataFrame([(1, "id 123-45-6789"), (2, "none"), (3, None)], "doc_id long, text string")
    other = pii.surrogate("ssn", "123-45-6789", b"surrogate-key")
    docs = docs.unionAll(spark.createDataFrame([(4, f"id {other}")], docs.schema))
    got = pii.met_again(docs, pii.replace_pii(docs)).collect()
    assert [(r["kind"], r["entity"]) for r in got] == [("ssn", "123456789")]
    assert pii.met_again(docs.limit(0), pii.replace_pii(docs.limit(0))).count() == 0


def found(text):
    return [(kind, text[a:z]) for a, z, kind in pii.find_entities(text)]


def test_names_behind_other_capitals_and_further_parts():
    for text, name in [("Contact Mary Smith now", "Mary Smith"), ("Yesterday John Miller left", "John Miller"), ("the President James Brown", "James Brown"), ("met Mary Anne Smith there", "Mary Anne Smith"), ("пишет Анна Петрова сама", "Анна Петрова"), ("λέει Ελένη Παπαδάκη εδώ", "Ελένη Παπαδάκη")]:
        assert found(text) == [("person", name)]
        new, _ = pii.replace_entities(text, b"k")
        assert name.split()[-1] not in new.split() and len(new.split()) == len(text.split())
    new = pii.surrogate("person", "Анна Петрова", b"k")
    assert new.split()[0] in pii.FEMALE_CYRILLIC and all("а" <= c.lower() <= "я" for c in new if c != " ")
    assert found("New York and Good Morning") == []
    assert len({pii._letters(c + "άκης", b"k", "surname") for c in "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"}) == 17


def test_compressed_ipv6():
    for text in ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8:0:0:0:0:0:1", "2001:db8::"):
        assert found(f"from {text}, to") == [("ipv6", text)] and found(f"ip:{text}.") == [("ipv6", text)]
    assert pii.surrogate("ipv6", "2001:db8::1", b"k") == pii.surrogate("ipv6", "2001:db8:0:0:0:0:0:1", b"k")
    assert found("std::vector9 at 12:30:45 ::1 dead::beef") == []


def test_collisions_cover_persons_and_addresses(spark):
    docs = spark.createDataFrame([(1, "Anna Lee at 10.1.2.3 and 2001:db8::1"), (2, "Anna Lee at 2001:db8:0:0:0:0:0:1")], "doc_id long, text string")
    made = pii.replace_pii(docs)
    assert pii.collisions(docs, made).count() == 0
    torn = made.withColumn("pii_spans", F.transform("pii_spans", lambda s: s.withField("replacement", F.concat(s["replacement"], F.col("doc_id").cast("string")))))
    assert {r["kind"] for r in pii.collisions(docs, torn).collect()} == {"person", "ipv6"}


# ---- decontamination

ITEM = "A train leaves Berlin at 9 and covers 120 km in 2 hours before Anna boards it; how far does the train travel per hour on average today"


def leaked(spark, texts, items=((1, ITEM),), **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in decontam.leaks(docs, spark.createDataFrame(list(items), "item_id long, text string"), **kw).collect()}


def test_templates_catch_new_parameters(spark):
    other = ITEM.replace("Berlin", "Madrid").replace("120", "340").replace(" 9 ", " 7 ").replace("Anna", "Maria").replace("km", "miles")
    found = leaked(spark, ["intro text here. " + ITEM + " more", "Intro. " + other, "A train is a thing that leaves a town", ITEM[: len(ITEM) // 4]])
    assert set(found) == {0, 1} and not found[0]["changed"] and found[1]["changed"]


def test_inconsistent_slots_are_no_leak(spark):
    item = "we give Anna the red ball and then Anna gives the blue ball to Anna while Anna keeps the green ball near Anna and we thank Anna for the gold ball"
    good = item.replace("Anna", "Clara")
    names = iter(["Clara", "Peter", "Maria", "Lucas", "Emma", "David"])
    bad = " ".join(next(names) if w == "Anna" else w for w in item.split())
    found = leaked(spark, [good, bad], [(1, item)])
    assert set(found) == {0} and found[0]["changed"]


def brute_leaks(texts, items):
    """(doc, item) by trying every place of a document: at least half of an item's 8-word windows line up with a window of
    the same template, values mapping one to one. Items of 8 words and more whose windows are mostly literal words."""
    import re

    def tokens(text):
        out = []
        for m in re.finditer(r"[^\W_]+(?:[.,](?<=\d[.,])(?=\d)\d+)*", text):
            gap = text[out[-1][3] : m.start()] if out else "."
            begins = bool(re.search(r"[.!?\n:;\"|]", gap)) or not out
            w = m[0]
            kind = "n" if w[0].isdigit() else "u" if w.lower() in decontam.UNITS else "p" if len(w) > 1 and w[0].isupper() and not w[1].isupper() and not begins else None
            if kind == "p" and out and out[-1][0] == "p" and not begins:
                out[-1] = ("p", out[-1][1] + " " + w.lower(), False, m.end())
            else:
                out.append((kind, w.lower(), begins, m.end()))
        return [(k, v) for k, v, *_ in out]

    found = set()
    for d, text in texts.items():
        doc = tokens(text)
        for i, item in items.items():
            own = tokens(item)
            n, hit = len(own) - 7, set()
            for shift in range(-len(own), len(doc)):
                pairs, at = set(), set()
                for j in range(n):
                    if 0 <= j + shift and j + shift + 8 <= len(doc):
                        x, y = own[j : j + 8], doc[j + shift : j + shift + 8]
                        if all(p == q and (p or a == b) for (p, a), (q, b) in zip(x, y, strict=True)):
                            at.add(j)
                            pairs |= {(a, b) for (p, a), (_, b) in zip(x, y, strict=True) if p}
                if at and min(len({a for a, _ in pairs}), len({b for _, b in pairs})) >= 0.8 * len(pairs):
                    hit |= at
            if 2 * len(hit) >= n:
                found.add((d, i))
    return found


def test_reparameterised_items_against_brute_force(spark):
    """Items asked again with other numbers, names and units, cut short, or with slots that don't map."""
    rng = random.Random(12)
    words = "the of train box garden paints carries before leaves every quick total how many does each then after under over".split()
    names, units = ["Anna", "Berlin", "Mary Ann", "Bob", "Otto", "Lyon"], ["km", "hours", "kg", "miles"]

    def sentence(n):
        out = []
        for _ in range(n):
            r = rng.random()
            out.append(str(rng.randrange(2, 999)) if r < 0.1 else rng.choice(names) if r < 0.2 else rng.choice(units) if r < 0.25 else rng.choice(words))
        return "so " + " ".join(out)

    items = {i: sentence(rng.randint(14, 30)) for i in range(12)}
    texts = {}
    for d in range(120):
        item = items[rng.randrange(12)]
        swap = dict(zip(names, rng.sample(names, len(names)), strict=True))
        new = " ".join(str(int(w) + 7) if w.isdigit() else w for w in item.split())
        for k, v in swap.items():
            new = new.replace(k, f"@{v}@")
        new = new.replace("@", "") if d % 3 else item
        cut = new.split()[: rng.choice([9, 12, 40])]
        if d % 5 == 4:
            cut = [rng.choice(names) if w in names else w for w in cut]
        texts[d] = f"{sentence(20)}. {' '.join(cut)} {sentence(8)}"
    want = brute_leaks(texts, items)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert len(want) > 30 and got == want


def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    found = leaked(spark, ["so what is the capital city of this land then"], [(1, "capital city of this land"), (2, "so"), (3, None), (4, "")])
    assert [r["item_id"] for r in found.values()] == [1]
    found = leaked(spark, ["we read Capital city of this land here", "What now? Name it.\nSo", "name it then. so what now"], [(1, "Capital city of this land"), (2, "so"), (5, "Name it!")])
    assert set(found) == {0, 1}
    texts = spark.createDataFrame([(1, "What now? Name it.\nSo")], "doc_id long, text string")
    got = decontam.leaks(texts, spark.createDataFrame([(2, "so"), (5, "Name it!"), (6, "now")], "item_id long, text string")).collect()
    assert sorted(r["item_id"] for r in got) == [2, 5] and {r["coverage"] for r in got} == {1.0}
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the old river bank at dawn"), (None, "x")], "item_id long, text string")
    got = decontam.leaks(odd_docs, bench).collect()
    assert sorted(r["doc_id"] for r in got) == [5, 6]
    rest = decontam.decontaminate(odd_docs, bench)
    assert rest.columns == odd_docs.columns and rest.count() == odd_docs.count() - 3
    assert decontam.leaks(no_docs, bench).count() == 0 and decontam.leaks(odd_docs, bench.limit(0)).count() == 0


def test_items_of_slots_and_decimals(spark):
    """Windows of slots are found by value; the sizes to scan are those of the items' windows."""
    sums, lengths, decimals = "12 34 56 78 90 11 23 45 67", "3 km 5 miles 7 kg 9 tons", "What is 3.5 times 2.5 plus 1.5?"
    items = [(1, sums), (2, lengths), (3, decimals)]
    for item_id, item in items:
        docs = spark.createDataFrame([(0, f"we read: {item} and so on"), (1, "we read 98 76 54 32 10 21 43 65 87 or 4 km 6 miles 8 kg 2 tons")], "doc_id long, text string")
        got = decontam.leaks(docs, spark.createDataFrame([(item_id, item)], "item_id long, text string")).collect()
        assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in got] == [(0, item_id, 1.0)]
    mixed = "we count the whole 12 km of the road and then go on 12 34 56 78 90 11 23 45 67 10 20 30 40 50"
    other = "we count the whole 77 km of the road and then go on 92 94 96 98 99 91 93 95 97 70 80 71 81 51"
    assert set(leaked(spark, [mixed, other], [(1, mixed)])) == {0, 1}


# ---- classifiers


def test_nnpu_separates_and_defaults():
    rng = random.Random(0)
    plain = lambda: " ".join(rng.choice("the of to and in it by for with from".split()) for _ in range(40))
    toxic = lambda: plain() + " you " + rng.choice(["slime", "grub"])
    model = toxicity.fit_nnpu([toxic() for _ in range(150)], [plain() for _ in range(450)] + [toxic() for _ in range(50)], 0.1)
    s = model.score(toxicity.words_of([toxic(), plain(), "", "you slime"]))
    assert s[0] > 0.5 and s[1] < 0.5 and s[2] < 0.5 and s[3] > 0.5
    assert toxicity.fit_nnpu([], ["a"], 0.2).score(toxicity.words_of(["x", ""])).tolist() == pytest.approx([0.2, 0.2])


def test_nnpu_keeps_all_significant_words():
    """More marking words than a fixed number would hold, each in 1 % of the positives."""
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice("the of to and in it by for with from".split()) for _ in range(20))
    marks = [f"mark{i}" for i in range(200)]
    positive = [f"{plain()} {marks[i % 200]} {marks[(i * 7 + 3) % 200]}" for i in range(2000)]
    model = toxicity.fit_nnpu(positive, [plain() for _ in range(3000)], 0.1)
    known = toxicity.words_of([" ".join(marks)]).hashes()
    assert np.isin(known, model.words).all() and len(model.words) <= 215
    assert (model.score(toxicity.words_of(marks)) > 0.5).all()


def test_nnpu_risk_and_gradient():
    rng = np.random.default_rng(7)
    chosen = np.arange(5, dtype=np.uint64)
    draw = lambda n: [np.flatnonzero(rng.random(5) < 0.5).astype(np.uint64) for _ in range(n)]
    xp, xu, w, prior = toxicity.Presence(draw(6), chosen), toxicity.Presence(draw(9), chosen), rng.normal(0, 1, 6), 0.3
    up, down, g_up, g_down = toxicity.risks(xp, xu, w, prior)
    sp, su = xp.scores(w), xu.scores(w)
    assert up == pytest.approx(0.3 * np.mean(1 - sp)) and down == pytest.approx(np.mean(su) - 0.3 * np.mean(sp))
    for i in range(6):
        ends = []
        for eps in (1e-6, -1e-6):
            moved = w.copy()
            moved[i] += eps
            ends.append(toxicity.risks(xp, xu, moved, prior)[:2])
        assert g_up[i] == pytest.approx((ends[0][0] - ends[1][0]) / 2e-6, abs=1e-7) and g_down[i] == pytest.approx((ends[0][1] - ends[1][1]) / 2e-6, abs=1e-7)


def test_nnpu_knows_families_of_words():
    """Words of a family that the sample does not hold are known by their beginning."""
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice("the of to and in it by for with from".split()) for _ in range(20))
    model = toxicity.fit_nnpu([f"{plain()} slimbo{rng.randrange(10**6)}" for _ in range(300)], [plain() for _ in range(900)], 0.1)
    assert model.score(toxicity.words_of(["the slimbozzz of"]))[0] > 0.5 > model.score(toxicity.words_of(["the slim of"]))[0]


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1.0
    for v in np.unique(scores):
        order[scores == v] = order[scores == v].mean()
    labels = np.array(labels, bool)
    n = labels.sum()
    return (order[labels].sum() - n * (n + 1) / 2) / (n * (~labels).sum())


def test_mil_gradient():
    rng = np.random.default_rng(0)
    texts = ["good words here and there " * 20, "BAD!! WORDS!! " * 30, "fine", ""]
    model = quality.fit_mil(texts * 3, [1, 0, 1, 0] * 3, epochs=1)
    model.p = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in model.p.items()}
    bags = quality.passages(toxicity.words_of(texts))
    y = np.array([1.0, 0, 1, 0])

    def loss():
        p = model.forward(bags)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = quality._gradient(model, bags, model.forward(bags), y)
    for k in model.p:
        flat, g = model.p[k].reshape(-1), np.asarray(grad[k]).reshape(-1)
        places = rng.choice(len(flat), min(4, len(flat)), replace=False) if k != "E" else [int(b) * quality.HIDDEN + i for i, b in enumerate(bags.bucket[:6])]
        for i in places:
            was, eps = flat[i], 1e-5
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert g[i] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_mil_reads_the_words():
    """Texts of equal shape that differ in their words alone, in one passage of ten."""
    rng = random.Random(8)
    plain = lambda n: [rng.choice("abel bond cord dare even fair gone hair iron jade".split()) for _ in range(n)]
    make = lambda mark: " ".join([*plain(32 * 5), *([mark] * 8), *plain(32 * 5)])
    texts, y = [make(m) for m in ("good", "evil") * 100], [1, 0] * 100
    model = quality.fit_mil(texts, y, epochs=30)
    new = [make(m) for m in ("good", "evil") * 30]
    assert auc(model.score(toxicity.words_of(new)), [1, 0] * 30) > 0.98


def test_attention_weights_sum_to_one():
    model = quality.fit_mil(["a b c " * 50, "X!! Y!! " * 50] * 4, [1, 0] * 4, epochs=2)
    f = model.forward(quality.passages(toxicity.words_of(["a b c " * 200, ""])))
    assert np.add.reduceat(f["a"], f["starts"]) == pytest.approx([1, 1])


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    q = quality.fit_mil(["a b c " * 50, "X!! Y!! " * 50] * 4, [1, 0] * 4, epochs=2)
    t = toxicity.fit_nnpu(["slime"] * 5, ["x", "y"] * 5, 0.1)
    for df in (quality.score(odd_docs, q), toxicity.score(odd_docs, t)):
        rows = df.collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(no_docs, q).count() == 0 and toxicity.score(no_docs, t).count() == 0
    kept = quality.keep_good(odd_docs, q, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert {r["score"] for r in kept.collect()} == {1.5, None}
    clash = odd_docs.withColumn("_score", F.lit(2)).withColumn("__score", F.lit(3))
    assert quality.keep_good(clash, q, 0.0).columns == clash.columns
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(odd_docs, quality.train(odd_docs, labels)).count() == odd_docs.count()
    assert toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).count() == odd_docs.count()


# ---- language


def test_bptt_gradient():
    """Finite differences of the loss of whole windows, through time in both directions."""
    rng = np.random.default_rng(1)
    h = 3
    grus = [langid.Gru(rng.normal(0, 0.5, (256, 3 * h)), rng.normal(0, 0.5, (h, 3 * h))) for _ in range(2)]
    model = langid.LanguageModel(["a", "b"], *grus, rng.normal(0, 0.5, (2 * h, 2)), rng.normal(0, 0.5, 2), h)
    x, y = rng.integers(97, 101, (4, 9)), np.array([0, 1, 1, 0])
    _, grad = langid.gradients(model, x, y)
    for name, w in (("fx", model.forth.x), ("fu", model.forth.u), ("bx", model.back.x), ("bu", model.back.u), ("o", model.out), ("b", model.bias)):
        places = [(i, j) for i in (97, 99) for j in (0, 4, 8)] if name in ("fx", "bx") else [tuple(int(rng.integers(n)) for n in w.shape) for _ in range(6)]
        for i in places:
            was, eps = w[i], 1e-5
            w[i] = was + eps
            up = langid.gradients(model, x, y)[0]
            w[i] = was - eps
            down = langid.gradients(model, x, y)[0]
            w[i] = was
            assert grad[name][i] == pytest.approx((up - down) / (2 * eps), abs=1e-7), name


def test_states_are_carried_through_whole_texts():
    """Lanes against a loop over all bytes: every position counts once, and windows leave no trace."""
    model = langid.fit(["the of and that with " * 40, "der die und nicht mit " * 40] * 5, ["en", "de"] * 5, steps=120)
    texts = ["the of " * 300 + "nicht die " * 300, "x", "", "der " * 10 + "with that and " * 171, "and" * 171, "a" * 512, "b" * 1025, "12 34 " * 400]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.sums(data, offsets)
    want = np.stack([model.positions(data[a:z]).sum(0) for a, z in zip(offsets[:-1], offsets[1:], strict=True)])
    assert got.sum(1) == pytest.approx(np.diff(offsets), abs=1e-2)
    assert (np.abs(got - want).sum(1) <= 2e-3 * np.diff(offsets) + 1e-2).all()


def test_window_edges_without_a_run_up(monkeypatch):
    """Where the run-up gives a wrong state, windows are read again until the states agree."""
    model = langid.fit(["the of and that with " * 40, "der die und nicht mit " * 40] * 5, ["en", "de"] * 5, steps=60)
    data = np.frombuffer(("the die of " * 900).encode(), np.uint8)
    want = model.positions(data).sum(0)
    monkeypatch.setattr(langid, "WARM", 1)
    monkeypatch.setattr(langid, "WINDOW", 40)
    monkeypatch.setattr(langid, "SAME_STATE", 1e-6)
    monkeypatch.setattr(langid, "LANES", 7)
    assert model.sums(data, np.array([0, len(data)]))[0] == pytest.approx(want, rel=1e-4)


def test_scripts_without_spaces():
    """Whole sentences without a space, in two ranges of one script and one other."""
    rng = random.Random(6)
    kana, han, hangul = [chr(0x3042 + i) for i in range(40)], [chr(0x4E00 + 7 * i) for i in range(200)], [chr(0xAC00 + 28 * i) for i in range(200)]
    make = {"ja": lambda: "".join(rng.choice(rng.choice([kana, kana, han])) for _ in range(rng.randint(20, 200))), "zh": lambda: "".join(rng.choice(han) for _ in range(rng.randint(20, 200))), "ko": lambda: "".join(rng.choice(hangul) for _ in range(rng.randint(20, 200)))}
    names = [n for n in make for _ in range(40)]
    model = langid.fit([make[n]() for n in names], names, steps=150)
    texts = [make[n]() for n in names]
    raw = [t.encode() for t in texts]
    got, _ = langid.label_texts(model, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), texts)
    assert np.mean([g == n for g, n in zip(got, names, strict=True)]) > 0.95


def test_language_odd_rows(spark, odd_docs, no_docs):
    texts = ["the of and that with " * 20, "der die und nicht mit " * 20] * 20
    model = langid.fit(texts, ["en", "de"] * 20, steps=60)
    docs = odd_docs.union(spark.createDataFrame([(100, "12 34 !!", None, None, None, None, None), (101, "die der und", None, None, None, None, None), (102, "漢字", None, None, None, None, None)], odd_docs.schema))
    got = {}
    for r in langid.identify(docs, model).collect():
        got[r["doc_id"]] = r
        assert 0 <= r["score"] <= 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 100))
    assert got[101]["lang_pred"] == "de" and got[5]["lang_pred"] == "en" and got[102]["lang_pred"] in ("en", "de")
    assert langid.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}



# ---- TIFF


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(how, predictor, tile):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 4, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (17, 33, 3), (70, 64, 1))]
    got = list(tiff.pages(tiff.encode(images, how, predictor, tile, rows_per_strip=16)))
    assert [g["pixels"] for g in got] == [i.tobytes() for i in images]
    assert [(g["height"], g["width"], g["samples"], g["page"]) for g in got] == [(1, 1, 1, 0), (17, 33, 3, 1), (70, 64, 1, 2)]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000, 70_000])
def test_codecs(n):
    for data in (bytes(n), np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes(), (b"the of and " * (n // 11 + 1))[:n]):
        assert tiff.unpack_bits(tiff.pack_bits(data), n) == data and tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def test_lzw_known_stream():
    # 256, 7, 258, 8, 8, 258, 6, 6, 257 as 9-bit codes: the format's own example, 7 7 7 8 8 7 7 6 6
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    data = (bits << (-9 * len(codes)) % 8).to_bytes(-(-9 * len(codes) // 8), "big")
    assert tiff.lzw_decode(data, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_float_predictor():
    import struct

    values = np.array([[1.5, -2.25, 3e10, 0.0]], "<f4")
    planes = values.astype(">f4").view(np.uint8).reshape(1, 4, 4).transpose(0, 2, 1).reshape(1, 16)
    coded = planes.copy()
    coded[:, 1:] -= planes[:, :-1]
    tags = [(256, 3, 4), (257, 3, 1), (258, 3, 32), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 1), (279, 4, 16), (317, 3, 3), (339, 3, 3)]
    blob = struct.pack("<2sHI", b"II", 42, 24) + coded.tobytes() + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    assert np.frombuffer(next(tiff.pages(blob))["pixels"], "<f4").tolist() == values[0].tolist()


def digested(docs):
    return tiff.digests(tiff.read_pages(tiff.with_digest(tiff.store_documents(docs)), keep=("doc_id", "n_bytes", "media_bytes", "media_sha256")))


def one_page(tags, data=b""):
    """A file of one page by hand: (tag, type, values) and bytes that begin at 8."""
    import struct

    out, at, fields = bytearray(data), 8 + len(data), []
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            raw, place = struct.pack("<I", 8 + len(out)), out.extend(raw)
        fields.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
    at = 8 + len(out)
    return struct.pack("<2sHI", b"II", 42, at) + bytes(out) + struct.pack("<H", len(fields)) + b"".join(fields) + b"\0" * 4


def shape(width, height, bits, *more, at=(8,), size=(1,), rows=None):
    return [(256, 4, [width]), (257, 4, [height]), (258, 3, bits), (273, 4, list(at)), (278, 4, [rows or max(1, height)]), (279, 4, list(size)), *more]


@pytest.mark.parametrize(
    "blob",
    [
        one_page(shape(0, 5, [8]), b"x"),
        one_page(shape(5, 0, [8]), b"x"),
        one_page(shape(4_000_000, 4_000_000, [8]), b"x"),
        one_page(shape(65_000, 60_000, [8]), b"x" * 2_000_000),
        one_page([t for t in shape(4, 4, [8]) if t[0] not in (273, 278, 279)] + [(322, 4, [0]), (323, 4, [16]), (324, 4, [8]), (325, 4, [1])], b"x"),
        one_page(shape(8, 8, [8], (259, 3, [8]), size=(9,)), zlib.compress(b"ab")),
        one_page(shape(8, 8, [8], (259, 3, [5]), size=(3,)), b"\xff\xff\xff"),
        one_page(shape(8, 8, [8], (277, 3, [0])), b"x"),
        one_page(shape(8, 8, [12]), b"x" * 96),
        one_page(shape(8, 8, [8], (317, 3, [3]), size=(64,)), b"x" * 64),
        one_page(shape(8, 8, [8], at=(8, 8), size=(64,)), b"x" * 64),
    ],
)
def test_headers_that_lie(blob):
    got = list(tiff.pages(blob))
    assert len(got) == 1 and got[0]["error"] and got[0]["pixels"] is None


def test_a_bomb_is_not_inflated():
    bomb = zlib.compress(bytes(50_000_000))
    got = list(tiff.pages(one_page(shape(8, 8, [8], (259, 3, [8]), size=(len(bomb),)), bomb)))
    assert got[0]["pixels"] == bytes(64)


def test_bits_and_planes():
    bits = np.random.default_rng(1).integers(0, 2, (5, 11, 1), dtype=np.uint8)
    packed = np.packbits(bits[:, :, 0], axis=1).tobytes()
    assert next(tiff.pages(one_page(shape(11, 5, [1], size=(10,)), packed)))["pixels"] == bits.tobytes()
    lines = b"".join(tiff.pack_bits(packed[i : i + 2]) for i in range(0, 10, 2))
    assert next(tiff.pages(one_page(shape(11, 5, [1], (259, 3, [tiff.PACKBITS]), size=(len(lines),)), lines)))["pixels"] == bits.tobytes()
    rgb = np.random.default_rng(2).integers(0, 256, (4, 3, 3), dtype=np.uint8)
    planes = [rgb[y : y + 2, :, p].tobytes() for p in range(3) for y in (0, 2)]
    blob = one_page(shape(3, 4, [8, 8, 8], (277, 3, [3]), (284, 3, [2]), at=[8 + 6 * i for i in range(6)], size=[6] * 6, rows=2), b"".join(planes))
    assert next(tiff.pages(blob))["pixels"] == rgb.tobytes()


def test_a_very_long_text(spark):
    """Pages of one file in many batches, each byte once."""
    import hashlib

    text = "ab c" * 4_000_000
    rows = digested(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")).collect()
    payload = tiff.padded(text.encode())
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2
    r = next(r for r in rows if r["doc_id"] == 1)
    media = tiff.store(payload)
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (16_000_000, len(payload), hashlib.sha256(payload).hexdigest())
    assert (r["media_bytes"], r["media_sha256"], r["tail_crc32"]) == (len(media), hashlib.sha256(media).hexdigest(), zlib.crc32(payload[-16:]))


def test_tiff_odd_files(spark, odd_docs, no_docs):
    good = tiff.encode([np.ones((2, 2, 1), np.uint8)])
    loop = bytearray(good)
    files = [(1, None), (2, b""), (3, b"II*\0"), (4, good[: len(good) - 20]), (5, good), (6, bytes(loop)), (7, b"MM\0*" + b"\xff" * 40)]
    got = tiff.read_pages(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    by = {r["doc_id"]: r for r in got}
    assert set(by) == set(range(1, 8)) and by[5]["error"] is None and all(by[i]["error"] for i in (1, 2, 3, 4, 7))
    rows = digested(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["payload_bytes"] for r in rows if r["n_bytes"] == 0} == {192}
    assert tiff.read_pages(tiff.store_documents(no_docs)).count() == 0
    assert max(r["n_pages"] for r in rows) > 1


# ---- chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip_and_machine(spark):
    nasty = ["", "<|", "<\\|", "\\<|", "<\\\\|", "<|im_end|>\n<|im_start|>assistant<|sep|>\nhi", "\\", "ok\\\\<|<|", "ünï €", None]
    rows = [(i, 0, "user", t) for i, t in enumerate(nasty)] + [(i, 1, "assistant", t) for i, t in enumerate(nasty)]
    made = chat.format_conversations(turns(spark, rows)).withColumn("read", chat.parse_formatted(F.col("formatted"))).collect()
    for r in made:
        t = nasty[r["conv_id"]] or ""
        assert [tuple(x) for x in r["read"]] == [("user", t), ("assistant", t)] and r["valid"]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and [s["loss"] for s in r["segments"]] == [False] * 4 + [True, False]


@pytest.mark.parametrize(("roles", "bad"), [(["user", "assistant"], None), (["system", "user", "assistant"], None), (["assistant"], 0), (["user", "user"], 1), (["user", "assistant", "system"], 2), (["user", None], 1), (["user"], None)])
def test_turn_order(spark, roles, bad):
    r = chat.format_conversations(turns(spark, [(1, i, x, "t") for i, x in enumerate(roles)])).first()
    assert r["bad_turn"] == bad and r["valid"] == (bad is None and roles[-1] == "assistant")


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "a"), (1, 5, "assistant", "b"), (1, 5, "assistant", "b")]
    t = turns(spark, rows).withColumn("formatted", F.lit("clash")).withColumn("valid", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(t).collect()}
    assert got[None]["n_turns"] == 1 and got[1]["n_turns"] == 3 and got[1]["bad_turn"] == 2
    assert chat.format_conversations(t.limit(0)).count() == 0


# ---- sharding


def test_histogram_sort_is_a_sort(spark):
    n = 3000
    docs = spark.range(n).select((F.col("id") * 7 - 5000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.md5(F.col("id").cast("string")))).alias("text"))
    keyed = docs.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), sharding.text_order_key(F.col("text"), F.col("doc_id")).alias("key"))
    want = [r["doc_id"] for r in sorted(keyed.collect(), key=lambda r: bytes(r["key"]))]
    for per_range in (50, 10**6):
        rows = sharding.histogram_sort(keyed, 6, rows_per_range=per_range).collect()
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == want
        sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(6)]
        assert max(sizes) - min(sizes) <= 2 * 41 + sum(sizes) / 6 * 0.003


def test_splitters_meet_exact_bytes(spark):
    tie = F.unhex(F.lit("0" * 16))
    docs = spark.range(500).select("id", F.lit(10).cast("long").alias("__size"), F.concat(sharding.text_order_key(F.lit("one hot text"), F.col("id")), tie).alias("__key"))
    found, total, n = sharding.find_splitters(docs, 5, 0.0)
    assert (total, n) == (5000, 500) and [s.bytes_below for s in found] == [1000, 2000, 3000, 4000] and [s.rows_below for s in found] == [100, 200, 300, 400]


def test_shards_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    for s in {r["shard"] for r in rows}:
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {8} and {r["text_crc32"] for r in rows if r["doc_id"] == 0} == {zlib.crc32(b"")}
    assert sharding.shard_documents(no_docs, 4).count() == 0


def test_shards_of_rows_that_are_all_equal(spark):
    """Equal texts without an id, a third of them null: nothing tells the rows apart but their place in the table."""
    rows = [(None, "one hot text " * 8, 1, "x")] * 2000 + [(None, None, 2, "y")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, __rank string")
    got = sharding.shard_documents(docs, 24).collect()
    assert len(got) == 3000
    sizes, counts = [0] * 24, [[] for _ in range(24)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]].append(r["slot"])
    assert max(sizes) - min(sizes) <= 2 * 112 and all(sorted(c) == list(range(len(c))) for c in counts)
    keyed = docs.select("*", F.lit(8).cast("long").alias("size"), sharding.text_order_key(F.col("text"), F.col("doc_id")).alias("key"))
    made = sharding.histogram_sort(keyed, 6, rows_per_range=100)
    assert made.columns == ["doc_id", "text", "__rank", "size", "shard", "slot"] and made.groupBy("shard").count().where("count = 500").count() == 6


# ---- packing


@pytest.mark.parametrize("lengths", [[600] * 500, [1] * 3000, [1023] * 10, [512, 512, 300, 200, 100], list(range(1, 1024))])
def test_patterns_hold_every_piece(lengths):
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    patterns = packing.shortest_pack_first(histogram, 1024)
    held = {}
    for p, n in patterns:
        assert sum(a * b for a, b in p) <= 1024
        for a, b in p:
            held[a] = held.get(a, 0) + b * n
    assert held == histogram
    spots = packing.places(patterns)
    assert sum(z - a + 1 for _, a, z, *_ in spots) == len(lengths)


def test_equal_lengths_pack_well(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the " * 599) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    sequences = {r["sequence_id"] for r in rows}
    assert sum(r["length"] for r in rows) / (len(sequences) * 1024) > 0.98


def test_tokenizers_agree():
    exact, fast = packing._encoder(packing.tokenizer_paths()[0], None), packing._encoder(*packing.tokenizer_paths())
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([*range(32, 127), *range(0xA1, 0x234), 9, 10, 13, 32, 32, 32])) for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += ["<|endoftext|>", "don't we'll  \n\n x", "　全角 и кириллица ​", "a b", "\x1c\x85", "  ", "¹²³ ½ Ⅷ"]
    texts += ["x" * 512 + " " * 64 + "y", "x" * 513, " " * 65, ("ab" * 200 + "\n" * 64) * 50]
    assert list(exact(texts)) == list(fast(texts))


@pytest.mark.parametrize("run", [" ", "\t", "\n", "a", "é", "!", " a", "\r\n"])
def test_runs_of_a_million(run):
    exact, fast = packing._encoder(packing.tokenizer_paths()[0], None), packing._encoder(*packing.tokenizer_paths())
    text = "a" + run * 1_000_000 + "b"
    assert list(fast([text])) == list(exact([text]))


def test_packing_a_text_of_white_space_and_copies(spark):
    """A million spaces, and many equal rows without an id: every id lies in one place."""
    rows = [(1, "a" + " " * 1_000_000 + "b")] + [(None, "same text of some words")] * 3000
    made = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    taken = {}
    for r in made:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in made if r["doc_id"] is None) == 3000 * 6
    assert sorted(r["start"] for r in made if r["doc_id"] == 1)[0] == 0 and sum(r["length"] for r in made if r["doc_id"] == 1) == 1_000_002


def test_assign_carries_clashing_columns(spark):
    pieces = spark.range(50).select(F.col("id").alias("at"), F.lit(100).cast("long").alias("length"), F.lit("x").alias("rank"), F.lit("y").alias("bucket"), F.lit("z").alias("offset"))
    made = packing.assign(pieces, packing.shortest_pack_first({100: 50}, 1024), ("at",))
    assert made.columns == ["at", "length", "rank", "bucket", "sequence_id", "offset"] and made.select("sequence_id", "offset").distinct().count() == 50


def test_packing_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert len({r["doc_id"] for r in rows}) == 11
    assert {(r["start"], r["length"], r["n_tokens"]) for r in rows if r["doc_id"] == 0} == {(0, 1, 1)}
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(no_docs).count() == 0


# ---- samples


def test_lowest_counts_keys_and_not_rows(spark):
    """The same sample of a table, of one with each row twice, and of one with few ids many times."""
    from theoremill.llm.common import lowest

    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    want = [r[0] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(40).collect()]
    assert sorted(r[0] for r in lowest(ids.unionAll(ids), "doc_id", 40, 3).collect()) == sorted(want)
    few = spark.range(200_000).select((F.col("id") % 100).alias("doc_id"))
    want = [r[0] for r in few.distinct().orderBy(F.xxhash64("doc_id", F.lit(0)), "doc_id").limit(50).collect()]
    assert sorted(r[0] for r in lowest(few, "doc_id", 50).collect()) == sorted(want)
    from theoremill.llm.common import lowest_by

    grouped = ids.withColumn("g", F.when(F.col("doc_id") < 300, "few").when(F.col("doc_id") < 310, None).otherwise("many"))
    got = lowest_by(grouped.unionAll(grouped), "doc_id", "g", 40, 3)
    for g in ("few", "many"):
        want = [r[0] for r in grouped.where(F.col("g") == g).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(40).collect()]
        assert sorted(k for k, x in got if x == g) == sorted(want)
    assert len(got) == 80
    nulls = ids.unionAll(spark.range(500).select(F.lit(None).cast("long").alias("doc_id")))
    assert lowest(nulls, "doc_id", 40).where("doc_id is null").count() == 0
    assert lowest(ids.limit(0), "doc_id", 40).count() == 0


def test_lowest_keys_are_those_of_lowest(spark):
    from theoremill.llm.common import lowest, lowest_keys

    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    nulls = ids.unionAll(spark.range(500).select(F.lit(None).cast("long").alias("doc_id")))
    for df, n in ((ids.unionAll(ids), 40), (nulls, 40), (ids.limit(30), 40), (ids.select(F.col("doc_id").cast("string")), 40)):
        got = lowest_keys(df, "doc_id", n, 3)
        assert len(got) == len(set(got)) and sorted(got) == sorted(r[0] for r in lowest(df, "doc_id", n, 3).collect())
    assert lowest_keys(ids.limit(0), "doc_id", 40) == []


def test_texts_by_id_of_repeated_and_missing_ids(spark):
    from theoremill.llm.common import texts_by_id

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (4, "d"), (None, "e")], "doc_id long, text string")
    assert texts_by_id(docs, [1, 2, 3, 9], 1000) == {1: "a", 3: "c"}  # as many rows as ids: merged here
    assert texts_by_id(docs, [1], 1000) == {1: "a"}  # more: grouped in the cluster
    assert texts_by_id(docs, [], 1000) == {}


def test_toxicity_trains_without_exchanges_by_key(spark):
    """With 211 shuffle partitions its samples took rounds of that many tasks to group by id, each with pages of its own."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.enabled": "true"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("toxicity-train", "")
        model = toxicity.train(docs, labels)
        stages = {s for j in tracker.getJobIdsForGroup("toxicity-train") for s in tracker.getJobInfo(j).stageIds}
        assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) <= spark.sparkContext.defaultParallelism
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert toxicity.score(docs, model).count() == 400
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256


def test_samples_of_repeated_rows_are_bounded(spark):
    """Each row 50 times: the same sample, and one text per id reaches the driver."""
    from theoremill.llm.common import labelled_sample, text_sample

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    many = docs.crossJoin(spark.range(50).select(F.lit(1).alias("extra"))).drop("extra")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert text_sample(docs, 30, 5, 0, 1000) == text_sample(many, 30, 5, 0, 1000)
    again = labels.unionAll(labels)
    assert labelled_sample(docs, labels, "quality", 20, 5, 0, 1000) == labelled_sample(many, again, "quality", 20, 5, 0, 1000)


def test_long_texts_give_pieces(spark):
    from theoremill.llm.common import bounded_text

    docs = spark.createDataFrame([(1, "short"), (2, "".join(f"{i:07d} " for i in range(50_000))), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in docs.select("doc_id", bounded_text(F.col("text"), F.col("doc_id"), 1600).alias("p")).collect()}
    assert got[1] == "short" and got[3] is None
    lines = got[2].split("\n")
    numbers = [int(x) for line in lines for x in line.split()[1:-1]]
    assert len(got[2]) <= 1600 and len(lines) == 16 and max(numbers) - min(numbers) > 20_000


def test_labels_of_held_out_rows_are_never_used(spark):
    from theoremill.llm.common import labelled_sample, text_sample

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = {f"text {i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = labelled_sample(docs, labels, "quality", 500, 5, 0, 1000)
    assert {t for t, _ in got} == {f"text {i}" for i in range(200)} - out and all(int(t.split()[1]) % 2 == y for t, y in got)
    assert not out & set(text_sample(docs, 500, 5, 0, 1000))


def test_pages_behind_an_unreadable_one():
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    blob = bytearray(tiff.encode([image, image, image], tiff.NONE))
    at = int.from_bytes(blob[4:8], "little")
    entry = next(at + 2 + 12 * i for i in range(20) if int.from_bytes(blob[at + 2 + 12 * i : at + 4 + 12 * i], "little") == tiff.COMPRESSION)
    blob[entry + 8] = 99
    got = list(tiff.pages(bytes(blob)))
    assert [r["page"] for r in got] == [0, 1, 2] and got[0]["error"] and [r["pixels"] for r in got[1:]] == [image.tobytes()] * 2


def test_lzw_at_any_length_with_both_predictors():
    seen = set()
    for i in range(400):
        payload = tiff.padded(f"text {i} the of and in ".encode() * 600)
        if zlib.crc32(payload) % 16 == 0:
            got = list(tiff.pages(tiff.store(payload)))
            assert b"".join(r["pixels"] for r in got) == payload
            seen |= {(r["compression"], r["predictor"]) for r in got}
    assert seen == {(tiff.LZW, 1), (tiff.LZW, 2)}
