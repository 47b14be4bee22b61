"""The registered queries on the small tables: against SQL where there is one, else against plain Python."""

import hashlib
import struct
import zlib

import pytest

from theoremill.llm import queries

from ..oracle import compare


def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])


def test_surrogates(spark, sf_dir):
    import re

    docs = documents(spark, sf_dir)
    got = {r["doc_id"]: r for r in queries.op1_pii_surrogates(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    luhn = lambda x: sum(int(c) if i % 2 == 0 else int("0246813579"[int(c)]) for i, c in enumerate(reversed(x))) % 10 == 0
    planted = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|[0-9a-f]{40}")
    n = 0
    for i, t in docs.items():
        found = {x for x in planted.findall(t) if not re.fullmatch(r"\d{16}", x) or luhn(x)}
        n += len(found)
        assert not any(x in got[i]["text"] for x in found)
        assert found or got[i]["text"] == t
    assert n > 0


def test_leaks(spark, sf_dir):
    import re

    plain = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    docs = {i: plain(t) for i, t in documents(spark, sf_dir).items()}
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontam_templates(spark, sf_dir).collect()}
    assert want and got == want


@pytest.mark.parametrize(("query", "label", "threshold", "least", "least_auc"), [(queries.op3_toxicity_nnpu, "toxic", 0.5, 0.95, 0.9), (queries.op6_quality_mil, "quality", 0.3, 0.97, 0.98)])
def test_classifiers_on_held_out_rows(spark, query, label, threshold, least, least_auc):
    """Accuracy well above the better constant answer, and the order of scores."""
    sf = "/root/testdata/sf0.1"
    import os

    from .test_operators import auc

    if not os.path.isdir(sf):
        pytest.skip("the driver's tables aren't here")
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == 10_000
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    known = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    share = sum(y for *_, y in known) / len(known)
    accuracy = sum(p == y for _, p, y in known) / len(known)
    assert accuracy >= least > max(share, 1 - share)
    assert auc([s for s, *_ in known], [y for *_, y in known]) >= least_auc


def test_tiff_digests(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = queries.op4_tiff_pages(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r["doc_id"]], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_languages(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables aren't here")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op8_langid_bigru(spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.97


def test_shards(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = queries.op9_histogram_sort(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(24))
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in s) - total / 24) <= largest + total / 24 * 0.01 for s in shards.values())


def test_packing(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    docs = documents(spark, sf_dir)
    ids = {d: t.encode(x, add_special_tokens=False).ids + [0] for d, x in docs.items()}
    pieces, sequences = {}, {}
    for r in queries.op10_pack_spfhp(spark, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for d, rs in pieces.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            own = ids[d][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r["length"]
        assert at == len(ids[d])
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert 1 - sum(map(len, ids.values())) / (len(sequences) * 1024) < 0.02
