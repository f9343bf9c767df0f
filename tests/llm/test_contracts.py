"""The registered queries: names, types and the plain parts of what they return."""

import base64
import hashlib
import re

import pytest
from tokenizers import Tokenizer

from quillstone.llm import bpe_count, queries, token_store

COLUMNS = {
    "op1_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_html_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_substring_dedup": {"doc_id": "bigint", "text": "string", "n_removed": "bigint"},
    "op4_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op5_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6_token_id_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op9_sentencepiece_codec": {"doc_id": "bigint", "ids": "array<int>", "n_tokens": "bigint", "lossless": "boolean"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op12_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
}


@pytest.fixture(scope="module")
def results(spark, sf):
    return {f.__name__: f(spark, sf) for f in queries.OPERATORS}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf, results, name):
    frame = results[name]
    types = dict(frame.dtypes)
    assert COLUMNS[name].items() <= types.items() and len(frame.columns) == len(set(map(str.lower, frame.columns)))
    if "doc_id" not in types and "page_id" not in types:
        return
    table, key = ("pages", "page_id") if "page_id" in types else ("documents", "doc_id")
    want = spark.read.parquet(f"{sf}/{table}.parquet").select(key)
    assert sorted(r[0] for r in frame.select(key).collect()) == sorted(r[0] for r in want.collect())


def test_values(spark, sf, results):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    one = results["op1_simhash_near_dedup"].collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in one)
    groups = {}
    for r in one:
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert all(min(g) == c for c, g in groups.items())
    four = Tokenizer.from_file(bpe_count.default_tokenizer())
    assert all(r.n_tokens == len(four.encode(docs[r.doc_id] or "", add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 512) for r in results["op4_token_counts"].limit(40).collect())
    six, start = Tokenizer.from_file(token_store.default_tokenizer()), 0
    for r in sorted(results["op6_token_id_output"].collect(), key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens
    assert start == sum(len(six.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs.values())
    for r in results["op8_warc"].collect():
        data = pages[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert pages[r.page_id] == pages[r.refers_to] if r.record_type == "revisit" else r.refers_to is None
    assert all(r.lossless and len(r.ids) == r.n_tokens for r in results["op9_sentencepiece_codec"].collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in results["op10_toxicity"].collect())
    assert all(not (r.base_failed and r.kept) for r in results["op7_quality_rules"].collect())
