"""Registered queries against DuckDB, and against brute force where SQL has no equivalent."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from compare import differences, duck
from playbill.llm import license_rules, wrapper
from playbill.llm.queries import ORACLES, QUERIES, VOCABULARY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_shards(spark, docs):
    rows = QUERIES["op1_shard_slots"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    numbers, load = defaultdict(list), Counter()
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        numbers[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    assert set(numbers) <= set(range(40)) and max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def scan_by_hand(text: str):
    low = text.translate(str.maketrans(license_rules.UPPER, license_rules.LOWER))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = " " + " ".join(words) + (" " if words else "")
    found = [(s := line[:m.start()].count(" "), s + m[0].count(" "), r) for r in license_rules.signature_rules() for m in re.finditer(f" {r.pattern}(?= )", line)]
    base = [f for f in found if f[2].priority < 4]
    left = [d for d in found if not any(
        e[0] <= d[0] and e[1] >= d[1] and (e[1] - e[0] > d[1] - d[0] or e[2].priority < d[2].priority) for e in found)]
    names = sorted({f[2].label for f in base})
    return (len(words), len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None), ",".join(names),
            ",".join(sorted({*names, *(f[2].label for f in left)})), max((f[2].relevance for f in left), default=0.0))


def test_licenses(spark, docs):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op2_license_rules"](spark, SF_DIR).collect()}
    assert got == {i: scan_by_hand(t) for i, t in docs.items()}


def test_license_forms(spark):
    texts = ["MIT License mit license; CC BY 4.0, licensed under the Apache License, Version 2.0. GNU General Public License",
             "SPDX-License-Identifier: GPL-2.0-or-later", "", None, "all rights reserved, placed in the public domain " * 40,
             "Permission is hereby granted, free of charge, to any person obtaining a copy"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in license_rules.digest(rows).collect()} == {i: scan_by_hand(t or "") for i, t in enumerate(texts)}


def test_many_detections_in_one_text(spark):
    """Twice the detections take little more than twice as long."""
    unit = "mit license, all rights reserved; licensed under the apache license. "
    seconds = []
    for n in (500, 4_000, 8_000):
        rows = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        start = time.perf_counter()
        row = license_rules.digest(rows).collect()[0]
        seconds.append(time.perf_counter() - start)
        assert row.n_base == 2 * n and row.last_word == 10 * n - 2
    assert seconds[2] <= 2.5 * seconds[1] + 1, seconds


def test_every_rule_passes_the_trigger():
    plain = re.compile(license_rules.TRIGGERS)
    for rule in license_rules.signature_rules():
        if not rule.label.startswith(("cc0",)):
            assert plain.search(rule.pattern.replace("licen[cs]e", "license")), rule


def test_pages(spark, con):
    pages = {i: h for i, h in con.execute("SELECT page_id, html FROM pages").fetchall()}
    for r in QUERIES["op3_wrapper"](spark, SF_DIR).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(wrapper.entities.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def simhash_by_hand(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    prints = {i: simhash_by_hand(t) for i, t in docs.items()}
    name = {i: i for i in prints}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                name[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_trie"](spark, SF_DIR).collect()}
    assert got == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_toxicity_on_held_out_rows(spark, con):
    table = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{table}/labels.parquet'").fetchall())
    rows = QUERIES["op7_toxicity_labels"](spark, table).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p > t for p, t in held) <= 0.03 * len(held)
    assert sum(p and t for p, t in held) >= 0.6 * sum(t for _, t in held)


def test_encoding(spark, docs):
    import public_tokenizers
    import tiktoken

    from playbill.llm.byte_bpe import read_ranks

    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    for r in QUERIES["op9_byte_bpe"](spark, SF_DIR).collect():
        ids = coder.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_pipeline_by_hand(spark, docs, con):
    """Each stage by hand on what the one before it kept; the learned verdict is that of the toxicity query, held against labels above."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from playbill.llm.byte_bpe import read_ranks

    toxic = {r.doc_id for r in QUERIES["op7_toxicity_labels"](spark, SF_DIR).collect() if r.predicted}
    kept = duck(SF_DIR)

    def ask(name, columns):
        return kept.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()

    left = set(docs) - toxic
    kept.execute("CREATE TABLE whole AS SELECT * FROM documents")
    rows = dict(kept.execute("SELECT doc_id, text FROM whole").fetchall())

    def view(ids):
        kept.execute("CREATE OR REPLACE TEMP TABLE now AS SELECT * FROM whole WHERE list_contains(?, doc_id)", [sorted(ids)])
        kept.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM now")

    view(left)
    left = {i for i, k in ask("op5_quality_cascade", "doc_id, kept") if k}
    prints = {i: simhash_by_hand(rows[i]) for i in sorted(left)}
    name = {i: i for i in prints}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                name[y] = x
    left = {root(i) for i in left}
    view(left)
    left = {i for i, c in ask("op8_decontaminate", "doc_id, contaminated") if not c}
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == {i: len(coder.encode_ordinary(rows[i])) for i in left}
    assert 0 < len(left) < len(docs)
