"""Vector codes, the Merkle manifest and token files against brute force, with the edge cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playbill.llm import merkle_dag, token_files, vector_codes
from playbill.llm.queries import WORDS
from playbill.session import new_run_dir

VOCABULARY = public_tokenizers.path(WORDS)
VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("part", "entry", "leaf", "rank", "tree", "path", "ids", "shard", "a.b")


def clashing(rows):
    return rows.withColumns({name: F.lit("kept") for name in CLASH})


def lloyd_by_hand(rows, rounds=6):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[min(max(math.floor(4096 * x), -vector_codes.LIMIT), vector_codes.LIMIT) for x in r[1]] for r in rows]
    first = {}
    for r, v in zip(rows, whole):
        if r[0] is not None:
            first[r[0]] = min(first.get(r[0], v), v)
    first = [first[i] for i in sorted(first)[:16]] or [min(whole)]
    d = len(whole[0]) // 8
    books = [[v[p * d:(p + 1) * d] for v in first] for p in range(8)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            members = defaultdict(list)
            for v in whole:
                members[near(v[p * d:(p + 1) * d], books[p])[1]].append(v[p * d:(p + 1) * d])
            for k, parts in members.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    out, labels = [], Counter()
    for r, v in zip(rows, whole):
        best = [near(v[p * d:(p + 1) * d], books[p]) for p in range(8)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), r[2]))
        labels[r[2]] += out[-1][2]
    return Counter((i, c, e, labels[x], vector_codes.codebooks_checksum(books)) for i, c, e, x in out)


def odd_vectors():
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(16)], i % 3) for i in range(90)]
    rows += [rows[5]] * 7 + [(5, [rnd.uniform(-1, 1) for _ in range(16)], None), (None, [0.5] * 16, None), (None, [0.25] * 16, 1), (91, [0.0] * 16, 1), (92, [-3.7] * 16, 1)]
    rows += [(-1, None, 0), (-2, [], 0), (-3, [None] + [1.0] * 15, 0), (-4, [float("nan")] * 16, 0), (-5, [float("-inf")] * 16, 0)]
    return rows


@pytest.mark.parametrize("scale", [1, 40_000])
def test_vector_codes(spark, scale):
    rows = [(i, v and [x and x * scale for x in v], n) for i, v, n in odd_vectors()]
    frame = spark.createDataFrame(rows, VECTORS)
    expected = lloyd_by_hand([tuple(r) for r in frame.collect()])
    assert Counter(tuple(r) for r in vector_codes.digest(frame).collect()) == expected
    assert Counter(tuple(r) for r in vector_codes.digest(clashing(frame)).collect()) == expected


def test_vector_codes_of_few_or_none(spark):
    for rows in ([], [(1, None, 0)], [(-7, [0.5] * 3, 1)]):
        assert vector_codes.digest(spark.createDataFrame(rows, VECTORS)).collect() == []
    rows = [(None, [float(k)] * 8, None) for k in (3, 1, 2)] + [(None, [1.0] * 16, None)]
    got = vector_codes.digest(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(r.code for r in got) == ["00" * 8] * 3 and len({r.label_error for r in got}) == 1


def test_members_that_stay_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MEMBERS", 20)
    frame = spark.createDataFrame(odd_vectors() * 4, VECTORS)
    expected = lloyd_by_hand([tuple(r) for r in frame.collect()])
    assert Counter(tuple(r) for r in vector_codes.digest(frame).collect()) == expected  # several salts
    rows = vector_codes.scaled(frame)
    first = vector_codes.first_vectors(rows)
    members = vector_codes._Members(vector_codes.parts_of(rows, [[v[p * 2:p * 2 + 2] for v in first] for p in range(8)], 20), 8)
    plan = members.seen([[v[p * 2:p * 2 + 2] for v in first] for p in range(8)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    members.drop()


def test_decoded_vectors_are_near(spark):
    rnd = random.Random(1)
    centres = [[rnd.uniform(-1, 1) for _ in range(32)] for _ in range(10)]
    rows = [(i, [x + rnd.uniform(-0.01, 0.01) for x in centres[i % 10]], 0) for i in range(200)]
    coded, books = vector_codes.compressed(spark.createDataFrame(rows, VECTORS))
    got = {r.vec_id: r.approximation for r in vector_codes.decoded(vector_codes.codes(coded), books).collect()}
    assert max(max(abs(a - b) for a, b in zip(got[i], v)) for i, v, _ in rows) < 0.05


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    groups, out = defaultdict(list), Counter()
    for r in rows:
        groups[r.lang].append(r)

    def levels(nodes):
        found = [nodes]
        while len(nodes) > 1:
            nodes = [H("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
            found.append(nodes)
        return found

    def path(found, i):
        steps = []
        for nodes in found[:-1]:
            at = i // 8 * 8
            steps.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + 8])))
            i //= 8
        return steps

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {x: levels([leaf(r, r.text) for r in groups[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            proof, text = path(trees[x], i) + path(top, k), r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            node = leaf(r, text)
            for before, after in proof:
                node = H(before + node + after)
            out[r.doc_id, leaf(r, r.text), trees[x][-1][0], top[-1][0], H("".join(a + b for a, b in proof)), node, node == top[-1][0]] += 1
    return out


def odd_documents():
    rows = [(i, f"Text {i} É", "en", "s", i) for i in range(600)] + [(i, f"Texte {i}", "fr", None, None) for i in range(9)] + [(7, "Allein", "de", "s", 1)]
    rows += [(3, "Copy", "en", "s", 1)] * 20 + [(3, "COPY", "en", "s", 1), (None, "No ID", "en", "s", 1), (None, None, None, None, None), (4, "", None, "", 0), (5, "A" * 50_000, "", "s", 1)]
    return rows + [(1000 + k, f"Lang {k}", f"x{k}", "s", k) for k in range(70)]


def test_manifest(spark):
    frame = spark.createDataFrame(odd_documents(), DOCS)
    expected = manifest_by_hand(frame.collect())
    assert Counter(tuple(r) for r in merkle_dag.digest(frame).collect()) == expected
    assert Counter(tuple(r) for r in merkle_dag.digest(clashing(frame)).collect()) == expected
    assert merkle_dag.digest(frame.limit(0)).collect() == []
    one = frame.where("doc_id = 7 and lang = 'de'")
    assert Counter(tuple(r) for r in merkle_dag.digest(one).collect()) == manifest_by_hand(one.collect())


def test_proofs_of_some_leaves(spark):
    found = merkle_dag.manifest(merkle_dag.document_leaves(spark.createDataFrame(odd_documents(), DOCS)))
    assert found.store.count() == found.store.select("digest").distinct().count()
    assert found.store.where(merkle_dag.joined_digest(F.col("children")) != F.col("digest")).isEmpty()
    asked = found.leaves.where("doc_id % 50 = 7")
    every = {(r.tree, r["rank"]): r.proof for r in merkle_dag.proofs(found).collect()}
    some = merkle_dag.proofs(found, asked)
    rows = some.withColumn("root", merkle_dag.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(rows) == asked.count() and {r.root for r in rows} == {found.root}
    assert all(every[r.tree, r["rank"]] == r.proof for r in rows)


def test_pieces_give_the_ids_of_whole_texts():
    with open(VOCABULARY, encoding="utf-8") as file:
        pieces = token_files._Pieces(file.read(), "<u2")
    whole = Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = True
    rnd = random.Random(1)
    letters = "abcdeéÉ́̈ İıſß'sS'LL 日本 \n\t\r\x0b\x0c\x1c\x85\xa0 　!?1234😀 <|endoftext|>가각ΑΣς"
    for k in range(3000):
        letters = letters if k % 2 else "abcXYZéÉſßÀÿ.,!?'s9²ªĀİ-\x01#$ "
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 40, 300])))
        assert np.frombuffer(pieces.encoded([text.encode()])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("most", [4, 6, 20])
def test_lengths_are_optimal_within_the_limit(most):
    rnd = random.Random(most)
    counts = {i: rnd.choice([1, 2, 5, 40, 3000]) for i in range(14)}
    lengths = token_files.code_lengths(counts, most)
    assert max(lengths.values()) <= most and sum(2.0 ** -b for b in lengths.values()) <= 1
    # By dynamic programming over sorted counts: least cost with codes worth 2 ** most in all.
    best = {0: 0}
    for n in sorted(counts.values()):
        best = _least(best, n, most)
    assert sum(counts[i] * b for i, b in lengths.items()) == min(best.values())
    assert token_files.code_lengths({7: 3}) == {7: 1} and token_files.code_lengths({}) == {}
    with pytest.raises(ValueError):
        token_files.code_lengths({i: 1 for i in range(17)}, 4)


def _least(best, n, most):
    out = {}
    for room, cost in best.items():
        for b in range(1, most + 1):
            if (k := room + (1 << (most - b))) <= 1 << most:
                out[k] = min(out.get(k, 1 << 60), cost + n * b)
    return out


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.exponential(300, n).astype(np.int64), 49_000)
    lengths = token_files.code_lengths(dict(Counter(ids.tolist())))
    code = token_files.Code(np.array(list(lengths)), np.array(list(lengths.values())))
    data, marks = code.pack(ids)
    lanes = np.frombuffer(marks, "<u4")
    back, again = code.unpack([data, data], [lanes, lanes], [n, n])
    assert (back == ids).all() and (again == ids).all()


def test_joined_crc():
    rnd, zeros = random.Random(2), token_files.zero_bytes()
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(100)), rnd.randbytes(rnd.randrange(3000))
        assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b), zeros) == zlib.crc32(a + b)


def token_documents():
    rows = [(i, f"Some words, number {i}! " * (i % 7), "en", "s", 1) for i in range(300)]
    return rows + [(-5, None, "en", "s", 1), (-6, "", "en", "s", 1), (-7, " \n ", "en", "s", 1), (None, "no id <|endoftext|>", "en", "s", 1), (41, "same", "en", "s", 1), (41, "same", "en", "s", 1),
                   (1000, "long text of many words " * 40_000, "en", "s", 1), (1001, "x" * 30_000, "en", "s", 1)]


def test_token_files(spark, tmp_path):
    frame = spark.createDataFrame(token_documents(), DOCS)
    coder = Tokenizer.from_file(VOCABULARY)
    coder.encode_special_tokens = True
    ids = [(i, coder.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in token_documents()]
    check = lambda x, kind: zlib.crc32(np.array(x, kind).tobytes())
    ids.sort(key=lambda r: (r[0] is not None, r[0] or 0, check(r[1], "<u2")))
    expected, stream = [], []
    for i, x in ids:
        expected.append((i, len(stream), len(x), check(x, "<u4")))
        stream += x
    path = f"{tmp_path}/ids"
    got = [tuple(r) for r in token_files.digest(frame, VOCABULARY, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    assert Counter(tuple(r) for r in token_files.digest(clashing(frame), VOCABULARY, f"{tmp_path}/more").collect()) == Counter(expected)
    for start, count in ((0, 10), (65_530, 20), (100, 150_000), (len(stream) - 3, 100)):
        parts = sorted(tuple(r) for r in token_files.read_span(spark, path, start, count).collect())
        assert sum((x for _, x in parts), []) == stream[start:start + count]


def test_no_token_files(spark):
    empty = spark.createDataFrame([], DOCS)
    assert token_files.digest(empty, VOCABULARY, new_run_dir(spark, "none")).collect() == []
