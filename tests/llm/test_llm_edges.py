"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import json
import random
import time
import uuid

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from playbill.llm import byte_bpe, chat_schema, decontaminate, license_rules, quality_cascade, revisits, shard_slots, simhash_trie, toxicity_labels, wrapper
from playbill.llm.queries import VOCABULARY

RANKS = public_tokenizers.path(VOCABULARY)
LONG = "word " * 30_000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (6, "x" * 40_000), (7, LONG), (8, "é ü 日本 😀 \x0b y")]
DOCS = "doc_id long, text string"
#: Columns named like what operators add.
CLASH = ("spans", "n_words", "score", "ids", "print", "_words", "shard", "a.b")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TEXTS, DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("b", "one"), ("c", None), (None, "no id")], "item_id string, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 5, int(i % 4 == 0)) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def document_digests(tmp, benchmark, labels):
    return {
        "shards": lambda d: shard_slots.digest(d, f"{tmp}/map-{uuid.uuid4().hex}"), "licenses": license_rules.digest, "simhash": simhash_trie.digest,
        "quality": quality_cascade.digest, "toxicity": lambda d: toxicity_labels.digest(d, labels),
        "benchmark": lambda d: decontaminate.digest(d, benchmark), "bpe": lambda d: byte_bpe.digest(d, RANKS, public_tokenizers.PATTERN)}


@pytest.mark.parametrize("name", ["shards", "licenses", "simhash", "quality", "toxicity", "benchmark", "bpe"])
def test_edges(spark, rows, benchmark, labels, tmp_path, name):
    run = document_digests(tmp_path, benchmark, labels)[name]
    plain = sorted(map(str, run(rows).collect()))
    assert len(plain) == len(TEXTS)
    assert sorted(map(str, run(rows.withColumns({name: F.lit("kept") for name in CLASH})).collect())) == plain
    assert run(spark.createDataFrame([], DOCS)).collect() == []


def test_pipeline_edges(spark, rows, tmp_path):
    long_texts = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(80)), "en", "s", 1) for i in (20, 21)], f"{DOCS}, lang string, source string, n_chars long")
    docs = rows.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")}).union(long_texts).union(long_texts.withColumn("doc_id", F.col("doc_id") + 10))
    docs.withColumns({name: F.lit("kept") for name in CLASH}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "w20x1 w20x2 w20x3")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {21}
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, kept, str(tmp_path)).schema.names == kept.schema.names
        assert stage(spark, kept.limit(0), str(tmp_path)).count() == 0


def test_pages_edges(spark):
    same = "<body><div class=top>Same words</div><div class=main><p>{0}</p></div><div class=x>Also the same</div></body>"
    pages = [(i, f"http://h/{i}", same.format(f"text {i}")) for i in range(8)]
    pages += [(20, None, None), (21, "http://one/1", ""), (22, "http://one/2", "<p>a<p>b &amp; c<!-- x --><script>no</script><form>f</form>"), (22, "http://one/2", "<p>a<p>b &amp; c<!-- x --><script>no</script><form>f</form>"),
              (23, "x", "<article><h1>T</h1>\n one <b>two</b>\tthree<aside>no</aside><ul><li>x<li>y</ul><div class='comments'>no</div></article><p>no"), (24, "x", "<div" * 3000), (25, "x", "<div>" * 2000 + "deep")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("_host", F.lit(1))
    got = sorted((r.page_id, r.text) for r in wrapper.extracted(rows.drop("_host")).collect())
    assert got[:8] == [(i, f"text {i}") for i in range(8)]
    assert dict(got) | {24: "", 25: "deep"} == dict(got[:8]) | {20: "", 21: "", 22: "a\nb & c", 23: "T\none two three\nx\ny", 24: "", 25: "deep"}
    assert wrapper.digest(rows.limit(0)).collect() == []


def test_tree_matching():
    a = ["html", "", [["div a", "1", []], ["div b", "2", [["p", "3", []]]], ["div c", "4", []]]]
    b = ["html", "", [["div b", "9", [["p", "3", []], ["p", "5", []]]], ["div c", "4", []]]]
    size, pairs = wrapper.matching(a, b)
    assert size == 4 and [(x[1], y[1]) for x, y in pairs if x[1]] == [("4", "4"), ("2", "9"), ("3", "3")] or size == 4


def test_own_text_in_a_constant_slot_stays(spark):
    page = "<body><div class=top>{}</div><div class=main><p>{}</p></div><nav>{}</nav></body>"
    rows = [(i, f"http://h/{i}", page.format("Own words" if i == 3 else "Same words", f"text {i}", "menu")) for i in range(20)]
    rows += [(100 + i, f"http://copies/{i}", page.format("Top", "One body" if i < 60 else f"body {i}", f"menu {i}")) for i in range(64)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == ("Own words\n" if i == 3 else "") + f"text {i}" for i in range(20))
    assert all(got[100 + i] == ("One body" if i < 60 else f"body {i}") for i in range(64)), got


def test_layouts_of_one_host(spark):
    one = "<body><div class=main><p>text {0}</p></div><div class=legal>Legal words</div></body>"
    other = "<body><section class=story><p>text {0}</p></section><section class=about>About words</section></body>"
    third = "<body><div class=main><p>text {0}</p></div><div class=legal>Legal words</div><ul class=list><li>item {0}</li></ul></body>"
    kinds = [one] * 12 + [other] * 8 + [third] * 2
    rows = [(i, f"http://h/{i}", k.format(i)) for i, k in enumerate(kinds)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}" for i in range(20)), got
    assert [got[i] for i in (20, 21)] == ["text 20\nLegal words\nitem 20", "text 21\nLegal words\nitem 21"]


def test_large_pages_are_aligned_whole():
    page = lambda n, i: wrapper.skeleton(wrapper.parse("<body>" + "".join(f"<div><div>text {i} {k}</div></div>" for k in range(n)) + "<div>Same words</div></body>"))
    a, b = page(3000, 1), page(1500, 2)
    size, pairs = wrapper.matching(a, b)
    assert size == len(pairs) == 2 + 3000 + 1
    assert [x[1] for x, y in pairs if x[1] == y[1]] == [a[2][0][2][-1][1]]
    assert wrapper.matching(a, json.loads(json.dumps(a)))[0] == 6000 + 3


def test_names_and_marked_parts():
    text = lambda page: wrapper.main_text(page, None, {})
    body = "long text " * 40
    assert text("<article><p>Body text here</p><article class='comment odd'><p>nice</p></article></article>") == "Body text here"
    assert text("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body</p></article>") == "Title\nBody"
    assert text("<article><div class='article-header'><h1>Head</h1></div><p>Body</p></article>") == "Head\nBody"
    assert text(f"<body><div class=body><p>{body}</p></div><article><p>teaser</p></article>") == f"{body.strip()}\nteaser"
    assert text("<div class='search-results-guide'><p>guide</p></div>") == "guide"
    for name in ("site-header", "comment-list", "main-nav", "searchForm", "sidebar widget-area", "post_comments", "ad-slot-3", "cookie-notice"):
        assert text(f"<div class='{name}'>no</div><p>yes</p>") == text(f"<div id='{name.split()[0]}'>no</div><p>yes</p>") == "yes", name


@pytest.mark.parametrize("hostile", [lambda n: "<![CDATA[ x>" * n, lambda n: "<blockquote>" * n, lambda n: "<section>" * n + "</h1>" * n])
def test_hostile_markup_in_linear_time(hostile):
    seconds = []
    for n in (20_000, 40_000):
        start = time.perf_counter()
        wrapper.parse(hostile(n))
        seconds.append(time.perf_counter() - start)
    assert seconds[1] <= 2.5 * seconds[0] + 0.3, seconds


def test_chat_layouts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\ <|im_end|>\n<|im_start|>user", "", "plain \\n \\\\", "<<SYS>> <</SYS>> <s>"]
    table = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(texts)] + [(2, None, None, None), (2, 1, "a\nb", "x"), (None, 0, "user", "y")],
                                  "conv_id long, turn int, role string, text string").withColumn("loss", F.lit(0))
    records = spark.createDataFrame([
        (10, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "extra": 1}'), (11, '{"instruction": "i", "input": "n", "output": "o"}'),
        (12, '{"prompt": "p", "response": "r"}'), (13, '{"other": 1}'), (14, None), (15, "broken")], "conv_id long, record string")
    turns = chat_schema.canonical(table).unionByName(chat_schema.canonical_records(records))
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat_schema.read_back(chat_schema.formatted(turns)).collect()}
    assert back[1] == ([("assistant" if t % 2 else "user", x) for t, x in enumerate(texts)], texts[1] + texts[3])
    assert back[2] == ([("", ""), ("a\nb", "x")], "") and back[None][0] == [("user", "y")]
    assert back[10] == ([("user", "q"), ("assistant", "a")], "a") and back[11][0] == [("user", "i"), ("user", "n"), ("assistant", "o")] and back[12][1] == "r"
    assert {r.conv_id for r in chat_schema.unmapped(records).collect()} == {13, 14, 15} and set(back) == {None, 1, 2, 10, 11, 12}
    assert len(chat_schema.digest(table.limit(0)).collect()) == 1
    with pytest.raises(ValueError):
        chat_schema.canonical(spark.range(1))


def test_revisits(spark):
    kind = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string, payload_length long"
    rows = [(1, "http://A.com/x/", 10, "response", {"ETag": '"a"', "Content-Length": "5", "Server": "s"}, "d1", 5), (2, "https://www.a.com/x?utm_source=q#f", 20, "response", {"ETag": '"b"'}, "d2", 6),
            (3, "http://a.com/x", 20, "revisit", {"etag": 'W/"a"', "Date": "now", "Content-Length": "0"}, None, None), (4, "http://a.com/x", 21, "revisit", {"etag": '"a"'}, None, None),
            (5, "http://a.com/x", 5, "revisit", {}, None, None), (6, None, 30, "revisit", {}, None, None), (7, "http://a.com/x", None, "revisit", {}, None, None), (3, "http://a.com/x", 20, "revisit", {"etag": 'W/"a"', "Date": "now", "Content-Length": "0"}, None, None)]
    got = sorted((r.record_id, r.status, r.refers_to, r.payload_digest, dict(r.headers)) for r in revisits.resolved(spark.createDataFrame(rows, kind)).collect())
    one = (3, "resolved", 1, "d1", {"etag": 'W/"a"', "content-length": "5", "server": "s", "date": "now"})
    assert got == [one, one, (4, "validator_mismatch", 2, None, {"etag": '"a"'}), (5, "unmatched", None, None, {}), (6, "unmatched", None, None, {}), (7, "unmatched", None, None, {})]
    assert revisits.resolved(spark.createDataFrame([], kind)).collect() == []


def test_revisits_a_fraction_later(spark):
    kind = "record_id long, url string, ts double, kind string, headers map<string,string>, payload_digest string, payload_length long"
    times = [(1, 10.0, "response"), (2, 10.25, "response"), (3, 10.5, "revisit"), (4, 10.25, "revisit"), (5, 10.0, "revisit"), (6, None, "response"), (7, 9.0, "revisit"), (8, 10.25, "response")]
    rows = [(i, "http://h/a", t, k, {"etag": "e"}, str(i), i) for i, t, k in times]
    got = {r.record_id: (r.status, r.refers_to) for r in revisits.resolved(spark.createDataFrame(rows, kind).withColumn("match", F.lit(1)).withColumn("a.b", F.lit(1))).collect()}
    assert got == {3: ("resolved", 8), 4: ("resolved", 1), 5: ("unmatched", None), 7: ("unmatched", None)}


def test_windows_that_many_items_share():
    windows, _ = decontaminate.hash_set((b"a b c", str(i)) for i in range(200_000))
    assert len(windows[b"a b c"]) == 200_000


def test_hot_url_is_carried_across_ranges(spark):
    kind = "record_id long, url string, ts long, kind string, headers map<string,string>, payload_digest string, payload_length long"
    rows = [(i, "http://h/hot" if i % 3 else f"http://h/{i % 7}", i, "response" if i % 10 == 0 else "revisit", {"etag": "e"}, str(i), i) for i in range(600)]
    got = {r.record_id: r.refers_to for r in revisits.resolved(spark.createDataFrame(rows, kind), cells=16).collect()}
    for i, url, _, what, *_ in rows:
        if what == "revisit":
            assert got[i] == max((j for j, u, _, w, *_ in rows if u == url and w == "response" and j < i), default=None)


def test_slot_map_edits():
    rnd = random.Random(3)
    loads = {v: rnd.randint(1, 100) for v in range(512)}
    first = shard_slots.deal(loads, 8, 512)
    grown = shard_slots.grow(first, loads, 8)
    assert all(grown[v] in (first[v], 8) for v in first)
    total = [sum(loads[v] for v in grown if grown[v] == s) for s in range(9)]
    assert max(total) - min(total) <= 100
    loads |= {v: 5000 for v in range(8)}
    moved = shard_slots.rebalance(first, loads, 8)
    total = [sum(loads[v] for v in moved if moved[v] == s) for s in range(8)]
    assert max(total) - min(total) <= 5000 and sum(moved[v] != first[v] for v in first) < 256


def test_map_versions(spark, tmp_path):
    path = f"{tmp_path}/map"
    assert [shard_slots.append_version(spark, path, {0: 0, 1: s}, 2) for s in (0, 1)] == [0, 1]
    assert [r.shard for r in shard_slots.read_version(spark, path, 1).orderBy("slot").collect()] == [0, 1]


@pytest.mark.parametrize("split_rows", [20_000, 8])
def test_trie_join(spark, split_rows):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    values = {rnd.getrandbits(64) for _ in range(200)}
    for b in base:
        for _ in range(12):
            for _ in range(rnd.randint(0, 3)):
                b ^= 1 << rnd.randrange(64)
            values.add(b)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    links = simhash_trie.trie_links(spark.createDataFrame([(0, v, v) for v in signed], "part int, print long, id long"), split_rows=split_rows)
    got = {r.node: r.label for r in simhash_trie.components(links).collect()}
    name = {v: v for v in signed}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                name[y] = x
    assert {v: got.get(v, v) for v in signed} == {v: root(v) for v in signed}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    assert {r.node: r.label for r in simhash_trie.components(links).collect()} == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def groups_by_hand(prints):
    """Label of each position: the smallest one reachable over pairs within two bits."""
    name = list(range(len(prints)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                name[y] = x
    return [root(i) for i in range(len(prints))]


def test_one_of_each(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(40):
        text = rnd.choices(words, k=200)
        for c in range(rnd.randint(1, 5)):
            copy = list(text)
            for _ in range(c // 2):
                copy[rnd.randrange(200)] = rnd.choice(words)
            rows.append((rnd.randrange(100), " ".join(copy)))
    rows += [rows[0]] * 5 + [(None, rows[3][1]), (None, "alone and without an id"), (None, None), (7, ""), (8, " "), (5, "T t"), (5, "T t"), (7, "U u"), (7, "T t")]
    prints = [simhash_trie.simhash(simhash_trie.shingle_hashes((t or "").encode(), 3)) for _, t in rows]
    groups = groups_by_hand(prints)
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{DOCS}, `a.b` int")
    left = [(r.doc_id, r.text, r["a.b"]) for r in simhash_trie.one_of_each(frame).collect()]
    assert sorted(groups[i] for _, _, i in left) == sorted(set(groups))
    for i, text, at in left:
        assert rows[at] == (i, text)
        assert (i is None, i or 0) == min((j is None, j or 0) for (j, _), g in zip(rows, groups) if g == groups[at])
    assert {(i, t) for i, t, _ in left} >= {(5, "T t"), (7, "U u")}


def test_thousands_of_copies(spark):
    """Copies of one text that differ in a word or two: the links are many, what passes on is a forest."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10 ** 9)}" for _ in range(1500)]
    rows = []
    for i in range(3000):
        copy = list(base)
        copy[rnd.randrange(1500)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    prints = sorted({simhash_trie.simhash(simhash_trie.shingle_hashes(t.encode(), 3)) for _, t in rows})
    left = simhash_trie.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert len(left) == len(set(groups_by_hand(prints)))
    signed = [(0, v - (1 << 64) if v >> 63 else v) for v in prints]
    links = simhash_trie.trie_links(spark.createDataFrame([(p, v, v) for p, v in signed], "part int, print long, id long"))
    assert links.count() <= 3 * len(prints)


def test_long_words():
    ranks = byte_bpe.read_ranks(RANKS)
    mine = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice("abcdeén 日本 \n\t!?1234😀ſ ") for _ in range(rnd.choice([1, 40, 400]))) + rnd.choice(["", "ab" * 400, "aaa" * 99])
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text.encode()


def test_benchmark_blocks_and_cuts(spark):
    rnd = random.Random(1)
    items = [(f"i{k}", " ".join(f"t{rnd.randrange(50)}" for _ in range(rnd.choice([1, 4, 12, 30])))) for k in range(60)]
    docs = [(k, " ".join([f"t{rnd.randrange(50)}" for _ in range(40)] + items[k][1].upper().split() + ["end."])) for k in range(60)]
    rows, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(str, decontaminate.contaminated_spans(rows, bench).collect()))
    assert sorted(map(str, decontaminate.contaminated_spans(rows, bench, block=100).collect())) == whole
    bare = decontaminate.without_spans(decontaminate.contaminated_spans(rows, bench))
    assert all(not r.spans or len(r.text.split()) < 42 + 30 for r in bare.collect())
    one = spark.createDataFrame([(1, "Keep this, AB cd! and that")], DOCS)
    marked = decontaminate.contaminated_spans(one, spark.createDataFrame([("x", "ab CD")], "item_id string, text string"))
    assert [r.text for r in decontaminate.without_spans(marked).collect()] == ["Keep this, ! and that"]


def test_cascade_order_never_changes_the_verdict(spark, rows):
    ordered = quality_cascade.cascade_order(rows)
    assert set(ordered) == set(quality_cascade.RULES)
    measured = quality_cascade.measured(rows)
    verdicts = [sorted(str(r) for r in measured.select("doc_id", quality_cascade.verdict(o).isNull().alias("kept")).collect()) for o in (ordered, ordered[::-1])]
    assert verdicts[0] == verdicts[1]
