"""DuckDB equivalents, by query."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SPACE = r"[\x20\x09-\x0D]"


def escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '\\'), '(<|\[)(\||/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g')"


def canonical(url: str) -> str:
    bare = rf"regexp_replace(regexp_replace(trim({url}), '^https?://', '', 'i'), '#.*$', '')"
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), '^(?:www|m)\.', ''), ':(?:80|443)$', '')"
    rest = rf"regexp_replace({bare}, '^[^/?]*', '')"
    path = rf"regexp_replace(regexp_extract({rest}, '^[^?]*'), '/+$', '')"
    params = rf"""array_to_string(list_sort(list_filter(string_split(regexp_extract({rest}, '\?(.*)$', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&')"""
    return f"{host} || {path} || CASE WHEN {params} = '' THEN '' ELSE '?' || {params} END"


def lloyd(rounds: int = 6) -> str:
    """The rounds of vector code compression, one after the other."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT r, p, min({{'d': list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best
      FROM parts JOIN c{k} USING (p) GROUP BY r, p)"""

    def updated(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{k} AS c LEFT JOIN (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
          SELECT p, best.e AS e, j, sum(part[j]) AS s, count(*) AS n FROM a{k} JOIN parts USING (r, p), unnest(range(1, len(part) + 1)) AS t(j) GROUP BY ALL) GROUP BY p, e) AS m ON m.p = c.p AND m.e = c.e)"""

    steps = ",\n".join(f"{assigned(k)},\n{updated(k)}" for k in range(rounds))
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, label, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS part FROM k, unnest(range(8)) AS t(p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT p, e, part::HUGEINT[] AS c FROM parts JOIN first USING (r)),
{steps},
{assigned(rounds)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} JOIN parts USING (r, p) GROUP BY r, vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books"""


def merkle(levels: int = 7, top: int = 4) -> str:
    """A manifest of at most 8 ** levels documents for each lang, and 8 ** top langs."""
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def above(name: str, k: int) -> str:
        return f"""{name}{k + 1} AS MATERIALIZED (SELECT g, r // 8 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h,
      (any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY g, r // 8)"""

    def climbed(name: str, k: int, before: str) -> str:
        return f"""{name}p{k} AS MATERIALIZED (SELECT d.* REPLACE (
        sibs || coalesce(b, '') || coalesce(a, '') AS sibs, CASE WHEN n > 1 THEN sha256(coalesce(b, '') || node || coalesce(a, '')) ELSE node END AS node, pos // 8 AS pos)
      FROM {before} AS d JOIN (SELECT x.g, x.r, any_value(x.n) AS n, string_agg(y.h, '' ORDER BY y.r) FILTER (y.r < x.r) AS b, string_agg(y.h, '' ORDER BY y.r) FILTER (y.r > x.r) AS a
        FROM {name}{k} AS x JOIN {name}{k} AS y ON x.g IS NOT DISTINCT FROM y.g AND x.r // 8 = y.r // 8 GROUP BY x.g, x.r) AS s ON s.g IS NOT DISTINCT FROM d.{name}g AND s.r = d.pos)"""

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of the decimal doc_id, bit by bit.
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295)")
    lang = [above("t", k) for k in range(levels)] + [climbed("t", k, f"tp{k - 1}" if k else "start") for k in range(levels)]
    last = [above("u", k) for k in range(top)] + [climbed("u", k, f"up{k - 1}" if k else "middle") for k in range(top)]
    return f"""
WITH d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claim FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
t0 AS MATERIALIZED (SELECT lang AS g, r, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM o),
start AS MATERIALIZED (SELECT doc_id, leaf, lang AS tg, 0 AS ug, r AS pos, claim AS node, '' AS sibs FROM o),
{",".join(lang)},
roots AS MATERIALIZED (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t{levels}),
u0 AS MATERIALIZED (SELECT 0 AS g, r, h, n FROM roots),
middle AS MATERIALIZED (SELECT d.* REPLACE (r AS pos), h AS subroot FROM tp{levels - 1} AS d JOIN roots ON lang IS NOT DISTINCT FROM tg),
{",".join(last)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, node AS folded_root, node = h AS verified FROM up{top - 1}, u{top}"""


ORACLES = {
    "op5_quality_cascade": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM w, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM m, unnest(range(0, 3)) AS t(k) GROUP BY r),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(t) - length(replace(t, '!!', '!')) AS n_shouts
      FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_shouts * 2 > n_words OR n_dup_lines * 2 > n_lines) AS kept
FROM f""",
    "op6_chat_schema": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(replace({escaped("role")}, chr(10), '\\' || chr(10))) + 1 + length({escaped("text")}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op10_revisits": f"""
WITH p AS (SELECT page_id::BIGINT AS page_id, {canonical("url")} AS response_url, {canonical("regexp_replace(url, '^http:', 'https:') || '#seen'")} AS revisit_url,
                  sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT v.page_id, v.revisit_url AS canonical_url, v.d, max(r.page_id) AS refers_to_page
      FROM p AS v LEFT JOIN p AS r ON r.response_url = v.revisit_url AND 2 * r.page_id < 2 * v.page_id + 3 GROUP BY ALL),
s AS (SELECT m.*, r.d AS stored, r.n, CASE WHEN m.refers_to_page IS NULL THEN 'unmatched'
             WHEN m.page_id % 7 <> 0 AND left(m.d, 16) = left(r.d, 16) THEN 'resolved' ELSE 'validator_mismatch' END AS status
      FROM m LEFT JOIN p AS r ON r.page_id = m.refers_to_page),
h AS (SELECT *, 'date=day ' || (page_id + 1) || chr(10) || 'etag=' || CASE WHEN page_id % 7 = 0 THEN '"outdated"' ELSE 'W/"' || left(d, 16) || '"' END AS own FROM s)
SELECT page_id, canonical_url, status, refers_to_page, CASE WHEN status = 'resolved' THEN stored END AS payload_digest,
       CASE WHEN status = 'resolved' THEN n END AS payload_length,
       sha256('content-length=' || CASE WHEN status = 'resolved' THEN n ELSE 0 END || chr(10) || own || CASE WHEN status = 'resolved' THEN chr(10) || 'server=origin' ELSE '' END) AS headers_sha256
FROM h""",
    "op8_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
g AS (SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS gram
      FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT DISTINCT len(gram) AS n FROM g),
o AS (SELECT r, i, n.n AS n, list_slice(w, i, i + n.n - 1) AS gram FROM d, n, unnest(range(1, len(w) - n.n + 2)) AS t(i) WHERE len(w) >= n.n),
h AS (SELECT o.r, o.i, o.n, g.item FROM o JOIN g USING (gram)),
p AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) AS t(k) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)""",
    "op11_vector_codes": lloyd(),
    "op12_merkle_dag": merkle(),
}
