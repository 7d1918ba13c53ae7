"""DuckDB queries with the same results as the Spark queries, on the given tables."""

from __future__ import annotations

_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _names(raw: str) -> str:
    """SQL for the list of names in ``raw``."""
    listed = f"json_extract_string({raw}, '$[*].name')"
    parts = f"list_filter(list_transform(string_split({raw}, '|'), lambda x: trim(x)), lambda x: x <> '')"
    return f"""CASE WHEN {raw} IS NULL OR trim({raw}) = '' THEN CAST([] AS VARCHAR[])
        WHEN json_valid({raw}) AND json_type({raw}) = 'ARRAY' AND len({listed}) > 0 THEN {listed}
        WHEN len({parts}) > 0 THEN {parts}
        ELSE [trim({raw})] END"""


# Common tables, by name; each may use the ones before it.
_CTES = {
    "sold": "SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS sold FROM lineitem GROUP BY 1",
    "raw_catalog": """
        SELECT p_partkey AS movie_id, p_name AS title, text AS overview,
            CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(round(p_retailprice) AS BIGINT) * p_size * 10 END AS budget,
            CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE coalesce(sold, 0) END AS revenue,
            p_size AS runtime, lang AS language,
            CASE WHEN p_partkey % 50 = 1 THEN '[]' WHEN p_partkey % 50 = 2 THEN ''
                WHEN p_partkey % 10 = 3 THEN p_type || '|' || p_brand
                WHEN p_partkey % 10 = 4 THEN p_type
                ELSE '[{"id": 1, "name": "' || p_type || '"}, {"id": 2, "name": "' || p_brand || '"}]' END AS genres,
            CASE WHEN p_partkey % 40 = 5 THEN '' WHEN p_partkey % 40 = 6 THEN 'unknown'
                ELSE concat(CAST(1980 + p_partkey % 37 AS VARCHAR), '-0', CAST(1 + p_partkey % 9 AS VARCHAR), '-15') END AS release_date,
            CASE WHEN p_partkey % 20 = 0 THEN 'Rumored' ELSE 'Released' END AS status
        FROM part LEFT JOIN documents ON doc_id = p_partkey LEFT JOIN sold ON l_partkey = p_partkey""",
    "catalog": f"""
        SELECT *, coalesce(genre_names[1], 'Unknown') AS primary_genre,
            list_distinct(list_transform(genre_names, lambda x: lower(x))) AS genre_keys,
            CASE WHEN length(release_date) >= 4 THEN TRY_CAST(substr(release_date, 1, 4) AS INTEGER) END AS release_year,
            CASE WHEN release_date IS NOT NULL THEN
                coalesce(TRY_CAST(regexp_extract(substr(release_date, 1, 4), '^\\s*([+-]?[0-9]+)', 1) AS INTEGER), 0) END AS filter_year
        FROM (SELECT *, {_names('genres')} AS genre_names FROM raw_catalog)""",
    "ratings": """
        SELECT o_custkey AS user_id, l_partkey AS movie_id, ceil(l_quantity / 5.0) * 0.5 AS rating, l_shipdate AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "stats": "SELECT movie_id, avg(rating) AS avg_rating, count(rating) AS n_ratings FROM ratings GROUP BY 1",
    "eligible": """
        SELECT * FROM catalog WHERE overview IS NOT NULL AND overview <> '' AND budget > 0 AND revenue > 0
            AND status = 'Released' AND genres IS NOT NULL AND genres <> ''""",
    "rated_pool": """
        SELECT eligible.*, avg_rating, coalesce(n_ratings, 0) AS n_ratings FROM eligible LEFT JOIN stats USING (movie_id)""",
    "ranks": """
        SELECT movie_id,
            percent_rank() OVER (PARTITION BY primary_genre ORDER BY budget) AS budget_rank,
            percent_rank() OVER (PARTITION BY primary_genre ORDER BY revenue) AS revenue_rank,
            percent_rank() OVER (PARTITION BY primary_genre ORDER BY CAST(revenue AS DOUBLE) / budget) AS roi_rank
        FROM eligible""",
    "words": """
        SELECT movie_id, genre_keys, unnest(string_split_regex(lower(overview), '[^\\p{L}]+')) AS word FROM eligible""",
    "tf": """
        SELECT movie_id, word, count(*) AS tf FROM words
        WHERE length(word) >= 4 AND NOT list_contains(genre_keys, word) GROUP BY ALL""",
    "df": "SELECT word, count(*) AS df FROM tf GROUP BY 1",
    "ranked_words": """
        SELECT movie_id, word, row_number() OVER (PARTITION BY movie_id ORDER BY score DESC, word) AS rank
        FROM (SELECT movie_id, word, round(tf * ln((SELECT count(*) FROM eligible) / df), 6) AS score FROM tf JOIN df USING (word))""",
    "sentiments": """
        SELECT doc_id AS movie_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS overview_sentiment
        FROM labels""",
}


def _rules(name: str, low: str = "1", high: str = "2", cut_base: str = "3", k: int = 5) -> str:
    """SQL for the rule enrichment of the whole eligible pool; the cuts are low/base and high/base."""
    def tier(rank: str) -> str:
        return (f"CASE WHEN {rank} < CAST({low} AS DOUBLE) / {cut_base} THEN 'low' "
                f"WHEN {rank} < CAST({high} AS DOUBLE) / {cut_base} THEN 'medium' ELSE 'high' END")

    return f"""
        SELECT movie_id, title, coalesce(overview_sentiment, 'neutral') AS overview_sentiment,
            {tier('budget_rank')} AS budget_tier, {tier('revenue_rank')} AS revenue_tier,
            CAST(least(10, 1 + floor(CAST(9 AS DOUBLE) * (CAST(0.6 AS DOUBLE) * roi_rank
                + CAST(0.4 AS DOUBLE) * coalesce((avg_rating - 0.5) / CAST(4.5 AS DOUBLE), 0.5)))) AS INTEGER) AS production_effectiveness_score,
            coalesce(themes, CAST([] AS VARCHAR[])) AS themes,
            CAST(len(list_filter(string_split_regex(lower(overview), '[^\\p{{L}}]+'), lambda w: w <> '')) AS BIGINT) AS input_tokens,
            CAST(coalesce(len(themes), 0) + 4 AS BIGINT) AS output_tokens, 'rules-v1' AS model
        FROM eligible JOIN ranks USING (movie_id) LEFT JOIN stats USING (movie_id) LEFT JOIN sentiments USING (movie_id)
            LEFT JOIN (SELECT movie_id, list(word ORDER BY rank) AS themes FROM ranked_words WHERE rank <= {k} GROUP BY 1) USING (movie_id)"""


_CTES["all_rules"] = _rules("all_rules")
_CTES["enriched"] = "SELECT * FROM all_rules WHERE len(themes) BETWEEN 3 AND 5 AND movie_id IN (SELECT doc_id FROM labels)"
_CTES["other_run"] = "SELECT * FROM (" + _rules("other_run", "0.4", "0.7", "1", 4) + ") WHERE movie_id IN (SELECT doc_id FROM labels)"
_CTES["found"] = """
    SELECT movie_id, title, release_year, budget, revenue, runtime, overview_sentiment, budget_tier, revenue_tier,
        production_effectiveness_score, array_to_string(themes, ',') AS themes,
        filter_year, genre_keys
    FROM catalog LEFT JOIN (SELECT * EXCLUDE (title) FROM enriched) USING (movie_id) WHERE status = 'Released'"""
_CTES["pairs"] = """
    SELECT user_id, movie_id FROM ratings UNION SELECT c_custkey, c_custkey * 2 FROM customer"""
_CTES["customer_pairs"] = "SELECT c_custkey AS user_id, c_custkey * 2 AS movie_id FROM customer"
_HISTORY = """
    SELECT * FROM (
        SELECT p.user_id, p.movie_id, h.movie_id AS rated_movie_id, h.rating, h.ts, c.title, c.genre_names, c.genre_keys,
            row_number() OVER (PARTITION BY p.user_id, p.movie_id ORDER BY h.ts DESC, h.movie_id, h.rating) AS rank
        FROM {pairs} p JOIN ratings h ON h.user_id = p.user_id AND h.movie_id <> p.movie_id JOIN catalog c ON c.movie_id = h.movie_id)
    WHERE rank <= 10"""
_CTES["history"] = _HISTORY.format(pairs="pairs")
_CTES["customer_history"] = _HISTORY.format(pairs="customer_pairs")
_LINE = "'  - ' || CAST(rating AS VARCHAR) || '/5.0 — ' || title || ' [' || array_to_string(genre_names[1:3], ', ') || ']'"
_CTES["features"] = """
    SELECT p.user_id, p.movie_id, t.movie_id IS NOT NULL AS known, count(h.rank) AS n, avg(h.rating) AS user_mean,
        count(*) FILTER (list_has_any(h.genre_keys, t.genre_keys)) AS n_genre,
        avg(h.rating) FILTER (list_has_any(h.genre_keys, t.genre_keys)) AS genre_mean
    FROM pairs p LEFT JOIN catalog t ON t.movie_id = p.movie_id LEFT JOIN history h ON h.user_id = p.user_id AND h.movie_id = p.movie_id
    GROUP BY ALL"""
_CTES["predictions"] = """
    SELECT user_id, movie_id, n, user_mean, n_genre,
        CASE WHEN NOT known THEN 'target_not_found' WHEN n < 3 THEN 'insufficient_history' ELSE 'ok' END AS status,
        CASE WHEN known AND n >= 3 THEN greatest(0.5, least(5.0,
            floor((user_mean + coalesce(CAST(n_genre AS DOUBLE) / (n_genre + 5) * (genre_mean - user_mean), 0.0)) * 2 + 0.5) / 2)) END AS predicted_rating
    FROM features"""
_CUT = "DATE '1997-01-01'"
_CELL = "CASE WHEN {0} < 16 THEN {0} ELSE (length(bin({0})) - 5) * 16 + ({0} >> (length(bin({0})) - 5)) END"
_CTES["amounts"] = f"""
    SELECT measure, primary_genre, movie_id, CASE WHEN amount > 0 THEN CAST({_CELL.format("amount")} AS INTEGER) END AS cell FROM (
        SELECT 'budget' AS measure, primary_genre, movie_id, budget AS amount FROM eligible UNION ALL SELECT 'revenue', primary_genre, movie_id, revenue FROM eligible)"""
_CTES["cell_sums"] = """
    SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY measure, primary_genre) AS m, sum(n) OVER w - n AS rows0, sum(s) OVER w - s AS s0, sum(q) OVER w - q AS q0,
        sum(n) OVER (PARTITION BY measure, primary_genre) AS rows1, sum(s) OVER (PARTITION BY measure, primary_genre) AS s1, sum(q) OVER (PARTITION BY measure, primary_genre) AS q1
    FROM (SELECT measure, primary_genre, cell, CAST(count(*) AS BIGINT) AS n, CAST(count(*) * cell AS BIGINT) AS s, CAST(count(*) * cell * cell AS BIGINT) AS q
        FROM amounts WHERE cell IS NOT NULL GROUP BY 1, 2, 3)
    WINDOW w AS (PARTITION BY measure, primary_genre ORDER BY cell)"""
_CTES["breaks"] = """
    SELECT measure, primary_genre, arg_min(a_cell, (cost, a_cell, b_cell)) AS medium_from, arg_min(b_cell, (cost, a_cell, b_cell)) AS high_from FROM (
        SELECT a.measure, a.primary_genre, a.cell AS a_cell, b.cell AS b_cell,
            a.q0 - CAST(a.s0 * a.s0 AS DOUBLE) / a.rows0 + (b.q0 - a.q0 - CAST((b.s0 - a.s0) * (b.s0 - a.s0) AS DOUBLE) / (b.rows0 - a.rows0))
                + (b.q1 - b.q0 - CAST((b.s1 - b.s0) * (b.s1 - b.s0) AS DOUBLE) / (b.rows1 - b.rows0)) AS cost
        FROM cell_sums a JOIN cell_sums b ON a.measure = b.measure AND a.primary_genre = b.primary_genre AND a.cell < b.cell AND a.place > 1) GROUP BY 1, 2
    UNION ALL SELECT measure, primary_genre, max(cell), CASE WHEN count(*) = 1 THEN max(cell) + 1 ELSE max(cell) END FROM cell_sums WHERE m < 3 GROUP BY 1, 2"""
_CTES["train_ratings"] = f"SELECT * FROM ratings WHERE ts < {_CUT}"
_CTES["test_ratings"] = f"SELECT user_id, movie_id, rating AS actual FROM ratings WHERE ts >= {_CUT}"
_CTES["test_pairs"] = "SELECT DISTINCT user_id, movie_id FROM test_ratings"
_CTES["test_history"] = _HISTORY.format(pairs="test_pairs").replace("JOIN ratings h", "JOIN train_ratings h")
_CTES["test_features"] = _CTES["features"].replace("FROM pairs p", "FROM test_pairs p").replace("JOIN history h", "JOIN test_history h")
_CTES["rule_predictions"] = _CTES["predictions"].replace("FROM features", "FROM test_features")
_CTES["user_effect0"] = "SELECT user_id, CAST(0 AS DOUBLE) AS user_effect FROM train_ratings GROUP BY 1"
for _k in range(3):
    _rest = "sum(rating - (SELECT avg(rating) FROM train_ratings) - coalesce({0}_effect, 0)) / (count(*) + 10.0)"
    _CTES[f"item_effect{_k + 1}"] = f"SELECT movie_id, {_rest.format('user')} AS item_effect FROM train_ratings LEFT JOIN user_effect{_k} USING (user_id) GROUP BY 1"
    _CTES[f"user_effect{_k + 1}"] = f"SELECT user_id, {_rest.format('item')} AS user_effect FROM train_ratings LEFT JOIN item_effect{_k + 1} USING (movie_id) GROUP BY 1"
_CTES["three_predictions"] = """
    SELECT 'effects' AS model, greatest(0.5, least(5.0, m + coalesce(item_effect, 0) + coalesce(user_effect, 0))) AS p, actual
    FROM test_ratings LEFT JOIN item_effect3 USING (movie_id) LEFT JOIN user_effect3 USING (user_id), (SELECT avg(rating) AS m FROM train_ratings)
    UNION ALL SELECT 'mean', m, actual FROM test_ratings, (SELECT avg(rating) AS m FROM train_ratings)
    UNION ALL SELECT 'history rule', predicted_rating, actual FROM test_ratings JOIN rule_predictions USING (user_id, movie_id)"""
_CTES["deltas"] = """
    SELECT user_id, movie_id, predicted_rating, actual, round(abs(predicted_rating - actual), 2) AS delta
    FROM (SELECT user_id, movie_id, max(struct_pack(ts := ts, rating := rating)).rating AS actual FROM ratings GROUP BY 1, 2)
    JOIN predictions USING (user_id, movie_id)"""
_CTES["candidates"] = """
    SELECT user_id, movie_id, rating AS actual, ts, title FROM ratings JOIN catalog USING (movie_id)
    WHERE movie_id IN (SELECT movie_id FROM enriched)
        AND user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 20)"""
_CTES["firsts"] = """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY user_id, ts, actual) AS rn FROM candidates) WHERE rn = 1"""
_CTES["sampled_pairs"] = "SELECT * FROM firsts ORDER BY md5(concat('7:', CAST(movie_id AS VARCHAR))), movie_id LIMIT 5"
_CTES["strata"] = "SELECT primary_genre, count(*) AS size FROM eligible GROUP BY 1"
_CTES["allocation"] = """
    SELECT primary_genre, size,
        CAST(base + CASE WHEN row_number() OVER (ORDER BY left_over DESC, primary_genre) <= 75 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats
    FROM (SELECT primary_genre, size, (75 * size) // sum(size) OVER () AS base, (75 * size) % sum(size) OVER () AS left_over FROM strata)"""
_CTES["top8"] = """
    SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, movie_id, ts DESC) AS rank
        FROM ratings r WHERE movie_id IN (SELECT movie_id FROM catalog)) WHERE rank <= 8"""
_CTES["bottom5"] = """
    SELECT user_id, movie_id, rating, ts, 6 - from_end AS rank FROM (
        SELECT r.*, row_number() OVER (PARTITION BY user_id ORDER BY rating, movie_id DESC, ts) AS from_end, count(*) OVER (PARTITION BY user_id) AS n
        FROM ratings r WHERE movie_id IN (SELECT movie_id FROM catalog)) WHERE from_end <= 5 AND n >= 13"""
_CTES["ranked_ratings"] = "SELECT *, 'top' AS side FROM top8 UNION ALL BY NAME SELECT *, 'bottom' AS side FROM bottom5"
_CTES["user_means"] = """
    SELECT user_id, count(*) AS n_ratings, round_even(avg(rating), 2) AS mean_rating FROM ratings
    WHERE movie_id IN (SELECT movie_id FROM catalog) GROUP BY 1"""


def _favorite(source: str, items: str, name: str) -> str:
    return f"""
        SELECT user_id, list(item ORDER BY place) AS {name} FROM (
            SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, mean DESC, item) AS place FROM (
                SELECT user_id, item, count(*) AS n, avg(rating) AS mean
                FROM (SELECT user_id, rating, unnest(list_distinct({items})) AS item FROM {source}) GROUP BY 1, 2))
        WHERE place <= 5 GROUP BY 1"""


_CTES["top_facts"] = """
    SELECT user_id, rating, genre_names, overview_sentiment, themes FROM top8 JOIN catalog USING (movie_id)
        LEFT JOIN (SELECT movie_id, overview_sentiment, themes FROM enriched) USING (movie_id)"""
_CTES["fav_genres"] = _favorite("top_facts", "genre_names", "favorite_genres")
_CTES["fav_themes"] = _favorite("top_facts", "themes", "favorite_themes")
_CTES["tone"] = """
    SELECT user_id, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(overview_sentiment, n) ELSE 'mixed' END AS typical_sentiment
    FROM (SELECT user_id, overview_sentiment, count(*) AS n FROM top_facts WHERE overview_sentiment IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
_CTES["profiles"] = """
    SELECT user_id, n_ratings, mean_rating, coalesce(favorite_genres, CAST([] AS VARCHAR[])) AS favorite_genres,
        coalesce(favorite_themes, CAST([] AS VARCHAR[])) AS favorite_themes, typical_sentiment
    FROM user_means LEFT JOIN fav_genres USING (user_id) LEFT JOIN fav_themes USING (user_id) LEFT JOIN tone USING (user_id)"""
_CTES["specs_text"] = """
    SELECT s_suppkey AS spec_id, CASE s_suppkey % 14
        WHEN 0 THEN concat('{"genres": ["promo", "Brand#', s_suppkey % 25, '"], "min_year": ', s_suppkey % 30 + 1980, ', "sort_by": "revenue_desc"}')
        WHEN 1 THEN concat('{"min_year": ', s_suppkey % 30 + 1980, ', "max_year": "1999", "limit": 20, "sort_by": "budget_desc", "title": "x"}')
        WHEN 2 THEN '{"budget_tier": "high", "sentiment": "positive", "min_score": 5.0, "sort_by": "rating_desc"}'
        WHEN 3 THEN '{"genres": ["Economy", "ECONOMY", "small"], "revenue_tier": "low", "limit": 50}'
        WHEN 4 THEN '{"genres": ["%"], "limit": 5}'
        WHEN 5 THEN concat('{"max_budget": ', s_suppkey * 1000, ', "min_runtime": 10, "max_runtime": 40, "sort_by": "runtime_desc"}')
        WHEN 6 THEN '{"budget_tier": "LOW", "limit": -3}'
        WHEN 7 THEN '{"min_score": 7.25, "limit": 51, "sort_by": "title_asc"}'
        WHEN 8 THEN '{"min_year": 1990'
        WHEN 9 THEN concat('{"max_budget": ', s_suppkey * 1000, ', "sort_by": "score_desc"}')
        WHEN 10 THEN concat('{"min_runtime": ', s_suppkey % 50, ', "limit": 50}')
        WHEN 11 THEN '{"min_year": 0, "max_year": 9999, "sort_by": "revenue_desc", "limit": 50}'
        WHEN 12 THEN '{"sort_by": "budget_desc"}' ELSE '{"genres": null, "sentiment": null}' END AS filter_json
    FROM supplier"""


def _json_int(name: str) -> str:
    number = f"TRY_CAST(json_extract_string(doc, '$.{name}') AS DOUBLE)"
    return f"CASE WHEN {number} = floor({number}) THEN CAST({number} AS BIGINT) END AS {name}"


def _json_text(name: str) -> str:
    return f"json_extract_string(doc, '$.{name}') AS {name}"


_CTES["specs"] = f"""
    SELECT spec_id, coalesce(CAST(json_extract_string(doc, '$.genres[*]') AS VARCHAR[]), []) AS genres,
        {', '.join(map(_json_text, ('budget_tier', 'revenue_tier', 'sentiment', 'sort_by')))},
        {', '.join(map(_json_int, ('min_score', 'min_year', 'max_year', 'min_budget', 'max_budget', 'min_runtime', 'max_runtime', 'limit')))},
        doc IS NULL AS broken, json_type(doc, '$.genres') = 'NULL' AS null_genres,
        json_extract_string(doc, '$.min_score') AS raw_score
    FROM (SELECT spec_id, CASE WHEN json_valid(filter_json) THEN CAST(filter_json AS JSON) END AS doc FROM specs_text)"""
_CTES["judged_specs"] = """
    SELECT * EXCLUDE ("limit"), coalesce("limit", 10) AS "limit", nullif(concat_ws('; ',
        CASE WHEN broken THEN 'not a JSON object' END,
        CASE WHEN null_genres THEN 'genres: wrong type' END,
        CASE WHEN budget_tier NOT IN ('low', 'medium', 'high') THEN 'budget_tier: not allowed' END,
        CASE WHEN raw_score IS NOT NULL AND min_score IS NULL THEN 'min_score: wrong type' END,
        CASE WHEN sort_by NOT IN ('revenue_desc', 'budget_desc', 'score_desc', 'runtime_desc', 'rating_desc') THEN 'sort_by: not allowed' END,
        CASE WHEN "limit" < 1 THEN 'limit: too small' WHEN "limit" > 50 THEN 'limit: too large' END), '') AS reject_reason
    FROM specs"""
_CTES["compare_ids"] = """
    SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority = '5-LOW' THEN [o_custkey]
        WHEN o_orderstatus = 'F' THEN [o_custkey, o_orderkey, o_custkey] ELSE [o_orderkey, o_custkey] END AS ids FROM orders"""
_CTES["compare_long"] = """
    SELECT request_id, position, id, c.movie_id IS NOT NULL AS known, e.movie_id IS NOT NULL AS rich,
        concat_ws('|', id, title, coalesce(CAST(release_year AS VARCHAR), '-'), budget, revenue, runtime, coalesce(e.overview_sentiment, '-'),
            coalesce(e.budget_tier, '-'), coalesce(e.revenue_tier, '-'), coalesce(CAST(e.production_effectiveness_score AS VARCHAR), '-'),
            coalesce(array_to_string(e.themes, ','), '')) AS line
    FROM (SELECT request_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS position FROM compare_ids WHERE len(ids) >= 2)
        LEFT JOIN catalog c ON c.movie_id = id LEFT JOIN (SELECT * EXCLUDE (title) FROM enriched) e ON e.movie_id = id"""
_CTES["comparisons"] = """
    SELECT request_id, CASE WHEN len(any_value(ids)) < 2 THEN 'at least two ids are needed' END AS error,
        CASE WHEN count(*) FILTER (NOT known) > 0 THEN 'not found: [' || string_agg(id, ', ' ORDER BY position) FILTER (NOT known) || ']'
            WHEN count(*) FILTER (known AND NOT rich) > 0 THEN 'not enriched: [' || string_agg(id, ', ' ORDER BY position) FILTER (known AND NOT rich) || ']' END AS note,
        CASE WHEN len(any_value(ids)) >= 2 THEN coalesce(string_agg(line, ';' ORDER BY position) FILTER (known), '') END AS movies
    FROM compare_ids LEFT JOIN compare_long USING (request_id) GROUP BY 1"""
_CTES["titles"] = "SELECT movie_id, length(title) AS size FROM rated_pool"
_CTES["response_text"] = f"""
    SELECT doc_id, n_chars, trim(text, {_SPACE}) AS clean FROM documents"""

_DECLARED = list(_CTES)


def _sql(body: str) -> str:
    """The body with the common tables it needs, directly or through others."""
    import re

    def uses(text: str) -> set[str]:
        return {name for name in _DECLARED if re.search(rf"\b(FROM|JOIN)\s+\(?{name}\b", text)}

    needed, todo = set(), uses(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= uses(_CTES[name]) - needed
    ctes = ", ".join(f"{name} AS ({_CTES[name]})" for name in _DECLARED if name in needed)
    return f"WITH {ctes} {body}" if ctes else body


_OUT = ("movie_id, title, release_year, budget, revenue, runtime, overview_sentiment, budget_tier, revenue_tier, "
        "production_effectiveness_score, themes")
_ROUND_STATS = "count(n) AS count, round(avg(n), {d}) AS mean, round(stddev_samp(n), {d}) AS std, CAST(min(n) AS DOUBLE) AS min"


def _found(where: str = "true", order: str = "", limit: int | None = None) -> str:
    tail = f" ORDER BY {order}, movie_id LIMIT {limit}" if order else f" ORDER BY movie_id LIMIT {limit}" if limit else ""
    return f"SELECT {_OUT} FROM found WHERE {where}{tail}"


def _genre(*keys: str) -> str:
    return "list_has_any(genre_keys, [" + ", ".join(f"'{k}'" for k in keys) + "])"


_ENRICHMENT_PROMPT = """
    'Title: ' || title || chr(10) || 'Overview: ' || overview || chr(10)
    || 'Genres: ' || CASE WHEN len(genre_names) > 0 THEN array_to_string(genre_names, ', ') ELSE 'Unknown' END || chr(10)
    || 'Budget: $' || format('{:,}', budget) || chr(10) || 'Revenue: $' || format('{:,}', revenue) || chr(10)
    || 'ROI: ' || CASE WHEN revenue = 0 OR budget = 0 THEN 'n/a' ELSE printf('%.1fx', round_even(CAST(revenue AS DOUBLE) / budget, 1)) END || chr(10)
    || 'Runtime: ' || CASE WHEN runtime = 0 THEN 'unknown' ELSE CAST(runtime AS VARCHAR) END || ' min' || chr(10)
    || 'User ratings: ' || CASE WHEN avg_rating IS NULL THEN 'no user ratings'
        ELSE printf('%.2f avg across %d user ratings', round_even(avg_rating, 2), n_ratings) END"""


def _oracles() -> dict[str, str]:
    from playbill.plans.prompts import ENRICH_TASK, PREDICT_TASK, PROFILE_TASK

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    verdict = "reject_reason IS NULL AS valid, reject_reason"
    bodies = {
        "scan_catalog": "SELECT movie_id, title, budget, revenue, runtime, genres, release_date FROM catalog",
        "scan_ratings": "SELECT user_id, movie_id, rating, strftime(ts, '%Y-%m-%d') AS ts FROM ratings",
        "scan_enriched": "SELECT movie_id, overview_sentiment, budget_tier, revenue_tier, production_effectiveness_score, array_to_string(themes, ',') AS themes FROM enriched",
        "format_records": """SELECT movie_id, CAST(json_object('movie_id', movie_id, 'title', title, 'release_year', release_year, 'budget', budget,
            'revenue', revenue, 'runtime', runtime, 'overview_sentiment', overview_sentiment, 'budget_tier', budget_tier, 'revenue_tier', revenue_tier,
            'production_effectiveness_score', production_effectiveness_score, 'themes', themes) AS VARCHAR) AS record
            FROM catalog LEFT JOIN (SELECT * EXCLUDE (title) FROM enriched) USING (movie_id) WHERE status = 'Released'""",
        "parse_filter_specs": f"""SELECT spec_id, array_to_string(genres, ';') AS genres, budget_tier, revenue_tier, sentiment, min_score, min_year, max_year,
            min_budget, max_budget, min_runtime, max_runtime, sort_by, "limit", {verdict} FROM judged_specs""",
        "parse_genres": "SELECT movie_id, array_to_string(genre_names, ';') AS names, len(genre_names) AS n_names FROM catalog",
        "primary_genre": "SELECT movie_id, primary_genre, array_to_string(genre_names[1:3], ', ') AS first_genres FROM catalog",
        "release_year": "SELECT movie_id, release_year FROM catalog",
        "predicate_year": "SELECT movie_id, filter_year FROM catalog",
        "roi": "SELECT movie_id, round(CAST(revenue AS DOUBLE) / nullif(budget, 0), 6) AS roi FROM catalog",
        "render_prompts": f"SELECT movie_id, {_ENRICHMENT_PROMPT} || chr(10) || chr(10) || {text(ENRICH_TASK)} AS prompt FROM rated_pool",
        "history_lines": f"""SELECT p.user_id, p.movie_id, coalesce(lines, '') AS lines FROM pairs p LEFT JOIN (
            SELECT user_id, movie_id, string_agg({_LINE}, chr(10) ORDER BY rank) AS lines FROM history GROUP BY 1, 2) USING (user_id, movie_id)""",
        "clean_responses": "SELECT doc_id, clean AS answer FROM response_text",
        "render_prediction_prompts": f"""SELECT user_id, p.movie_id, concat('Newest ratings of user ', user_id, ':', chr(10), lines, chr(10), chr(10),
            'Movie to rate, id ', p.movie_id, ':', chr(10), 'Title: ', t.title, chr(10), 'Overview: ', coalesce(overview, ''), chr(10),
            'Genres: ', array_to_string(genre_names, ', '), chr(10), 'Enriched: ',
            CASE WHEN e.movie_id IS NULL THEN 'outside the enriched sample, only overview and genres are known'
                ELSE concat('sentiment ', overview_sentiment, '; budget ', budget_tier, '; revenue ', revenue_tier, '; effectiveness ',
                    production_effectiveness_score, '; themes ', array_to_string(themes, ', ')) END,
            chr(10), chr(10), {text(PREDICT_TASK)}) AS prompt
            FROM customer_pairs p JOIN (SELECT user_id, movie_id, string_agg({_LINE}, chr(10) ORDER BY rank) AS lines, count(*) AS n FROM customer_history GROUP BY 1, 2) h
                USING (user_id, movie_id) JOIN catalog t ON t.movie_id = p.movie_id LEFT JOIN enriched e ON e.movie_id = p.movie_id WHERE n >= 3""",
        "render_profile_prompts": f"""SELECT user_id, concat_ws(chr(10) || chr(10),
            printf('User %d: %d ratings, mean %.2f.', user_id, any_value(n_ratings), any_value(mean_rating)),
            'Highest rated:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (side = 'top'),
            'Lowest rated:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (side = 'bottom'), {text(PROFILE_TASK)}) AS prompt
            FROM (SELECT user_id, side, rank, {_LINE} || ' themes=' || coalesce(array_to_string(themes[1:3], ', '), '') || ' sentiment='
                    || coalesce(overview_sentiment, 'unknown') AS line
                FROM ranked_ratings JOIN catalog USING (movie_id) LEFT JOIN (SELECT * EXCLUDE (title) FROM enriched) USING (movie_id))
            JOIN user_means USING (user_id) GROUP BY user_id""",
        "prediction_delta": "SELECT * FROM deltas",
        "dry_run_table": """SELECT movie_id, title, overview_sentiment AS sentiment, budget_tier, revenue_tier, production_effectiveness_score AS score,
            array_to_string(themes, ', ') AS themes, input_tokens AS tokens_asked, output_tokens AS tokens_answered FROM enriched""",
        "filter_status": _found(),
        "filter_year_range": _found("filter_year BETWEEN 1990 AND 1999"),
        "filter_budget_range": _found("budget BETWEEN 100000 AND 300000"),
        "filter_runtime_range": _found("runtime BETWEEN 10 AND 40"),
        "eligible_pool": "SELECT movie_id, primary_genre, budget, revenue FROM eligible",
        "filter_genres": _found(_genre("promo", "brand#7")),
        "filter_tiers": _found("budget_tier = 'low' AND revenue_tier = 'high'"),
        "filter_sentiment": _found("overview_sentiment = 'positive'"),
        "filter_min_score": _found("production_effectiveness_score >= 6"),
        "ids_semi_join": "SELECT movie_id, title, budget FROM catalog WHERE movie_id IN (SELECT movie_id FROM enriched)",
        "validate_filters": f"""SELECT spec_id, {verdict} FROM (SELECT p_partkey AS spec_id, nullif(concat_ws('; ',
            CASE WHEN p_partkey % 5 = 3 THEN 'budget_tier: not allowed' END, CASE WHEN p_partkey % 7 = 3 THEN 'sentiment: not allowed' END,
            CASE WHEN p_size % 13 < 1 THEN 'min_score: too small' WHEN p_size % 13 > 10 THEN 'min_score: too large' END,
            CASE WHEN p_partkey % 8 = 5 THEN 'sort_by: not allowed' END, CASE WHEN p_size + 2 > 50 THEN 'limit: too large' END), '') AS reject_reason FROM part)""",
        "validate_enriched": f"""SELECT movie_id, {verdict} FROM (SELECT movie_id, nullif(concat_ws('; ',
            CASE WHEN movie_id % 5 = 1 THEN 'overview_sentiment: not allowed' END, CASE WHEN movie_id % 7 = 2 THEN 'budget_tier: missing' END,
            CASE WHEN score < 1 THEN 'production_effectiveness_score: too small' WHEN score > 10 THEN 'production_effectiveness_score: too large' END,
            CASE WHEN n < 3 THEN 'themes: too few items' WHEN n > 5 THEN 'themes: too many items' END), '') AS reject_reason
            FROM (SELECT movie_id, production_effectiveness_score + movie_id % 6 - 1 AS score,
                CASE movie_id % 4 WHEN 3 THEN least(2, len(themes)) WHEN 2 THEN len(themes) + 1 ELSE len(themes) END AS n FROM enriched))""",
        "validate_predictions": f"""SELECT predicted_rating, {verdict}, count(*) AS n FROM (SELECT predicted_rating, nullif(concat_ws('; ',
            CASE WHEN predicted_rating < 0.5 THEN 'predicted_rating: too small' WHEN predicted_rating > 5 THEN 'predicted_rating: too large' END,
            CASE WHEN rating = 2.5 THEN 'rationale: missing' END), '') AS reject_reason
            FROM (SELECT rating, rating * CAST(1.25 AS DOUBLE) - 0.25 AS predicted_rating FROM ratings)) GROUP BY ALL""",
        "validate_profiles": f"""SELECT user_id, {verdict} FROM (SELECT user_id, nullif(concat_ws('; ',
            CASE WHEN len(favorite_genres) + least(1, len(favorite_genres)) > 5 THEN 'favorite_genres: too many items' END,
            CASE WHEN typical_sentiment IS NULL THEN 'typical_sentiment: missing' END), '') AS reject_reason FROM profiles)""",
        "movies_with_ratings": "SELECT movie_id, title, round(avg_rating, 6) AS avg_rating, coalesce(n_ratings, 0) AS n_ratings FROM catalog LEFT JOIN stats USING (movie_id)",
        "rated_titles": "SELECT user_id, movie_id, rating, strftime(ts, '%Y-%m-%d') AS ts, title FROM ratings JOIN catalog USING (movie_id)",
        "candidates_enriched": _found(_genre("economy")),
        "enriched_lookup": """SELECT o_orderkey AS movie_id, overview_sentiment, budget_tier, revenue_tier, production_effectiveness_score,
            array_to_string(themes, ',') AS themes, CASE WHEN e.movie_id IS NULL THEN concat('movie ', o_orderkey, ' is not enriched') END AS error
            FROM orders LEFT JOIN enriched e ON e.movie_id = o_orderkey""",
        "uncached_requests": "SELECT movie_id, title FROM eligible WHERE movie_id NOT IN (SELECT movie_id FROM enriched)",
        "eval_candidates": "SELECT user_id, movie_id, actual, strftime(ts, '%Y-%m-%d') AS ts, title FROM candidates",
        "movie_rating_stats": "SELECT movie_id, round(avg_rating, 6) AS avg_rating, n_ratings FROM stats",
        "row_counts": """SELECT n_ratings, n_users, n_rated_movies, n_movies, round(100.0 * n_rated_movies / n_movies, 1) AS rated_percent FROM (
            SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT movie_id) AS n_rated_movies,
                (SELECT count(*) FROM catalog) AS n_movies FROM ratings)""",
        "eligible_share": """SELECT n_movies, n_eligible, round(n_eligible / n_movies, 6) AS share FROM (
            SELECT count(*) AS n_movies, (SELECT count(*) FROM eligible) AS n_eligible FROM catalog)""",
        "missing_rates": """SELECT field, round(rate, 6) AS rate FROM (UNPIVOT (SELECT
            avg(CASE WHEN overview IS NULL OR overview = '' THEN 1.0 ELSE 0.0 END) AS overview_missing,
            avg(CASE WHEN budget IS NULL OR budget = 0 THEN 1.0 ELSE 0.0 END) AS budget_zero,
            avg(CASE WHEN revenue IS NULL OR revenue = 0 THEN 1.0 ELSE 0.0 END) AS revenue_zero,
            avg(CASE WHEN runtime IS NULL OR runtime = 0 THEN 1.0 ELSE 0.0 END) AS runtime_missing,
            avg(CASE WHEN genres IS NULL OR genres = '' THEN 1.0 ELSE 0.0 END) AS genres_missing,
            avg(CASE WHEN status IS NULL OR status <> 'Released' THEN 1.0 ELSE 0.0 END) AS not_released FROM catalog)
            ON COLUMNS(*) INTO NAME field VALUE rate)""",
        "genre_distribution": "SELECT primary_genre, size AS n, round(size / sum(size) OVER (), 6) AS share FROM strata",
        "ratings_per_key": """SELECT 'movie_id' AS key_name, movie_id AS key, count(*) AS n FROM ratings GROUP BY 2
            UNION ALL SELECT 'user_id', user_id, count(*) FROM ratings GROUP BY 2""",
        "describe_counts": f"""SELECT key_name, {_ROUND_STATS.format(d=6)}, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90,
            CAST(max(n) AS DOUBLE) AS max FROM (SELECT 'movie_id' AS key_name, count(*) AS n FROM ratings GROUP BY movie_id
            UNION ALL SELECT 'user_id', count(*) FROM ratings GROUP BY user_id) GROUP BY key_name""",
        "rating_histogram": """SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(10) LEFT JOIN (
            SELECT least(floor((rating - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS n
            FROM ratings, (SELECT min(rating) AS lo, max(rating) AS hi FROM ratings) GROUP BY 1) b ON b.bin = range""",
        "clipped_histogram": """SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(30) LEFT JOIN (
            SELECT least(floor(CAST(v - lo AS DOUBLE) / (hi - lo) * 30), 29) AS bin, count(*) AS n FROM (
                SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT least(count(*), 100) AS v FROM ratings GROUP BY movie_id)) GROUP BY 1) b
            ON b.bin = range""",
        "attribute_counts": """SELECT attribute, value, count(*) AS n FROM (UNPIVOT (SELECT overview_sentiment, budget_tier, revenue_tier FROM enriched)
            ON COLUMNS(*) INTO NAME attribute VALUE value) GROUP BY 1, 2""",
        "score_describe": f"""SELECT {_ROUND_STATS.format(d=2)}, round(quantile_cont(n, 0.25), 2) AS p25, round(quantile_cont(n, 0.5), 2) AS p50,
            round(quantile_cont(n, 0.75), 2) AS p75, CAST(max(n) AS DOUBLE) AS max FROM (SELECT production_effectiveness_score AS n FROM enriched)""",
        "top_themes": """SELECT theme, count(*) AS n, count(*) OVER () AS n_distinct FROM (SELECT unnest(themes) AS theme FROM enriched)
            GROUP BY 1 ORDER BY n DESC, theme LIMIT 15""",
        "user_stats": "SELECT user_id, count(*) AS n_ratings, round_even(avg(rating), 2) AS mean_rating FROM ratings GROUP BY 1",
        "cost_report": """SELECT model, n_movies, input_tokens, output_tokens, round(cost, 9) AS cost, round(cost / n_movies, 9) AS cost_per_movie FROM (
            SELECT model, count(*) AS n_movies, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
                CAST(sum(input_tokens) AS DOUBLE) * 0.07 / 1e6 + CAST(sum(output_tokens) AS DOUBLE) * 0.3 / 1e6 AS cost FROM enriched GROUP BY 1)""",
        "prediction_hits": """SELECT count(delta) AS n, count(*) FILTER (delta = 0) AS exact, count(*) FILTER (delta <= 1) AS within_1,
            count(*) FILTER (delta <= 2.5) AS within_2_5, round(avg(delta), 6) AS mean_delta FROM deltas""",
        "stratum_allocation": "SELECT * FROM allocation WHERE seats > 0",
        "active_users": "SELECT user_id, count(*) AS n_ratings FROM ratings GROUP BY 1 HAVING count(*) >= 20",
        "unique_titles": "SELECT concat_ws(' ', title, runtime) AS title FROM catalog GROUP BY 1 HAVING count(*) = 1",
        "title_ids": """SELECT q.request_id, q.title, c.movie_id, c.title AS catalog_title FROM (
            SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 4 = 0 THEN 'no such title' ELSE concat('  ', upper(p_name), ' ') END AS title
            FROM supplier LEFT JOIN part ON s_suppkey = p_partkey) AS q LEFT JOIN catalog AS c ON lower(trim(q.title)) = lower(trim(c.title))""",
        "leak_free_history": "SELECT user_id, movie_id, CAST(rank AS INTEGER) AS rank, rated_movie_id, rating, strftime(ts, '%Y-%m-%d') AS ts FROM history",
        "top_bottom_rated": "SELECT user_id, movie_id, rating, strftime(ts, '%Y-%m-%d') AS ts, CAST(rank AS INTEGER) AS rank, side FROM ranked_ratings",
        "stratified_sample": """SELECT movie_id, title, primary_genre, round(avg_rating, 6) AS avg_rating, n_ratings FROM (
            SELECT *, row_number() OVER (PARTITION BY primary_genre ORDER BY md5(concat('42:', CAST(movie_id AS VARCHAR))), movie_id) AS place FROM rated_pool)
            JOIN allocation USING (primary_genre) WHERE place <= seats""",
        "small_sample": "SELECT movie_id, title, primary_genre FROM eligible ORDER BY md5(concat('42:', CAST(movie_id AS VARCHAR))), movie_id LIMIT 3",
        "first_per_movie": "SELECT user_id, movie_id, actual, strftime(ts, '%Y-%m-%d') AS ts, title FROM firsts",
        "eval_pairs": "SELECT user_id, movie_id, actual, strftime(ts, '%Y-%m-%d') AS ts, title FROM sampled_pairs",
        "top_movies": _found(order="production_effectiveness_score DESC NULLS LAST", limit=50),
        "first_movies": _found(limit=50),
        "top_rated": """SELECT movie_id, title, round(avg_rating, 6) AS avg_rating, coalesce(n_ratings, 0) AS n_ratings
            FROM catalog LEFT JOIN stats USING (movie_id) ORDER BY stats.avg_rating DESC NULLS LAST, movie_id LIMIT 5""",
        "compare_notes": "SELECT request_id, note FROM comparisons WHERE note IS NOT NULL",
        "query_movies_nineties": _found(f"{_genre('promo')} AND filter_year BETWEEN 1990 AND 1999", "revenue DESC NULLS LAST", 10),
        "query_movies_positive": _found(f"{_genre('economy')} AND revenue_tier = 'high' AND overview_sentiment = 'positive'", limit=50),
        "query_movies_small_budget": _found(f"{_genre('standard')} AND budget_tier = 'low'", "revenue DESC NULLS LAST", 10),
        "query_movies_score": _found("production_effectiveness_score >= 8 AND budget <= 300000", "production_effectiveness_score DESC NULLS LAST", 10),
        "query_movies_batch": f"""SELECT spec_id, CAST(rank AS INTEGER) AS rank, {_OUT} FROM (
            SELECT s.spec_id, s."limit" AS most, f.*, row_number() OVER (PARTITION BY spec_id ORDER BY CASE sort_by WHEN 'revenue_desc' THEN revenue
                WHEN 'budget_desc' THEN budget WHEN 'runtime_desc' THEN runtime WHEN 'score_desc' THEN production_effectiveness_score
                WHEN 'rating_desc' THEN production_effectiveness_score END DESC NULLS LAST, movie_id) AS rank
            FROM judged_specs s JOIN found f ON (len(s.genres) = 0 OR list_has_any(f.genre_keys, list_transform(s.genres, lambda x: lower(x))))
                AND (s.min_year IS NULL OR f.filter_year >= s.min_year) AND (s.max_year IS NULL OR f.filter_year <= s.max_year)
                AND (s.min_budget IS NULL OR f.budget >= s.min_budget) AND (s.max_budget IS NULL OR f.budget <= s.max_budget)
                AND (s.min_runtime IS NULL OR f.runtime >= s.min_runtime) AND (s.max_runtime IS NULL OR f.runtime <= s.max_runtime)
                AND (s.budget_tier IS NULL OR f.budget_tier = s.budget_tier) AND (s.revenue_tier IS NULL OR f.revenue_tier = s.revenue_tier)
                AND (s.sentiment IS NULL OR f.overview_sentiment = s.sentiment)
                AND (s.min_score IS NULL OR f.production_effectiveness_score >= s.min_score)
            WHERE s.reject_reason IS NULL) WHERE rank <= most""",
        "compare_movies": "SELECT request_id, error, note, movies FROM comparisons",
        "predict_ratings": """SELECT user_id, movie_id, status, predicted_rating, n AS based_on_n_user_ratings,
            CASE WHEN status = 'ok' THEN printf('mean %.2f over %d ratings, %d of them sharing a genre', round_even(user_mean, 2), n, n_genre) END AS rationale
            FROM predictions""",
        "user_profiles": """SELECT user_id, n_ratings, mean_rating, array_to_string(favorite_genres, ',') AS favorite_genres,
            array_to_string(favorite_themes, ',') AS favorite_themes, typical_sentiment,
            printf('%d ratings with a mean of %.2f. Favorite genres: %s. Recurring themes: %s.', n_ratings, mean_rating,
                CASE WHEN len(favorite_genres) > 0 THEN array_to_string(favorite_genres, ', ') ELSE 'none' END,
                CASE WHEN len(favorite_themes) > 0 THEN array_to_string(favorite_themes, ', ') ELSE 'none' END) AS summary FROM profiles""",
        "batch_inference": """SELECT movie_id, status, attempts,
            CASE WHEN status = 'ok' THEN 'neutral' END AS overview_sentiment, CASE WHEN status = 'ok' THEN 'low' END AS budget_tier,
            CASE WHEN status = 'ok' THEN 'high' END AS revenue_tier, CASE WHEN status = 'ok' THEN 1 + size % 10 END AS production_effectiveness_score,
            CASE WHEN status = 'ok' THEN concat('a,b,c', size) END AS themes,
            CASE WHEN status <> 'ok' THEN 'production_effectiveness_score: too large' END AS reject_reason,
            size * attempts AS input_tokens, CAST(attempts * (attempts + 1) / 2 AS BIGINT) AS output_tokens, 'title-length' AS model
            FROM (SELECT *, CASE WHEN size % 6 = 0 THEN 3 WHEN size % 3 = 0 THEN 2 ELSE 1 END AS attempts,
                CASE WHEN size % 12 = 0 THEN 'invalid' ELSE 'ok' END AS status FROM titles)""",
        "prediction_eval": """SELECT user_id, movie_id, substr(title, 1, 40) AS title, predicted_rating, actual,
            round(abs(predicted_rating - actual), 2) AS delta,
            substr(coalesce(CASE WHEN status = 'ok' THEN printf('mean %.2f over %d ratings, %d of them sharing a genre', round_even(user_mean, 2), n, n_genre) END, status), 1, 100) AS rationale
            FROM sampled_pairs JOIN predictions USING (user_id, movie_id)""",
    }
    bodies["model_predictions"] = """SELECT p.user_id, p.movie_id,
            CASE WHEN t.movie_id IS NULL THEN 'target_not_found' WHEN coalesce(n, 0) < 3 THEN 'insufficient_history' ELSE 'ok' END AS status,
            CASE WHEN t.movie_id IS NOT NULL AND n >= 3 THEN n / 2 END AS predicted_rating,
            CASE WHEN t.movie_id IS NOT NULL AND n >= 3 THEN concat(n, ' lines') END AS rationale, coalesce(n, 0) AS based_on_n_user_ratings
        FROM customer_pairs p LEFT JOIN catalog t ON t.movie_id = p.movie_id
            LEFT JOIN (SELECT user_id, movie_id, count(*) AS n FROM customer_history GROUP BY 1, 2) h ON h.user_id = p.user_id AND h.movie_id = p.movie_id"""
    bodies["model_profiles"] = """SELECT user_id, n_ratings, mean_rating, 'ok' AS status, 'g' AS favorite_genres, 'mixed' AS typical_sentiment,
            concat(n, ' lines') AS summary FROM user_means JOIN (SELECT user_id, count(*) AS n FROM ranked_ratings GROUP BY 1) USING (user_id)"""
    bodies["rating_baseline"] = """SELECT model, count(*) AS n, round(sqrt(avg((p - actual) ** 2)), 6) AS rmse, round(avg(abs(p - actual)), 6) AS mae
        FROM three_predictions WHERE p IS NOT NULL GROUP BY 1"""
    bodies["tier_breaks"] = "SELECT measure, primary_genre, CAST(medium_from AS INTEGER) AS medium_from, CAST(high_from AS INTEGER) AS high_from FROM breaks"
    bodies["natural_tiers"] = """SELECT movie_id, max(t) FILTER (measure = 'budget') AS budget_tier, max(t) FILTER (measure = 'revenue') AS revenue_tier FROM (
        SELECT a.measure, movie_id, CASE WHEN cell IS NULL THEN NULL WHEN cell < medium_from THEN 'low' WHEN cell < high_from THEN 'medium' ELSE 'high' END AS t
        FROM amounts a LEFT JOIN breaks b ON a.measure = b.measure AND a.primary_genre = b.primary_genre) GROUP BY 1"""
    bodies["similar_titles_exact"] = """SELECT vec_id, CAST(rank AS INTEGER) AS rank, similar_id, round(score, 6) AS score FROM (
        SELECT q.vec_id, i.vec_id AS similar_id, list_cosine_similarity(q.e, i.e) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, i.e), 9) DESC, i.vec_id) AS rank
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) q JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) i
            ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id) WHERE rank <= 10"""
    bodies["lexicon_sentiment"] = """SELECT movie_id, CASE WHEN tone > 0 THEN 'positive' WHEN tone < 0 THEN 'negative' ELSE 'neutral' END AS overview_sentiment
        FROM eligible LEFT JOIN (SELECT movie_id, sum(weight) AS tone FROM (
                SELECT movie_id, unnest(string_split_regex(lower(overview), '[^\\p{L}]+')) AS word FROM eligible)
            JOIN (SELECT word, sum(tone) AS weight FROM (
                SELECT CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS tone,
                    unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}]+'))) AS word FROM documents JOIN labels USING (doc_id)) GROUP BY 1)
            USING (word) GROUP BY 1) USING (movie_id)"""
    full = """SELECT movie_id, title, overview_sentiment, budget_tier, revenue_tier, production_effectiveness_score, array_to_string(themes, ',') AS themes,
        input_tokens, output_tokens, model FROM all_rules WHERE len(themes) BETWEEN 3 AND 5"""
    bodies["cache_union_new"] = bodies["enrich_incremental"] = full
    compared = ("overview_sentiment", "budget_tier", "revenue_tier", "production_effectiveness_score", "themes")
    join = "FROM enriched a JOIN other_run b USING (movie_id)"
    per_field = [f"SELECT '{c}' AS field, count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) AS n_drift, count(*) AS n_compared {join}" for c in compared]
    together = " + ".join(f"count(*) FILTER (a.{c} IS DISTINCT FROM b.{c})" for c in compared[:4])
    bodies["run_drift"] = " UNION ALL ".join([*per_field, f"SELECT 'all_categorical', {together}, count(*) * 4 {join}"])

    def shown(alias: str, c: str) -> str:
        return f"array_to_string({alias}.{c}, ', ')" if c == "themes" else f"CAST({alias}.{c} AS VARCHAR)"

    bodies["drift_rows"] = " UNION ALL ".join(
        f"SELECT movie_id, '{c}' AS field, {shown('a', c)} AS before, {shown('b', c)} AS after {join} WHERE a.{c} IS DISTINCT FROM b.{c}" for c in compared)
    return {name: _sql(body) for name, body in bodies.items()}


ORACLES = _oracles()
