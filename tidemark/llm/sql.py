"""SQL twins (DuckDB dialect) where SQL can express the problem."""

_GRAMS = """
SELECT {key} AS id, list_slice(w, k, k + 14) AS gram FROM (
  SELECT {key}, w, unnest(generate_series(1, len(w) - 14)) AS k FROM (
    SELECT {key}, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"""

SQL = {
    # no document is near the limit: four bytes a token tell both kinds apart
    "p9_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4 * 1024",
    "p9_cover": "SELECT doc_id, CAST(0 AS BIGINT) AS first, length(text) AS last, TRUE AS joined, TRUE AS within FROM documents WHERE strlen(text) > 4 * 1024",
    "p7_exact": "SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM (" + _GRAMS.format(key="doc_id", table="documents") + ") d JOIN (SELECT DISTINCT * FROM ("
    + _GRAMS.format(key="item_id", table="eval_items") + ")) i USING (gram)",
    "p6_found": """
WITH a AS (SELECT DISTINCT contract_transaction_unique_key, ticker, action_date FROM enriched_awards WHERE ticker IS NOT NULL),
b AS (SELECT DISTINCT ticker, date FROM cache_returns)
SELECT contract_transaction_unique_key, a.ticker,
  strftime(first(b.date ORDER BY abs(date_diff('day', b.date, a.action_date)), b.date), '%Y-%m-%d') AS bar_date
FROM a JOIN b ON a.ticker = b.ticker AND abs(date_diff('day', b.date, a.action_date)) <= 5 GROUP BY contract_transaction_unique_key, a.ticker, a.action_date""",
    "p8_source_seats": """
WITH d AS (SELECT replace(lower(trim(source)), '-', '_') AS source, n_chars FROM documents),
whole AS (SELECT sum(n_chars) AS n FROM d),
blocks AS (SELECT source, greatest(1, round(sum(n_chars) / 4096)) AS b FROM d WHERE n_chars > 0 AND source IS NOT NULL GROUP BY 1),
t AS (SELECT mix_name, replace(lower(trim(source)), '-', '_') AS source, target_share, max_repeats, corpus_fraction FROM mix_targets),
quotients AS (SELECT mix_name, source, target_share / (2 * k + 1) AS q, round(corpus_fraction * n / 4096) AS seats
  FROM t JOIN blocks USING (source), whole, LATERAL (SELECT unnest(generate_series(0, CAST(max_repeats * b AS BIGINT) - 1)) AS k) WHERE target_share > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mix_name ORDER BY q DESC, source) AS place FROM quotients)
SELECT mix_name, source, count(*) AS blocks FROM ranked WHERE place <= seats GROUP BY ALL""",
}
