"""SQL twins (DuckDB dialect) of the general data problems."""

from __future__ import annotations

from pyspark.sql import types as T

from tidemark.schemas import LABELLED_TRANSACTION

_FIELDS = r"""
WITH body AS (SELECT *, regexp_replace(raw_record, '(\r\n|\n|\r)\z', '') AS b FROM mock_transaction_types),
read AS (
  SELECT *, regexp_full_match(b, '(?s)([^",\r\n]*|"([^"]|"")*")(,([^",\r\n]*|"([^"]|"")*"))*') AS quoted_well,
    list_transform(regexp_extract_all(',' || b, '(?s),("(?:[^"]|"")*"|[^",]*)', 1), lambda x:
      CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f
  FROM body),
judged AS (
  SELECT *, CASE WHEN b IS NULL OR b = '' THEN 'column_count' WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> 25 THEN 'column_count'
    WHEN NOT regexp_full_match(f[1], '[A-Za-z0-9-]+(_[A-Za-z0-9-]+){5}')
      OR NOT regexp_full_match(trim(f[4], ' '), '([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)?')
      OR NOT regexp_full_match(f[8], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(f[8] AS DATE) IS NULL
    THEN 'invalid_value' END AS reason FROM read)
"""


def _typed(i: int, field: T.StructField) -> str:
    x = f"f[{i}]"
    if isinstance(field.dataType, T.DateType):
        x = f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({x} AS DATE) END"
    elif isinstance(field.dataType, T.DoubleType):
        x = f"try_cast(nullif(trim({x}, ' '), '') AS DOUBLE)"
    else:
        x = f"nullif({x}, '')"
    return f"{x} AS {field.name}"


_TYPED = ", ".join(_typed(i, f) for i, f in enumerate(LABELLED_TRANSACTION, 1))

_KNOWN = """
WITH known AS (
  SELECT e.*, v.market_cap AS known_market_cap, v.shares_outstanding AS known_shares_outstanding, v.market_cap_quality AS known_market_cap_quality
  FROM enriched_awards e LEFT JOIN LATERAL (
    SELECT market_cap, shares_outstanding, market_cap_quality FROM cache_market_cap c
    WHERE c.ticker = e.ticker AND c.status = 'success' AND c.date <= e.action_date AND CAST(c.fetched_at AS DATE) <= e.action_date
    ORDER BY c.date DESC, c.fetched_at DESC, market_cap DESC NULLS LAST, shares_outstanding DESC NULLS LAST, market_cap_quality DESC NULLS LAST LIMIT 1) v ON TRUE
  WHERE e.ticker IS NOT NULL)
"""
_READINGS = """
WITH readings AS (
  SELECT contract_transaction_unique_key, awarding_sub_agency_name AS source, action_date AS day, award_id_piid AS unit, field, value
  FROM (UNPIVOT signals_awards ON potential_total_value_of_award, ceiling_change, relative_ceiling_change INTO NAME field VALUE value)),
measured AS (SELECT * FROM readings WHERE source IS NOT NULL AND isfinite(value) AND value <> 0),
medians AS (SELECT source, field, count(*) AS n, median(abs(value)) AS median FROM measured GROUP BY ALL)
"""
_JUDGED = _READINGS + """
, frozen AS (
  SELECT DISTINCT c.source, c.field, c.value, c.day FROM (SELECT DISTINCT source, field, value, day FROM measured) c
  JOIN (SELECT s.source, s.field, s.value, s.day FROM (SELECT DISTINCT source, field, value, day FROM measured) s
    JOIN measured e ON s.source = e.source AND s.field = e.field AND s.value = e.value AND e.day >= s.day AND e.day <= s.day + 30
    GROUP BY ALL HAVING count(DISTINCT e.unit) >= 6) w
  ON c.source = w.source AND c.field = w.field AND c.value = w.value AND c.day >= w.day AND c.day <= w.day + 30),
judged AS (SELECT readings.*, median, isnan(value) OR isinf(value) OR (field = 'potential_total_value_of_award' AND value < 0)
  OR (field = 'relative_ceiling_change' AND value < -1)
  OR (field = 'ceiling_change' AND EXISTS (SELECT 1 FROM raw_filtered_awards r
    WHERE r.contract_transaction_unique_key = readings.contract_transaction_unique_key AND -value > r.prev_potential_value)) AS impossible,
  coalesce(isfinite(value) AND (abs(value) > 100 * median OR (field = 'potential_total_value_of_award' AND value <> 0 AND abs(value) < median / 100)), FALSE) AS ratio,
  EXISTS (SELECT 1 FROM frozen f WHERE f.source = readings.source AND f.field = readings.field AND f.value = readings.value AND f.day = readings.day) AS frozen
  FROM readings LEFT JOIN medians USING (source, field) WHERE value IS NOT NULL)
"""


def _reach(start: str, half: str, quarter: str) -> str:
    """Cutoff of a generalised Pareto tail fitted by quantiles of its excesses: shape by Pickands, drawn towards 0; risk 1e-4 beyond a tenth."""
    xi = f"greatest(-0.5, least(0.5, log2(({quarter} - {half}) / ({half} - {start})) * (n * 0.025) / (n * 0.025 + 80)))"
    curved = f"({half} - {start}) / (pow(2, {xi}) - 1) * (pow(0.001, -{xi}) - 1)"
    return f"CASE WHEN {half} > {start} AND {quarter} > {half} THEN {start} + CASE WHEN abs({xi}) < 1e-6 THEN -({half} - {start}) / ln(2) * ln(0.001) ELSE {curved} END END"


_FLAGS = f"""
, logs AS (SELECT source, field, coalesce(month(day), 0) AS month, log10(abs(value)) AS lg FROM measured),
season AS (SELECT source, field, month, quantile_cont(lg, 0.5) AS centre FROM logs GROUP BY ALL),
spread AS (SELECT source, field, count(*) AS n, quantile_cont(lg - centre, [0.025, 0.05, 0.1, 0.9, 0.95, 0.975]) AS q FROM logs JOIN season USING (source, field, month) GROUP BY ALL),
fit AS (SELECT source, field, {_reach("q[4]", "q[5]", "q[6]")} AS upper, {_reach("-q[3]", "-q[2]", "-q[1]")} AS lower FROM spread),
cells AS (SELECT *, centre + upper <= log10(median) + 2 - 1e-9 AS high_fit, centre - lower >= log10(median) - 2 + 1e-9 AS low_fit
  FROM season JOIN fit USING (source, field) JOIN medians USING (source, field)),
marked AS (SELECT j.*, c.high_fit, c.low_fit, coalesce(isfinite(value) AND value <> 0 AND (log10(nullif(abs(value), 0)) - centre > upper
    OR (j.field = 'potential_total_value_of_award' AND centre - log10(nullif(abs(value), 0)) > lower)), FALSE) AS tail
  FROM judged j LEFT JOIN cells c ON j.source = c.source AND j.field = c.field AND coalesce(month(j.day), 0) = c.month),
flags AS (SELECT contract_transaction_unique_key, source, field, day, impossible, tail, ratio, frozen, CASE WHEN impossible THEN 'impossible'
    WHEN ratio THEN CASE WHEN CASE WHEN abs(value) > median THEN high_fit ELSE low_fit END THEN 'fit' ELSE 'plausibility' END WHEN frozen THEN 'frozen' END AS found_by
  FROM marked WHERE tail OR impossible OR ratio OR frozen)
"""

SQL = {
    "p1_found": _FIELDS + "SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_typed_rows": _FIELDS + f"SELECT record_id, source_file, line_no, received_at, {_TYPED} FROM judged WHERE reason IS NULL",
    "p1_reasons_by_file": _FIELDS + "SELECT source_file, reason, count(*) AS n, min(record_id) AS first_record_id FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _KNOWN + """SELECT DISTINCT contract_transaction_unique_key FROM known WHERE market_cap IS DISTINCT FROM known_market_cap
  OR shares_outstanding IS DISTINCT FROM known_shares_outstanding OR market_cap_quality IS DISTINCT FROM known_market_cap_quality""",
    "p3_known_attributes": _KNOWN + "SELECT contract_transaction_unique_key, ticker, action_date, known_market_cap, known_shares_outstanding, known_market_cap_quality FROM known",
    "p4_found": """
SELECT 'award_id_piid' AS field, award_id_piid AS key_value FROM raw_filtered_awards WHERE award_id_piid IS NOT NULL GROUP BY 2
HAVING count(*) >= 0.05 * (SELECT count(*) FROM raw_filtered_awards)
UNION ALL SELECT 'ticker', ticker FROM enriched_awards WHERE ticker IS NOT NULL GROUP BY 2
HAVING count(*) >= 0.05 * (SELECT count(*) FROM enriched_awards WHERE ticker IS NOT NULL)""",
    "p4_award_results": """
SELECT award_id_piid, count(*) AS n, round(sum(federal_action_obligation), 2) AS obligated, min(action_date) AS first_action,
  last(potential_total_value_of_award ORDER BY action_date NULLS FIRST, contract_transaction_unique_key NULLS FIRST, ingested_at NULLS FIRST, potential_total_value_of_award NULLS FIRST) AS last_potential
FROM raw_filtered_awards GROUP BY ALL""",
    "p4_ticker_results": """
SELECT ticker, count(*) AS n, max(market_cap) AS max_cap,
  last(market_cap ORDER BY action_date NULLS FIRST, contract_transaction_unique_key NULLS FIRST, market_cap NULLS FIRST) AS last_cap
FROM enriched_awards WHERE ticker IS NOT NULL GROUP BY ALL""",
    "p4_row_shares": """
SELECT contract_transaction_unique_key, ingested_at, award_id_piid,
  round(total_dollars_obligated / nullif(max(total_dollars_obligated) OVER (PARTITION BY award_id_piid), 0), 6) AS share_of_highest
FROM raw_filtered_awards""",
    "p5_found": _JUDGED + "SELECT contract_transaction_unique_key, field FROM judged WHERE impossible OR ratio OR frozen",
    "p5_flags": _JUDGED + _FLAGS + "SELECT * FROM flags",
    "p5_paths": _JUDGED + _FLAGS + "SELECT field, found_by, count(*) AS n, count(*) FILTER (tail) AS beyond_fit, count(*) FILTER (ratio) AS beyond_ratio FROM flags GROUP BY ALL",
    "p5_source_medians": _READINGS + "SELECT source, field, n, median FROM medians",
}
