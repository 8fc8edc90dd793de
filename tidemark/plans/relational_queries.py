"""Queries of scans, filters, joins, strings, aggregates and keyed state, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import exprs as x
from tidemark.operators import bars, state
from tidemark.operators.asof import asof_join
from tidemark.plans import event_sql as q
from tidemark.plans import event_tables as t
from tidemark.plans import phases
from tidemark.session import table
from tidemark.sources.files import service_codes
from tidemark.sources.html_pages import parse_details
from tidemark.sources.providers import resolve_tickers

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = t.KEY


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# scans, filters, projections


@query(f"WITH {q.LAGGED}, kinds AS (SELECT *, {q.KIND} AS kind FROM lagged) SELECT contract_transaction_unique_key, award_id_piid, action_date, federal_action_obligation, prev_potential_value, ceiling_change, kind AS transaction_type FROM kinds WHERE federal_action_obligation >= 0 AND total_dollars_obligated >= 5000000 AND award_type IN ('DEFINITIVE CONTRACT', 'DELIVERY ORDER', 'PURCHASE ORDER')")
def phase1_filter_select(spark: SparkSession, d: str) -> DataFrame:
    return phases.ingest(t.raw(spark, d)).select(KEY, "award_id_piid", "action_date", "federal_action_obligation", "prev_potential_value", "ceiling_change", "transaction_type")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_orderdate AS DATE) AS order_day, CAST(o_totalprice AS DOUBLE) AS price, o_totalprice > 250000 AS is_large FROM orders")
def typed_projection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("order_key"), F.col("o_orderdate").cast("date").alias("order_day"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_totalprice") > 250000).alias("is_large"))


@query("SELECT * EXCLUDE (o_orderpriority) REPLACE (lower(o_orderstatus) AS o_orderstatus) FROM orders")
def drop_replace_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").drop("o_orderpriority").withColumn("o_orderstatus", F.lower("o_orderstatus"))


@query("SELECT 'raw_filtered_awards' AS input_file, CAST(-1 AS BIGINT) AS input_count, count(*) AS output_count, round(sum(federal_action_obligation), 2) AS total_obligation FROM raw_filtered_awards")
def ingestion_profile(spark: SparkSession, d: str) -> DataFrame:
    return phases.profile(table(spark, d, "raw_filtered_awards"), "raw_filtered_awards").withColumn("total_obligation", F.round("total_obligation", 2))


@query("SELECT ticker, action_date, contract_transaction_unique_key, market_cap FROM (SELECT DISTINCT ticker, action_date, contract_transaction_unique_key, market_cap FROM enriched_awards WHERE is_public AND market_cap IS NOT NULL AND ticker IS NOT NULL)")
def eligible_order_limit(spark: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    e = table(spark, d, "enriched_awards").where(F.col("is_public") & F.col("market_cap").isNotNull() & F.col("ticker").isNotNull())
    out = e.select("ticker", "action_date", KEY, "market_cap").distinct().orderBy("ticker", "action_date", KEY)
    return out if limit is None else out.limit(limit)


@query("SELECT ticker, date, close_adj FROM cache_returns WHERE date BETWEEN DATE '2023-01-01' AND DATE '2023-03-31'")
def date_range_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cache_returns").where(F.col("date").between("2023-01-01", "2023-03-31")).select("ticker", "date", "close_adj")


@query("SELECT *, '0.1.0' AS pipeline_version, TIMESTAMP '2024-01-01 00:00:00' AS ingested_at FROM region")
def metadata_stamp(spark: SparkSession, d: str) -> DataFrame:
    return phases.stamp(table(spark, d, "region"), now=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT contract_transaction_unique_key, market_cap, ticker, sector FROM enriched_awards WHERE market_cap IS NOT NULL AND ticker IS NOT NULL AND sector IS NOT NULL")
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enriched_awards").select(KEY, "market_cap", "ticker", "sector").dropna(subset=["market_cap", "ticker", "sector"])


@query("""SELECT contract_transaction_unique_key, ingested_at, number_of_offers_received = 1 AND number_of_offers_received IS NOT NULL AS one_offer,
CASE WHEN number_of_offers_received >= 1 THEN number_of_offers_received < 2 AND number_of_offers_received = 1 END AS sole_source,
transaction_type IS NOT NULL AND transaction_type IN ('NEW_AWARDS', 'NEW_DELIVERY_ORDERS', 'FUNDING_INCREASE') AS is_primary FROM raw_filtered_awards""")
def boolean_derivations(spark: SparkSession, d: str) -> DataFrame:
    raw, offers = table(spark, d, "raw_filtered_awards"), F.col("number_of_offers_received")
    return raw.select(
        KEY, "ingested_at", F.coalesce(offers == 1, F.lit(False)).alias("one_offer"), phases.sole_source(offers).alias("sole_source"),
        F.coalesce(F.col("transaction_type").isin(*phases.PRIMARY), F.lit(False)).alias("is_primary"),
    )


@query("SELECT o_orderkey, o_custkey, NULL AS s_suppkey FROM orders UNION ALL BY NAME SELECT NULL AS o_orderkey, NULL AS o_custkey, s_suppkey FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return a.unionByName(table(spark, d, "supplier").select("s_suppkey"), allowMissingColumns=True)


# lag and classification


@query(f"WITH {q.LAGGED} SELECT contract_transaction_unique_key, prev_potential_value, ceiling_change FROM lagged")
def full_history_lag(spark: SparkSession, d: str) -> DataFrame:
    return phases.full_history_lag(t.raw(spark, d)).select(KEY, "prev_potential_value", "ceiling_change")


@query(f"WITH {q.LAGGED} SELECT {q.KIND} AS transaction_kind, count(*) AS n FROM lagged GROUP BY ALL")
def transaction_type_case(spark: SparkSession, d: str) -> DataFrame:
    return phases.full_history_lag(t.raw(spark, d)).groupBy(phases.transaction_type().alias("transaction_kind")).agg(F.count("*").alias("n"))


@query("SELECT contract_transaction_unique_key, string_split(contract_transaction_unique_key, '_')[-3] AS modification, string_split(contract_transaction_unique_key, '_')[1] AS agency, string_split(contract_transaction_unique_key, '_')[9] AS beyond FROM raw_filtered_awards")
def key_segment_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col(KEY)
    return table(spark, d, "raw_filtered_awards").select(KEY, x.key_segment(k, -3).alias("modification"), x.key_segment(k, 1).alias("agency"), x.key_segment(k, 9).alias("beyond"))


@query(f"WITH {q.LAGGED} SELECT {q.EVENT_CLASS.format(major='1e8')} AS event_class, count(*) AS n, round(sum(ceiling_change), 0) AS total_change FROM lagged GROUP BY ALL")
def event_class_counts(spark: SparkSession, d: str) -> DataFrame:
    lagged = phases.full_history_lag(t.raw(spark, d))
    return lagged.groupBy(phases.event_class().alias("event_class")).agg(F.count("*").alias("n"), F.round(F.sum("ceiling_change"), 0).alias("total_change"))


LIMITS = (5e7, 1e8, 2e8, 5e8, 1e9)


@query(f"WITH {q.LAGGED}, limits AS (SELECT unnest([5e7, 1e8, 2e8, 5e8, 1e9]) AS major_limit) SELECT major_limit, {q.EVENT_CLASS.format(major='major_limit')} AS event_class, count(*) AS n FROM lagged, limits GROUP BY ALL")
def event_class_reclass_sweep(spark: SparkSession, d: str) -> DataFrame:
    lagged = phases.full_history_lag(t.raw(spark, d)).select("transaction_type", "ceiling_change")
    each = lagged.withColumn("major_limit", F.explode(F.array(*[F.lit(v) for v in LIMITS])))
    return each.groupBy("major_limit", phases.event_class(F.col("major_limit")).alias("event_class")).agg(F.count("*").alias("n"))


@query(f"SELECT contract_transaction_unique_key, {q.QUIET} AS is_quiet, {q.MONEY} AS brings_money FROM raw_filtered_awards")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("transaction_description")
    return table(spark, d, "raw_filtered_awards").select(KEY, x.any_keyword(text, phases.QUIET_WORDS).alias("is_quiet"), x.any_keyword(text, phases.MONEY_WORDS).alias("brings_money"))


# joins


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def hierarchy_left_join(spark: SparkSession, d: str) -> DataFrame:
    s = phases.lookup(table(spark, d, "supplier"), table(spark, d, "nation"), {"s_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    return phases.lookup(s, table(spark, d, "region"), {"n_regionkey": "r_regionkey"}, ["r_name"]).select("s_suppkey", "s_name", "n_name", "r_name")


@query("WITH o AS (SELECT highest_level_owner_name AS owner, min(ticker) AS ticker FROM enriched_awards WHERE highest_level_owner_name IS NOT NULL AND ticker IS NOT NULL GROUP BY 1) SELECT contract_transaction_unique_key, recipient_parent_name, o.ticker AS owner_ticker FROM raw_filtered_awards LEFT JOIN o ON recipient_parent_name = o.owner")
def owner_ticker_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enriched_awards").where(F.col("highest_level_owner_name").isNotNull() & F.col("ticker").isNotNull())
    owners = e.groupBy(F.col("highest_level_owner_name").alias("owner")).agg(F.min("ticker").alias("owner_ticker"))
    return phases.lookup(table(spark, d, "raw_filtered_awards").select(KEY, "recipient_parent_name"), owners, {"recipient_parent_name": "owner"}, ["owner_ticker"])


@query("WITH c AS (SELECT ticker, date, max(market_cap) AS day_cap FROM cache_market_cap GROUP BY ALL) SELECT e.contract_transaction_unique_key, e.ticker, e.action_date, day_cap FROM enriched_awards e LEFT JOIN c ON e.ticker = c.ticker AND e.action_date = c.date")
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cache_market_cap").groupBy("ticker", "date").agg(F.max("market_cap").alias("day_cap"))
    return phases.lookup(table(spark, d, "enriched_awards").select(KEY, "ticker", "action_date"), c, {"ticker": "ticker", "action_date": "date"}, ["day_cap"])


@query("""WITH titles AS (SELECT lpad(trim(naics_code), 6, '0') AS code, min(naics_description) AS naics_title FROM raw_filtered_awards WHERE naics_code IS NOT NULL GROUP BY 1),
psc AS (SELECT upper(trim(product_or_service_code)) AS code, min(product_or_service_code_description) AS psc_name FROM raw_filtered_awards WHERE product_or_service_code IS NOT NULL GROUP BY 1)
SELECT contract_transaction_unique_key, lpad(trim(r.naics_code), 6, '0') AS naics_code, naics_title, upper(trim(product_or_service_code)) AS service_code, psc_name
FROM raw_filtered_awards r LEFT JOIN titles ON titles.code = lpad(trim(r.naics_code), 6, '0') LEFT JOIN psc ON psc.code = upper(trim(product_or_service_code))""")
def lookup_normalised_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_filtered_awards").select(
        KEY, x.pad_code(F.col("naics_code")).alias("naics_code"), "naics_description", x.upper_code(F.col("product_or_service_code")).alias("service_code"), F.col("product_or_service_code_description").alias("text")
    )
    titles = r.where(F.col("naics_code").isNotNull()).groupBy(F.col("naics_code").alias("code")).agg(F.min("naics_description").alias("naics_title"))
    psc = r.where(F.col("service_code").isNotNull()).groupBy(F.col("service_code").alias("code")).agg(F.min("text").alias("psc_name"))
    out = phases.lookup(r.drop("naics_description", "text"), titles, {"naics_code": "code"}, ["naics_title"])
    return phases.lookup(out, psc, {"service_code": "code"}, ["psc_name"])


_OWNERS = "SELECT highest_level_owner_name FROM enriched_awards WHERE highest_level_owner_name IS NOT NULL"


@query(f"SELECT DISTINCT recipient_parent_name AS owner FROM raw_filtered_awards WHERE recipient_parent_name IS NOT NULL AND recipient_parent_name NOT IN ({_OWNERS})")
def pending_left_anti(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "raw_filtered_awards").select(F.col("recipient_parent_name").alias("owner"))
    return state.pending(wanted, table(spark, d, "enriched_awards").select(F.col("highest_level_owner_name").alias("owner")), ["owner"])


@query(f"SELECT contract_transaction_unique_key, ingested_at, recipient_parent_name FROM raw_filtered_awards WHERE recipient_parent_name IN ({_OWNERS})")
def cached_left_semi(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_filtered_awards").select(KEY, "ingested_at", "recipient_parent_name")
    owners = table(spark, d, "enriched_awards").select(F.col("highest_level_owner_name").alias("recipient_parent_name"))
    return raw.join(owners, "recipient_parent_name", "left_semi")


_TICKERS = "SELECT highest_level_owner_name AS owner, min(ticker) AS ticker FROM enriched_awards WHERE highest_level_owner_name IS NOT NULL AND ticker IS NOT NULL GROUP BY 1"


@query(f"SELECT owner, t.ticker, CASE WHEN t.owner IS NULL THEN 'not_found' ELSE 'success' END AS status FROM (SELECT DISTINCT recipient_parent_name AS owner FROM raw_filtered_awards WHERE recipient_parent_name IS NOT NULL) w LEFT JOIN ({_TICKERS}) t USING (owner) WHERE owner NOT IN (SELECT recipient_parent_name FROM raw_filtered_awards WHERE action_date < DATE '2023-01-01' AND recipient_parent_name IS NOT NULL)".replace("SELECT owner, t.ticker, CASE WHEN t.owner IS NULL", "SELECT w.owner, t.ticker, CASE WHEN t.owner IS NULL").replace("WHERE owner NOT IN", "WHERE w.owner NOT IN").replace("USING (owner)", "ON t.owner = w.owner"))
def negative_caching(spark: SparkSession, d: str) -> DataFrame:
    """Owners that no action before 2023 named are asked for; those without a ticker are kept as not found."""
    raw = table(spark, d, "raw_filtered_awards").select(F.col("recipient_parent_name").alias("owner"), "action_date")
    e = table(spark, d, "enriched_awards").where(F.col("highest_level_owner_name").isNotNull() & F.col("ticker").isNotNull())
    answers = e.groupBy(F.col("highest_level_owner_name").alias("owner")).agg(F.min("ticker").alias("ticker"))
    return state.settle(raw.select("owner"), raw.where("action_date < '2023-01-01'").select("owner"), answers, ["owner"])


_LISTED = "l AS (SELECT DISTINCT contract_transaction_unique_key, ticker, action_date FROM enriched_awards WHERE ticker IS NOT NULL)"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enriched_awards").where(F.col("ticker").isNotNull()).select(KEY, "ticker", "action_date").distinct()


@query(f"WITH {q.BARS}, {_LISTED} SELECT contract_transaction_unique_key, l.ticker, action_date, b.date AS bar_date, close_adj AS bar_close FROM l ASOF LEFT JOIN bars b ON l.ticker = b.ticker AND l.action_date <= b.date")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    out = asof_join(_listed(spark, d), t.daily_bars(spark, d), "ticker", "action_date", "date", ["date", "close_adj"], "forward", prefix="bar_")
    return out.withColumnRenamed("bar_close_adj", "bar_close")


@query(f"WITH {q.BARS}, {_LISTED}, j AS (SELECT contract_transaction_unique_key, l.ticker, action_date, b.date AS d, close_adj FROM l ASOF LEFT JOIN bars b ON l.ticker = b.ticker AND l.action_date >= b.date) SELECT contract_transaction_unique_key, ticker, action_date, CASE WHEN action_date - d <= 10 THEN d END AS bar_date, CASE WHEN action_date - d <= 10 THEN close_adj END AS bar_close FROM j")
def asof_backward_tolerance(spark: SparkSession, d: str) -> DataFrame:
    out = asof_join(_listed(spark, d), t.daily_bars(spark, d), "ticker", "action_date", "date", ["date", "close_adj"], "backward", 10, "bar_")
    return out.withColumnRenamed("bar_close_adj", "bar_close")


@query("SELECT contract_transaction_unique_key, industry, CASE industry WHEN 'Aerospace & Defense' THEN 'ITA' WHEN 'Information Technology Services' THEN 'XLK' ELSE 'SPY' END AS benchmark FROM enriched_awards")
def benchmark_map_join(spark: SparkSession, d: str) -> DataFrame:
    names = {"Aerospace & Defense": "ITA", "Information Technology Services": "XLK"}
    return table(spark, d, "enriched_awards").select(KEY, "industry", bars.benchmark_of(F.col("industry"), names, "SPY").alias("benchmark"))


@query(f"""WITH {q.BARS}, {_LISTED}, sh AS (SELECT ticker, date AS report_date, max(shares_outstanding) AS count FROM cache_market_cap WHERE status = 'success' AND shares_outstanding IS NOT NULL GROUP BY ALL),
cur AS (SELECT ticker, max(shares_outstanding) AS shares_now FROM cache_market_cap GROUP BY ticker),
a AS (SELECT l.*, CASE WHEN l.action_date - b.date <= 10 THEN b.close_adj END AS close FROM l ASOF LEFT JOIN bars b ON l.ticker = b.ticker AND l.action_date >= b.date),
c AS (SELECT a.*, CASE WHEN a.action_date - sh.report_date <= 180 AND sh.count > 0 THEN sh.count END AS known FROM a ASOF LEFT JOIN sh ON a.ticker = sh.ticker AND a.action_date >= sh.report_date),
e AS (SELECT c.*, CASE WHEN shares_now > 0 THEN shares_now END AS shares_now FROM c LEFT JOIN cur USING (ticker))
SELECT contract_transaction_unique_key, ticker, action_date, close AS close_price, CASE WHEN close IS NOT NULL THEN coalesce(known, shares_now) END AS shares_outstanding,
  round(close * coalesce(known, shares_now), 2) AS market_cap, CASE WHEN close IS NULL THEN 'no_close' WHEN known IS NOT NULL THEN 'ok' WHEN shares_now IS NOT NULL THEN 'stale_shares' ELSE 'no_shares' END AS market_cap_quality FROM e""")
def pit_market_cap(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "cache_market_cap")
    shares = cache.where((F.col("status") == "success") & F.col("shares_outstanding").isNotNull())
    shares = shares.groupBy("ticker", F.col("date").alias("report_date")).agg(F.max("shares_outstanding").alias("count"))
    current = cache.groupBy("ticker").agg(F.max("shares_outstanding").alias("shares_now"))
    prices = t.daily_bars(spark, d).withColumnRenamed("close_adj", "close")
    return phases.point_in_time_cap(_listed(spark, d), prices, shares, current).withColumn("market_cap", F.round("market_cap", 2))


# strings, dates, numbers


@query("SELECT p_partkey, lpad(trim(CAST(p_size AS VARCHAR)), 6, '0') AS code, upper(trim(p_name)) AS name FROM part")
def lpad_trim_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", x.pad_code(F.col("p_size")).alias("code"), x.upper_code(F.col("p_name")).alias("name"))


@query("SELECT contract_transaction_unique_key, trim(replace(replace(naics_description, ' Manufacturing', ''), 'Pump', '')) AS stripped FROM raw_filtered_awards")
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_filtered_awards").select(KEY, x.strip_phrases(F.col("naics_description"), ["Pump", " Manufacturing"]).alias("stripped"))


_FORMS = "trim(regexp_replace(regexp_replace(upper(recipient_parent_name_raw), '[^\\p{L}\\p{N}_\\s\\x{00A0}&]', ' ', 'g'), '\\s+', ' ', 'g'))"
for _long, _short in x.LEGAL_FORMS:
    _FORMS = f"regexp_replace({_FORMS}, '\\b{_long}\\b', '{_short}', 'g')"


@query(f"SELECT DISTINCT recipient_parent_name_raw AS name, {_FORMS} AS name_key FROM raw_filtered_awards")
def company_name_normalise(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "raw_filtered_awards").select(F.col("recipient_parent_name_raw").alias("name")).distinct()
    return names.withColumn("name_key", x.company_key(F.col("name")))


@query("WITH t AS (SELECT DISTINCT coalesce(ticker, '1446752D') AS ticker FROM enriched_awards UNION ALL SELECT CAST(1000 + p_partkey AS VARCHAR) || CASE WHEN p_size > 25 THEN 'D' ELSE 'd' END FROM part) SELECT ticker, regexp_full_match(ticker, '[0-9]{4,}[A-Z]?') AS is_id FROM t")
def id_reject_regex(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "enriched_awards").select(F.coalesce("ticker", F.lit("1446752D")).alias("ticker")).distinct()
    b = table(spark, d, "part").select(F.concat((F.col("p_partkey") + 1000).cast("string"), F.when(F.col("p_size") > 25, "D").otherwise("d")).alias("ticker"))
    both = a.unionByName(b)
    return both.withColumn("is_id", x.looks_like_id(F.col("ticker")))


@query(f"SELECT DISTINCT action_date, {q.FISCAL} AS fiscal_quarter FROM raw_filtered_awards")
def fiscal_quarter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_filtered_awards").select("action_date", x.fiscal_quarter(F.col("action_date")).alias("fiscal_quarter")).distinct()


@query("SELECT contract_transaction_unique_key, greatest(30, coalesce(date_diff('day', action_date, period_of_performance_current_end_date), 30)) AS duration_days FROM raw_filtered_awards")
def duration_floor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_filtered_awards").select(KEY, x.floored_days(F.col("action_date"), F.col("period_of_performance_current_end_date")).alias("duration_days"))


@query("SELECT contract_transaction_unique_key, CASE WHEN isnan(ceiling_change) THEN 'nan' WHEN isinf(ceiling_change) THEN 'inf' ELSE 'finite' END AS kind, round(CASE WHEN ceiling_change <> 0 AND isfinite(ceiling_change) THEN sign(ceiling_change) * log10(greatest(1.0, abs(ceiling_change))) END, 6) AS logged FROM signals_awards")
def signed_log10(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("ceiling_change")
    kind = F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "inf").otherwise("finite")
    s = table(spark, d, "signals_awards").withColumn("kind", kind)
    return s.select(KEY, "kind", F.round(F.when(F.col("kind") == "finite", x.signed_log10(c)), 6).alias("logged"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS written, CAST(o_orderdate AS DATE) AS read_back FROM orders")
def us_date_parse(spark: SparkSession, d: str) -> DataFrame:
    written = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, d, "orders").select("o_orderkey", written.alias("written"), x.us_date(written).alias("read_back"))


# aggregates


@query("WITH k AS (SELECT DISTINCT naics_code, product_or_service_code_description AS kw FROM raw_filtered_awards WHERE naics_code IS NOT NULL AND product_or_service_code_description IS NOT NULL) SELECT naics_code, string_agg(kw, '; ' ORDER BY kw) AS keywords FROM k GROUP BY 1")
def keyword_listagg(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "raw_filtered_awards").select("naics_code", F.col("product_or_service_code_description").alias("kw")).dropna().distinct()
    return k.groupBy("naics_code").agg(F.expr("listagg(kw, '; ') WITHIN GROUP (ORDER BY kw)").alias("keywords"))


@query("SELECT DISTINCT cage_code FROM raw_filtered_awards WHERE cage_code IS NOT NULL")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_filtered_awards").select("cage_code").where(F.col("cage_code").isNotNull()).distinct()


@query("SELECT count(*) AS n, count(DISTINCT cage_code) AS codes, count(DISTINCT award_id_piid) AS awards, count(DISTINCT awarding_sub_agency_name) AS agencies FROM raw_filtered_awards")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_filtered_awards").agg(F.count("*").alias("n"), F.countDistinct("cage_code").alias("codes"), F.countDistinct("award_id_piid").alias("awards"), F.countDistinct("awarding_sub_agency_name").alias("agencies"))


@query("SELECT ticker, min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM cache_returns GROUP BY 1")
def coverage_minmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cache_returns").groupBy("ticker").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n"))


@query("SELECT sector, industry, count(*) AS n FROM enriched_awards GROUP BY ALL ORDER BY n DESC, sector NULLS FIRST, industry NULLS FIRST LIMIT 15")
def top15_value_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "enriched_awards").groupBy("sector", "industry").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "sector", "industry").limit(15)


@query("SELECT ticker, date, close_adj, fetched_at FROM cache_returns WHERE close_adj IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY fetched_at DESC, close_adj DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "cache_returns").where(F.col("close_adj").isNotNull()).select("ticker", "date", "close_adj", "fetched_at")
    return bars.latest(some, ["ticker", "date"], ["fetched_at", "close_adj"])


# keyed state


@query("""WITH b AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE c.c_acctbal END AS c_acctbal, c_mktsegment FROM customer c FULL JOIN b ON c.c_custkey = b.c_custkey""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """All customers; the batch is what the orders in progress say of their balance."""
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    batch = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return state.upsert(old, batch, ["c_custkey"], ["c_acctbal"])


@query("""WITH f AS (SELECT event_type AS provider, CAST(user_id AS VARCHAR) AS key, max(ts) AS last_attempt_at, count(*) AS attempts FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL),
n AS (SELECT event_type AS provider, CAST(user_id AS VARCHAR) AS key, max(ts) AS last_attempt_at FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL)
SELECT provider, key, coalesce(n.last_attempt_at, f.last_attempt_at) AS last_attempt_at, f.attempts FROM f FULL JOIN n USING (provider, key)""")
def upsert_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures by provider and key: a later batch moves the time of the last attempt and leaves the other columns."""
    e = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("user_id").cast("string").alias("key"), "ts")
    old = e.where("ts < '2024-01-15'").groupBy("provider", "key").agg(F.max("ts").alias("last_attempt_at"), F.count("*").alias("attempts"))
    batch = e.where("ts >= '2024-01-15'").withColumnRenamed("ts", "last_attempt_at")
    return state.upsert(old, batch, ["provider", "key"], ["last_attempt_at"])


@query("""WITH have AS (SELECT ticker, date, close_adj FROM cache_returns WHERE date < DATE '2023-07-01' QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY fetched_at, close_adj NULLS FIRST) = 1),
late AS (SELECT ticker, date, close_adj FROM cache_returns WHERE date >= DATE '2023-01-01' QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY fetched_at, close_adj NULLS FIRST) = 1)
SELECT * FROM have UNION ALL SELECT * FROM late l WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.ticker = l.ticker AND h.date = l.date)""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cache_returns").select("ticker", "date", "fetched_at", "close_adj")
    keys, empty = ["ticker", "date"], c.where(F.lit(False))
    have, _ = state.insert_ignore(empty, c.where("date < '2023-07-01'"), keys, ["fetched_at"])
    after, _ = state.insert_ignore(have, c.where("date >= '2023-01-01'"), keys, ["fetched_at"])
    return after.drop("fetched_at")


@query("WITH f AS (SELECT event_id, user_id, ts AS last_attempt_at, CAST(1 + event_id % 5 AS INTEGER) AS attempts FROM events WHERE event_type = 'error') SELECT event_id, attempts FROM f WHERE last_attempt_at + ([60, 3600, 86400])[greatest(1, least(attempts, 3))] * INTERVAL 1 SECOND > TIMESTAMP '2024-01-15 12:00:00'")
def failure_backoff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    f = e.select("event_id", F.col("ts").alias("last_attempt_at"), (F.col("event_id") % 5 + 1).cast("int").alias("attempts"))
    return state.in_backoff(f, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), [60, 3600, 86400]).select("event_id", "attempts")


@query("SELECT count(*) AS n_before, count(*) FILTER (status = 'error' OR market_cap IS NULL) AS n_deleted, count(*) FILTER (NOT coalesce(status = 'error' OR market_cap IS NULL, FALSE)) AS n_after FROM cache_market_cap")
def delete_predicate(spark: SparkSession, d: str) -> DataFrame:
    return state.delete_where(table(spark, d, "cache_market_cap"), (F.col("status") == "error") | F.col("market_cap").isNull())[1]


@query("""WITH w AS (SELECT ticker, min(action_date) - 5 AS "start", max(action_date) + 265 AS "end" FROM enriched_awards WHERE ticker IS NOT NULL GROUP BY 1),
h AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM cache_returns GROUP BY 1)
SELECT w.* FROM w LEFT JOIN h USING (ticker) WHERE lo IS NULL OR lo > "start" OR hi < "end" """)
def range_coverage_plan(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "enriched_awards").where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.date_sub(F.min("action_date"), 5).alias("start"), F.date_add(F.max("action_date"), 265).alias("end"))
    return state.fetch_plan(wanted, table(spark, d, "cache_returns"), "ticker", "date")


@query("""WITH c AS (SELECT count(DISTINCT cage_code) AS n FROM raw_filtered_awards WHERE cage_code NOT IN (SELECT cage_code FROM enriched_awards WHERE cage_code IS NOT NULL AND is_highest)),
t AS (SELECT count(*) AS n FROM (SELECT DISTINCT highest_level_owner_name FROM enriched_awards WHERE highest_level_owner_name IS NOT NULL AND ticker IS NULL)),
m AS (SELECT count(*) AS n FROM (SELECT DISTINCT ticker, action_date FROM enriched_awards WHERE ticker IS NOT NULL) e WHERE NOT EXISTS (SELECT 1 FROM cache_market_cap k WHERE k.ticker = e.ticker AND k.date = e.action_date))
SELECT c.n AS hierarchy, t.n AS tickers, m.n AS caps, round((c.n * 1.5 + t.n * 2.5 + m.n * 1.0) / 3600, 4) AS hours FROM c, t, m""")
def work_estimate(spark: SparkSession, d: str) -> DataFrame:
    raw, e, cache = table(spark, d, "raw_filtered_awards"), table(spark, d, "enriched_awards"), table(spark, d, "cache_market_cap")
    tag = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
    parts = tag(state.pending(raw, e.where(F.col("is_highest")), ["cage_code"]), "hierarchy")
    parts = parts.unionByName(tag(e.where(F.col("ticker").isNull()).select("highest_level_owner_name").dropna().distinct(), "tickers"))
    parts = parts.unionByName(tag(state.pending(e.select("ticker", F.col("action_date").alias("date")), cache, ["ticker", "date"]), "caps"))
    wide = parts.groupBy().pivot("k", ["hierarchy", "tickers", "caps"]).agg(F.first("n"))
    return wide.withColumn("hours", F.round((F.col("hierarchy") * 1.5 + F.col("tickers") * 2.5 + F.col("caps") * 1.0) / 3600, 4))


@query("SELECT sector, min(ticker) AS ticker FROM enriched_awards WHERE ticker <> '' AND NOT regexp_full_match(ticker, '[0-9]{4,}[A-Z]?') GROUP BY 1")
def ticker_choice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enriched_awards").where((F.col("ticker") != "") & ~x.looks_like_id(F.col("ticker")))
    return e.groupBy("sector").agg(F.min("ticker").alias("ticker"))


@query("SELECT psc_code, psc_name FROM (SELECT upper(product_or_service_code) AS psc_code, product_or_service_code_description AS psc_name, row_number() OVER (PARTITION BY upper(product_or_service_code) ORDER BY ingested_at, contract_transaction_unique_key) AS rn FROM raw_filtered_awards WHERE product_or_service_code IS NOT NULL AND product_or_service_code_description IS NOT NULL AND (period_of_performance_current_end_date IS NULL OR period_of_performance_current_end_date >= DATE '2024-01-01')) WHERE rn = 1")
def service_code_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_filtered_awards").where(F.col("product_or_service_code_description").isNotNull()).select(
        F.upper("product_or_service_code").alias("psc_code"), F.col("product_or_service_code_description").alias("psc_name"), "ingested_at", KEY,
        F.date_format("period_of_performance_current_end_date", "MM/dd/yyyy").alias("end"),
    )
    return service_codes(spark, r, "psc_code", "end", "2024-01-01", ["psc_name"], ["ingested_at", KEY])


@query("SELECT transaction_type, award_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM raw_filtered_awards GROUP BY 1, 2")
def value_count_shares(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "raw_filtered_awards").groupBy("transaction_type", "award_type").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # a row per kind


_PAGE = """<table><tr><td class="detail-left-col">Legal Business Name</td><td class="detail-right-col">%s</td></tr></table>
<div id="detail_topsection">%s%s</div>%s"""
_OWNER = """
<div id="ownership"><div class="subsection_header">Highest Level Owner</div><div class="data">%s%s</div></div>"""


def _field(label: str, value: Column) -> Column:
    """A label and its escaped value, nothing for null."""
    escaped = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.when(value.isNotNull(), F.format_string(f"<label>{label}</label><span>%s</span>", escaped)).otherwise("")


_CLEAN = "trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@query(f"""WITH e AS (SELECT contract_transaction_unique_key, {_CLEAN.format(c="cage_code")} AS cage_code, coalesce(strftime(cage_update_date, '%Y-%m-%d'), '') AS cage_update_date,
  highest_level_owner_name IS NULL AND highest_level_cage_code IS NULL AS is_highest, {_CLEAN.format(c="cage_business_name")} AS business,
  {_CLEAN.format(c="highest_level_owner_name")} AS name, {_CLEAN.format(c="highest_level_cage_code")} AS code FROM enriched_awards)
SELECT contract_transaction_unique_key, cage_code, cage_update_date, is_highest, if(name = '', business, name) AS owner, if(code = '', cage_code, code) AS owner_code FROM e""")
def html_detail_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enriched_awards")
    name, code = F.col("highest_level_owner_name"), F.col("highest_level_cage_code")
    owner = F.when(name.isNotNull() | code.isNotNull(), F.format_string(_OWNER, _field("Company Name", name), _field("CAGE", code))).otherwise("")
    business = F.coalesce(F.replace(F.replace("cage_business_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    page = F.format_string(_PAGE, business, _field("CAGE", F.col("cage_code")), _field("CAGE Update Date", F.date_format("cage_update_date", "MM/dd/yyyy")), owner)
    p = e.select(KEY, parse_details(page).alias("p"))
    return p.select(KEY, "p.cage_code", "p.cage_update_date", "p.is_highest", F.col("p.highest_level_owner_name").alias("owner"), F.col("p.highest_level_cage_code").alias("owner_code"))


_BY_NAME = _FORMS.replace("recipient_parent_name_raw", "highest_level_owner_name")


@query(f"WITH c AS (SELECT {_BY_NAME} AS k, min(ticker) AS ticker FROM enriched_awards WHERE ticker IS NOT NULL AND highest_level_owner_name IS NOT NULL GROUP BY 1), o AS (SELECT DISTINCT recipient_parent_name_raw AS owner, {_FORMS} AS k FROM raw_filtered_awards) SELECT owner, ticker FROM o LEFT JOIN c USING (k)")
def ticker_by_normalised_name(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enriched_awards").select(F.col("highest_level_owner_name").alias("name"), "ticker", F.lit("US").alias("exchange")).where(F.col("name").isNotNull())
    owners = table(spark, d, "raw_filtered_awards").select(F.col("recipient_parent_name_raw").alias("owner"))
    return resolve_tickers(owners, e).select("owner", "ticker")


# all phases in a row

_NOW = "2024-01-01 00:00:00"
_PIPELINE = f"""WITH {q.LAGGED.replace("* EXCLUDE (prev_potential_value)", "* EXCLUDE (prev_potential_value, transaction_type)")},
scoped AS (SELECT * EXCLUDE (ingested_at), {q.KIND} AS transaction_type FROM lagged
  WHERE federal_action_obligation >= 0 AND total_dollars_obligated >= 1e6 AND award_type IN ('DEFINITIVE CONTRACT', 'DELIVERY ORDER', 'PURCHASE ORDER')),
owners AS (SELECT cage_code, max(highest_level_owner_name) AS highest_level_owner_name FROM enriched_awards WHERE cage_code IS NOT NULL GROUP BY 1),
tickers AS ({_TICKERS}),
caps AS (SELECT ticker, date, market_cap, market_cap_quality, sector, industry FROM cache_market_cap
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY fetched_at DESC NULLS LAST, market_cap DESC NULLS LAST, market_cap_quality DESC NULLS LAST, sector DESC NULLS LAST, industry DESC NULLS LAST) = 1),
titles AS (SELECT lpad(trim(naics_code), 6, '0') AS naics_code, max(naics_description) AS naics_title FROM raw_filtered_awards WHERE naics_code IS NOT NULL GROUP BY 1),
words AS (SELECT naics_code, string_agg(kw, '; ' ORDER BY kw) AS naics_keywords FROM (SELECT DISTINCT lpad(trim(naics_code), 6, '0') AS naics_code, product_or_service_code_description AS kw
  FROM raw_filtered_awards WHERE naics_code IS NOT NULL AND product_or_service_code_description IS NOT NULL) GROUP BY 1),
psc AS (SELECT upper(trim(product_or_service_code)) AS psc_code, max(product_or_service_code_description) AS psc_name FROM raw_filtered_awards WHERE product_or_service_code IS NOT NULL GROUP BY 1),
base AS (SELECT s.*, o.highest_level_owner_name, t.ticker, c.sector, c.industry, c.market_cap, c.market_cap_quality, n.naics_title, w.naics_keywords, p.psc_name
  FROM scoped s LEFT JOIN owners o USING (cage_code) LEFT JOIN tickers t ON t.owner = o.highest_level_owner_name LEFT JOIN caps c ON c.ticker = t.ticker AND c.date = s.action_date
  LEFT JOIN titles n ON n.naics_code = lpad(trim(s.naics_code), 6, '0') LEFT JOIN words w ON w.naics_code = lpad(trim(s.naics_code), 6, '0') LEFT JOIN psc p ON p.psc_code = upper(trim(s.product_or_service_code)))
{q.SIGNAL_STEPS}
SELECT contract_transaction_unique_key, transaction_type, highest_level_owner_name, ticker, ticker IS NOT NULL AS is_public,
  CASE WHEN number_of_offers_received >= 1 THEN number_of_offers_received = 1 END AS sole_source_flag, market_cap, naics_title, naics_keywords, psc_name,
  round(ceiling_change, 2) + 0.0 AS ceiling_change, is_primary_action, signal_quality, event_class, '{phases.VERSION}' AS pipeline_version FROM signals"""


def caches(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """What outside services would have answered, from the tables."""
    e, raw, cap = table(spark, d, "enriched_awards"), table(spark, d, "raw_filtered_awards"), table(spark, d, "cache_market_cap")
    named = e.where(F.col("highest_level_owner_name").isNotNull() & F.col("ticker").isNotNull())
    code, text = x.pad_code(F.col("naics_code")), F.col("product_or_service_code_description")
    none = F.lit(None).cast("string")
    return {
        "hierarchy": e.where(F.col("cage_code").isNotNull()).groupBy("cage_code").agg(*[F.max(c).alias(c) for c in phases.HIERARCHY]),
        "tickers": named.groupBy("highest_level_owner_name").agg(F.min("ticker").alias("ticker")),
        "caps": bars.latest(cap, ["ticker", "date"], ["fetched_at", "market_cap", "market_cap_quality", "sector", "industry", "close_price", "shares_outstanding"]),
        "naics": raw.where(F.col("naics_code").isNotNull()).groupBy(code.alias("naics_code")).agg(F.max("naics_description").alias("naics_title"), F.max("naics_description").alias("naics_description")),
        "keywords": raw.select(code.alias("naics_code"), text.alias("keyword")).dropna().distinct(),
        "psc": raw.where(F.col("product_or_service_code").isNotNull()).groupBy(x.upper_code(F.col("product_or_service_code")).alias("psc_code")).agg(
            F.max(text).alias("psc_name"), F.first(none).alias("psc_includes"), F.first(none).alias("psc_level_1_category")),
    }


@query(_PIPELINE)
def pipeline_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Ingest, enrich, themes and signals in a row, from raw transactions and caches."""
    out = phases.run(t.raw(spark, d), **caches(spark, d), now=F.lit(_NOW).cast("timestamp_ntz"), least_total=1e6)
    return out.select(
        KEY, "transaction_type", "highest_level_owner_name", "ticker", "is_public", "sole_source_flag", "market_cap", "naics_title", "naics_keywords", "psc_name",
        (F.round("ceiling_change", 2) + F.lit(0.0)).alias("ceiling_change"), "is_primary_action", "signal_quality", "event_class", "pipeline_version",
    )
