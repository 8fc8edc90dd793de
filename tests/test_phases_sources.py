import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as x
from tidemark.operators import bad_rows, state
from tidemark.plans import phases, render
from tidemark.schemas import RAW_TRANSACTION
from tidemark.sources import files, html_pages, providers, tables
from tidemark.streaming import incremental


def tx(key, piid="P", parent=None, money=0.0, total=6e6, potential=1.0, day=1, text="", kind="DELIVERY ORDER"):
    values = dict(contract_transaction_unique_key=key, award_id_piid=piid, parent_award_id_piid=parent, federal_action_obligation=money, total_dollars_obligated=total,
                  potential_total_value_of_award=potential, action_date=date(2024, 1, day), transaction_description=text, award_type=kind)
    return tuple(values.get(f.name) for f in RAW_TRANSACTION)


def kinds(spark, rows):
    return {r.contract_transaction_unique_key: r for r in phases.ingest(spark.createDataFrame(rows, RAW_TRANSACTION)).collect()}


def test_transaction_kinds(spark):
    k = lambda n, seq="P1": f"A_B_{n}_{seq}_C_0"
    rows = [
        tx(k(1, "0"), "a"), tx(k(2, "000"), "b", parent="X"), tx(k(3, "0"), "c", parent="-NONE-"), tx(k(4), "d", money=5e6), tx(k(5), "e", money=888300.0),
        tx(k(6), "f", text="Procurement of x"), tx(k(7), "g", text="quiet"), tx(k(8), "h", text="Administrative Change, add"), tx("short", "i"), tx(k(9), "j", money=-1.0),
        tx(k(10), "l", kind="GRANT"), tx(k(11), "m", total=4_999_999.0), tx(k(12), "n", text="LOGISTICS"),
    ]
    out = kinds(spark, rows)
    assert "short" in out and out["short"].transaction_type is None
    want = {k(1, "0"): "NEW_AWARDS", k(2, "000"): "NEW_DELIVERY_ORDERS", k(3, "0"): "NEW_AWARDS", k(4): "MODIFICATION", k(5): "FUNDING_INCREASE", k(6): "FUNDING_INCREASE", k(7): None, k(8): None, k(12): "FUNDING_INCREASE"}
    assert {a: out[a].transaction_type for a in want} == want and not {k(9), k(10), k(11)} & out.keys()


def test_lag_looks_over_rows_out_of_scope(spark):
    rows = [tx("A_B_1_0_C_0", potential=4e6, day=1, total=1.0), tx("A_B_1_P1_C_0", potential=1e7, day=2), tx("A_B_1_P2_C_0", potential=1.2e7, day=2)]
    out = kinds(spark, rows)
    assert out["A_B_1_P1_C_0"].ceiling_change == 6e6 and out["A_B_1_P1_C_0"].transaction_type == "FUNDING_INCREASE" and out["A_B_1_P2_C_0"].ceiling_change == 2e6


def test_signals_by_hand(spark):
    cols = "contract_transaction_unique_key string, award_id_piid string, potential_total_value_of_award double, total_dollars_obligated double, current_total_value_of_award double, period_of_performance_start_date date, period_of_performance_current_end_date date, action_date date, federal_action_obligation double, market_cap double, market_cap_quality string, sector string, number_of_offers_received double, transaction_type string"
    d = date
    rows = [
        ("k1", "A", 5000.0, 1000.0, 10000.0, d(2023, 1, 1), d(2024, 1, 1), d(2023, 6, 1), 3000.0, 1000.0, "ok", "S", 2.0, "NEW_AWARDS"),
        ("k2", "A", 10000.0, 1000.0, 10000.0, d(2023, 1, 1), d(2024, 1, 1), d(2023, 7, 1), 0.0, 1000.0, "ok", "S", 1.0, None),
        ("k3", "B", 1.0, 1.0, 0.0, None, d(2023, 1, 1), d(2023, 7, 1), 5.0, None, "no_close", None, 0.0, "MODIFICATION"),
        ("k4", "B", 1.0, 1.0, 1.0, None, None, d(2023, 8, 1), 5.0, 0.0, "ok", None, 4.0, "FUNDING_INCREASE"),
    ]
    got = {r.contract_transaction_unique_key: r for r in phases.signals(spark.createDataFrame(rows, cols)).collect()}
    a, b, c, e = (got[k] for k in ("k1", "k2", "k3", "k4"))
    assert (a.ceiling_change, a.obligation_ratio, a.alpha_ratio, a.duration_days, a.moat_index, a.is_primary_action) == (None, 0.3, 3.0, 214, 0.5, True)
    assert a.acv_signal == pytest.approx(3000 / 214 * 365.25) and a.signal_quality == "microcap" and a.event_class == "NEW_AWARD"
    assert (b.ceiling_change, b.obligation_ratio, b.alpha_ratio, b.is_primary_action) == (5000.0, 0.5, 5.0, False)
    assert "extreme_ratio" in b.signal_quality and b.ceiling_change_log_dollars == pytest.approx(3.69897, abs=1e-5)
    assert (c.duration_days, c.alpha_ratio, c.obligation_ratio, c.moat_index, c.signal_quality) == (30, None, None, None, "missing_market_cap;no_close")
    assert (e.alpha_ratio, e.duration_days, e.event_class, e.ceiling_change_log_dollars) == (None, 30, "NON_EVENT", None)


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    quarter = lambda d: one(x.fiscal_quarter(lit(d).cast("date")))
    assert [quarter(d) for d in ("2023-10-01", "2023-12-31", "2024-01-01", "2024-09-30", "2024-10-01", None)] == ["FY24Q1", "FY24Q1", "FY24Q2", "FY24Q4", "FY25Q1", "UNKNOWN"]
    assert one(x.pad_code(lit(" 12345 "))) == "012345" and one(x.key_segment(lit("a_b"), 5)) is None and one(x.key_segment(lit("a_b"), -1)) == "b"
    assert one(x.company_key(lit(" Acme, Limited Liability Company "))) == "ACME LLC" and one(x.company_key(lit("É & Sons Corporation"))) == "É & SONS CORP"
    assert [one(x.looks_like_id(lit(t))) for t in ("1446752D", "BRK-A", "123", "12345")] == [True, False, False, True]
    assert one(x.us_date(lit("02/30/2024"))) is None and one(x.us_date(lit("01/15/2023"))) == date(2023, 1, 15)
    assert one(x.safe_div(lit(1.0), lit(0.0))) is None and one(x.signed_log10(lit(-0.5))) == 0.0 and one(x.signed_log10(lit(0.0))) is None
    assert one(x.quote_symbol(lit("BRK/B"))) == "BRK-B"


def test_themes(spark):
    awards = spark.createDataFrame([("1", "12345", "old", " r499 "), ("2", None, "old", None)], "id string, naics_code string, naics_description string, product_or_service_code string")
    naics = spark.createDataFrame([("012345", "T", "Cross-References. Desc")], "naics_code string, naics_title string, naics_description string")
    words = spark.createDataFrame([("12345", "b"), ("12345", "a")], "naics_code string, keyword string")
    psc = spark.createDataFrame([("R499", "N", "I", "L")], "psc_code string, psc_name string, psc_includes string, psc_level_1_category string")
    got = {r.id: r for r in phases.themes(awards, naics, words, psc, ["Cross-References."]).collect()}
    assert (got["1"].naics_code, got["1"].naics_title, got["1"].naics_description, got["1"].naics_keywords, got["1"].psc_name, got["1"].deliverable) == ("012345", "T", "Desc", "a; b", "N", "L")
    assert (got["2"].naics_code, got["2"].naics_title, got["2"].deliverable) == (None, None, None)


def test_point_in_time_cap(spark):
    d = date
    events = spark.createDataFrame([("A", d(2024, 6, 15), 1), ("A", d(2024, 1, 2), 2), ("B", d(2024, 6, 15), 3), ("C", d(2024, 6, 15), 4), ("D", d(2024, 6, 15), 5)], "ticker string, action_date date, id int")
    prices = spark.createDataFrame([(t, d(2024, 6, 10), 102.0) for t in "ABC"] + [("D", d(2024, 6, 1), 5.0)], "ticker string, date date, close double")
    shares = spark.createDataFrame([("A", d(2024, 5, 1), 1.1e6), ("A", d(2024, 7, 1), 9e6), ("B", d(2024, 5, 1), 0.0), ("B", d(2024, 4, 1), 7.0)], "ticker string, report_date date, count double")
    now = spark.createDataFrame([("B", 2e6), ("C", float("nan"))], "ticker string, shares_now double")
    got = {r.id: (r.market_cap, r.market_cap_quality) for r in phases.point_in_time_cap(events, prices, shares, now).collect()}
    assert got == {1: (102.0 * 1.1e6, "ok"), 2: (None, "no_close"), 3: (102.0 * 2e6, "stale_shares"), 4: (None, "no_shares"), 5: (None, "no_close")}


def test_state(spark, rows):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, s string, v double")
    batch = spark.createDataFrame([(2, 5.0), (2, 4.0), (3, None), (None, 9.0)], "k int, v double")
    assert rows(state.upsert(old, batch, ["k"], ["v"])) == sorted([(1, "a", 1.0), (2, "b", 5.0), (3, None, None), (None, "n", 9.0)], key=repr)
    with pytest.raises(ValueError):
        state.upsert(old, batch.withColumnRenamed("v", "other"), ["k"])
    new, added = state.insert_ignore(old.select("k", "v"), spark.createDataFrame([(2, 9.0), (4, 2.0), (4, 1.0)], "k int, v double"), ["k"], ["v"])
    assert rows(added) == [(4, 1.0)] and new.count() == 4
    kept, counts = state.delete_where(old, F.col("v") > 1)
    assert rows(kept, "k") == [(1,), (None,)] and tuple(counts.first()) == (3, 1, 2)
    f = spark.createDataFrame([("x", 1, datetime(2024, 1, 1)), ("y", 9, datetime(2024, 1, 1))], "p string, attempts int, last_attempt_at timestamp_ntz")
    assert rows(state.in_backoff(f, F.lit("2024-01-01 00:01:00").cast("timestamp_ntz"), [10, 3600]), "p") == [("y",)]
    want = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 2, 1)), ("b", date(2024, 1, 1), date(2024, 2, 1))], "k string, start date, end date")
    have = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 2, 1))], "k string, d date")
    assert rows(state.fetch_plan(want, have, "k", "d"), "k") == [("b",)]


def test_files_and_tables(spark, tmp_path, rows):
    (tmp_path / "FY2024_a.csv").write_text('key,money,extra\n007,1.5,"x, y"\n008,bad,z\n')
    (tmp_path / "FY2025_b.csv").write_text("money,key\n2,009\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("money", T.DoubleType()), T.StructField("day", T.DateType())])
    got = files.scan_glob(spark, f"{tmp_path}/*.csv", schema)
    assert rows(got) == [("007", 1.5, None), ("008", None, None), ("009", 2.0, None)]
    assert "extra" in files.scan_csv(spark, [f"{tmp_path}/FY2024_a.csv", f"{tmp_path}/FY2025_b.csv"], pinned=schema).columns
    with pytest.raises(FileNotFoundError):
        files.scan_glob(spark, f"{tmp_path}/none*.csv")
    assert files.label_of(["FY2024_a.csv", "FY2025_b.csv"]) == "FY2024_FY2025" and files.label_of(["a.csv", "b.csv"]) == "all_sources"
    files.write_csv(got, f"{tmp_path}/out", single=True)
    assert files.query_file(spark, f"{tmp_path}/FY2024_a.csv", "select count(*) from file").first()[0] == 2
    house = tables.Warehouse(spark, str(tmp_path / "house"))
    house.save(got, "t", "cache", view=True)
    house.save(house.read("t", "cache").where("key > '007'"), "t", "cache")
    assert house.read("t", "cache").count() == 2 and not house.exists("t") and house.vacuum("t", "cache") >= 1 and house.read("t", "cache").count() == 2
    (tmp_path / "c.csv").write_text('key,money,extra\n1,2.5,x\n2,bad,y\n3,"4\n4,5,6,7\n')
    good, bad = files.scan_checked(spark, [f"{tmp_path}/c.csv"], T.StructType(schema.fields[:2]), {"money": bad_rows.plain_number})
    assert rows(good, "key", "money") == [("1", 2.5)] and rows(bad, "raw_record", "reason") == sorted([("2,bad,y", "invalid_value"), ('3,"4', "quoting"), ("4,5,6,7", "column_count")], key=repr)
    tables.backup(house, ["t", "none"], "cache", str(tmp_path / "backup"))
    house.drop("t", "cache")
    assert tables.restore(house, "t", "cache", str(tmp_path / "backup"), ["key"], ["money"]).count() == 2
    codes = spark.createDataFrame([("B", "01/01/49", "open"), ("A", "01/01/50", "old"), ("A", "", "first"), ("A", None, "second"), (" ", "", "no")], "code string, stop string, name string")
    assert rows(files.service_codes(spark, codes.coalesce(1), "code", "stop", "2024-01-01", ["name"])) == [("A", "first"), ("B", "open")]


def test_pages(spark):
    page = """<td class="detail-left-col">Legal Business Name</td><td class="detail-right-col">TEST CORP</td>
    <div id="detail_topsection"><label>CAGE</label><span>12345</span><label>CAGE Update Date</label><span>01/15/2023</span></div><div id="ownership">%s</div>"""
    block = '<div class="subsection_header">%s</div><div class="data">%s</div>'
    parent = "<label>Company Name</label><span>A &amp; B</span><label>CAGE</label><span>67890</span><label>CAGE Last Updated</label><span>02/20/2023</span>"
    none = "<p>Information not Available</p>"
    r = html_pages.read_details(page % (block % ("Highest Level Owner", parent)))
    assert (r["cage_business_name"], r["cage_code"], r["cage_update_date"], r["is_highest"], r["highest_level_owner_name"], r["highest_level_cage_code"], r["highest_level_cage_update_date"]) == ("TEST CORP", "12345", "2023-01-15", False, "A & B", "67890", "2023-02-20")
    r = html_pages.read_details(page % (block % ("Highest Level Owner", none) + block % ("Immediate Owner", parent)))
    assert (r["is_highest"], r["immediate_level_owner"], r["highest_level_owner_name"]) == (False, True, "A & B")
    r = html_pages.read_details(page % (block % ("Highest Level Owner", none) + block % ("Immediate Owner", none)))
    assert (r["is_highest"], r["immediate_level_owner"], r["highest_level_owner_name"]) == (True, False, "TEST CORP")
    df = spark.createDataFrame([(page % "", "u"), (None, "u"), ("<a href='/Search/Details?id=1&amp;b=2'>Details</a>", "x/Agree")], "h string, u string")
    got = df.select(html_pages.parse_details(F.col("h")).alias("p"), html_pages.details_link(F.col("h")).alias("l"), html_pages.needs_login(F.col("u"), F.col("h")).alias("n")).collect()
    assert got[0].p.cage_code == "12345" and got[1].p.cage_code is None and got[2].l == "/Search/Details?id=1&b=2" and [r.n for r in got] == [False, True, True]


def test_providers(spark, rows):
    bars = spark.createDataFrame([("A/B", date(2024, 1, n), float(n)) for n in range(1, 6)], "ticker string, date date, close_adj double")
    want = spark.createDataFrame([("A/B", date(2024, 1, 2), date(2024, 1, 3)), ("A-B", date(2024, 1, 3), date(2024, 1, 4))], "ticker string, start date, end date")
    p = providers.TableReturns(bars)
    assert p.fetch_daily_bars(want).count() == 3 and p.fetch_benchmark("A-B", "2024-01-01", "2024-01-02").count() == 2
    found = spark.createDataFrame([("Acme Inc", "MSFT", "US"), ("ACME, INCORPORATED", "MSF", "US"), ("Acme Inc", "1446752D", "US"), ("x", "", "US")], "name string, ticker string, exchange string")
    owners = spark.createDataFrame([("acme inc.",), ("Other",)], "owner string")
    assert rows(providers.resolve_tickers(owners, found), "owner", "ticker") == [("Other", None), ("acme inc.", "MSF")]


def test_reports(spark):
    df = spark.createDataFrame([("a|<b>", 1.23456, None)], "name string, v double, n int")
    page, text = render.report("T", [("One", df), ("None", df.limit(0))])
    assert "a|&lt;b&gt;" in page and "a\\|<b>" in text and "no rows" in text and "1.235" in text
    assert render.bar_chart(["a", "b"], [1.0, None], [0.1, None]).startswith("<svg") and render.line_chart([]).startswith("<svg")
    assert "rgba" in render.heat_map(["r"], ["c", "d"], {("r", "c"): 0.5, ("r", "d"): None})


def test_stream(spark, tmp_path, rows):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])
    (tmp_path / "in").mkdir()
    house = tables.Warehouse(spark, str(tmp_path / "house"))

    def run():
        incremental.append_new_keys(incremental.stream_csv(spark, str(tmp_path / "in"), schema), house, "t", ["k"], ["v"], str(tmp_path / "check")).awaitTermination(60)

    (tmp_path / "in/1.csv").write_text("k,v\na,2\na,1\nb,5\n")
    run()
    (tmp_path / "in/2.csv").write_text("k,v\na,0\nc,7\n")
    run()
    assert rows(house.read("t")) == [("a", 1), ("b", 5), ("c", 7)]


def test_negative_caching(spark, rows):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("a",)], "owner string")
    cache = spark.createDataFrame([("b", None, "not_found")], "owner string, ticker string, status string")
    answers = spark.createDataFrame([("a", "AAA"), ("a", "AAB"), ("b", "BBB")], "owner string, ticker string")
    assert rows(state.settle(wanted, cache, answers, ["owner"]), "owner", "ticker", "status") == [("a", "AAB", "success"), ("c", None, "not_found")]


def test_all_phases_give_the_columns_of_the_contract(spark, small):
    from tidemark import schemas
    from tidemark.plans import event_tables, relational_queries

    out = phases.run(event_tables.raw(spark, small), **relational_queries.caches(spark, small), least_total=1e6)
    assert out.columns == schemas.SIGNALLED and len(schemas.SIGNALLED) == 69 and len(schemas.THEMED) == 49 and len(schemas.ENRICHED) == 43
    kinds = dict(out.dtypes)
    assert kinds["theme_llm"] == kinds["ticker"] == "string" and kinds["is_public"] == "boolean" and kinds["market_cap"] == "double"
    assert spark.range(1).select(*[phases.sole_source(F.lit(v).cast("double")) for v in (1.0, 2.0, 0.0, None)]).first() == (True, False, None, None)


def test_composed_report(spark, small):
    from tidemark.plans import analytics_queries, reports

    page, text = reports.compose("R", [reports.VALIDATION[0], ("All", analytics_queries.ic_overall)], spark, small, ["<svg/>"])
    assert "## Signal coverage" in text and "moat_index" in page and "| p |" in text and page.endswith("<svg/>")
    names = [n for n, _ in (*reports.VALIDATION, *reports.BACKTEST)]
    assert len(names) == len(set(names)) == 20
