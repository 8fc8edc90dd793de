"""Queries on tables of a few rows, against what the whole table gives."""

from datetime import date, datetime

import pytest

import __spark_entry__ as entry
from tidemark.plans import relational_queries


@pytest.fixture
def put(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_market_cap_uses_all_share_counts_and_tickers(spark, put, rows):
    day = date(2023, 11, 10)
    events = [("k1", "AAA", day), ("k2", "XYZ", day), ("k3", "NON", day), ("k4", "BAR", day), ("k5", "OLD", day)]
    put("enriched_awards", events, "contract_transaction_unique_key string, ticker string, action_date date")
    bars = [(t, date(2023, 11, 9), 10.0, datetime(2024, 1, 1)) for t in ("AAA", "XYZ", "NON", "OLD")] + [("BAR", date(2023, 6, 1), 10.0, datetime(2024, 1, 1))]
    put("cache_returns", bars, "ticker string, date date, close_adj double, fetched_at timestamp")
    counts = [
        ("AAA", date(2023, 6, 30), 5.0, "success"), ("AAA", date(2023, 9, 30), 7.0, "success"), ("AAA", date(2023, 11, 1), None, "success"), ("AAA", date(2023, 11, 2), 99.0, "failed"),
        ("XYZ", date(2023, 1, 31), 3.0, "success"), ("BAR", date(2023, 10, 1), 4.0, "success"), ("OLD", date(2022, 12, 1), 0.0, "success"),
    ]
    d = put("cache_market_cap", counts, "ticker string, date date, shares_outstanding double, status string")
    got = rows(entry.queries()["pit_market_cap"](spark, d), "contract_transaction_unique_key", "shares_outstanding", "market_cap", "market_cap_quality")
    assert got == [("k1", 7.0, 70.0, "ok"), ("k2", 3.0, 30.0, "stale_shares"), ("k3", None, None, "no_shares"), ("k4", None, None, "no_close"), ("k5", None, None, "no_shares")]


def test_all_eligible_rows_in_order_and_an_optional_limit(spark, put):
    events = [(f"k{i:04}", "ZZZ" if i % 2 else "AAA", date(2023, 1, 1), True, float(i)) for i in range(1203)] + [("x", "AAA", date(2023, 1, 1), False, 1.0), ("y", None, date(2023, 1, 1), True, 1.0), ("z", "AAA", date(2023, 1, 1), True, None)]
    d = put("enriched_awards", events + events[:5], "contract_transaction_unique_key string, ticker string, action_date date, is_public boolean, market_cap double")
    want = sorted((e[1], e[2], e[0], e[4]) for e in events[:1203])
    assert [tuple(r) for r in entry.queries()["eligible_order_limit"](spark, d).collect()] == want
    assert [tuple(r) for r in relational_queries.eligible_order_limit(spark, d, 7).collect()] == want[:7]


def test_upsert_into_all_customers(spark, put, rows):
    put("customer", [(i, float(i), f"s{i}") for i in range(1, 8)], "c_custkey int, c_acctbal double, c_mktsegment string")
    orders = [(3, 30.0, "P"), (3, 31.0, "P"), (4, 40.0, "P"), (5, 50.0, "O"), (9, 90.0, "P")]
    d = put("orders", orders, "o_custkey int, o_totalprice double, o_orderstatus string")
    got = rows(entry.queries()["upsert_merge"](spark, d), "c_custkey", "c_acctbal", "c_mktsegment")
    assert got == [(1, 1.0, "s1"), (2, 2.0, "s2"), (3, 31.0, "s3"), (4, 40.0, "s4"), (5, 5.0, "s5"), (6, 6.0, "s6"), (7, 7.0, "s7"), (9, 90.0, None)]


def test_pages_of_all_rows(spark, put, rows):
    day, s = date(2023, 2, 3), "2023-02-03"
    data = [
        ("a", "A & <B>", "C1", day, "Own  &  Co ", "C2"), ("b", "Biz  & <Co", "C1", day, None, None), ("c", "Biz", None, day, "Own", "C2"),
        ("d", "Biz", "C1", None, "Own", "C2"), ("e", "Biz", "C1", day, "Own", None), ("f", "Biz", "C1", day, None, "C2"), ("g", None, None, None, None, None),
    ]
    d = put("enriched_awards", data, "contract_transaction_unique_key string, cage_business_name string, cage_code string, cage_update_date date, highest_level_owner_name string, highest_level_cage_code string")
    got = rows(entry.queries()["html_detail_parse"](spark, d), "contract_transaction_unique_key", "cage_code", "cage_update_date", "is_highest", "owner", "owner_code")
    assert got == [
        ("a", "C1", s, False, "Own & Co", "C2"), ("b", "C1", s, True, "Biz & <Co", "C1"), ("c", "", s, False, "Own", "C2"),
        ("d", "C1", "", False, "Own", "C2"), ("e", "C1", s, False, "Own", "C1"), ("f", "C1", s, False, "Biz", "C2"), ("g", "", "", True, "", ""),
    ]
