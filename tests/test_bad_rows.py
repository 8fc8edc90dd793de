import csv
import io
import os
import random
import re
from datetime import date

import pytest
from pyspark.sql import types as T

from tidemark.operators import bad_rows as b

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("money", T.DoubleType()), T.StructField("day", T.DateType())])
CHECKS = {"key": b.key_parts(2), "money": b.plain_number, "day": b.real_day}


def judge(spark, records):
    df = spark.createDataFrame(list(enumerate(records)), "id long, raw string")
    return {r.id: (r.reason, r.row) for r in b.parse_records(df, "raw", SCHEMA, CHECKS).collect()}


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        ("a_b,1.5,2024-02-29", None),
        ('"a_b","1","2024-01-01"', None),
        ("a_b,,2024-01-01\n", None),
        ("a_b, 2e3 ,2024-01-01", None),
        ("a_b,1,2023-02-29", "invalid_value"),
        ("a_b,1,2023-2-9", "invalid_value"),
        ("a_b,1,", "invalid_value"),
        ("a_b,1D,2024-01-01", "invalid_value"),
        ("a_b,NaN,2024-01-01", "invalid_value"),
        ("a_b,1٣,2024-01-01", "invalid_value"),
        ("a_,1,2024-01-01", "invalid_value"),
        (",1,2024-01-01", "invalid_value"),
        ("a_b,1", "column_count"),
        ("a_b,1,2024-01-01,", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ('a_b,"1,2024-01-01', "quoting"),
        ('a_b,1"0,2024-01-01', "quoting"),
        ('a_b,"1" x,2024-01-01', "quoting"),
        ('a_b,"1"",2024-01-01', "quoting"),
        ("a_b,1,2024-01-01\na_b,1,2024-01-01", "quoting"),
        ('"', "quoting"),
        ('""', "column_count"),
    ],
)
def test_reasons(spark, record, reason):
    assert judge(spark, [record])[0][0] == reason


def test_typed_values_and_quotes_inside(spark):
    got = judge(spark, ['"a_b",-1.5e1,2024-03-01', '"a_b\n",1,2024-03-01'])
    assert tuple(got[0][1]) == ("a_b", -15.0, date(2024, 3, 1))
    assert got[1][0] == "invalid_value"  # a line break inside of quotes is read, but the key may not hold it


def test_against_a_csv_reader_on_random_texts(spark):
    rng = random.Random(3)
    records = ["".join(rng.choice('ab,"\n_1') for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    got = judge(spark, records)
    field = r'(?:[^",\r\n]*|"(?:[^"]|"")*")'
    for i, r in enumerate(records):
        body = r[:-1] if r.endswith("\n") else r
        if not body:
            want = "column_count"
        elif not re.fullmatch(rf"{field}(?:,{field})*", body):
            want = "quoting"
        else:
            n = len(next(csv.reader(io.StringIO(body, newline=""))))
            want = "column_count" if n != 3 else "invalid_value"
        assert got[i][0] == want, r


def test_long_wide_and_clashing(spark):
    records = ["a_b,1,2024-01-01" + "," * 30000, 'a_b,"' + '""' * 200000 + '",2024-01-01', "x" * 1000000]
    assert [judge(spark, records)[i][0] for i in range(3)] == ["column_count", "invalid_value", "column_count"]
    df = spark.createDataFrame([("a_b,1,2024-01-01", "old", 5), ("x", "old", 6)], "raw string, reason string, KEY long")
    good, bad = b.split_records(df, "raw", SCHEMA, CHECKS)
    assert [tuple(r) for r in good.collect()] == [("a_b", 1.0, date(2024, 1, 1))]
    assert [tuple(r) for r in bad.collect()] == [("x", 6, "column_count")]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "raw string, note string")
    good, bad = b.split_records(df, "raw", SCHEMA, CHECKS)
    assert good.count() == bad.count() == 0
    twice = spark.createDataFrame([("bad",), ("bad",)], "raw string")
    assert b.split_records(twice, "raw", SCHEMA, CHECKS)[1].count() == 2


def test_a_schema_of_any_width(spark):
    """No bound on the number of fields: a good record is usable and whole.

    With TIDEMARK_SLOW set it has 20,001 fields, which takes Spark's analysis three minutes.
    """
    n = 20_001 if os.environ.get("TIDEMARK_SLOW") else 2_001
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
    rows = [(1, ",".join(f"v{i}" for i in range(n))), (2, ",".join("x" * (n + 1))), (3, '"' + ",".join("x" * n)), (4, ",".join(['"a,b"'] * n))]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = b.parse_records(df, "raw", schema, {}).select("id", "reason", "row.c0", f"row.c{n - 1}").collect()
    assert [tuple(r) for r in got] == [(1, None, "v0", f"v{n - 1}"), (2, "column_count", None, None), (3, "quoting", None, None), (4, None, "a,b", "a,b")]
