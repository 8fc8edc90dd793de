"""Rows that fail to parse: typed rows and rejected rows out of raw CSV records.

The records are read permissively with ``from_csv`` under an explicit schema that
keeps the raw text of corrupt records. Spark's reader is lenient: it repairs some
broken quoting and accepts numbers such as ``12D`` or ``NaN``, so its verdict alone
is not enough. Every record is then classified again, with plain expressions and in
this order, by quoting, by field count and by checks of single fields:

``quoting``        not one record under RFC 4180 (comma, double quote, quotes doubled
                   inside quoted fields, line breaks only inside quotes; one line break
                   at the very end of the record is its terminator and allowed)
``column_count``   another number of fields than the schema has; a null record and an
                   empty one have no usable fields and count here
``invalid_value``  a field fails its check

No regular expression with nested repetition is used, so texts of any length work:
the record is cut at the quotes; pieces at odd places are quoted content, pieces at
even places are outside of quotes. One narrow stage, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"


def _without_terminator(raw: Column) -> Column:
    return F.when(raw.endswith("\r\n"), raw.substr(F.lit(1), F.length(raw) - 2)).when(
        raw.endswith("\n") | raw.endswith("\r"), raw.substr(F.lit(1), F.length(raw) - 1)
    ).otherwise(raw)


def _pieces(raw: Column) -> Column:
    return F.split(raw, '"', -1)


def quoting_ok(raw: Column) -> Column:
    """Whether ``raw`` is one record under RFC 4180; null stays null.

    Nothing in the functions over pieces refers to the text, which would be cut again for each piece.
    """
    pieces = _pieces(raw)
    n = F.size(pieces)
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    unbroken = lambda p: ~p.contains("\n") & ~p.contains("\r")
    # between two quoted stretches: a doubled quote, or a comma at either end
    between = lambda p: unbroken(p) & ((p == "") | (p.startswith(",") & p.endswith(",")))
    inner = F.slice(pieces, F.lit(2), F.greatest(n - 2, F.lit(0)))
    fine = F.forall(F.transform(inner, lambda p, i: (i % 2 == 0) | between(p)), lambda ok: ok)
    ends = unbroken(first) & unbroken(last) & ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(","))
    return F.when(~raw.contains('"'), unbroken(raw)).otherwise((n % 2 == 1) & ends & fine)


def field_count(raw: Column) -> Column:
    """Fields of a record whose quoting is right: commas outside of quotes, plus one."""
    commas = lambda c: F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    outside = F.aggregate(
        F.transform(_pieces(raw), lambda p, i: F.when(i % 2 == 0, commas(p)).otherwise(F.lit(0))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return F.when(~raw.contains('"'), commas(raw)).otherwise(outside) + 1


def plain_number(c: Column) -> Column:
    """Empty, or a plain ASCII decimal number; blanks around it are dropped."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")


def real_day(c: Column) -> Column:
    """A real day written YYYY-MM-DD."""
    c = F.coalesce(c, F.lit(""))
    shaped = c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~c.startswith("0000")
    return shaped & F.when(shaped, F.try_to_date(c, "yyyy-MM-dd")).isNotNull()


def key_parts(n: int) -> Callable[[Column], Column]:
    """``n`` non-empty parts joined by ``_``, each of ASCII letters, digits and ``-``."""
    return lambda c: F.coalesce(c, F.lit("")).rlike(rf"^[A-Za-z0-9-]+(_[A-Za-z0-9-]+){{{n - 1}}}\z")


def parse_records(
    df: DataFrame, raw: str, schema: T.StructType, checks: Mapping[str, Callable[[Column], Column]], reason: str = "reason", typed: str = "row"
) -> DataFrame:
    """``df`` with ``reason`` (null: usable) and ``typed``, the typed row (null: not usable).

    ``schema`` gives the fields in their order; ``checks`` gives for some of them a
    function of the field's text that says whether it is usable. Other fields that don't
    fit their type come out null. Columns of ``df`` called like the two outputs are replaced.
    """
    if raw.lower() in (reason.lower(), typed.lower()):
        raise ValueError("the raw column can't be called like an output")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (reason.lower(), typed.lower())])
    n = len(schema)
    corrupt = "_corrupt_record"
    names = [f"f{i}" for i in range(n)]
    text_schema = ", ".join(f"{x} string" for x in names) + f", {corrupt} string"
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "quote": '"', "escape": '"', "multiLine": "true",
        "maxColumns": str(n + 1), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    body = _without_terminator(F.col(raw))
    df = df.withColumn("__tm_body", body)
    shape = (
        F.when(F.col("__tm_body").isNull() | (F.col("__tm_body") == ""), F.lit(COLUMN_COUNT))
        .when(~quoting_ok(F.col("__tm_body")), F.lit(QUOTING)).when(field_count(F.col("__tm_body")) != n, F.lit(COLUMN_COUNT))
    )
    # generators keep what is costly below them from being evaluated again in filters and columns above
    once = lambda d, c, name: d.select("*", F.inline(F.array(F.struct(c.alias(name)))))
    df = once(df, shape, "__tm_shape")
    # only records of the right shape are parsed, so the parser's buffers need no more columns than the schema has
    df = once(df, F.from_csv(F.when(F.col("__tm_shape").isNull(), F.col("__tm_body")), text_schema, options), "__tm_text")
    field = {f.name: F.col(f"__tm_text.{x}") for f, x in zip(schema, names, strict=True)}
    bad_value = F.lit(False)
    for name, usable in checks.items():
        bad_value = bad_value | ~usable(field[name])
    why = (
        F.when(F.col("__tm_shape").isNotNull(), F.col("__tm_shape"))
        .when(F.col(f"__tm_text.{corrupt}").isNotNull(), F.lit(COLUMN_COUNT)).when(bad_value, F.lit(INVALID_VALUE))
    )

    def cast(f: T.StructField) -> Column:
        c = field[f.name]
        if isinstance(f.dataType, T.StringType):
            return c
        if isinstance(f.dataType, T.DateType):
            return F.when(real_day(c), F.try_to_date(c, "yyyy-MM-dd"))
        if isinstance(f.dataType, T.NumericType):
            return F.when(plain_number(c), F.trim(c).try_cast(f.dataType))
        return F.trim(c).try_cast(f.dataType)

    row = F.struct(*[cast(f).alias(f.name) for f in schema])
    return df.withColumn(reason, why).withColumn(typed, F.when(F.col(reason).isNull(), row)).drop("__tm_body", "__tm_shape", "__tm_text")


def split_records(df: DataFrame, raw: str, schema: T.StructType, checks: Mapping[str, Callable[[Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """(typed rows with the other columns of ``df``, rejected rows with ``reason``).

    Typed fields that share a name with a column of ``df`` replace it, as does ``reason``.
    """
    reason, row = "reason", "__tm_row"
    parsed = parse_records(df, raw, schema, checks, reason, row)
    fields = {x.lower() for x in schema.names} | {reason}
    keep = [f"`{c}`" for c in df.columns if c != raw and c.lower() not in fields]
    good = parsed.where(F.col(reason).isNull()).select(*keep, f"{row}.*")
    bad = parsed.where(F.col(reason).isNotNull()).select(*[f"`{c}`" for c in df.columns if c.lower() != reason], reason)
    return good, bad
