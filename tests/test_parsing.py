import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgrid.functions.parsing import (
    label_of,
    text_of,
    text_to_boolean,
    text_to_moment,
    text_to_number,
)
from quillgrid.functions.render import compact_number


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def run(spark, values, function):
    rows = texts(spark, values).select("i", function(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


NUMBERS = {
    "$1,234.56": 1234.56,
    " 42 ": 42.0,
    "15%": 15.0,
    "€999": 999.0,
    "₹1,00,000": 100000.0,
    "-3.5e2": -350.0,
    ".5": 0.5,
    "1.234,56": 1.23456,  # a decimal comma is misread on purpose
    "99,10": 9910.0,
    "1d": None,
    "0x1p3": None,
    "5%%": None,
    "abc": None,
    "": None,
    None: None,
}


def test_numbers(spark):
    assert run(spark, list(NUMBERS), text_to_number) == list(NUMBERS.values())


def test_decimal_comma_option(spark):
    read = run(spark, ["1.234,56", "99,10"], lambda c: text_to_number(c, decimal_comma=True))
    assert read == [1234.56, 99.1]


MOMENTS = {
    "2026-01-05": dt.datetime(2026, 1, 5),
    "2026-1-5 10:30:00": dt.datetime(2026, 1, 5, 10, 30),
    "2026-01-05T10:30:00Z": dt.datetime(2026, 1, 5, 10, 30),
    "2026.01.08": dt.datetime(2026, 1, 8),
    "02/03/2026": dt.datetime(2026, 2, 3),  # month first
    "13/02/2026": dt.datetime(2026, 2, 13),  # falls back to day first
    "Jan 6 2026": dt.datetime(2026, 1, 6),
    "January 6, 2026": dt.datetime(2026, 1, 6),
    "6 Feb 2026": dt.datetime(2026, 2, 6),
    "01/02/2024 3:45 PM": dt.datetime(2024, 1, 2, 15, 45),
    "13.02.2024 12:05:30.5 a.m.": dt.datetime(2024, 2, 13, 0, 5, 30, 500000),
    "2024-01-15 10:30 pm": dt.datetime(2024, 1, 15, 22, 30),
    "Jan 5, 2024, 12 PM": dt.datetime(2024, 1, 5, 12),
    "01/15/24": dt.datetime(2024, 1, 15),
    "15-1-99 08:15": dt.datetime(1999, 1, 15, 8, 15),
    "5-Mar-68": dt.datetime(2068, 3, 5),
    "Jan 2024": dt.datetime(2024, 1, 1),
    "September, 2024": dt.datetime(2024, 9, 1),
    "Mon, 15 Jan 2024": dt.datetime(2024, 1, 15),
    "Monday, January 15th, 2024 10:30:15": dt.datetime(2024, 1, 15, 10, 30, 15),
    "2024 Sept 3": dt.datetime(2024, 9, 3),
    "2024-Oct-03 07:00": dt.datetime(2024, 10, 3, 7),
    "marble 12, 2024": None,
    "01/02/2024 13:45 PM": None,
    "01/02/2024 3:75 PM": None,
    "room 15 PM": None,
    "10.0.0": None,
    "192.168.10.12": None,
    "2026-13-01": None,
    "31/31/2026": None,
    "Foo 6 2026": None,
    "12:30": None,
    "20260105": None,
    "garbage": None,
    None: None,
}


def test_moments(spark):
    assert run(spark, list(MOMENTS), text_to_moment) == list(MOMENTS.values())


def test_booleans(spark):
    values = ["Yes", " no", "TRUE", "f", "1", "0", "maybe", None]
    assert run(spark, values, text_to_boolean) == [True, False, True, False, True, False, None, None]


def test_display_text(spark):
    frame = spark.createDataFrame(
        [(12345678.9, True, None), (0.0005, False, "x"), (1.0, None, "y"), (float("nan"), None, "z")],
        "d double, b boolean, s string",
    )
    rows = frame.select(text_of(frame, "d"), text_of(frame, "b"), label_of(frame, "s")).collect()
    assert [tuple(r) for r in rows] == [
        ("12345678.9", "True", "(missing)"),
        ("0.0005", "False", "x"),
        ("1.0", None, "y"),
        (None, None, "z"),
    ]


@pytest.mark.parametrize(
    ("value", "tile", "fact"),
    [
        (2_345_678.0, "2.35M", "2.35M"),
        (12_340.0, "12.3K", "12.3K"),
        (4_321.0, "4,321", "4.3K"),
        (99.5, "99.50", "99.50"),
        (-1_500_000.0, "-1.50M", "-1.50M"),
    ],
)
def test_compact_numbers(spark, value, tile, fact):
    row = spark.range(1).select(
        compact_number(F.lit(value)), compact_number(F.lit(value), 1_000, None)
    ).first()
    assert tuple(row) == (tile, fact)
