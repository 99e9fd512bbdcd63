"""Hand-made rows for every scalar edge case."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from couponflow.functions import dates, discount
from couponflow.functions.basic import mean_gap, ratio, some
from couponflow.functions.cleaning import clean_offline, clean_online
from couponflow.sources import schemas


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "discount_rate_text string")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_discount_split_and_rate(spark):
    df = texts(spark, "150:20", "0.9", None, "fixed")
    assert column(df, discount.spend()) == [150, None, None, None]
    assert column(df, discount.off()) == [20, None, None, None]
    assert column(df, F.round(discount.paid_share(), 6)) == [0.866667, 0.9, None, None]
    assert column(df, discount.online_paid_share())[3] == 0.0


def test_alternative_discount(spark):
    df = texts(spark, "150:20", "0.9", None, "fixed")
    assert column(df, F.round(discount.alt_paid_share(), 6)) == [0.866667, 0.0, 1.0, 0.0]
    assert column(df, discount.alt_spend()) == [150, 0, 0, 0]
    assert column(df, discount.alt_off()) == [20, 0, 0, 0]
    assert column(df, discount.alt_class()) == [1, 0, None, 0]


def test_discount_type_and_kind(spark):
    df = texts(spark, "0.2", "100:1", "7:1", None)
    assert column(df, discount.type_code()) == [0, 45, -1, -1]
    assert column(df, discount.is_threshold()) == [False, True, True, False]
    assert column(df, discount.is_decimal()) == [True, False, False, False]
    assert len(discount.DISCOUNT_TYPES) == 46


def test_bins(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (0.85,), (0.95,)], "r double")
    assert column(df, discount.bin_of(F.col("r"), (0.6, 0.7, 0.8, 0.9))) == [0, 1, 3, 4]


def test_labels(spark):
    day = date(2016, 5, 1)
    df = spark.createDataFrame(
        [(day, date(2016, 5, 16)), (day, date(2016, 5, 17)), (day, None), (None, day)],
        "date_received date, date date",
    )
    assert column(df, dates.redeemed_in_time()) == [1, 0, 0, 0]
    assert column(df, dates.three_way_label()) == [1, 0, 0, -1]


def test_weekdays(spark):
    days = [date(2016, 4, 29), date(2016, 5, 28), date(2016, 6, 13), None]
    df = spark.createDataFrame([(d,) for d in days], "date_received date")
    assert column(df, dates.weekday0()) == [4, 5, 0, None]
    assert column(df, dates.weekday1()) == [5, 6, 1, None]
    assert column(df, dates.is_weekend()) == [0, 1, 0, 0]
    flags = [tuple(r) for r in df.select(*dates.weekday_flags()).collect()]
    assert [f.index(1) + 1 if 1 in f else None for f in flags] == [5, 6, 1, None]


def test_null_algebra(spark):
    df = spark.createDataFrame([(0, 2, 0), (3, 0, 4)], "a int, b int, c int")
    assert column(df, some("a")) == [None, 3]
    assert column(df, ratio("a", "b")) == [0.0, None]
    assert column(df, ratio(some("a"), "b")) == [None, None]


@pytest.mark.parametrize("n, expected", [(1, None), (3, 5.0)])
def test_span(spark, n, expected):
    df = spark.createDataFrame(
        [(date(2016, 1, 1), date(2016, 1, 1 if n == 1 else 11), n)], "a date, b date, n int"
    )
    assert column(df, mean_gap("a", "b", "n")) == [expected]


def test_cleaning(spark):
    offline = spark.createDataFrame([(1, 2, None, None, None, None, None)], schemas.OFFLINE)
    row = clean_offline(offline).first()
    assert (row.coupon_id, row.distance, row.discount_rate, row.date) == (0, 11, None, None)
    online = spark.createDataFrame(
        [(1, 2, 1, "fixed", "fixed", None, None), (1, 2, 0, None, None, None, None)],
        schemas.ONLINE,
    )
    assert [(r.coupon_id, r.discount_rate) for r in clean_online(online).collect()] == [
        ("fixed", 0.0),
        ("0", None),
    ]
