"""Statistics merged from panes equal those of the history rows."""

import random
from datetime import date, timedelta

import pytest

from couponflow.functions.cleaning import clean_offline
from couponflow.operators.folds import Fold, history_rows, sliding_folds
from couponflow.plans import history as past
from couponflow.plans import panes
from couponflow.sources.schemas import OFFLINE

TEN = sliding_folds(date(2016, 3, 1), date(2016, 12, 31), 20, 30, 15, 60)[:10]


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(5)
    first, rows = date(2016, 1, 1), []
    for n in range(3000):
        user = 1 if n % 3 == 0 else draw.randint(2, 40)
        day = first + timedelta(draw.randint(0, 300))
        used = draw.choice([None, day + timedelta(draw.randint(0, 40))])
        text = draw.choice(["30:5", "0.9", "100:20", None])
        coupon = draw.choice([None, 11, 12, 13, 14])
        if coupon is None:
            rows.append((user, draw.randint(1, 9), None, None, draw.choice([None, 3]), None, day))
        else:
            rows.append((user, draw.randint(1, 9), coupon, text, draw.choice([None, 0, 10]), day, used))
    # Odd rows: nothing but keys; a receipt date without a coupon; both dates missing.
    rows += [(5, 1, None, None, None, None, None), (5, 1, None, None, None, date(2016, 4, 1), date(2016, 4, 2)), (6, 2, 11, "0.9", 1, None, None)]
    rows += rows[:50]
    return clean_offline(spark.createDataFrame(rows, OFFLINE)).cache()


def table(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(found, expected):
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    assert table(found, columns) == table(expected, columns)


@pytest.mark.parametrize("keys", [["user_id"], ["merchant_id"], ["user_id", "merchant_id"], ["coupon_id"], ["discount_rate_text"]])
def test_ten_windows(events, keys):
    assert len(TEN) == 10
    history = history_rows(events, TEN)
    same(panes.merge(panes.panes(panes.dated(events), keys), TEN, keys), past.stats(history, ["fold", *keys]))


def test_open_windows_with_different_starts(events):
    folds = [Fold(1, None, None, None, date(2016, 5, 1), date(2016, 2, 1), None), Fold(2, None, None, date(2016, 6, 1), None, None, date(2016, 3, 1))]
    history = history_rows(events, folds)
    same(panes.merge(panes.panes(panes.dated(events), ["user_id"]), folds, ["user_id"]), past.stats(history, ["fold", "user_id"]))


@pytest.mark.parametrize("rows_per_task", [10**6, 300])
def test_features_of_ten_windows(events, rows_per_task):
    """Also with a user who has a third of all rows and is too large for a bucket."""
    history = history_rows(events, TEN)
    pairs, coupons = past.user_merchant_counts(history), past.user_coupon_counts(history)
    sliding = panes.SlidingHistory(events, TEN, rows_per_task)
    assert len(sliding.groups) == (2 if rows_per_task == 300 else 1)
    same(sliding.users(), past.user_features(history, pairs, coupons))
    same(sliding.merchants(), past.merchant_features(history, pairs, past.merchant_coupon_counts(history)))
    same(sliding.coupons(), past.coupon_features(history))
    same(sliding.user_merchants(), past.user_merchant_features(pairs))


def test_events_are_aggregated_before_windows_repeat_them(events):
    """The plan reads events once and repeats only panes."""
    plan = panes.merge(panes.panes(panes.dated(events), ["merchant_id"]), TEN, ["merchant_id"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in text.splitlines() if "Generate explode" in line]
    assert len(generates) == 1
    assert text.index("Generate explode") < text.index("kind#", text.index("Aggregate", text.index("Generate explode")))


def test_no_events(spark):
    none = clean_offline(spark.createDataFrame([], OFFLINE))
    sliding = panes.SlidingHistory(none, TEN)
    assert sliding.users().count() == sliding.merchants().count() == 0
