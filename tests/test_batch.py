"""In-batch windows, on the printed three-receipt user, on ties, and against brute force."""

import random
from datetime import date, timedelta

from couponflow.operators.spread import attach
from couponflow.plans import batch as in_batch
from couponflow.plans import history as past

SCHEMA = "fold int, user_id long, merchant_id long, coupon_id long, date_received date"


def features(rows):
    pairs, coupons = in_batch.user_merchant(rows), in_batch.user_coupon(rows)
    out = attach(rows, in_batch.user_coupon_day(rows), in_batch.USER_COUPON_DAY)
    out = attach(out, in_batch.user_day(rows), in_batch.USER_DAY)
    return attach(out, in_batch.user(pairs, coupons), past.USER).collect()


def test_three_receipts(spark):
    rows = spark.createDataFrame(
        [
            (2, 1439408, 4663, 11002, date(2016, 5, 28)),
            (2, 1439408, 2632, 8591, date(2016, 6, 13)),
            (2, 1439408, 2632, 8591, date(2016, 5, 16)),
        ],
        SCHEMA,
    )
    found = {
        (r.date_received.month, r.date_received.day): (r.o17, r.o18, r.o3, r.o4, r.o5, r.o6)
        for r in features(rows)
    }
    assert found == {
        (5, 28): (12, 16, 1, 1, 0, 0),
        (6, 13): (16, -1, 2, 0, 1, 0),
        (5, 16): (-1, 12, 0, 2, 0, 1),
    }
    assert {(r.o7, r.o9, r.o12, r.o1) for r in features(rows)} == {(14.0, 2, 2, 3)}


def test_same_day_ties(spark):
    days = [date(2016, 5, d) for d in (10, 10, 12, 15)]
    rows = spark.createDataFrame([(1, 7, 1, 5, d) for d in days], SCHEMA)
    found = sorted((r.date_received.day, r.o3, r.o4, r.o17, r.o18) for r in features(rows))
    assert found == [(10, 0, 2, -1, 2), (10, 0, 2, -1, 2), (12, 2, 1, 2, 3), (15, 3, 0, 3, -1)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    raw = [
        (rng.randint(1, 2), rng.randint(1, 5), rng.randint(1, 3), rng.randint(1, 4),
         date(2016, 1, 1) + timedelta(rng.randint(0, 20)))
        for _ in range(200)
    ]
    for r in features(spark.createDataFrame(raw, SCHEMA)):
        mine = [x for x in raw if x[:2] == (r.fold, r.user_id)]
        before = [x for x in mine if x[4] < r.date_received]
        after = [x for x in mine if x[4] > r.date_received]
        assert (r.o3, r.o4) == (len(before), len(after))
        assert r.o5 == sum(x[3] == r.coupon_id for x in before)
        assert r.o6 == sum(x[3] == r.coupon_id for x in after)
        assert r.o17 == min(((r.date_received - x[4]).days for x in before), default=-1)
        assert r.o18 == min(((x[4] - r.date_received).days for x in after), default=-1)
        assert (r.o9, r.o12) == (len({x[2] for x in mine}), len({x[3] for x in mine}))
