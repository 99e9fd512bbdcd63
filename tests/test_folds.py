from datetime import date

from couponflow.functions.cleaning import clean_offline
from couponflow.operators.folds import (
    FOLDS_2016,
    PREDICT_FROM_2016,
    history_rows,
    label_rows,
    scoring_history,
    sliding_folds,
)
from couponflow.sources import schemas


def events(spark, *rows):
    full = [(i, 1, c, "30:5" if c else None, 1, r, d) for i, (c, r, d) in enumerate(rows)]
    return clean_offline(spark.createDataFrame(full, schemas.OFFLINE))


def found(df):
    return sorted((r.fold, r.user_id) for r in df.collect())


def test_label_windows_are_closed(spark):
    df = events(
        spark,
        (1, date(2016, 4, 15), None),
        (1, date(2016, 4, 16), None),
        (1, date(2016, 5, 15), None),
        (1, date(2016, 5, 16), None),
        (1, date(2016, 6, 30), None),
        (None, None, date(2016, 5, 1)),
    )
    assert found(label_rows(df, FOLDS_2016)) == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_history_takes_receipts_and_purchases_once(spark):
    df = events(
        spark,
        (1, date(2016, 3, 31), None),
        (1, date(2016, 4, 1), None),
        (None, None, date(2016, 4, 15)),
        (None, None, date(2016, 5, 16)),
        (1, date(2016, 1, 31), date(2016, 3, 1)),
    )
    assert found(history_rows(df, FOLDS_2016)) == [(1, 0), (1, 2), (1, 4), (2, 0), (2, 1), (2, 2)]


def test_compatible_history_repeats_purchases(spark):
    df = events(spark, (None, None, date(2016, 4, 15)), (None, None, date(2016, 5, 16)))
    assert found(history_rows(df, FOLDS_2016, compat_sentinel=True)) == [
        (1, 0),
        (1, 0),
        (1, 1),
        (2, 0),
    ]


def test_scoring_history(spark):
    df = events(
        spark,
        (1, date(2016, 3, 16), date(2016, 3, 20)),
        (1, date(2016, 3, 1), date(2016, 3, 20)),
        (None, None, date(2016, 3, 20)),
        (None, None, date(2016, 3, 15)),
    )
    assert sorted(r.user_id for r in scoring_history(df, PREDICT_FROM_2016).collect()) == [0, 2]


def test_sliding_folds():
    made = sliding_folds(date(2016, 4, 1), date(2016, 6, 30), 15, 30, 15, 90)
    assert [f.label_from for f in made] == [
        date(2016, 4, 1),
        date(2016, 4, 16),
        date(2016, 5, 1),
        date(2016, 5, 16),
        date(2016, 5, 31),
    ]
    first = made[0]
    assert (first.label_to, first.recv_to, first.buy_to) == (
        date(2016, 4, 30),
        date(2016, 3, 16),
        date(2016, 3, 31),
    )
    assert first.recv_from == first.buy_from == date(2016, 1, 2)
