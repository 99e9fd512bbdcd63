"""Assembly of the feature matrix for training folds and for a batch to score.

Store events are written once in buckets by user. The label rows, the history aggregates of
every grain that includes the user, and their joins then run bucket by bucket without another
shuffle. Merchant, coupon and discount features are joined on the much smaller table of
distinct (merchant, coupon, discount, day) items first and reach the rows in one last join.
Users too big for a bucket are kept out of it and take the same steps through shuffles on the
finer keys, with hot keys spread over several tasks. Spark itself broadcasts feature tables
that it measures to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponflow.functions import dates, discount
from couponflow.functions.basic import ratio, zero_if_missing
from couponflow.functions.cleaning import clean_offline, clean_online
from couponflow.operators.folds import Fold, history_rows, label_rows, scoring_history
from couponflow.operators.spread import ROWS_PER_TASK, HotKeys, UserLayout, attach, with_row_ids
from couponflow.plans import batch as in_batch
from couponflow.plans import history as past
from couponflow.plans import online as web
from couponflow.session import CO_LOCATED, settings, stage, stage_by_key

RAW = [
    "user_id",
    "merchant_id",
    "coupon_id",
    "discount_rate_text",
    "distance",
    "date_received",
]
NOT_INPUTS = ["user_id", "merchant_id", "discount_rate_text", "date_received"]
NOT_INPUTS += ["discount_rate_x", "discount_rate_y"]
ITEM_TEXT = "_text"
ITEM = ["fold", "merchant_id", "coupon_id", ITEM_TEXT, "date_received"]
BATCH_COLUMNS = ["m5", "m6", "c5", *[f"o{n}" for n in range(1, 19)]]


def labelled_rows(
    offline: DataFrame, folds: Sequence[Fold], rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Receipts of the label windows with their label and a ``row_id``."""
    rows = label_rows(offline, folds)
    numbered = with_row_ids(rows, ["fold", *RAW, "date"], rows_per_task)
    return numbered.withColumns(
        {
            "discount_rate_x": discount.spend(),
            "discount_rate_y": discount.off(),
            "discount_rate": discount.paid_share(),
            "label": dates.redeemed_in_time(),
        }
    )


def row_features(rows: DataFrame) -> DataFrame:
    """weekday, day, discount_type and c6, which need the row alone."""
    return rows.withColumns(
        {
            "weekday": dates.weekday0(),
            "day": F.dayofmonth("date_received"),
            "discount_type": discount.type_code(),
            "c6": discount.is_threshold().cast("int"),
        }
    )


@dataclass(frozen=True)
class UserGroup:
    """Tables of one group of users: all usual users (in buckets), or all hot ones.

    ``batch`` is the whole batch that the in-batch features describe; ``rows`` is the batch or
    its distinct rows.
    """

    rows: DataFrame
    batch: DataFrame
    history: DataFrame
    web_history: DataFrame
    pairs: DataFrame
    buckets: int | None  # None for the hot users, who have no buckets
    hot: HotKeys | None


def user_side(group: UserGroup) -> DataFrame:
    """Rows with the features of every grain that includes the user."""
    rows, history, batch = group.rows, group.history, group.batch
    spread_by = [c for c in rows.columns if c not in ("label", "discount_rate")]

    def add(left: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
        hot = group.hot.of(keys) if group.hot else None
        return attach(left, features, keys, hot, spread_by)

    user_coupon = past.user_coupon_counts(history)
    batch_pairs = in_batch.user_merchant(batch)
    batch_user_coupon = in_batch.user_coupon(batch)
    web_users = web.user_features(group.web_history)
    if group.buckets is not None:
        web_users = web_users.repartition(group.buckets, "user_id")
    users = (
        in_batch.user(batch_pairs, batch_user_coupon)
        .join(past.user_features(history, group.pairs, user_coupon), past.USER, "left")
        .join(web_users, past.USER, "left")
    )
    user_coupons = batch_user_coupon.join(
        past.user_coupon_features(user_coupon), past.USER_COUPON, "left"
    )
    pairs = batch_pairs.drop("first", "last").join(
        past.user_merchant_features(group.pairs), past.USER_MERCHANT, "left"
    )
    # History of other days cannot match; there are only as many batch days as calendar days.
    days = F.broadcast(rows.select("fold", "date_received").distinct())
    same_days = history.join(days, ["fold", "date_received"], "left_semi")

    # Wider keys come before their own prefix: in buckets, a prefix needs no second sort.
    out = row_features(rows)
    out = add(out, past.user_merchant_day_features(same_days), past.USER_MERCHANT_DAY)
    out = add(out, pairs, past.USER_MERCHANT)
    out = add(out, in_batch.user_coupon_day(batch), in_batch.USER_COUPON_DAY)
    out = add(out, user_coupons, past.USER_COUPON)
    out = add(out, past.user_discount_features(history), past.USER_DISCOUNT)
    out = add(out, in_batch.user_day(batch), in_batch.USER_DAY)
    out = add(out, users, past.USER)
    return past.fill_after_join(out).withColumns(
        {
            "u33": ratio("u32", "u47"),
            "u34": ratio("u2", "u47"),
            "um5": ratio("um2", "u3"),
            **web.offline_share(),
        }
    )


def _finished_user_side(group: UserGroup) -> DataFrame:
    """Written, which ends the long plan."""
    local = CO_LOCATED if group.buckets is not None else {}
    with settings(group.rows.sparkSession, local):
        return stage(user_side(group), "user-side")


def assemble(groups: Sequence[UserGroup], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All features for the rows of all user groups."""
    rows = _union(g.rows for g in groups).withColumn(ITEM_TEXT, _item_text())
    hot = HotKeys(rows, rows_per_task)
    items = item_features(groups, rows, rows_per_task)
    spread_by = [c for c in groups[0].rows.columns if c not in ("label", "discount_rate")]
    out = _union(_finished_user_side(g) for g in groups).withColumn(ITEM_TEXT, _item_text())
    hot_items = hot.of(ITEM) if hot.of(past.COUPON) is not None else None
    out = attach(out, items, ITEM, hot_items, spread_by).drop(ITEM_TEXT)
    return out.withColumn("m2", zero_if_missing("m2"))


def item_features(groups: Sequence[UserGroup], rows: DataFrame, rows_per_task: int) -> DataFrame:
    """Merchant, coupon and discount features per distinct item of the batch."""
    items = stage(rows.select(*ITEM, "discount_rate_text").distinct(), "items")
    hot = HotKeys(items, rows_per_task)
    history, batch = _union(g.history for g in groups), _union(g.batch for g in groups)
    pairs = _union(g.pairs for g in groups)
    merchant_coupon = past.merchant_coupon_counts(history)
    batch_merchant_coupon = in_batch.merchant_coupon(batch)
    merchants = in_batch.merchant(in_batch.user_merchant(batch), batch_merchant_coupon).join(
        past.merchant_features(history, pairs, merchant_coupon), past.MERCHANT, "left"
    )
    tables = [
        (merchants, past.MERCHANT),
        (in_batch.merchant_day(batch), in_batch.MERCHANT_DAY),
        (batch_merchant_coupon, past.MERCHANT_COUPON),
        (past.coupon_features(history), past.COUPON),
        (in_batch.coupon_day(batch), in_batch.COUPON_DAY),
        (past.discount_features(history), past.DISCOUNT),
    ]
    for features, keys in tables:
        items = attach(items, features, keys, hot.of(keys), ITEM)
    return items.drop("discount_rate_text")


def feature_table(
    offline: DataFrame,
    online: DataFrame,
    folds: Sequence[Fold],
    compat_sentinel: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Input columns, label and all features for the receipts of all folds, in one pass."""
    layout = UserLayout.of(offline, rows_per_task)
    events, web_events = clean_offline(offline), clean_online(online)

    def group(events: DataFrame, web_events: DataFrame, hot: bool) -> UserGroup:
        store = _store(layout, hot)
        events = store(events, "offline")
        rows = store(labelled_rows(events, folds, rows_per_task if hot else None), "rows")
        history = history_rows(events, folds, compat_sentinel)
        web_history = history_rows(web_events, folds, compat_sentinel)
        return _group(layout, hot, rows, rows, history, web_history, rows_per_task)

    return assemble(_per_layout(layout, group, events, web_events), rows_per_task)


def scoring_table(
    batch: DataFrame,
    offline: DataFrame,
    online: DataFrame,
    start: date,
    until: date | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """All features for the distinct rows of a batch to score, as fold 0.

    Equal rows have equal features, so dropping repeats before the joins gives the same rows
    as dropping them afterwards; the in-batch features still count every row.
    """
    fold = F.lit(0).alias("fold")
    past_events = scoring_history(clean_offline(offline), start, until).select(fold, "*")
    web_events = scoring_history(clean_online(online), start, until).select(fold, "*")
    whole = clean_offline(batch).select(fold, "*")
    layout = UserLayout.of(
        whole.select("user_id").unionByName(past_events.select("user_id")), rows_per_task
    )

    def group(whole: DataFrame, events: DataFrame, web_events: DataFrame, hot: bool) -> UserGroup:
        store = _store(layout, hot)
        whole, events = store(whole, "batch"), store(events, "history")
        rows = store(whole.distinct(), "rows")
        return _group(layout, hot, rows, whole, events, web_events, rows_per_task)

    return assemble(_per_layout(layout, group, whole, past_events, web_events), rows_per_task)


def _per_layout(layout: UserLayout, group, *tables: DataFrame) -> list[UserGroup]:
    groups = [group(*[layout.usual(t) for t in tables], hot=False)]
    if layout.hot_users is not None:
        groups.append(group(*[layout.hot(t) for t in tables], hot=True))
    return groups


def _store(layout: UserLayout, hot: bool):
    if hot:
        return stage
    return lambda df, name: stage_by_key(df, name, "user_id", layout.buckets)


def _group(layout, hot, rows, batch, history, web_history, rows_per_task) -> UserGroup:
    pairs = _store(layout, hot)(past.user_merchant_counts(history), "user-merchant")
    return UserGroup(
        rows,
        batch,
        history,
        web_history,
        pairs,
        None if hot else layout.buckets,
        HotKeys(rows, rows_per_task) if hot else None,
    )


def _union(tables) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _item_text():
    """Discount text as a join key that matches where the text is missing, too."""
    return F.coalesce("discount_rate_text", F.lit(""))


def drop_columns(table: DataFrame, predict: bool = False) -> DataFrame:
    """Drop ids, dates and the raw discount; what is left is what a model may see.

    Training keeps the coupon (for the per-coupon metric); scoring drops it.
    """
    return table.drop(*NOT_INPUTS, "coupon_id" if predict else "date")


def fill_missing(table: DataFrame) -> DataFrame:
    """Every missing number becomes 0."""
    return table.fillna(0)


def training_matrix(table: DataFrame, include_batch_features: bool = True) -> DataFrame:
    """Model-ready matrix: ``fold``, ``row_id``, ``coupon_id``, ``label`` and the inputs."""
    kept = drop_columns(table)
    return fill_missing(kept if include_batch_features else kept.drop(*BATCH_COLUMNS))


def model_inputs(matrix: DataFrame) -> list[str]:
    """Input columns, in a stable order."""
    other = {"fold", "row_id", "coupon_id", "label", "user_id", "date_received"}
    return sorted(c for c in matrix.columns if c not in other)
