"""Oracles of scans, row-level columns, filters, joins and time windows."""

from __future__ import annotations

from oracles.base import (
    BATCH,
    CLEAN,
    FOLDS,
    IDENTIFIED,
    LABEL,
    OFFLINE,
    ONLINE,
    PREDICT_LABEL,
    WEB,
    columns,
    fraction,
    history,
    query,
    ratio,
)
from oracles.features import (
    IN_BATCH,
    KIND,
    MERCHANT,
    TYPE_CODE,
    USER,
    USER_MERCHANT,
)

EVENT = 'user_id, merchant_id, coupon_id, date_received, "date"'
ROW = "fold, user_id, merchant_id, coupon_id, date_received"


def raw(select: str) -> str:
    return query([OFFLINE], f"SELECT {select} FROM offline")


def cleaned(select: str) -> str:
    return query([OFFLINE, CLEAN], f"SELECT {select} FROM clean")


COLON = "coalesce(contains(discount_rate_text, ':'), false)"
MAN = f"CASE WHEN {COLON} THEN split_part(discount_rate_text, ':', 1)::INTEGER ELSE 0 END"
JIAN = f"CASE WHEN {COLON} THEN split_part(discount_rate_text, ':', 2)::INTEGER ELSE 0 END"
DAY_FLAGS = ", ".join(
    f"coalesce(isodow(date_received) = {n}, false)::INTEGER AS weekday_{n}" for n in range(1, 8)
)
WEEKEND = "coalesce(isodow(date_received) IN (6, 7), false)::INTEGER"

COMPAT = "\n  UNION ALL ".join(
    [
        # Open receipt window of fold 1: rows without a receipt date pass as 1970-01-01.
        f"""SELECT 1 AS fold, {EVENT} FROM clean
            WHERE coalesce(date_received, DATE '1970-01-01') <= DATE '1998-06-30'""",
        f"""SELECT 1, {EVENT} FROM clean WHERE coupon_id = 0
            AND coalesce("date", DATE '1970-01-01') <= DATE '1998-12-31'""",
        f"SELECT 2, {EVENT} FROM clean WHERE {FOLDS[1][2]}",
        f"SELECT 2, {EVENT} FROM clean WHERE coupon_id = 0 AND {FOLDS[1][3]}",
    ]
)

SLIDING_WINDOWS = """
windows AS (
  SELECT n::INTEGER + 1 AS fold, (DATE '1997-01-01' + (182 * n)::INTEGER) AS a,
         (DATE '1997-01-01' + (182 * n + 181)::INTEGER) AS b
  FROM range(20) t(n)
  WHERE DATE '1997-01-01' + (182 * n + 181)::INTEGER <= DATE '2001-07-31')"""

SCORED = """
scored AS (
  SELECT *, round(cheap * 0.65::DOUBLE + near * 0.35::DOUBLE, 6) AS score
  FROM (SELECT *, (11 - distance) / 11.0::DOUBLE AS near, 1 - discount_rate AS cheap
        FROM batch))"""
WITH_SCORE = [OFFLINE, CLEAN, BATCH, SCORED]

CODES = ["weekday", "day", "discount_type"]
ENCODED = f"""
encoded AS (
  SELECT {ROW}, (isodow(date_received) - 1)::INTEGER AS weekday,
         day(date_received)::INTEGER AS day, {TYPE_CODE} AS discount_type
  FROM batch)"""

SCALED_COLUMNS = ["distance", "discount_rate", "discount_rate_x", "discount_rate_y"]


def scaled(name: str) -> str:
    low, high = f"min({name}) OVER ()", f"max({name}) OVER ()"
    return (
        f"round(CASE WHEN {name} IS NULL THEN NULL WHEN {high} = {low} THEN 0 "
        f"ELSE ({name} - {low})::DOUBLE / ({high} - {low}) END::DOUBLE, 6) AS {name}"
    )


SQL = {
    "scan_offline": raw("*"),
    "scan_offline_batch": query(
        [OFFLINE], f'SELECT * EXCLUDE ("date") FROM offline WHERE {PREDICT_LABEL}'
    ),
    "scan_online": query([ONLINE], "SELECT * FROM online"),
    "scan_quarantine": raw(
        """CASE WHEN user_id % 50 = 0 THEN 'bad' ELSE 'good' END AS kind, merchant_id, count(*) AS lines"""
    )
    + " GROUP BY ALL",
    "feature_cache_roundtrip": query(
        [OFFLINE, CLEAN, history(), USER],
        f"SELECT {columns('fold user_id u1:l u2 u3 u4:d')} FROM user_f",
    ),
    "feature_cache_incremental": query(
        [OFFLINE, CLEAN, history(), USER],
        f"""SELECT {columns('fold user_id u1:l u2 u3 u4:d')},
                   CASE fold WHEN 1 THEN 'reused' ELSE 'built' END AS state FROM user_f""",
    ),
    "clean_distance": cleaned(f"{EVENT}, distance"),
    "clean_coupon": query(
        [OFFLINE, CLEAN, ONLINE, WEB],
        """SELECT 'offline' AS source, user_id, coupon_id::VARCHAR AS coupon_id FROM clean
           UNION ALL SELECT 'online', user_id, coupon_id FROM web""",
    ),
    "clean_dates": raw(
        """user_id, merchant_id, coalesce(date_received, DATE '1970-01-01') AS received_filled,
           coalesce("date", DATE '1970-01-01') AS date_filled"""
    ),
    "discount_split": cleaned(f"{EVENT}, discount_rate_text, discount_rate_x, discount_rate_y"),
    "discount_rate": cleaned(
        f"{EVENT}, discount_rate_text, round(discount_rate, 6) AS discount_rate"
    ),
    "discount_type": cleaned(f"{EVENT}, {TYPE_CODE} AS discount_type"),
    "discount_kind": cleaned(f"{EVENT}, {KIND} AS c6"),
    "date_parts": cleaned(
        f"{EVENT}, (isodow(date_received) - 1)::INTEGER AS weekday, "
        "day(date_received)::INTEGER AS day"
    ),
    "label_15d": query([OFFLINE, CLEAN, BATCH], f'SELECT {ROW}, "date", label FROM batch'),
    "label_3way": cleaned(
        f"""{EVENT}, (CASE WHEN date_received IS NULL THEN -1
                     WHEN "date" - date_received <= 15 THEN 1 ELSE 0 END)::INTEGER AS label"""
    ),
    "alt_discount_rate": raw(
        f"""{EVENT}, round(CASE WHEN discount_rate_text IS NULL THEN 1.0
             WHEN {COLON} THEN 1 - {ratio(JIAN, MAN)} ELSE 0.0 END::DOUBLE, 6) AS discount_rate"""
    ),
    "alt_discount_parts": raw(
        f"""{EVENT}, {MAN} AS discount_man, {JIAN} AS discount_jian,
            CASE WHEN discount_rate_text IS NULL THEN NULL
                 ELSE {COLON}::INTEGER END AS discount_type"""
    ),
    "alt_distance": raw(f"{EVENT}, coalesce(distance, -1)::INTEGER AS distance"),
    "weekday_onehot": raw(
        f"""{EVENT}, isodow(date_received)::INTEGER AS weekday, {WEEKEND} AS weekday_type,
            1 - {WEEKEND} AS workday, {DAY_FLAGS}"""
    ),
    "matrix_fillna": query(
        [OFFLINE, CLEAN, history(), BATCH, USER],
        f"""SELECT {ROW}, label, coalesce(u1, 0) AS u1, coalesce(u2, 0) AS u2,
                   coalesce(u3, 0) AS u3, round(coalesce(u4, 0), 6) AS u4,
                   round(coalesce(u19, 0), 6) AS u19
            FROM batch LEFT JOIN user_f USING (fold, user_id)""",
    ),
    "matrix_columns": query(
        [OFFLINE, CLEAN, BATCH],
        """SELECT fold, coupon_id, distance, round(discount_rate, 6) AS discount_rate, label
           FROM batch""",
    ),
    "online_fixed_rate": query(
        [ONLINE, WEB],
        """SELECT user_id, merchant_id, action, coupon_id,
                  round(discount_rate, 6) AS discount_rate FROM web""",
    ),
    "discount_bins": cleaned(
        f"""{EVENT}, (CASE WHEN discount_rate < 0.6 THEN 0 WHEN discount_rate < 0.7 THEN 1
                     WHEN discount_rate < 0.8 THEN 2 WHEN discount_rate < 0.9 THEN 3
                     WHEN discount_rate IS NOT NULL THEN 4 END)::INTEGER AS discount_bin"""
    ),
    "segment_rows": cleaned(
        f"""{EVENT}, CASE WHEN coupon_id <> 0 AND "date" IS NOT NULL THEN 'used'
                    WHEN coupon_id <> 0 THEN 'unused'
                    WHEN "date" IS NOT NULL THEN 'plain' END AS segment"""
    ),
    "fold_label_rows": query([OFFLINE, CLEAN, BATCH], f"SELECT fold, {EVENT} FROM batch"),
    "fold_history_rows": query([OFFLINE, CLEAN, history()], f"SELECT fold, {EVENT} FROM history"),
    "fold_history_rows_compat": query([OFFLINE, CLEAN], COMPAT),
    "predict_history_rows": cleaned(EVENT)
    + """ WHERE (coupon_id = 0 AND "date" >= DATE '1998-01-01')
            OR date_received >= DATE '1998-01-01'""",
    "date_split": query(
        [OFFLINE, CLEAN],
        f"""SELECT {EVENT}, {LABEL}, CASE WHEN date_received < DATE '2000-01-01' THEN 'train'
                   ELSE 'valid' END AS part
            FROM clean WHERE date_received <= DATE '2000-12-31'""",
    ),
    "sliding_folds": query(
        [OFFLINE, CLEAN, SLIDING_WINDOWS],
        f"""SELECT fold, merchant_id, label_rows, positives,
                   coalesce(history_rows, 0) AS history_rows
            FROM (SELECT fold, merchant_id, count(*) AS label_rows,
                         sum(label)::BIGINT AS positives
                  FROM (SELECT *, {LABEL} FROM clean JOIN windows
                        ON date_received BETWEEN a AND b) GROUP BY fold, merchant_id)
            LEFT JOIN (SELECT fold, merchant_id, count(*) AS history_rows
                       FROM clean JOIN windows
                       ON date_received BETWEEN a - 365 AND a - 91
                          OR (coupon_id = 0 AND "date" BETWEEN a - 365 AND a - 1)
                       GROUP BY fold, merchant_id) USING (fold, merchant_id)""",
    ),
    "three_sigma": query(
        [OFFLINE, CLEAN, history()],
        """SELECT fold, user_id, merchant_id, held, bought
           FROM (SELECT *, avg(held) OVER () AS hm, stddev_samp(held) OVER () AS hs,
                        avg(bought) OVER () AS bm, stddev_samp(bought) OVER () AS bs
                 FROM (SELECT fold, user_id, merchant_id, count(*) FILTER (WHERE held) AS held,
                              count("date") AS bought
                       FROM history GROUP BY fold, user_id, merchant_id))
           WHERE abs(held - hm) <= 3 * hs AND abs(bought - bm) <= 3 * bs""",
    ),
    "online_known_users": query(
        [OFFLINE, ONLINE, WEB],
        """SELECT user_id, merchant_id, action, coupon_id, date_received, "date" FROM web
           WHERE user_id IN (SELECT user_id FROM offline)""",
    ),
    "join_left_1key": query(
        [OFFLINE, CLEAN, history(), BATCH, MERCHANT],
        f"""SELECT {ROW}, m1, round(m4, 6) AS m4
            FROM batch LEFT JOIN merchant_f USING (fold, merchant_id)""",
    ),
    "join_left_2key": query(
        [OFFLINE, CLEAN, history(), BATCH, USER_MERCHANT],
        f"""SELECT {ROW}, um1, um2, um3, round(um4, 6) AS um4, um6, um7
            FROM batch LEFT JOIN user_merchant_f USING (fold, user_id, merchant_id)""",
    ),
    "join_left_3key": query([OFFLINE, CLEAN, BATCH, IN_BATCH], f"SELECT {ROW}, o11 FROM in_batch"),
    "cold_start_users": query(
        [OFFLINE, CLEAN],
        f"""SELECT DISTINCT user_id FROM clean WHERE {PREDICT_LABEL} AND user_id NOT IN
            (SELECT user_id FROM offline WHERE coalesce(date_received, "date") < DATE '2001-01-01')""",
    ),
    "cold_start_merchants": query(
        [OFFLINE, CLEAN],
        f"""SELECT DISTINCT merchant_id FROM clean WHERE {PREDICT_LABEL} AND merchant_id NOT IN
            (SELECT merchant_id FROM offline WHERE coalesce(date_received, "date") < DATE '2001-01-01')""",
    ),
    "dedup_rows": query([OFFLINE], "SELECT DISTINCT * FROM offline"),
    "head_sample": query(
        [OFFLINE],
        """SELECT * FROM offline
           ORDER BY user_id, merchant_id, coupon_id NULLS FIRST, discount_rate_text NULLS FIRST,
                    distance NULLS FIRST, date_received NULLS FIRST, "date" NULLS FIRST
           LIMIT 1000""",
    ),
    "split_train_test": query(
        [OFFLINE, CLEAN, BATCH, IDENTIFIED],
        f"""SELECT row_id, label, CASE WHEN {fraction("row_id || '/0'")} < 0.25 THEN 'test'
                   WHEN {fraction("row_id || '/0-train'")} < 0.5 THEN 'train'
                   ELSE 'rest' END AS part
            FROM identified""",
    ),
    "stratified_folds": query(
        [OFFLINE, CLEAN, BATCH, IDENTIFIED],
        """SELECT row_id, label, ((row_number() OVER (PARTITION BY label, substr(h, 1, 6)
                  ORDER BY h, row_id) + ('0x' || substr(h, 1, 6))::BIGINT) % 3)::INTEGER AS split
           FROM (SELECT row_id, label, md5(row_id || '/0') AS h FROM identified)""",
    ),
    "tuning_sample": query(
        [OFFLINE, CLEAN, BATCH, IDENTIFIED],
        "SELECT row_id, label FROM identified ORDER BY md5(row_id || '/0-sample'), row_id LIMIT 10000",
    ),
    "split_exact": query(
        [OFFLINE, CLEAN, BATCH, IDENTIFIED],
        f"""SELECT row_id, label, 'test' AS part FROM identified WHERE {fraction("row_id || '/0'")} < 0.25
            UNION ALL SELECT * FROM (
                SELECT row_id, label, 'train' FROM identified WHERE {fraction("row_id || '/0'")} >= 0.25
                ORDER BY md5(row_id || '/0-train-sample'), row_id LIMIT 5000)""",
    ),
    "undersample": query(
        [OFFLINE, CLEAN, BATCH, IDENTIFIED, """
marked AS (SELECT row_id, user_id, label, max(label) OVER (PARTITION BY user_id) = 1 AS kept FROM identified)"""],
        """SELECT row_id, user_id, label FROM marked WHERE kept
           UNION ALL SELECT * FROM (
               SELECT row_id, user_id, label FROM marked WHERE NOT kept
               ORDER BY md5(row_id || '/0-sample'), row_id LIMIT 200)""",
    ),
    "bagging_split": query(
        [OFFLINE, CLEAN, BATCH, IDENTIFIED],
        f"""SELECT row_id, label, {fraction("row_id || '/bag-1'")} < 0.33 AS is_test
            FROM identified""",
    ),
    "metric_accuracy": query(
        WITH_SCORE,
        """SELECT count(*) AS rows, round(avg(((score > 0.4)::INTEGER = label)::INTEGER), 6)
                  AS accuracy FROM scored""",
    ),
    "metric_auc": query(
        WITH_SCORE,
        """SELECT sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives,
                  round((sum(label * r) - sum(label) * (sum(label) + 1) / 2.0)
                        / (sum(label) * sum(1 - label)), 6)::DOUBLE AS auc
           FROM (SELECT label::DOUBLE AS label, rank() OVER (ORDER BY score)
                        + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)""",
    ),
    "metric_coupon_auc": query(
        WITH_SCORE,
        """SELECT count(*) AS coupons, round(avg(auc), 6) AS coupon_auc
           FROM (SELECT (sum(label * r) - sum(label) * (sum(label) + 1) / 2.0)
                        / (sum(label) * sum(1 - label)) AS auc
                 FROM (SELECT coupon_id, label::DOUBLE AS label,
                              rank() OVER (PARTITION BY coupon_id ORDER BY score)
                              + (count(*) OVER (PARTITION BY coupon_id, score) - 1) / 2.0 AS r
                       FROM scored)
                 GROUP BY coupon_id HAVING count(DISTINCT label) = 2)""",
    ),
    "score_minmax": query(
        WITH_SCORE,
        f"""SELECT {ROW}, round((score - min(score) OVER ())
                   / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM scored""",
    ),
    "weighted_blend": query(
        WITH_SCORE,
        f"""SELECT {ROW}, round(cheap * 0.65::DOUBLE + near * 0.35::DOUBLE, 6) AS blend
            FROM scored""",
    ),
    "checkpoint_blend": query(
        WITH_SCORE,
        f"""SELECT {ROW}, round((near * 1.0::DOUBLE + cheap * 2.0::DOUBLE + score * 1.0::DOUBLE
                   + discount_rate * 2.0::DOUBLE) / 6.0::DOUBLE, 6) AS blend FROM scored""",
    ),
    "label_encode": query(
        [OFFLINE, CLEAN, BATCH, ENCODED],
        "SELECT *, "
        + ", ".join(
            f"(dense_rank() OVER (ORDER BY {c}) - 1)::BIGINT AS {c}_code" for c in CODES
        )
        + " FROM encoded",
    ),
    "minmax_scale": query(
        [OFFLINE, CLEAN, BATCH],
        f"SELECT {ROW}, {', '.join(scaled(c) for c in SCALED_COLUMNS)} FROM batch",
    ),
}
