"""Oracles of the feature tables and the assembled matrices."""

from __future__ import annotations

from oracles.base import (
    BATCH,
    CLEAN,
    OFFLINE,
    ONLINE,
    SCORING_BATCH,
    SLIDING,
    WEB,
    WEB_HISTORY,
    columns,
    count_if,
    history,
    mean_rate,
    names,
    query,
    ratio,
    scoring_history,
    sliding_batch,
    some,
    some_if,
)


def gap(day: str, n: str, condition: str) -> str:
    span = f"max({day}) FILTER (WHERE {condition}) - min({day}) FILTER (WHERE {condition})"
    return ratio(span, f"{n} - 1")


NEAR = "used AND distance <> 11"
DELAY = '"date" - date_received'
N_USED, N_UNUSED, N_PLAIN = (count_if(c) for c in ("used", "unused", "plain"))
RECEIVED = "date_received IS NOT NULL"

USER = f"""
user_f AS (
  SELECT *, {ratio('u2', 'u3')} AS u19, {ratio('u2', 'u1')} AS u4, u2 + u5 AS u25,
         {ratio('u2', 'u2 + u5')} AS u20, u6 / 15 AS u8, u7 / 15 AS u9, u10 / 15 AS u11,
         {ratio('u21', 'u2')} AS u22, {ratio('u21', 'u3')} AS u23, {ratio('u21', 'u1')} AS u24,
         {ratio('um10', 'um9')} AS um11, {ratio('u2', 'um9')} AS um12
  FROM (SELECT fold, user_id, {some(N_USED)} AS u2, {some(N_UNUSED)} AS u3,
               {N_USED} + {N_UNUSED} AS u1, {some(N_PLAIN)} AS u5,
               {gap('"date"', N_PLAIN, 'plain')} AS u6,
               {gap('"date"', N_USED, 'used')} AS u7,
               avg({DELAY}) FILTER (WHERE used) AS u10,
               {some_if(f'used AND {DELAY} <= 15')} AS u21,
               {mean_rate('used')} AS u45,
               min(discount_rate) FILTER (WHERE used) AS u27,
               max(discount_rate) FILTER (WHERE used) AS u28,
               {some('count(DISTINCT coupon_id) FILTER (WHERE used)')} AS u32,
               avg(distance) FILTER (WHERE {NEAR}) AS u35,
               min(distance) FILTER (WHERE {NEAR}) AS u36,
               max(distance) FILTER (WHERE {NEAR}) AS u37,
               {some_if("contains(discount_rate_text, ':')")} AS u48,
               {some_if("contains(discount_rate_text, '.')")} AS u49,
               count(DISTINCT merchant_id) AS um9,
               {some('count(DISTINCT merchant_id) FILTER (WHERE used)')} AS um10
        FROM history GROUP BY fold, user_id))"""
USER_SPEC = (
    "u1:l u2 u3 u4:d u5 u6:d u7:d u8:d u9:d u10:d u11:d u19:d u20:d u21 u22:d u23:d u24:d u25 "
    "u27:d u28:d u32 u35:d u36 u37 u45:d u48 u49 um9 um10 um11:d um12:d"
)

USER_COUPON = f"""
user_coupon_f AS (
  SELECT fold, user_id, coupon_id, {some_if(RECEIVED)} AS u47
  FROM history GROUP BY ALL)"""

USER_DISCOUNT = f"""
user_discount_f AS (
  SELECT *, {ratio('u42', 'u41')} AS u44
  FROM (SELECT fold, user_id, discount_rate_text, count(*) AS u41, {some(N_USED)} AS u42,
               {some(N_UNUSED)} AS u43
        FROM history WHERE discount_rate_text IS NOT NULL
        GROUP BY fold, user_id, discount_rate_text))"""

MERCHANT = f"""
merchant_f AS (
  SELECT *, coalesce(m0, 0) - coalesce(m1, 0) AS m2, {ratio('m1', 'm3')} AS m4,
         {ratio('m11', 'm12')} AS m13, {ratio('m1', 'm12')} AS m14, {ratio('m15', 'm18')} AS m19
  FROM (SELECT fold, merchant_id, {some_if('"date" IS NOT NULL')} AS m0, {some(N_USED)} AS m1,
               {some_if(RECEIVED)} AS m3, {some(N_UNUSED)} AS m7,
               {mean_rate('used')} AS m8,
               max(discount_rate) FILTER (WHERE used) AS m9,
               min(discount_rate) FILTER (WHERE used) AS m10,
               {some('count(DISTINCT user_id) FILTER (WHERE used)')} AS m11,
               {some(f'count(DISTINCT user_id) FILTER (WHERE {RECEIVED})')} AS m12,
               {some('count(DISTINCT coupon_id) FILTER (WHERE used)')} AS m15,
               {some(f'count(DISTINCT coupon_id) FILTER (WHERE {RECEIVED})')} AS m18,
               {gap('"date"', N_USED, 'used')} AS m20,
               avg(distance) FILTER (WHERE {NEAR}) AS m21,
               min(distance) FILTER (WHERE {NEAR}) AS m22,
               max(distance) FILTER (WHERE {NEAR}) AS m23
        FROM history GROUP BY fold, merchant_id))"""
MERCHANT_SPEC = (
    "m0 m1 m2:l m3 m4:d m7 m8:d m9:d m10:d m11 m12 m13:d m14:d m15 m18 m19:d m20:d m21:d m22 m23"
)

COUPON = f"""
coupon_f AS (
  SELECT *, {ratio('c2', 'c1')} AS c3, c1 - c2 AS c4
  FROM (SELECT fold, coupon_id, count(*) AS c1, {some(N_USED)} AS c2,
               {gap('"date"', N_USED, 'used')} AS c12
        FROM history WHERE held GROUP BY fold, coupon_id))"""

DISCOUNT = f"""
discount_f AS (
  SELECT *, {ratio('c9', 'c8')} AS c11
  FROM (SELECT fold, discount_rate_text, count(*) AS c8, {some(N_USED)} AS c9,
               {some(N_UNUSED)} AS c10
        FROM history WHERE discount_rate_text IS NOT NULL GROUP BY fold, discount_rate_text))"""

USER_MERCHANT = f"""
user_merchant_f AS (
  SELECT *, {ratio('um3', 'um1')} AS um4
  FROM (SELECT fold, user_id, merchant_id, {some_if('held')} AS um1, {some(N_UNUSED)} AS um2,
               {some(N_USED)} AS um3, {some_if('"date" IS NOT NULL')} AS um6,
               {some(N_PLAIN)} AS um7
        FROM history GROUP BY fold, user_id, merchant_id))"""

USER_MERCHANT_DAY = f"""
user_merchant_day_f AS (
  SELECT fold, user_id, merchant_id, date_received, count(*) AS um8
  FROM history WHERE {RECEIVED} GROUP BY ALL)"""

WEB_USER = f"""
web_user_f AS (
  SELECT *, {ratio('on_u2', 'on_u1')} AS on_u3, {ratio('on_u4', 'on_u1')} AS on_u5,
         {ratio('on_u6', 'on_u1')} AS on_u7, {ratio('on_u9', 'on_u6')} AS on_u10
  FROM (SELECT fold, user_id, count(*) AS on_u1, {some_if('action = 0')} AS on_u2,
               {some_if('action = 1')} AS on_u4, {some_if('held')} AS on_u6,
               {some_if('held AND "date" IS NULL')} AS on_u8,
               {some_if('held AND "date" IS NOT NULL')} AS on_u9
        FROM web_history GROUP BY fold, user_id))"""
WEB_SPEC = "on_u1 on_u2 on_u3:d on_u4 on_u5:d on_u6 on_u7:d on_u8 on_u9 on_u10:d"

WEB_SHARE = f"""{ratio('u3', 'on_u8 + u3')} AS on_u11, {ratio('u2', 'on_u9 + u2')} AS on_u12,
         {ratio('u1', 'on_u6 + u1')} AS on_u13"""

# In-batch features, straight from the batch rows; days as numbers for the range frames.
IN_BATCH = f"""
in_batch AS (
  SELECT b.*, (d - coalesce(max(d) OVER before_u, d + 1))::INTEGER AS o17,
         (coalesce(min(d) OVER after_u, d - 1) - d)::INTEGER AS o18,
         count(*) OVER before_u AS o3, count(*) OVER after_u AS o4,
         count(*) OVER before_c AS o5, count(*) OVER after_c AS o6,
         count(*) OVER (PARTITION BY fold, user_id) AS o1,
         count(*) OVER (PARTITION BY fold, user_id, coupon_id) AS o2,
         count(*) OVER (PARTITION BY fold, user_id, merchant_id) AS o8,
         count(*) OVER (PARTITION BY fold, user_id, d) AS o10,
         count(*) OVER (PARTITION BY fold, user_id, coupon_id, d) AS o11,
         count(*) OVER (PARTITION BY fold, merchant_id) AS o13,
         count(*) OVER (PARTITION BY fold, merchant_id, coupon_id) AS o14,
         count(*) OVER (PARTITION BY fold, merchant_id, d) AS m5,
         count(*) OVER (PARTITION BY fold, coupon_id, d) AS c5,
         count(DISTINCT merchant_id) OVER (PARTITION BY fold, user_id) AS o9,
         count(DISTINCT coupon_id) OVER (PARTITION BY fold, user_id) AS o12,
         count(DISTINCT user_id) OVER (PARTITION BY fold, merchant_id) AS o15,
         count(DISTINCT coupon_id) OVER (PARTITION BY fold, merchant_id) AS o16,
         count(DISTINCT user_id) OVER (PARTITION BY fold, merchant_id, d) AS m6,
         {ratio('max(d) OVER (PARTITION BY fold, user_id) - min(d) OVER (PARTITION BY fold, user_id)',
                'count(*) OVER (PARTITION BY fold, user_id) - 1')} AS o7
  FROM (SELECT *, date_received - DATE '1970-01-01' AS d FROM batch) b
  WINDOW before_u AS (PARTITION BY fold, user_id ORDER BY d
                      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after_u AS (PARTITION BY fold, user_id ORDER BY d
                     RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
         before_c AS (PARTITION BY fold, user_id, coupon_id ORDER BY d
                      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after_c AS (PARTITION BY fold, user_id, coupon_id ORDER BY d
                     RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
# d - (d + 1) = -1 and (d - 1) - d = -1 stand for "none".
BATCH_USER_SPEC = "o1 o2 o7:d o8 o9 o10 o11 o12"

# The known discount texts; the position is the code.
TYPES = [
    "0.2", "0.5", "0.6", "0.7", "0.75", "0.8", "0.85", "0.9", "0.95", "30:20", "50:30", "10:5",
    "20:10", "100:50", "200:100", "50:20", "30:10", "150:50", "100:30", "20:5", "200:50", "5:1",
    "50:10", "100:20", "150:30", "30:5", "300:50", "200:30", "150:20", "10:1", "50:5", "100:10",
    "200:20", "300:30", "150:10", "300:20", "500:30", "20:1", "100:5", "200:10", "30:1", "150:5",
    "300:10", "200:5", "50:1", "100:1",
]
TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
TYPE_CODE = f"coalesce(list_position({TYPE_LIST}, discount_rate_text), 0)::INTEGER - 1"
KIND = "coalesce(contains(discount_rate_text, ':'), false)::INTEGER"

ALL_HISTORY = [
    USER,
    USER_COUPON,
    USER_DISCOUNT,
    MERCHANT,
    COUPON,
    DISCOUNT,
    USER_MERCHANT,
    USER_MERCHANT_DAY,
    WEB_USER,
    IN_BATCH,
]
MATRIX = f"""
features AS (
  SELECT * EXCLUDE (u1, m2), coalesce(u1, 0) AS u1, coalesce(m2, 0) AS m2,
         (isodow(date_received) - 1)::INTEGER AS weekday, day(date_received)::INTEGER AS day,
         {TYPE_CODE} AS discount_type, {KIND} AS c6,
         {ratio('u32', 'u47')} AS u33, {ratio('u2', 'u47')} AS u34, {ratio('um2', 'u3')} AS um5,
         {ratio('u3', 'on_u8 + u3')} AS on_u11, {ratio('u2', 'on_u9 + u2')} AS on_u12,
         {ratio('coalesce(u1, 0)', 'on_u6 + coalesce(u1, 0)')} AS on_u13
  FROM in_batch
  LEFT JOIN user_f USING (fold, user_id)
  LEFT JOIN user_coupon_f USING (fold, user_id, coupon_id)
  LEFT JOIN user_discount_f USING (fold, user_id, discount_rate_text)
  LEFT JOIN merchant_f USING (fold, merchant_id)
  LEFT JOIN coupon_f USING (fold, coupon_id)
  LEFT JOIN discount_f USING (fold, discount_rate_text)
  LEFT JOIN user_merchant_f USING (fold, user_id, merchant_id)
  LEFT JOIN user_merchant_day_f USING (fold, user_id, merchant_id, date_received)
  LEFT JOIN web_user_f USING (fold, user_id))"""

INPUT_SPEC = (
    "distance discount_rate:d weekday day discount_type c6 "
    + USER_SPEC
    + " u33:d u34:d u41 u42 u43 u44:d u47 "
    + MERCHANT_SPEC
    + " m5 m6 c1 c2 c3:d c4 c5 c8 c9 c10 c11:d c12:d um1 um2 um3 um4:d um5:d um6 um7 um8 "
    + BATCH_USER_SPEC
    + " o3:l o4:l o5:l o6:l o13 o14 o15 o16 o17 o18 "
    + WEB_SPEC
    + " on_u11:d on_u12:d on_u13:d"
)


def filled(spec: str) -> str:
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        value = f'coalesce("{name}", 0)'
        if kind == "d":
            value = f"round({value}::DOUBLE, 6)"
        elif kind == "l":
            value = f"{value}::BIGINT"
        out.append(f'{value} AS "{name}"')
    return ", ".join(out)


TRAIN_CTES = [OFFLINE, CLEAN, ONLINE, WEB, history(), WEB_HISTORY, BATCH, *ALL_HISTORY, MATRIX]
COMPAT_CTES = [OFFLINE, CLEAN, ONLINE, WEB, history(compat=True)]
COMPAT_CTES += [history("web_history", "web", "'0'", compat=True), BATCH, *ALL_HISTORY, MATRIX]
IN_BATCH_INPUTS = {"m5", "m6", "c5", *[f"o{n}" for n in range(1, 19)]}
LIVE_SPEC = " ".join(s for s in INPUT_SPEC.split() if s.partition(":")[0] not in IN_BATCH_INPUTS)
SCORE_CTES = [
    OFFLINE,
    CLEAN,
    ONLINE,
    WEB,
    scoring_history(),
    scoring_history("web_history", "web", "'0'"),
    SCORING_BATCH,
    *ALL_HISTORY,
    MATRIX,
]


def from_history(cte: str, table: str, spec: str, where: str = "true") -> str:
    return query(
        [OFFLINE, CLEAN, history(), cte], f"SELECT {columns(spec)} FROM {table} WHERE {where}"
    )


def user_table(spec: str) -> str:
    return from_history(USER, "user_f", "fold user_id " + spec)


def merchant_table(spec: str) -> str:
    return from_history(MERCHANT, "merchant_f", "fold merchant_id " + spec)


def in_batch_table(spec: str) -> str:
    return query([OFFLINE, CLEAN, BATCH, IN_BATCH], f"SELECT {columns(spec)} FROM in_batch")


TIERS = [("0_50", 0, 50), ("50_200", 50, 200), ("200_500", 200, 500)]
SPEND = (
    "CASE WHEN contains(discount_rate_text, ':') "
    "THEN split_part(discount_rate_text, ':', 1)::INTEGER END"
)


def tier_columns() -> str:
    out = []
    for name, above, up_to in TIERS:
        inside = f"held AND ({SPEND}) > {above} AND ({SPEND}) <= {up_to}"
        used = count_if(f"{inside} AND used")
        out.append(f"round({ratio(used, count_if(inside))}, 6) AS tier_rate_{name}")
        out.append(f"round({ratio(used, N_USED)}, 6) AS tier_share_{name}")
    return ", ".join(out)


ROW_KEYS = "fold user_id merchant_id coupon_id date_received"

SQL = {
    "feat_user_counts": user_table("u1:l u2 u3 u4:d u5 u19:d u20:d u25"),
    "feat_user_span": user_table("u6:d u7:d u8:d u9:d"),
    "feat_user_delay": user_table("u10:d u11:d u21 u22:d u23:d u24:d"),
    "feat_user_rate": user_table("u45:d u27:d u28:d"),
    "feat_user_variety": user_table("u32"),
    "feat_user_distance": user_table("u35:d u36 u37"),
    "feat_user_discount_kind": user_table("u48 u49"),
    "feat_user_merchant_variety": user_table("um9 um10 um11:d um12:d"),
    "feat_user_coupon": query(
        [OFFLINE, CLEAN, history(), USER, USER_COUPON],
        f"""SELECT fold, user_id, coupon_id, u47, round({ratio('u32', 'u47')}, 6) AS u33,
                   round({ratio('u2', 'u47')}, 6) AS u34
            FROM user_coupon_f LEFT JOIN user_f USING (fold, user_id) WHERE u47 IS NOT NULL""",
    ),
    "feat_user_discount": from_history(
        USER_DISCOUNT, "user_discount_f", "fold user_id discount_rate_text u41 u42 u43 u44:d"
    ),
    "sliding_user_features": query(
        [OFFLINE, CLEAN, history(folds=SLIDING), USER],
        f"SELECT {columns('fold user_id ' + USER_SPEC)} FROM user_f",
    ),
    "sliding_merchant_features": query(
        [OFFLINE, CLEAN, history(folds=SLIDING), MERCHANT],
        f"SELECT {columns('fold merchant_id ' + MERCHANT_SPEC)} FROM merchant_f",
    ),
    "sliding_coupon_features": query(
        [OFFLINE, CLEAN, history(folds=SLIDING), COUPON],
        f"SELECT {columns('fold coupon_id c1 c2 c3:d c4 c12:d')} FROM coupon_f",
    ),
    "sliding_training_rows": query(
        [OFFLINE, CLEAN, sliding_batch(), history(folds=SLIDING), USER, MERCHANT, COUPON, USER_MERCHANT],
        f"""SELECT {columns(ROW_KEYS + ' label', 'b.')}, coalesce(u1, 0)::BIGINT AS u1, {columns(USER_SPEC.removeprefix('u1:l'))},
                   {columns(MERCHANT_SPEC + ' c1 c2 c3:d c4 c12:d um1 um2 um3 um4:d um6 um7')}
            FROM batch b LEFT JOIN user_f USING (fold, user_id) LEFT JOIN merchant_f USING (fold, merchant_id)
            LEFT JOIN coupon_f USING (fold, coupon_id) LEFT JOIN user_merchant_f USING (fold, user_id, merchant_id)""",
    ),
    "feat_merchant_counts": merchant_table("m0 m1 m2:l m3 m4:d m7"),
    "feat_merchant_rate": merchant_table("m8:d m9:d m10:d"),
    "feat_merchant_variety": merchant_table("m11 m12 m13:d m14:d m15 m18 m19:d"),
    "feat_merchant_span": merchant_table("m20:d"),
    "feat_merchant_distance": merchant_table("m21:d m22 m23"),
    "feat_coupon_counts": from_history(COUPON, "coupon_f", "fold coupon_id c1 c2 c3:d c4"),
    "feat_coupon_span": from_history(COUPON, "coupon_f", "fold coupon_id c12:d"),
    "feat_discount": from_history(
        DISCOUNT, "discount_f", "fold discount_rate_text c8 c9 c10 c11:d"
    ),
    "feat_user_merchant": query(
        [OFFLINE, CLEAN, history(), USER, USER_MERCHANT],
        f"""SELECT {columns('fold user_id merchant_id um1 um2 um3 um4:d um6 um7')},
                   round({ratio('um2', 'u3')}, 6) AS um5
            FROM user_merchant_f JOIN user_f USING (fold, user_id)""",
    ),
    "feat_user_merchant_day": from_history(
        USER_MERCHANT_DAY, "user_merchant_day_f", "fold user_id merchant_id date_received um8"
    ),
    "feat_distance": query(
        [OFFLINE, CLEAN, history()],
        f"""SELECT fold, distance, distance_0, distance_1, distance_0 + distance_1 AS distance_2,
                   round({ratio('distance_0', 'distance_0 + distance_1')}, 6) AS distance_3,
                   round(d4, 6) AS d4
            FROM (SELECT fold, distance, {some(N_USED)} AS distance_0,
                         {some(N_UNUSED)} AS distance_1
                  FROM history WHERE held GROUP BY fold, distance)
            LEFT JOIN (SELECT fold, avg(distance) AS d4 FROM history WHERE {NEAR} GROUP BY fold)
            USING (fold)""",
    ),
    "feat_online_user": query(
        [ONLINE, WEB, WEB_HISTORY, WEB_USER],
        f"SELECT {columns('fold user_id ' + WEB_SPEC)} FROM web_user_f",
    ),
    "feat_online_share": query(
        [OFFLINE, CLEAN, ONLINE, WEB, history(), WEB_HISTORY, USER, WEB_USER, BATCH],
        f"""SELECT {columns('fold user_id on_u11:d on_u12:d on_u13:d')} FROM (
              SELECT fold, user_id, {WEB_SHARE}
              FROM (SELECT fold, user_id, u2, u3, coalesce(u1, 0) AS u1, on_u6, on_u8, on_u9
                    FROM (SELECT DISTINCT fold, user_id FROM batch)
                    LEFT JOIN user_f USING (fold, user_id)
                    LEFT JOIN web_user_f USING (fold, user_id)))""",
    ),
    "feat_online_rate": query(
        [ONLINE, WEB, WEB_HISTORY],
        f"""SELECT fold, user_id, round({mean_rate()}, 6) AS ou14,
                  round(min(discount_rate), 6) AS ou15, round(max(discount_rate), 6) AS ou16
           FROM web_history WHERE used GROUP BY fold, user_id""",
    ),
    "feat_online_discount": query(
        [ONLINE, WEB, WEB_HISTORY],
        f"""SELECT fold, discount_rate_text, count(*) AS oc1, {some(N_USED)} AS oc2,
                   {some(N_UNUSED)} AS oc3, round({ratio(some(N_USED), 'count(*)')}, 6) AS oc4
            FROM web_history WHERE discount_rate_text IS NOT NULL GROUP BY fold, discount_rate_text""",
    ),
    "feat_batch_user": in_batch_table(ROW_KEYS + " " + BATCH_USER_SPEC),
    "feat_batch_prev_next": in_batch_table(ROW_KEYS + " o3:l o4:l o5:l o6:l o17 o18"),
    "feat_batch_merchant": in_batch_table(ROW_KEYS + " o13 o14 o15 o16"),
    "feat_batch_merchant_day": query(
        [OFFLINE, CLEAN, BATCH],
        """SELECT fold, merchant_id, date_received, count(*) AS m5, count(DISTINCT user_id) AS m6
           FROM batch GROUP BY ALL""",
    ),
    "feat_batch_coupon_day": query(
        [OFFLINE, CLEAN, BATCH],
        "SELECT fold, coupon_id, date_received, count(*) AS c5 FROM batch GROUP BY ALL",
    ),
    "feat_user_spend_tier": query(
        [OFFLINE, CLEAN, history()],
        f"SELECT fold, user_id, {tier_columns()} FROM history GROUP BY fold, user_id",
    ),
    "feat_user_per_merchant": query(
        [OFFLINE, CLEAN, history(), USER],
        f"""SELECT fold, user_id, round({ratio('u2', 'um10')}, 6) AS used_per_merchant
            FROM user_f""",
    ),
    "feat_merchant_per_coupon": query(
        [OFFLINE, CLEAN, history(), MERCHANT],
        f"""SELECT fold, merchant_id, round({ratio('m1', 'm15')}, 6) AS used_per_coupon
            FROM merchant_f""",
    ),
    "feat_user_merchant_share": query(
        [OFFLINE, CLEAN, history(), USER, MERCHANT, USER_MERCHANT],
        f"""SELECT fold, user_id, merchant_id, round({ratio('um2', 'u3')}, 6) AS um5,
                   round({ratio('um3', 'u2')}, 6) AS share_of_user_used,
                   round({ratio('um2', 'm7')}, 6) AS share_of_merchant_unused,
                   round({ratio('um3', 'm1')}, 6) AS share_of_merchant_used
            FROM user_merchant_f JOIN user_f USING (fold, user_id)
            JOIN merchant_f USING (fold, merchant_id)""",
    ),
    "feat_user_coupon_history": query(
        [OFFLINE, CLEAN, history()],
        f"""SELECT fold, user_id, coupon_id, {count_if(RECEIVED)} AS received, {N_USED} AS used,
                   round({ratio(N_USED, count_if(RECEIVED))}, 6) AS used_share
            FROM history WHERE held GROUP BY fold, user_id, coupon_id""",
    ),
    "train_matrix": query(
        TRAIN_CTES, f"SELECT fold, coupon_id, label, {filled(INPUT_SPEC)} FROM features"
    ),
    "train_matrix_compat": query(
        COMPAT_CTES, f"SELECT fold, coupon_id, label, {filled(INPUT_SPEC)} FROM features"
    ),
    "train_matrix_live": query(
        TRAIN_CTES, f"SELECT fold, coupon_id, label, {filled(LIVE_SPEC)} FROM features"
    ),
    "scoring_matrix": query(
        SCORE_CTES,
        f"""SELECT DISTINCT user_id, merchant_id, coupon_id, date_received, {filled(INPUT_SPEC)}
            FROM features""",
    ),
}
assert len(names(INPUT_SPEC)) == 115
