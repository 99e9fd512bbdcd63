"""Oracles of the exploratory reports and the column checks."""

from __future__ import annotations

from itertools import combinations

from oracles.base import BATCH, CLEAN, OFFLINE, ONLINE, names, query, ratio
from oracles.features import INPUT_SPEC, TRAIN_CTES, filled

RAW_COLUMNS = [
    "user_id",
    "merchant_id",
    "coupon_id",
    "discount_rate_text",
    "distance",
    "date_received",
    "date",
]
MATRIX_COLUMNS = sorted(["coupon_id", "label", *names(INPUT_SPEC)])
FILLED = f"\nfilled AS (SELECT coupon_id, label, {filled(INPUT_SPEC)} FROM features)"
USED = 'coupon_id <> 0 AND "date" IS NOT NULL'


def _pairs() -> str:
    tests = [
        f"{{'a': '{a}', 'b': '{b}', 'same': bool_and(\"{a}\" = \"{b}\")}}"
        for a, b in combinations(MATRIX_COLUMNS, 2)
    ]
    return f"SELECT unnest([{', '.join(tests)}]) AS p FROM filled"


def _variances() -> str:
    entries = [
        f"{{'name': '{c}', 'v': var_pop(\"{c}\")::DOUBLE}}" for c in sorted(names(INPUT_SPEC))
    ]
    return f"SELECT unnest([{', '.join(entries)}]) AS p FROM filled"


SQL = {
    "eda_distance_rate": query(
        [OFFLINE, CLEAN],
        f"""SELECT distance, receive_count, consume_count,
                   round({ratio('consume_count', 'receive_count')}, 6) AS consume_rate
            FROM (SELECT distance, count(*) AS receive_count FROM clean GROUP BY distance)
            JOIN (SELECT distance, count(*) AS consume_count FROM clean WHERE {USED}
                  GROUP BY distance) USING (distance)""",
    ),
    "eda_segments": query(
        [OFFLINE],
        """SELECT count(*) FILTER (WHERE date_received IS NOT NULL AND "date" IS NOT NULL)
                    AS coupon_purchase,
                  count(*) FILTER (WHERE date_received IS NULL AND "date" IS NOT NULL)
                    AS plain_purchase,
                  count(*) FILTER (WHERE date_received IS NOT NULL AND "date" IS NULL)
                    AS coupon_unused,
                  count(*) FILTER (WHERE date_received IS NULL AND "date" IS NULL) AS neither
           FROM offline""",
    ),
    "eda_distinct_values": query(
        [OFFLINE],
        """SELECT DISTINCT 'discount_rate_text' AS kind, discount_rate_text AS value FROM offline
           UNION ALL SELECT DISTINCT 'distance', distance::VARCHAR FROM offline""",
    ),
    "eda_date_range": query(
        [OFFLINE],
        """SELECT min(date_received) AS first_received, max(date_received) AS last_received,
                  min("date") AS first_bought, max("date") AS last_bought FROM offline""",
    ),
    "eda_daily_redeem": query(
        [OFFLINE],
        """SELECT date_received, count(*) AS received, count("date") AS used,
                  round(count("date")::DOUBLE / count(*), 6) AS used_share
           FROM offline WHERE date_received IS NOT NULL GROUP BY date_received""",
    ),
    "eda_label_balance": query(
        [OFFLINE, CLEAN, BATCH],
        """SELECT fold, count(*) AS rows, sum(label)::BIGINT AS positives,
                  round(sum(label)::DOUBLE / count(*), 6) AS positive_share
           FROM batch GROUP BY fold""",
    ),
    "eda_pivot_daily": query(
        [OFFLINE, CLEAN],
        """SELECT "date", nullif(count(*) FILTER (WHERE coupon_id <> 0), 0) AS used,
                  nullif(count(*) FILTER (WHERE coupon_id = 0), 0) AS plain
           FROM clean WHERE "date" IS NOT NULL GROUP BY "date" """,
    ),
    "dq_fixed": query(
        [ONLINE],
        """SELECT count(*) AS fixed_rows, count("date") AS fixed_used,
                  count(*) - count("date") AS fixed_unused,
                  count(*) FILTER (WHERE date_received <> "date") AS fixed_other_day
           FROM online WHERE coupon_id = 'fixed'""",
    ),
    "dq_null_counts": query(
        [OFFLINE],
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL) AS missing "
            "FROM offline"
            for c in RAW_COLUMNS
        ),
    ),
    "dq_duplicate_columns": query(
        [*TRAIN_CTES, FILLED],
        f"""SELECT p.a AS first_column, p.b AS second_column FROM ({_pairs()}) WHERE p.same""",
    ),
    "variance_filter": query(
        [*TRAIN_CTES, FILLED],
        f"""SELECT p.name AS column_name, round(p.v, 4) AS variance FROM ({_variances()})
            WHERE p.v > 0.16""",
    ),
}

SQL["report_file"] = SQL["eda_distance_rate"]
