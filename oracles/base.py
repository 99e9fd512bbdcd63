"""Common table expressions shared by the oracles, and small SQL text helpers."""

from __future__ import annotations


def ratio(top: str, bottom: str) -> str:
    return f"(({top})::DOUBLE / nullif(({bottom})::DOUBLE, 0))"


def some(count: str) -> str:
    return f"nullif({count}, 0)"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def some_if(condition: str) -> str:
    return some(count_if(condition))


def mean_rate(condition: str = "true") -> str:
    """Mean rate from a decimal sum, which no engine rounds differently."""
    where = f"FILTER (WHERE {condition})"
    return ratio(
        f"sum(discount_rate::DECIMAL(14, 10)) {where}", f"count(discount_rate) {where}"
    )


def columns(spec: str, prefix: str = "") -> str:
    """``a b:d c:i`` -> select list; ``d`` rounds a double, ``i`` and ``l`` cast to int types."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        value = f'{prefix}"{name}"'
        if kind == "d":
            value = f"round({value}::DOUBLE, 6)"
        elif kind == "i":
            value = f"{value}::INTEGER"
        elif kind == "l":
            value = f"{value}::BIGINT"
        out.append(f'{value} AS "{name}"')
    return ", ".join(out)


def names(spec: str) -> list[str]:
    return [item.partition(":")[0] for item in spec.split()]


def query(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


OFFLINE = """
offline AS (
  SELECT o_custkey AS user_id, l_suppkey AS merchant_id, coupon_id,
         CASE WHEN coupon_id IS NULL THEN NULL
              WHEN coupon_id % 8 = 0 THEN '30:5'   WHEN coupon_id % 8 = 1 THEN '100:10'
              WHEN coupon_id % 8 = 2 THEN '50:20'  WHEN coupon_id % 8 = 3 THEN '20:1'
              WHEN coupon_id % 8 = 4 THEN '200:30' WHEN coupon_id % 8 = 5 THEN '0.9'
              WHEN coupon_id % 8 = 6 THEN '0.95'   ELSE '0.5' END AS discount_rate_text,
         (CASE WHEN d <> 11 THEN d END)::INTEGER AS distance,
         CASE WHEN coupon_id IS NOT NULL THEN day END AS date_received,
         CASE WHEN coupon_id IS NULL THEN day
              WHEN l_linestatus = 'F' THEN day + (l_quantity::INTEGER % 31)::INTEGER
         END AS "date"
  FROM (SELECT o_custkey, l_suppkey, l_linestatus, l_quantity, o_orderdate::DATE AS day,
               CASE WHEN l_returnflag <> 'N' THEN l_suppkey * 10 + l_partkey % 5 + 1 END
                 AS coupon_id,
               (l_orderkey * 7 + l_suppkey) % 12 AS d
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""

ONLINE = """
online AS (
  SELECT user_id, event_id % 100 AS merchant_id, action, coupon_id,
         CASE WHEN coupon_id = 'fixed' THEN 'fixed'
              WHEN coupon_id IS NULL THEN NULL
              WHEN event_id % 2 = 0 THEN '30:5' ELSE '0.9' END AS discount_rate_text,
         CASE WHEN coupon_id IS NOT NULL THEN day END AS date_received,
         CASE WHEN action <> 2 THEN day END AS "date"
  FROM (SELECT user_id, event_id,
               CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS action,
               CASE WHEN event_type = 'signup' THEN (event_id % 50 + 1)::VARCHAR
                    WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'fixed'
                    WHEN event_type = 'purchase' AND event_id % 4 = 1
                      THEN (event_id % 50 + 1)::VARCHAR END AS coupon_id,
               DATE '1995-01-01'
                 + (80 * (ts::DATE - DATE '2024-01-01'))::INTEGER AS day
        FROM events))"""

CLEAN = """
clean AS (
  SELECT user_id, merchant_id, coalesce(coupon_id, 0) AS coupon_id, discount_rate_text,
         coalesce(distance, 11)::INTEGER AS distance, date_received, "date",
         CASE WHEN discount_rate_text LIKE '%:%'
              THEN split_part(discount_rate_text, ':', 1)::INTEGER END AS discount_rate_x,
         CASE WHEN discount_rate_text LIKE '%:%'
              THEN split_part(discount_rate_text, ':', 2)::INTEGER END AS discount_rate_y,
         CASE WHEN discount_rate_text LIKE '%:%'
              THEN 1 - split_part(discount_rate_text, ':', 2)::DOUBLE
                       / split_part(discount_rate_text, ':', 1)::DOUBLE
              ELSE try_cast(discount_rate_text AS DOUBLE) END AS discount_rate
  FROM offline)"""

WEB = """
web AS (
  SELECT user_id, merchant_id, action, coalesce(coupon_id, '0') AS coupon_id,
         discount_rate_text, date_received, "date",
         CASE WHEN discount_rate_text = 'fixed' THEN 0.0::DOUBLE
              WHEN discount_rate_text LIKE '%:%'
              THEN 1 - split_part(discount_rate_text, ':', 2)::DOUBLE
                       / split_part(discount_rate_text, ':', 1)::DOUBLE
              ELSE try_cast(discount_rate_text AS DOUBLE) END AS discount_rate
  FROM online)"""

# (fold, label window, receipt window, purchase window) as SQL conditions.
FOLDS = [
    (
        1,
        "date_received BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'",
        "date_received <= DATE '1998-06-30'",
        "\"date\" <= DATE '1998-12-31'",
    ),
    (
        2,
        "date_received BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'",
        "date_received BETWEEN DATE '1996-01-01' AND DATE '1999-06-30'",
        "\"date\" BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
    ),
]
# Nine half years from 1997 on, each described by the year before it.
SLIDING = [
    (
        n + 1,
        "",
        f"date_received BETWEEN {start} - 365 AND {start} - 91",
        f'"date" BETWEEN {start} - 365 AND {start} - 1',
    )
    for n in range(9)
    for start in [f"(DATE '1997-01-01' + {182 * n})"]
]
PREDICT_LABEL = "date_received BETWEEN DATE '2001-01-01' AND DATE '2001-12-31'"

FLAGS = """coupon_id <> {none} AND "date" IS NOT NULL AS used,
         coupon_id <> {none} AND "date" IS NULL AS unused,
         coupon_id = {none} AND "date" IS NOT NULL AS plain,
         coupon_id <> {none} AS held"""


def _sentinel(condition: str) -> str:
    """A missing day counts as 1970-01-01, which only a window that is open at the start takes."""
    for day in ("date_received", '"date"'):
        condition = condition.replace(f"{day} <=", f"coalesce({day}, DATE '1970-01-01') <=")
    return condition


def history(
    name: str = "history",
    source: str = "clean",
    none: str = "0",
    compat: bool = False,
    folds: list | None = None,
) -> str:
    parts = []
    for fold, _, receipts, purchases in folds or FOLDS:
        if compat:
            receipts, purchases = _sentinel(receipts), _sentinel(purchases)
        parts.append(f"SELECT {fold} AS fold, * FROM {source} WHERE {receipts}")
        parts.append(
            f"SELECT {fold} AS fold, * FROM {source} WHERE coupon_id = {none} AND {purchases}"
        )
    union = "\n  UNION ALL ".join(parts)
    return f"\n{name} AS (SELECT *, {FLAGS.format(none=none)} FROM (\n  {union}))"


def scoring_history(name: str = "history", source: str = "clean", none: str = "0") -> str:
    window = "BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'"
    return (
        f"\n{name} AS (SELECT 0 AS fold, *, {FLAGS.format(none=none)} FROM {source} "
        f'WHERE (coupon_id = {none} AND "date" {window}) OR date_received {window})'
    )


LABEL = """CASE WHEN "date" - date_received <= 15 THEN 1 ELSE 0 END::INTEGER AS label"""

BATCH = "\nbatch AS (" + "\n  UNION ALL ".join(
    f"SELECT {fold} AS fold, *, {LABEL} FROM clean WHERE {label}" for fold, label, _, _ in FOLDS
) + ")"

def sliding_batch() -> str:
    """Label rows of the nine half years."""
    return "\nbatch AS (" + "\n  UNION ALL ".join(
        f"SELECT {n + 1} AS fold, *, {LABEL} FROM clean WHERE date_received BETWEEN "
        f"DATE '1997-01-01' + {182 * n} AND DATE '1997-01-01' + {182 * n + 181}"
        for n in range(9)
    ) + ")"


SCORING_BATCH = f"""
batch AS (SELECT 0 AS fold, * EXCLUDE ("date") FROM clean WHERE {PREDICT_LABEL})"""

# Equal rows are told apart by a number; any order among them gives the same set of ids.
IDENTIFIED = """
identified AS (
  SELECT *, md5(concat_ws('|', fold::VARCHAR, coalesce(user_id::VARCHAR, '~'),
             coalesce(merchant_id::VARCHAR, '~'), coalesce(coupon_id::VARCHAR, '~'),
             coalesce(discount_rate_text, '~'), coalesce(distance::VARCHAR, '~'),
             coalesce(date_received::VARCHAR, '~'), coalesce("date"::VARCHAR, '~'),
             copy_no::VARCHAR)) AS row_id
  FROM (SELECT *, row_number() OVER (PARTITION BY fold, user_id, merchant_id, coupon_id,
               discount_rate_text, distance, date_received, "date") AS copy_no
        FROM batch))"""


def fraction(text: str) -> str:
    """The first 32 bits of an MD5 as a number in [0, 1)."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


WEB_HISTORY = history("web_history", "web", "'0'")
TRAINING = [OFFLINE, CLEAN, BATCH]
WITH_HISTORY = [OFFLINE, CLEAN, history()]
WITH_WEB = [OFFLINE, CLEAN, ONLINE, WEB]
