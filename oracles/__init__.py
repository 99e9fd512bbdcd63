"""DuckDB SQL for every deterministic query, written from the definitions.

The SQL takes the direct route (row-level groups, distinct counts, range frames), so it shares
no plan shape with the Spark side.
"""

from __future__ import annotations

from oracles import features, reports, rows


def all_sql() -> dict[str, str]:
    return {**rows.SQL, **features.SQL, **reports.SQL}
