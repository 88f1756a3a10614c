"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Views of the driver's tables, as common table expressions.
VIEWS = {
    "pts_li": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS y, CAST(round(l_discount * 100) AS BIGINT) AS z,
        CAST(round(l_tax * 100) AS BIGINT) AS tax, l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_linenumber AS BIGINT) AS linenumber,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS shipday FROM lineitem""",
    "pts_emb": "SELECT vec_id AS pos, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS label FROM embeddings",
    "scan_ev": "SELECT event_id AS pos, user_id AS sid, epoch_us(ts) AS gps, event_type AS cls, CAST(round(value * 100) AS BIGINT) AS val FROM events",
    "planted": "SELECT *, CAST(7 AS BIGINT) AS k7, partkey AS dup, 3 * suppkey + 5 AS aff, partkey + pos % 4 AS res FROM pts_li",
}


def with_views(sql: str, *names: str) -> str:
    """sql (SELECT ... or name AS (...), ... SELECT ...) after the views that it reads."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {ctes}{' ' if body.upper().startswith('SELECT') else ', ' if ctes else ''}{body}"


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views or not sql.upper().startswith("SELECT") else sql
        return f

    return put
