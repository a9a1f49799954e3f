"""Registered queries by name, each with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tables that the SQL derives as the fixtures do.
REQ = "req AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS request_id, epoch_us(ts) // 1000 AS impr_time, CAST(event_id AS VARCHAR) AS search_id, event_id % 7 AS scene_id FROM events WHERE event_type = 'signup')"
ITEM = "item AS (SELECT o_custkey AS user_id, o_orderkey AS item_id, CAST(o_orderstatus = 'F' AS BIGINT) AS label FROM orders)"
FLAT = f"{REQ}, {ITEM}, flat AS (SELECT *, row_number() OVER (PARTITION BY user_id, request_id ORDER BY item_id) - 1 AS candidate_position FROM req JOIN item USING (user_id))"
SEEN = "seen AS (SELECT r.user_id, r.request_id, r.impr_time, e.event_type AS stream, e.event_id AS id, epoch_us(e.ts) // 1000 AS t FROM req r JOIN events e ON e.user_id = r.user_id AND e.event_type IN ('click', 'view', 'purchase') AND epoch_us(e.ts) // 1000 <= r.impr_time WHERE r.user_id IN (SELECT o_custkey FROM orders))"
SCORED = "scored AS (SELECT l_orderkey AS group_id, l_linenumber AS line, round((l_quantity - 25) / 10 - (l_discount - 0.05) * 20, 6) AS logit, CAST(l_returnflag = 'R' AS INT) AS label, l_linestatus AS scenario, l_suppkey AS user_id FROM lineitem)"
#: Macro-like texts: signed to unsigned and back, the 64-bit mix, a product modulo 2**64.
MASK = "18446744073709551616"


def unsigned(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN CAST({x} AS HUGEINT) + {MASK} ELSE CAST({x} AS HUGEINT) END)"


def signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN {x} - {MASK} ELSE {x} END AS BIGINT)"


def mixed(x: str, source: str, keep: str = "") -> str:
    """A query that adds the unsigned mix ``h`` of the column expression ``x`` to rows of ``source``."""
    keep = f"{keep}, " if keep else ""
    product = lambda v, f: f"CAST((CAST({v} AS UHUGEINT) * CAST('{f}' AS UHUGEINT)) % CAST('{MASK}' AS UHUGEINT) AS HUGEINT)"
    return (
        f"(SELECT {keep}xor(c, c >> 31) AS h FROM (SELECT {keep}{product('b', 0x94D049BB133111EB)} AS c FROM (SELECT {keep}xor(a, a >> 27) AS b FROM "
        f"(SELECT {keep}{product('z', 0xBF58476D1CE4E5B9)} AS a FROM (SELECT {keep}xor(u, u >> 30) AS z FROM (SELECT {keep}{unsigned(x)} AS u FROM {source}))))))"
    )


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(values: Column | str) -> Column:
    """A list as text."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",", "null")
