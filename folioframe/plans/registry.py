"""Where the queries of this package register, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# --- SQL fragments shared by the comparison queries ------------------------------------------


def sql_words(text: str, lower: bool = True) -> str:
    inner = f"lower({text})" if lower else text
    return f"list_filter(regexp_split_to_array(coalesce({inner}, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


def sql_case(column: str, names: tuple[str, ...]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names, 1)) + " END"


SQL_LANG = sql_case("lang", ("en", "fr", "de", "es"))
SQL_TITLE = "split_part(text, chr(10), 1)"
SQL_SEGMENT = sql_case("c_mktsegment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
SQL_GEO = """
geo AS (
  SELECT r_regionkey + 1 AS id, NULL AS parent, r_name AS name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name FROM customer
),
closed(ancestor, id) AS (
  SELECT id, id FROM geo
  UNION ALL SELECT c.ancestor, g.id FROM closed c JOIN geo g ON g.parent = c.id
)"""
SQL_DATES = """
dates AS (
  SELECT o_custkey + 1 AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
         strftime(o_orderdate, '%Y%m%d') AS sk, o_orderdate AS d
  FROM orders
),
datelists AS (SELECT key, list(sk ORDER BY pos) AS l FROM dates GROUP BY key)"""
