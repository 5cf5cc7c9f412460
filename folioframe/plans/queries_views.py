"""Ordered views and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions import terms
from ..operators import views
from . import bindings as b
from .registry import SQL_DATES, SQL_SEGMENT, query

_BY_DATE = f"""WITH {SQL_DATES},
v AS (SELECT c_custkey + 1 AS key, row_number() OVER (ORDER BY coalesce(l, []), c_custkey) - 1 AS pos
      FROM customer LEFT JOIN datelists ON key = c_custkey + 1)
"""


def _by_date(spark, sf):
    return views.view(b.cust_values(spark, sf, "date"), b.cust_keys(spark, sf), [("date", True)])


@query(_BY_DATE + "SELECT key, pos FROM v")
def order_by(spark, sf):
    return _by_date(spark, sf)


@query(f"""WITH {SQL_DATES}
SELECT c_custkey + 1 AS key, row_number() OVER (
  ORDER BY 'segment/' || ({SQL_SEGMENT}), coalesce(l, []) DESC, c_custkey) - 1 AS pos
FROM customer LEFT JOIN datelists ON key = c_custkey + 1""")
def order_by_many(spark, sf):
    values = b.cust_values(spark, sf, "date", "segment")
    return views.view(values, b.cust_keys(spark, sf), [("segment", True), ("date", False)])


@query("""SELECT key, row_number() OVER (ORDER BY l, f, key) - 1 AS pos FROM (
            SELECT p_partkey + 1 AS key, split_part(p_name, ' ', 2) AS l, split_part(p_name, ' ', 1) AS f FROM part)""")
def view(spark, sf):
    """Parts by name, read as a person: last name first."""
    part = b.table(spark, sf, "part")
    person = m.person(F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    values = m.values_of(part, F.col("p_partkey") + 1, "author", F.lit(0), "person", person)
    return views.view(values, values, [("author", True)])


@query("""SELECT p_partkey + 1 AS key, split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 1) AS person_key,
                 (2000 + p_size % 2) || '0000' AS date_key, p_brand AS id_key FROM part""")
def sort_key(spark, sf):
    part = b.table(spark, sf, "part")
    person = m.person(F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    keys = part.select(
        (F.col("p_partkey") + 1).alias("key"),
        terms.sort_key(m.value("person", person)).alias("person_key"),
        terms.sort_key(m.value("date", m.partial_date(b.part_year()))).alias("date_key"),
        terms.sort_key(m.value("id", F.col("p_brand"))).alias("id_key"),
    )
    return keys.withColumn("person_key", F.replace("person_key", F.lit("\u0000"), F.lit("|")))


@query(_BY_DATE + "SELECT key, pos FROM v WHERE pos = 100")
def view_at(spark, sf):
    return views.select(b.cust_values(spark, sf, "date"), b.cust_keys(spark, sf), [("date", True)], 100)


@query(_BY_DATE + "SELECT key, pos FROM v WHERE pos BETWEEN 40 AND 59")
def view_slice(spark, sf):
    """A few rows by selection: only their range of the view is sorted."""
    return views.select(b.cust_values(spark, sf, "date"), b.cust_keys(spark, sf), [("date", True)], 40, 20)


@query(_BY_DATE + "SELECT key, pos FROM v WHERE key = 101")
def view_position(spark, sf):
    """One key by a count of what comes before it."""
    return views.position_of(b.cust_values(spark, sf, "date"), b.cust_keys(spark, sf), [("date", True)], 101)


@query(_BY_DATE + """SELECT w.key, v.pos FROM (SELECT DISTINCT user_id * 20 + 1 AS key FROM events) w
                     LEFT JOIN v ON v.key = w.key""")
def view_index(spark, sf):
    """Positions of wanted keys, some of which are not in the view."""
    wanted = b.table(spark, sf, "events").select((F.col("user_id") * 20 + 1).alias("key"))
    return views.index_of(_by_date(spark, sf), wanted)


@query(_BY_DATE + "SELECT key FROM v WHERE pos BETWEEN 50 AND 74")
def limit_page(spark, sf):
    """A page of hits: offset and limit of the ordered keys."""
    return views.first(b.cust_values(spark, sf, "date"), b.cust_keys(spark, sf), [("date", True)], 25, 50)
