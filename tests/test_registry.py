import os

import pytest

import __spark_entry__ as registry
import check_queries

SMALL = "/root/testdata/sf0.001"
# One query of each kind; FOLIO_ALL=1 runs them all.
CHOSEN = ("q_and", "in_taxonomy", "index_update", "order_by", "add_records", "validate_records", "fold_fields", "clean_persons",
          "style_plain", "alpha_keys", "ingest_ris", "change_feed_apply")


def test_names_agree():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
    assert set(CHOSEN) <= set(queries)


def test_entry(spark):
    assert registry.entry(spark).columns == ["key"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.queries()) if os.environ.get("FOLIO_ALL") else CHOSEN)
def test_query_agrees_with_sql(spark, name):
    assert check_queries.compare(spark, check_queries.duck(SMALL), SMALL, name) == ""
