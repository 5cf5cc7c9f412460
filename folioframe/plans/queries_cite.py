"""Citation keys and bibliographies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style
from ..operators import cite
from ..session import cut
from ..sinks import bibliography as sink
from . import bindings as b
from .queries_clean import SQL_REFS, reference_rows
from .registry import query

_FIRST = """
first AS (SELECT l_suppkey AS doc, l_partkey + 1 AS uid, min({'o': l_orderkey, 'n': l_linenumber}) AS place
          FROM lineitem GROUP BY l_suppkey, l_partkey),
ordered AS (SELECT doc, uid, row_number() OVER (PARTITION BY doc ORDER BY place, uid) AS pos FROM first)"""
_ALPHA = f"""{SQL_REFS}, {_FIRST},
bases AS (SELECT uid, CASE WHEN n = 0 AND year IS NULL THEN 'Unknown' ELSE
            coalesce(CASE n WHEN 0 THEN '' WHEN 1 THEN left(authors[1].l, 3)
                     ELSE array_to_string(list_transform(authors, lambda x: left(x.l, 1)), '') END, '')
            || coalesce(right(year, 2), '') END AS base FROM refs),
clashes AS (SELECT doc, uid, base, row_number() OVER (PARTITION BY doc, base ORDER BY place, uid) - 1 AS r
            FROM first JOIN bases USING (uid)),
alpha AS (SELECT doc, uid, base || CASE WHEN r = 0 THEN '' WHEN r <= 26 THEN ':' || chr(CAST(96 + r AS INTEGER))
            ELSE ':' || chr(CAST(96 + (r - 1) // 26 AS INTEGER)) || chr(CAST(97 + (r - 1) % 26 AS INTEGER)) END AS cite_key FROM clashes)"""


def _alpha(spark, sf):
    return cite.alpha_keys(b.cites(spark, sf), cite.alpha_bases(b.part_records(spark, sf)))


@query(f"WITH {_FIRST} SELECT doc, uid, pos FROM ordered")
def document_order(spark, sf):
    return cite.document_order(b.cites(spark, sf))


@query(f"WITH {_FIRST} SELECT doc, uid, CAST(pos AS VARCHAR) AS cite_key FROM ordered")
def numeric_keys(spark, sf):
    return cite.numeric_keys(b.cites(spark, sf))


@query(f"WITH {_ALPHA} SELECT uid, base FROM bases")
def alpha_bases(spark, sf):
    return cite.alpha_bases(b.part_records(spark, sf))


@query(f"WITH {_ALPHA} SELECT doc, uid, cite_key FROM alpha")
def alpha_keys(spark, sf):
    return _alpha(spark, sf)


@query("""WITH r AS (SELECT p_partkey + 1 AS uid, p_brand AS base,
                            row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size, p_partkey) - 1 AS r, p_type AS doc FROM part)
          SELECT doc, uid, base || CASE WHEN r = 0 THEN '' WHEN r <= 26 THEN ':' || chr(CAST(96 + r AS INTEGER))
            ELSE ':' || chr(CAST(96 + (r - 1) // 26 AS INTEGER)) || chr(CAST(97 + (r - 1) % 26 AS INTEGER)) END AS cite_key FROM r""")
def disambiguate_keys(spark, sf):
    """Parts clash on their brand inside a type."""
    return cite.disambiguate(
        b.table(spark, sf, "part").select(
            F.col("p_type").alias("doc"), (F.col("p_partkey") + 1).alias("uid"), F.col("p_size").alias("at"), F.col("p_brand").alias("base")
        )
    )


@query(f"""WITH {_FIRST},
           shipped AS (SELECT l_suppkey AS doc, l_partkey + 1 AS uid, min({{'o': l_orderkey, 'n': l_linenumber}}) AS place
                       FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey, l_partkey),
           later AS (SELECT doc, uid, row_number() OVER (PARTITION BY doc ORDER BY place, uid) AS pos FROM shipped)
           SELECT doc, uid, CAST(o.pos AS VARCHAR) AS old_key, CAST(n.pos AS VARCHAR) AS new_key
           FROM ordered o JOIN later n USING (doc, uid) WHERE o.pos <> n.pos""")
def rekey_changed(spark, sf):
    """Keys that change when the documents keep only some of their citations."""
    lines = b.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "F")
    fewer = lines.select(
        F.col("l_suppkey").alias("doc"), (F.col("l_partkey") + 1).alias("uid"), F.struct("l_orderkey", "l_linenumber").alias("at")
    )
    return cite.rekey_changed(cite.numeric_keys(b.cites(spark, sf)), cite.numeric_keys(fewer))


def _earlier(spark, sf):
    """First citations of the first batch: line items that are finished."""
    lines = b.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "F")
    return cite.first_citations(
        lines.select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") + 1).alias("uid"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    )


@query(f"""WITH {_ALPHA},
           earlier AS (SELECT l_suppkey AS doc, l_partkey + 1 AS uid, min({{'o': l_orderkey, 'n': l_linenumber}}) AS place
                       FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey, l_partkey),
           given AS (SELECT * FROM (SELECT doc, uid, base, row_number() OVER (PARTITION BY doc, base ORDER BY place, uid) - 1 AS r
                                    FROM earlier JOIN bases USING (uid)) WHERE uid % 3 <> 0),
           fresh AS (SELECT doc, uid, base, row_number() OVER (PARTITION BY doc, base ORDER BY place, uid) - 1 AS n
                     FROM first JOIN bases USING (uid) ANTI JOIN given USING (doc, uid)),
           free AS (SELECT doc, base, r, row_number() OVER (PARTITION BY doc, base ORDER BY r) - 1 AS n
                    FROM (SELECT doc, base, unnest(range(0, CAST(max(m) AS BIGINT))) AS r
                          FROM (SELECT doc, base, count(*) + max(n) + 1 AS m FROM fresh GROUP BY doc, base
                                UNION ALL SELECT doc, base, f.k + g.top + 2
                                FROM (SELECT doc, base, count(*) AS k FROM fresh GROUP BY doc, base) f
                                JOIN (SELECT doc, base, max(r) AS top FROM given GROUP BY doc, base) g USING (doc, base))
                          GROUP BY doc, base)
                    ANTI JOIN given USING (doc, base, r)),
           every AS (SELECT doc, uid, base, r FROM given UNION ALL SELECT doc, uid, base, r FROM fresh JOIN free USING (doc, base, n))
           SELECT doc, uid, base || CASE WHEN r = 0 THEN '' WHEN r <= 26 THEN ':' || chr(CAST(96 + r AS INTEGER))
             ELSE ':' || chr(CAST(96 + (r - 1) // 26 AS INTEGER)) || chr(CAST(97 + (r - 1) % 26 AS INTEGER)) END AS cite_key FROM every""")
def kept_alpha_keys(spark, sf):
    """Keys of a first batch, a third of them lost, stay when all citations come."""
    bases = cite.alpha_bases(b.part_records(spark, sf))
    given = cite.alpha_keys_of(_earlier(spark, sf), bases).filter(F.col("uid") % 3 != 0)
    return cite.extend_alpha_keys(cite.first_citations(b.cites(spark, sf)).join(bases, "uid"), cut(given))


@query(f"""WITH {_FIRST},
           given AS (SELECT doc, uid, row_number() OVER (PARTITION BY doc ORDER BY place, uid) AS n FROM (
                       SELECT l_suppkey AS doc, l_partkey + 1 AS uid, min({{'o': l_orderkey, 'n': l_linenumber}}) AS place
                       FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey, l_partkey)),
           fresh AS (SELECT doc, uid, row_number() OVER (PARTITION BY doc ORDER BY place, uid) AS n FROM first ANTI JOIN given USING (doc, uid))
           SELECT doc, uid, CAST(n AS VARCHAR) AS cite_key FROM given
           UNION ALL SELECT doc, uid, CAST(n + coalesce(last, 0) AS VARCHAR)
           FROM fresh LEFT JOIN (SELECT doc, max(n) AS last FROM given GROUP BY doc) USING (doc)""")
def kept_numeric_keys(spark, sf):
    """Numbers of a first batch stay when all citations come."""
    given = cite.order_of(_earlier(spark, sf)).select("doc", "uid", F.col("pos").cast("string").alias("cite_key"))
    return cite.extend_numeric_keys(cite.first_citations(b.cites(spark, sf)), cut(given))


def _bibliography(spark, sf, out):
    order = cite.document_order(b.cites(spark, sf))
    keys = order.select("doc", "uid", F.col("pos").cast("string").alias("cite_key"))
    return cite.bibliography(order, keys, reference_rows(spark, sf), style.plain, out)


@query(f"""WITH {_ALPHA}, texts AS (SELECT uid, concat_ws('. ', who, title, place) || '.' AS reference FROM styled)
           SELECT doc, pos, cite_key, reference FROM ordered JOIN alpha USING (doc, uid) JOIN texts USING (uid)""")
def bibliography(spark, sf):
    """All documents with their alphabetic keys."""
    # Order and keys both start from the first citations: reduce the citations once.
    firsts = cut(cite.first_citations(b.cites(spark, sf)))
    keys = cite.alpha_keys_of(firsts, cite.alpha_bases(b.part_records(spark, sf)))
    return cite.bibliography(cite.order_of(firsts), keys, reference_rows(spark, sf))


@query(f"""WITH {SQL_REFS}, {_FIRST}
           SELECT doc, pos, '<tr><td>[' || pos || ']</td><td>' || concat_ws('. ', who, title_html, place_html) || '.</td></tr>' AS line
           FROM ordered JOIN styled USING (uid)
           UNION ALL SELECT doc, 0, '<table>' FROM ordered GROUP BY doc
           UNION ALL SELECT doc, max(pos) + 1, '</table>' FROM ordered GROUP BY doc""")
def bibliography_html(spark, sf):
    return sink.html_lines(_bibliography(spark, sf, style.html))


@query(f"""WITH {SQL_REFS}, {_FIRST}
           SELECT doc, pos, '[' || pos || '] ' || concat_ws('. ', who, title, place) || '.' AS line FROM ordered JOIN styled USING (uid)""")
def bibliography_text(spark, sf):
    return sink.text_lines(_bibliography(spark, sf, style.text))
