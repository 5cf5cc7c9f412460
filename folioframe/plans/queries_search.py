"""Scans, field access, boolean search, index, taxonomy, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions import terms
from ..operators import enrich, index, postings, search, sets, tables, taxonomy
from ..operators.search import nested
from ..session import cut, scratch_path
from . import bindings as b
from .registry import SQL_GEO, SQL_LANG, SQL_TITLE, query, sql_words

WORD = "the"
ASIA = 3
_EN = "SELECT doc_id + 1 AS key FROM documents WHERE lang = 'en'"
_LAB = "SELECT doc_id + 1 AS key FROM labels"

# --- scans and fields -----------------------------------------------------------------------

_DOC_LONG = f"""
SELECT doc_id + 1 AS key, 'title' AS attr, 0 AS pos, {SQL_TITLE} AS value FROM documents
UNION ALL SELECT doc_id + 1, 'abstract', 0, text FROM documents
UNION ALL SELECT doc_id + 1, 'language', 0, 'lang/' || ({SQL_LANG}) FROM documents
UNION ALL SELECT doc_id + 1, 'source', 0, source FROM documents
UNION ALL SELECT doc_id + 1, 'quality', 0, CAST(quality AS VARCHAR) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"""


@query(_DOC_LONG)
def scan_records(spark, sf):
    values = m.to_values(b.doc_records(spark, sf))
    return values.select("key", "attr", "pos", m.payload_text().alias("value"))


@query("SELECT count(*) AS n FROM documents")
def database_len(spark, sf):
    return search.count(b.doc_keys(spark, sf))


@query("""SELECT doc_id + 1 AS key, CAST(quality AS VARCHAR) AS quality, source
          FROM documents LEFT JOIN labels USING (doc_id)""")
def get_field(spark, sf):
    records = b.doc_records(spark, sf, "quality", "source")
    text = lambda n: F.array_join(F.transform(m.get_field(n), lambda v: v["text"]), "; ")
    return records.select("key", text("quality").alias("quality"), text("source").alias("source"))


@query("SELECT doc_id + 1 AS key, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def one_value(spark, sf):
    return b.doc_records(spark, sf, "quality").select("key", m.one_value("quality")["text"].alias("quality"))


@query("""SELECT p_partkey + 1 AS key, CASE p_size % 4 WHEN 0 THEN NULL ELSE p_size % 4 END AS n_authors
          FROM part""")
def all_values(spark, sf):
    authors = m.get_field("author")
    return b.part_records(spark, sf).select("key", F.when(authors.isNotNull(), F.size(authors)).alias("n_authors"))


@query("SELECT CAST(doc_id + 1 AS VARCHAR) AS record_key FROM documents")
def record_key(spark, sf):
    return b.doc_keys(spark, sf).select(m.record_key().alias("record_key"))


@query("""SELECT CAST(c_custkey + 1000 AS INTEGER) AS id, c_name || ' (' || c_nationkey || ')' AS en_us,
                 CASE WHEN c_acctbal > 0 THEN 'Kunde ' || c_custkey ELSE c_name END AS de
          FROM customer""")
def localized_name(spark, sf):
    """Names in three languages, where German is missing for some."""
    cust = b.table(spark, sf, "customer")
    names = F.map_filter(
        F.create_map(
            F.lit("C"), F.col("c_name"),
            F.lit("en"), F.concat("c_name", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")")),
            F.lit("de"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Kunde "), F.col("c_custkey").cast("string"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    return cust.select(
        (F.col("c_custkey") + b.PLACE_BASE).cast("int").alias("id"),
        m.localized(names, "en_US").alias("en_us"), m.localized(names, "de").alias("de"),
    )


# --- boolean search -------------------------------------------------------------------------

_HAS_WORD = f"list_contains({sql_words('text')}, '{WORD}')"


@query(f"SELECT doc_id + 1 AS key FROM documents WHERE {_HAS_WORD}")
def any_word(spark, sf):
    return search.match(b.doc_records(spark, sf), nested.any_word(WORD))


@query(f"SELECT doc_id + 1 AS key FROM documents WHERE {_HAS_WORD}")
def any_word_long(spark, sf):
    return search.match_values(b.doc_values(spark, sf, *b.DOC_FIELDS), search.any_word(WORD))


@query(f"""SELECT page_id + 1 AS key FROM pages
           WHERE list_contains({sql_words("regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", lower=False)}, 'blog')""")
def any_word_url(spark, sf):
    pages = b.table(spark, sf, "pages")
    values = m.values_of(pages, F.col("page_id") + 1, "url", F.lit(0), "url", F.col("url"))
    return search.match_values(values, search.any_word("blog"))


@query("SELECT doc_id + 1 AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def has_field(spark, sf):
    values = b.doc_values(spark, sf, "source", "quality")
    return search.match_values(values, search.has_field("quality", b.DOC_SCHEMA))


@query(f"""WITH RECURSIVE {SQL_GEO}
           SELECT o_orderkey + 1 AS key FROM orders
           WHERE o_custkey + 1000 IN (SELECT id FROM closed WHERE ancestor = {ASIA})""")
def in_taxonomy(spark, sf):
    """Orders placed anywhere in a region, by the range of places of its subtree."""
    places = cut(taxonomy.intervals(b.geo_items(spark, sf)))
    found = taxonomy.with_places(b.order_places(spark, sf), places)
    return search.match_values(found, search.in_subtree("place", taxonomy.bounds(places, "geo", ASIA)))


@query(f"""WITH RECURSIVE {SQL_GEO}
           SELECT o_orderkey + 1 AS key FROM orders
           WHERE o_custkey + 1000 IN (SELECT id FROM closed WHERE ancestor = {ASIA})""")
def in_taxonomy_stored(spark, sf):
    """The same from values stored in the order of places: the range reaches the scan."""
    places = cut(taxonomy.intervals(b.geo_items(spark, sf)))
    path = scratch_path(spark, "places")
    stored = taxonomy.with_places(b.order_places(spark, sf), places).select("key", "attr", "place")
    stored.repartitionByRange("place", "key").sortWithinPartitions("place", "key").write.parquet(path)
    low, high = taxonomy.bounds(places, "geo", ASIA)
    found = spark.read.parquet(path).filter((F.col("attr") == "place") & F.col("place").between(low, high))
    return found.select("key").distinct()


@query(f"SELECT doc_id + 1 AS key FROM documents WHERE lang = 'en' AND {_HAS_WORD}")
def q_and(spark, sf):
    """English documents that contain a word in any field: the language is pushed to the scan."""
    docs = b.documents(spark, sf).filter(F.col("lang") == b.LANGUAGES[0])
    # The quality is a text field of its own table; the title is part of the text.
    docs = docs.join(b.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("grade")), "doc_id", "left")
    found = docs.filter(search.columns.any_word(WORD, F.col("text"), F.col("grade")))
    return found.select(b.doc_key().alias("key")).distinct()


@query(f"""SELECT doc_id + 1 AS key FROM documents
           WHERE lang = 'fr' OR {_HAS_WORD}""")
def q_or(spark, sf):
    """Over nested records a tree is a filter: one scan and no shuffle of values."""
    condition = nested.in_taxonomy("language", "lang", [2]) | nested.any_word(WORD)
    return search.match(b.doc_records(spark, sf), condition)


@query(f"""SELECT doc_id + 1 AS key FROM documents
           WHERE NOT (doc_id IN (SELECT doc_id FROM labels) OR {_HAS_WORD})""")
def q_not(spark, sf):
    return search.match(b.doc_records(spark, sf), ~(nested.has_field("quality") | nested.any_word(WORD)))


@query(f"""SELECT doc_id + 1 AS key FROM documents
           WHERE n_chars % 2 = 0 AND {_HAS_WORD} AND NOT doc_id IN (SELECT doc_id FROM labels)""")
def custom_condition(spark, sf):
    """A condition of one's own is a Column and combines with the others."""
    sizes = b.table(spark, sf, "documents").select(b.doc_key().alias("key"), "n_chars")
    records = b.doc_records(spark, sf).join(sizes, "key")
    even = F.col("n_chars") % 2 == 0
    return search.match(records, even & nested.any_word(WORD) & ~nested.has_field("quality"))


@query("SELECT doc_id + 1 AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_null(spark, sf):
    """The empty condition leaves the other side of a combination as it is."""
    return search.match(b.doc_records(spark, sf, "quality"), search.all_of(None, nested.has_field("quality")))


@query(f"SELECT count(*) AS n FROM documents WHERE {_HAS_WORD} AND doc_id IN (SELECT doc_id FROM labels)")
def count_query(spark, sf):
    records = b.doc_records(spark, sf)
    return search.count(search.match(records, nested.any_word(WORD) & nested.has_field("quality")))


@query("""SELECT DISTINCT o_custkey * 2 + 1 AS key,
                 o_custkey * 2 + 1 IN (SELECT c_custkey + 1 FROM customer) AS present FROM orders""")
def has_key(spark, sf):
    wanted = b.table(spark, sf, "orders").select((F.col("o_custkey") * 2 + 1).alias("key"))
    return search.has_keys(b.cust_keys(spark, sf), wanted)


# --- index ----------------------------------------------------------------------------------

_INDEX = f"""SELECT DISTINCT term, key FROM (
  SELECT unnest({sql_words('text')}) AS term, doc_id + 1 AS key FROM documents
  UNION ALL SELECT 'lang/' || {SQL_LANG}, doc_id + 1 FROM documents
  UNION ALL SELECT CAST(quality AS VARCHAR), doc_id + 1 FROM labels) WHERE term IS NOT NULL"""


@query(f"SELECT doc_id + 1 AS key, array_to_string({sql_words('text')}, ' ') AS terms FROM documents")
def index_terms(spark, sf):
    values = b.doc_values(spark, sf, "abstract")
    return values.select("key", F.array_join(terms.value_terms(terms.ROW), " ").alias("terms"))


@query("""WITH u AS (
            SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
                   regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1),
                                  '((^|/)[.]*[^/.][^/]*)[.][^./]*$', '\\1') AS page FROM pages)
          SELECT page_id + 1 AS key, array_to_string(list_concat("""
       + sql_words("host", lower=False) + ", " + sql_words("page", lower=False)
       + "), ' ') AS terms FROM u")
def url_terms(spark, sf):
    pages = b.table(spark, sf, "pages")
    return pages.select((F.col("page_id") + 1).alias("key"), F.array_join(terms.url_words(F.col("url")), " ").alias("terms"))


@query(_INDEX)
def build_index(spark, sf):
    """Built, stored sorted by term, and read back."""
    path = scratch_path(spark, "index")
    index.write_index(index.index_rows_nested(b.doc_records(spark, sf)), path)
    return index.read_index(spark, path)


@query(f"SELECT doc_id + 1 AS key FROM documents WHERE {_HAS_WORD}")
def index_lookup(spark, sf):
    """A word through a stored index: agrees with the search by filter."""
    path = scratch_path(spark, "index")
    index.write_index(index.index_rows_nested(b.doc_records(spark, sf)), path)
    return index.lookup(index.read_index(spark, path), WORD)


_CHANGED_INDEX = f"""WITH idx AS ({_INDEX}),
           titles AS (SELECT DISTINCT unnest({sql_words(SQL_TITLE)}) AS term, doc_id + 1 AS key
                      FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
           SELECT term, key FROM idx WHERE key - 1 NOT IN (SELECT doc_id FROM labels)
           UNION ALL SELECT term, key FROM titles"""


@query(_CHANGED_INDEX)
def index_update(spark, sf):
    """Labelled documents change: the good ones keep their title only, the others are deleted."""
    rows = index.index_rows_nested(b.doc_records(spark, sf))
    titles = sets.members(b.doc_values(spark, sf, "title"), b.labelled_keys(spark, sf, 1))
    return index.update(rows, b.labelled_keys(spark, sf), titles)


@query(f"WITH idx AS ({_INDEX}) SELECT term, count(*) AS n_records FROM idx GROUP BY term")
def term_stats(spark, sf):
    return index.term_stats(index.index_rows_nested(b.doc_records(spark, sf)))


@query(f"""SELECT doc_id + 1 AS key, CAST(len(list_distinct(list_concat({sql_words('text')},
                    ['lang/' || ({SQL_LANG})], CASE WHEN quality IS NULL THEN [] ELSE [CAST(quality AS VARCHAR)] END))) AS BIGINT) AS n_terms
           FROM documents LEFT JOIN labels USING (doc_id)""")
def record_stats(spark, sf):
    return index.record_stats(index.index_rows_nested(b.doc_records(spark, sf)))


# --- stored postings ------------------------------------------------------------------------


def _store(spark, sf):
    """Postings of all documents: words, fields, languages in the tree, two result sets, the keys."""
    records = b.doc_records(spark, sf)
    places = cut(taxonomy.intervals(b.name_items(spark, "lang", b.LANGUAGES)))
    languages = taxonomy.with_places(b.doc_values(spark, sf, "language"), places)
    path = scratch_path(spark, "postings")
    rows = (
        postings.nested_word_rows(records), postings.nested_field_rows(records), postings.item_rows(languages),
        postings.set_rows(_three_sets(spark, sf)), postings.key_rows(b.doc_keys(spark, sf)),
    )
    postings.write(postings.build(*rows), path)
    return path, places


_TREE = f"""(lang = 'fr' OR {_HAS_WORD}) AND NOT doc_id IN (SELECT doc_id FROM labels)
            OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang = 'de'"""


def _tree(places):
    subtree = lambda item: postings.in_taxonomy("language", "lang", taxonomy.bounds(places, "lang", item))
    unlabelled = ~postings.has_field("quality", b.DOC_SCHEMA)
    return (subtree(2) | postings.any_word(WORD)) & unlabelled | postings.in_set(3) & subtree(3)


@query(f"SELECT doc_id + 1 AS key FROM documents WHERE {_TREE}")
def q_tree_stored(spark, sf):
    """A tree of words, fields, subtrees and sets that reads only the postings of its leaves."""
    path, places = _store(spark, sf)
    return postings.match(postings.read(spark, path), _tree(places))


@query(f"SELECT count(*) AS n FROM documents WHERE {_TREE}")
def count_stored(spark, sf):
    path, places = _store(spark, sf)
    return postings.count(postings.read(spark, path), _tree(places))


@query(f"""SELECT 'and' AS op, key FROM ({_EN} INTERSECT {_LAB})
           UNION ALL SELECT 'or', key FROM ({_EN} UNION {_LAB})
           UNION ALL SELECT 'minus', key FROM ({_EN} EXCEPT {_LAB})
           UNION ALL SELECT 'not', doc_id + 1 FROM documents WHERE lang <> 'en'""")
def set_algebra_stored(spark, sf):
    """The four operations on stored result sets."""
    path, _ = _store(spark, sf)
    stored, english, labelled = postings.read(spark, path), postings.in_set(1), postings.in_set(2)
    found = {"and": english & labelled, "or": english | labelled, "minus": english & ~labelled, "not": ~english}
    return m.union_all([postings.match(stored, c).select(F.lit(op).alias("op"), "key") for op, c in found.items()])


def _changed_store(spark, sf):
    """Labelled documents change in two segments: the good ones keep their title only, then the others
    are deleted."""
    path, places = _store(spark, sf)
    good, bad = b.labelled_keys(spark, sf, 1), b.labelled_keys(spark, sf, 0)
    titles = sets.members(b.doc_values(spark, sf, "title"), good)
    held = sets.members(b.doc_keys(spark, sf), good)
    new = postings.change(good, postings.word_rows(titles), postings.field_rows(titles), postings.key_rows(held))
    for _ in range(2):  # a change that comes twice counts once
        postings.write(new, path, segment=1)
    postings.write(postings.change(bad), path, segment=2)
    return path, places


@query(_CHANGED_INDEX)
def index_segments(spark, sf):
    """Every term of the changed store, over three segments."""
    return postings.term_keys(postings.read(spark, _changed_store(spark, sf)[0]))


@query(_CHANGED_INDEX)
def index_compacted(spark, sf):
    """The same after the two changes have become one segment; the first is not read for it."""
    path, _ = _changed_store(spark, sf)
    postings.compact(spark, path)
    return postings.term_keys(postings.read(spark, path))


@query(f"""WITH titles AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
                           AND list_contains({sql_words(SQL_TITLE)}, '{WORD}'))
           SELECT doc_id + 1 AS key FROM documents
           WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND ({_HAS_WORD}) OR doc_id IN (SELECT doc_id FROM titles)""")
def lookup_segments(spark, sf):
    """A word over all segments: deleted records are out, changed ones found by what they hold now."""
    return postings.match(postings.read(spark, _changed_store(spark, sf)[0]), postings.any_word(WORD))


# --- taxonomy -------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {SQL_GEO},
           tree(id, way) AS (
             SELECT id, [id] FROM geo WHERE parent IS NULL
             UNION ALL SELECT g.id, list_append(t.way, g.id) FROM tree t JOIN geo g ON g.parent = t.id
           ),
           sizes AS (SELECT ancestor AS id, count(*) AS size FROM closed GROUP BY ancestor)
           SELECT 'geo' AS grp, CAST(id AS INTEGER) AS id, row_number() OVER (ORDER BY way) - 1 AS "begin",
                  row_number() OVER (ORDER BY way) + size - 2 AS "end" FROM tree JOIN sizes USING (id)""")
def taxonomy_intervals(spark, sf):
    return taxonomy.intervals(b.geo_items(spark, sf))


@query(f"WITH RECURSIVE {SQL_GEO} SELECT 'geo' AS grp, CAST(ancestor AS INTEGER) AS ancestor, CAST(id AS INTEGER) AS id FROM closed")
def taxonomy_closure(spark, sf):
    return taxonomy.closure(b.geo_items(spark, sf))


@query("SELECT o_orderkey + 1 AS key, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def resolve_taxonomy(spark, sf):
    return taxonomy.resolve(b.order_places(spark, sf), b.geo_items(spark, sf)).select("key", "name")


@query("SELECT c_custkey + 1 AS key, CAST(c_custkey + 1000 AS INTEGER) AS id FROM customer")
def taxonomy_by_name(spark, sf):
    named = b.table(spark, sf, "customer").select(b.cust_key().alias("key"), "c_name")
    return taxonomy.by_name(named, b.geo_items(spark, sf), "geo", "c_name").select("key", "id")


@query("SELECT c_custkey + 1 AS key, CAST(c_nationkey + 100 AS INTEGER) AS id FROM customer")
def prune_taxonomy(spark, sf):
    """The region goes wherever the nation is given too."""
    closed = taxonomy.closure(b.geo_items(spark, sf))
    return taxonomy.prune(b.cust_values(spark, sf, "geo"), closed).select("key", "txo.id")


# --- sets -----------------------------------------------------------------------------------

@query(f"{_EN} UNION {_LAB}")
def rs_union(spark, sf):
    return sets.union(b.doc_keys_in(spark, sf, "en"), b.labelled_keys(spark, sf))


@query(f"{_EN} INTERSECT {_LAB}")
def rs_intersect(spark, sf):
    return sets.intersect(b.doc_keys_in(spark, sf, "en"), b.labelled_keys(spark, sf))


@query(f"{_EN} EXCEPT {_LAB}")
def rs_minus(spark, sf):
    return sets.minus(b.doc_keys_in(spark, sf, "en"), b.labelled_keys(spark, sf))


@query("SELECT doc_id + 1 AS key FROM documents WHERE lang <> 'en'")
def rs_complement(spark, sf):
    return sets.complement(b.doc_keys_in(spark, sf, "en"), b.doc_keys(spark, sf))


@query(f"{_EN} UNION {_LAB}")
def merge_sets(spark, sf):
    return sets.merge(b.doc_keys_in(spark, sf, "en"), b.labelled_keys(spark, sf))


def _two_sets(spark, sf):
    """Set 1: English documents. Set 2: labelled documents."""
    return sets.of(b.doc_keys_in(spark, sf, "en"), 1).union(sets.of(b.labelled_keys(spark, sf), 2))


def _three_sets(spark, sf):
    """Also set 3: labelled as good."""
    return _two_sets(spark, sf).union(sets.of(b.labelled_keys(spark, sf, 1), 3))


@query(f"""SELECT CAST(1 AS BIGINT) AS rs_id, key FROM ({_EN} UNION SELECT doc_id + 1 FROM documents WHERE lang = 'fr')
           UNION ALL SELECT 2, key FROM ({_LAB})""")
def rs_add(spark, sf):
    """Adding keys twice keeps them once."""
    french = b.doc_keys_in(spark, sf, "fr")
    return sets.add(sets.add(_two_sets(spark, sf), 1, french), 1, french)


@query(f"""SELECT CAST(1 AS BIGINT) AS rs_id, key FROM ({_EN} EXCEPT {_LAB})
           UNION ALL SELECT 2, key FROM ({_LAB})""")
def rs_remove(spark, sf):
    return sets.remove(_two_sets(spark, sf), 1, b.labelled_keys(spark, sf))


@query(f"""SELECT CAST(2 AS BIGINT) AS rs_id, 'labelled' AS name, key FROM ({_LAB})
           UNION ALL SELECT 3, 'emptied', NULL""")
def rs_save_load(spark, sf):
    """Sets are saved, replaced, dropped and emptied; the rest is listed and read."""
    path = scratch_path(spark, "sets")
    sets.save(path, 3, "emptied", b.doc_keys_in(spark, sf, "fr"))
    sets.save(path, 3, "emptied", b.doc_keys_in(spark, sf, "none"))
    sets.save(path, 1, "english", b.doc_keys_in(spark, sf, "en"))
    sets.save(path, 2, "labelled", b.doc_keys_in(spark, sf, "de"))
    sets.save(path, 2, "labelled", b.labelled_keys(spark, sf))
    sets.drop(spark, path, 1)
    return sets.listing(spark, path).join(sets.load(spark, path), "rs_id", "left").select("rs_id", "name", "key")


@query(f"SELECT CAST(1 AS BIGINT) AS rs_id, count(*) AS n FROM ({_EN}) UNION ALL SELECT 2, count(*) FROM ({_LAB})")
def set_len(spark, sf):
    return sets.sizes(_two_sets(spark, sf))


@query(f"SELECT doc_id + 1 AS key, {SQL_TITLE} AS title FROM documents WHERE lang = 'en'")
def members_of(spark, sf):
    values = sets.members(b.doc_values(spark, sf, "title"), b.doc_keys_in(spark, sf, "en"))
    return values.select("key", F.col("text").alias("title"))


@query(f"SELECT CAST(2 AS BIGINT) AS rs_id, key FROM ({_LAB} EXCEPT {_EN})")
def rs_cascade(spark, sf):
    return sets.cascade(_two_sets(spark, sf), b.doc_keys_in(spark, sf, "en"))


@query(f"""WITH kept AS (SELECT doc_id + 1 AS key, {SQL_TITLE} AS title FROM documents WHERE lang <> 'en')
           SELECT 'values' AS part, key, title AS detail FROM kept
           UNION ALL SELECT 'index', key, term FROM (SELECT DISTINCT unnest({sql_words('title')}) AS term, key FROM kept)
           UNION ALL SELECT 'member', key, '2' FROM kept WHERE key IN ({_LAB})""")
def rs_destroy(spark, sf):
    """Destroying a set deletes its records everywhere: every row that is left."""
    values = b.doc_values(spark, sf, "title")
    return tables.listed(*sets.destroy(values, index.index_rows(values), _two_sets(spark, sf), 1))


# --- collate and arity ----------------------------------------------------------------------


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source")
def collate(spark, sf):
    return sets.part_sizes(sets.collate_nested(b.doc_records(spark, sf, "source"), "source"))


@query("""SELECT CAST(quality AS VARCHAR) AS value, doc_id + 1 AS key
          FROM documents LEFT JOIN labels USING (doc_id)""")
def collate_members(spark, sf):
    """Records without the field come under NULL."""
    return sets.collate(b.doc_values(spark, sf, "quality"), "quality", b.doc_keys(spark, sf))


@query("""SELECT c_custkey + 1 AS key, 'geo' AS attr, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS n FROM customer
          UNION ALL SELECT o_custkey + 1, 'date', count(*) FROM orders GROUP BY o_custkey""")
def field_arity(spark, sf):
    return sets.field_arity(b.cust_values(spark, sf, "geo", "date"))


# --- identifiers ----------------------------------------------------------------------------

_ENRICHED = """
ref AS (SELECT lower(p_name) AS t, replace(lower(p_brand), '#', ' ') AS l, lower(p_type) AS v, p_size AS p, 2000 + p_size % 2 AS y,
               '10.1/' || p_partkey AS i FROM part),
hits AS (SELECT t, l, v, p, y, count(*) AS n, min(i) AS i FROM ref GROUP BY t, l, v, p, y),
enriched AS (
  SELECT l_orderkey, l_linenumber, l_partkey, coalesce(n, 0) AS n_hits, CASE WHEN n = 1 THEN i END AS found
  FROM lineitem JOIN part ON l_partkey = p_partkey
  LEFT JOIN hits ON t = CASE l_linenumber WHEN 1 THEN NULL ELSE lower(p_name) END AND l = replace(lower(p_brand), '#', ' ')
    AND v = lower(p_type) AND p = CASE l_linenumber WHEN 2 THEN p_size + 1000 ELSE p_size END AND y = 2000 + p_size % 2)"""


def _enriched(spark, sf):
    """Each line item is a request with the coordinates of its part, but the first lines have no
    title and the second another page; the reference holds all parts, some with equal coordinates."""
    part = b.table(spark, sf, "part")
    size, year = F.col("p_size"), F.lit(2000) + F.col("p_size") % 2
    coords = lambda title, page: enrich.coordinates(title, F.col("p_brand"), F.col("p_type"), page, year)
    reference = part.select(
        *coords(F.col("p_name"), size), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("identifier")
    )
    requests = b.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = F.col("l_linenumber")
    asked = coords(F.when(line != 1, F.col("p_name")), F.when(line == 2, size + 1000).otherwise(size))
    records = requests.select((F.col("l_partkey") + 1).alias("key"), *asked)
    return enrich.enrich_identifiers(records, reference)


@query(f"WITH {_ENRICHED} SELECT l_partkey + 1 AS key, n_hits, found FROM enriched")
def enrich_identifiers(spark, sf):
    return _enriched(spark, sf)


@query(f"""WITH {_ENRICHED} SELECT count(*) FILTER (n_hits = 1) AS resolved, count(*) FILTER (n_hits = 0) AS unknown,
           count(*) FILTER (n_hits > 1) AS ambiguous FROM enriched""")
def enrich_statistics(spark, sf):
    return enrich.statistics(_enriched(spark, sf))
