"""Record tables made from the shipped tables: which column plays which field.

Keys are the table keys plus 1, as record keys are positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as m
from . import scan

LANGUAGES = ("en", "fr", "de", "es")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
# Document types of the BibTeX schema; the position is the id.
DOCTYPES = (
    "article", "book", "booklet", "inbook", "incollection", "inproceedings", "manual",
    "mastersthesis", "misc", "phdthesis", "proceedings", "techreport", "unpublished",
)
PART_TYPES = {"ECONOMY": "article", "SMALL": "book", "PROMO": "manual", "LARGE": "misc",
              "MEDIUM": "techreport", "STANDARD": "unpublished"}
NATION_BASE, PLACE_BASE = 100, 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def code_of(column: Column, names_: tuple[str, ...]) -> Column:
    """Position from 1 in a short fixed list; NULL for other strings."""
    found = F.array_position(F.array(*[F.lit(n) for n in names_]), column)
    return F.when(found > 0, found).cast("int")


def name_items(spark: SparkSession, grp: str, names_: tuple[str, ...]) -> DataFrame:
    """A flat taxonomy from a fixed list of names."""
    rows = [(grp, i, None, {"C": n}) for i, n in enumerate(names_, 1)]
    return spark.createDataFrame(rows, "grp string, id int, parent int, names map<string,string>")


# --- documents ------------------------------------------------------------------------------


def doc_key() -> Column:
    return F.col("doc_id") + 1


def doc_title() -> Column:
    return F.split_part("text", F.lit("\n"), F.lit(1))


DOC_FIELDS = ("title", "abstract", "language", "source", "quality")


def doc_records(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Nested records: title, abstract, language, source, and quality where it is labelled.
    With ``fields`` only those: the scan then reads only their columns."""
    docs = documents(spark, sf) if not fields or {"title", "abstract"} & set(fields) else table(spark, sf, "documents")
    if not fields or "quality" in fields:
        docs = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    make = {
        "title": lambda: m.value("text", doc_title()),
        "abstract": lambda: m.value("text", F.col("text")),
        "language": lambda: m.value("txo", m.txo("lang", code_of(F.col("lang"), LANGUAGES))),
        "source": lambda: m.value("id", F.col("source")),
        "quality": lambda: m.value("text", F.col("quality").cast("string")),
    }
    chosen = {f: m.one(make[f]()) for f in (fields or DOC_FIELDS)}
    return docs.select(doc_key().alias("key"), m.attributes(**chosen).alias("attrs"))


def doc_values(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Long form of the chosen fields only, so that the scans read only their columns."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    zero = F.lit(0)
    make = {
        "title": lambda: m.values_of(docs, doc_key(), "title", zero, "text", doc_title()),
        "abstract": lambda: m.values_of(documents(spark, sf).select("doc_id", "text"), doc_key(), "abstract", zero, "text", F.col("text")),
        "language": lambda: m.values_of(docs, doc_key(), "language", zero, "txo", m.txo("lang", code_of(F.col("lang"), LANGUAGES))),
        "source": lambda: m.values_of(docs, doc_key(), "source", zero, "id", F.col("source")),
        "quality": lambda: m.values_of(labels, doc_key(), "quality", zero, "text", F.col("quality").cast("string")),
    }
    return m.union_all([make[f]() for f in fields])


def doc_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(doc_key().alias("key"))


def doc_keys_in(spark: SparkSession, sf: str, lang: str) -> DataFrame:
    return table(spark, sf, "documents").filter(F.col("lang") == lang).select(doc_key().alias("key"))


def labelled_keys(spark: SparkSession, sf: str, quality: int | None = None) -> DataFrame:
    labels = table(spark, sf, "labels")
    if quality is not None:
        labels = labels.filter(F.col("quality") == quality)
    return labels.select(doc_key().alias("key"))


DOC_SCHEMA = m.Schema(
    "documents",
    {
        "title": m.Attribute("text", max_n=1, indexed=True),
        "abstract": m.Attribute("text", indexed=True),
        "language": m.Attribute("txo", grp="lang", max_n=1),
        "source": m.Attribute("id"),
        "quality": m.Attribute("text"),
    },
)


# --- customers ------------------------------------------------------------------------------


def geo_items(spark: SparkSession, sf: str) -> DataFrame:
    """A taxonomy of places: region > nation > customer. It grows with the customers."""
    named = lambda c: F.create_map(F.lit("C"), c)
    part = lambda df, id_, parent, name: df.select(
        F.lit("geo").alias("grp"), id_.cast("int").alias("id"), parent.cast("int").alias("parent"), named(name).alias("names")
    )
    return m.union_all(
        [
            part(table(spark, sf, "region"), F.col("r_regionkey") + 1, F.lit(None), F.col("r_name")),
            part(table(spark, sf, "nation"), F.col("n_nationkey") + NATION_BASE, F.col("n_regionkey") + 1, F.col("n_name")),
            part(table(spark, sf, "customer"), F.col("c_custkey") + PLACE_BASE, F.col("c_nationkey") + NATION_BASE, F.col("c_name")),
        ]
    )


def cust_key() -> Column:
    return F.col("c_custkey") + 1


def cust_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(cust_key().alias("key"))


def cust_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of the orders of a customer, in order of the order key."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = scan.rank(orders, ["o_custkey"], ["o_orderkey"], "_r")
    d = F.col("o_orderdate")
    return m.values_of(
        ranked, F.col("o_custkey") + 1, "date", F.col("_r") - 1, "date",
        m.partial_date(F.year(d), F.month(d), F.dayofmonth(d)),
    )


def cust_values(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    cust = table(spark, sf, "customer")
    nations = table(spark, sf, "nation")
    zero = F.lit(0)

    def geo() -> DataFrame:
        """The nation, and the region as well for customers with money."""
        own = m.values_of(cust, cust_key(), "geo", zero, "txo", m.txo("geo", F.col("c_nationkey") + NATION_BASE))
        rich = cust.filter(F.col("c_acctbal") > 0).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return own.unionByName(
            m.values_of(rich, cust_key(), "geo", F.lit(1), "txo", m.txo("geo", F.col("n_regionkey") + 1))
        )

    make = {
        "name": lambda: m.values_of(cust, cust_key(), "name", zero, "text", F.col("c_name")),
        "segment": lambda: m.values_of(cust, cust_key(), "segment", zero, "txo", m.txo("segment", code_of(F.col("c_mktsegment"), SEGMENTS))),
        "geo": geo,
        "date": lambda: cust_dates(spark, sf),
    }
    return m.union_all([make[f]() for f in fields])


# --- orders ---------------------------------------------------------------------------------


def order_places(spark: SparkSession, sf: str) -> DataFrame:
    """One record per order, with the place of its customer."""
    return m.values_of(
        table(spark, sf, "orders"), F.col("o_orderkey") + 1, "place", F.lit(0), "txo",
        m.txo("geo", F.col("o_custkey") + PLACE_BASE),
    )


# --- parts as bibliographic records ---------------------------------------------------------


def part_author(first: Column, last: Column) -> Column:
    return m.value("person", m.person(F.initcap(last), F.initcap(first)))


def part_year() -> Column:
    return F.lit(2000) + F.col("p_size") % 2


def part_doctype() -> Column:
    name = F.lit(None).cast("string")
    for kind, doctype in PART_TYPES.items():
        name = F.when(F.col("p_type") == kind, F.lit(doctype)).otherwise(name)
    return name


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records in the BibTeX schema. The size gives the number of authors (0 to 3): the
    name read as first and last name, the type, the brand."""
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("b"))
    people = F.array(
        part_author(first, last), part_author(brand, F.col("p_type")), part_author(F.col("p_type"), brand)
    )
    n = (F.col("p_size") % 4).cast("int")
    text = lambda c: m.one(m.value("text", c.cast("string")))
    is_article = F.col("p_type") == "ECONOMY"
    return table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("key"),
        m.attributes(
            id=m.one(m.value("id", F.concat(F.lit("part"), F.col("p_partkey").cast("string")))),
            doctype=m.one(m.value("txo", m.txo("doctype", code_of(part_doctype(), DOCTYPES)))),
            author=F.slice(people, F.lit(1), n),
            title=text(F.concat(F.col("p_brand"), F.lit(" & "), F.col("p_name"))),
            journal=text(F.when(is_article, F.concat(F.lit("Journal of "), F.initcap(F.col("p_name"))))),
            volume=text(F.when(is_article, F.col("p_size"))),
            number=text(F.when(is_article & (F.col("p_size") > 25), F.col("p_size") - 25)),
            pages=text(F.when(is_article, F.concat_ws("-", F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string")))),
            date=m.one(m.value("date", F.when((F.col("p_size") != 7) & (F.col("p_size") % 8 != 4), m.partial_date(part_year())))),
        ).alias("attrs"),
    )


def doctype_items(spark: SparkSession) -> DataFrame:
    return name_items(spark, "doctype", DOCTYPES)


# --- citations ------------------------------------------------------------------------------


def cites(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier is a document that cites the parts of its line items."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc"),
        (F.col("l_partkey") + 1).alias("uid"),
        F.struct("l_orderkey", "l_linenumber").alias("at"),
    )


# --- changes --------------------------------------------------------------------------------

CHANGES = {"signup": "add", "view": "update", "click": "update", "purchase": "update", "error": "delete"}


def feed(events: DataFrame) -> DataFrame:
    """``(key, seq, op, payload)`` changes from the events."""
    op = F.lit(None).cast("string")
    for kind, change in CHANGES.items():
        op = F.when(F.col("event_type") == kind, F.lit(change)).otherwise(op)
    return events.select(
        (F.col("user_id") + 1).alias("key"),
        F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id")).alias("seq"),
        op.alias("op"),
        F.col("props").alias("payload"),
    )
