"""Citation keys and bibliographies over citation tables.

``cites`` is ``(doc, uid, at)``: document ``doc`` cites record ``uid`` at place ``at``, where
``at`` is anything that orders (a struct, a number). A document may have any number of
citations: ranks inside documents come from ``plans.scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import style
from ..model import get_field
from ..plans import scan
from ..session import cut


def first_citations(cites: DataFrame) -> DataFrame:
    """``(doc, uid, at)`` of the first citation of each record in each document."""
    return cites.groupBy("doc", "uid").agg(F.min("at").alias("at"))


def order_of(firsts: DataFrame) -> DataFrame:
    """``(doc, uid, pos)`` from first citations: order of first citation, from 1."""
    return scan.rank(firsts, ["doc"], ["at", "uid"], "pos").select("doc", "uid", "pos")


def document_order(cites: DataFrame) -> DataFrame:
    """Distinct records of each document in order of first citation."""
    return order_of(first_citations(cites))


def numeric_keys(cites: DataFrame) -> DataFrame:
    return document_order(cites).select("doc", "uid", F.col("pos").cast("string").alias("cite_key"))


def alpha_base(authors: Column, has_date: Column, year: Column) -> Column:
    """Letters of the authors and two digits of the year: ``Gar06``, ``GF06``, ``Unknown``."""
    # A person without a last name adds nothing.
    single = F.left(F.coalesce(F.try_element_at(authors, F.lit(1))["last"], F.lit("")), F.lit(3))
    letters = F.transform(
        F.slice(authors, 1, 3), lambda p: F.left(F.coalesce(p["last"], F.lit("")), F.lit(1))
    )
    names = F.when(F.size(authors) == 1, single).otherwise(F.array_join(letters, ""))
    digits = F.right(year.cast("string"), F.lit(2))
    known = F.concat(F.coalesce(names, F.lit("")), F.coalesce(digits, F.lit("")))
    return F.when(authors.isNull() & ~has_date, F.lit("Unknown")).otherwise(known)


def alpha_bases(records: DataFrame) -> DataFrame:
    """``(uid, base)`` of nested records."""
    authors = F.transform(get_field("author"), lambda v: v["person"])
    date = F.try_element_at(get_field("date"), F.lit(1))
    return records.select(F.col("key").alias("uid"), alpha_base(authors, date.isNotNull(), date["date"]["year"]).alias("base"))


def letters(n: Column) -> Column:
    """1, 2 .. 26, 27 .. to a, b .. z, aa .."""
    state = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["n"] - 1
        letter = F.chr(F.lit(97) + F.pmod(rest, F.lit(26)))
        return F.struct(
            F.when(acc["n"] > 0, F.floor(rest / 26)).otherwise(F.lit(0)).cast("bigint").alias("n"),
            F.when(acc["n"] > 0, F.concat(letter, acc["s"])).otherwise(acc["s"]).alias("s"),
        )

    # n has log26(n) letters at most, rounded up; a step with nothing left adds none.
    most = F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(26.0))) + 2
    any_number = F.aggregate(F.sequence(F.lit(1), most.cast("int")), state, step, lambda acc: acc["s"])
    # One and two letters, by far the most frequent, are plain arithmetic, which is compiled.
    last = F.chr(F.lit(97) + F.pmod(n - 1, F.lit(26)))
    two = F.concat(F.chr(F.lit(96) + F.floor((n - 1) / 26)), last)
    return F.when((n > 0) & (n <= 26), last).when((n > 26) & (n <= 702), two).otherwise(any_number)


def disambiguate(based: DataFrame) -> DataFrame:
    """``(doc, uid, at, base)`` to ``(doc, uid, cite_key)``: in each document the second
    holder of a key gets ``:a``, the third ``:b``, and so on."""
    ranked = scan.rank(based, ["doc", "base"], ["at", "uid"], "_r")
    suffix = F.when(F.col("_r") > 1, F.concat(F.lit(":"), letters(F.col("_r") - 1))).otherwise(F.lit(""))
    return ranked.select("doc", "uid", F.concat("base", suffix).alias("cite_key"))


def alpha_keys_of(firsts: DataFrame, bases: DataFrame) -> DataFrame:
    """Disambiguated keys. Citations of records that do not exist get none."""
    return disambiguate(firsts.join(bases, "uid").select("doc", "uid", "at", "base"))


def alpha_keys(cites: DataFrame, bases: DataFrame) -> DataFrame:
    return alpha_keys_of(first_citations(cites), bases)


def letters_number(text: Column) -> Column:
    """The number that ``letters`` writes as this text."""
    marks = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(marks, F.lit(0).cast("bigint"), lambda n, c: n * 26 + F.ascii(c) - 96)


def _occupied(keys: DataFrame) -> DataFrame:
    """``(doc, base, place)`` that assigned keys take: a key is place 0 of its own base, and one that
    ends like a generated key also takes that place of the base before the suffix."""
    suffix = r"(?s)^(.*):([a-z]{1,12})$"
    place = letters_number(F.regexp_extract("cite_key", suffix, 2))
    plain = F.struct(F.col("cite_key").alias("base"), F.lit(0).cast("bigint").alias("place"))
    generated = F.struct(F.regexp_extract("cite_key", suffix, 1).alias("base"), place.alias("place"))
    both = F.array_compact(F.array(plain, F.when(F.col("cite_key").rlike(suffix), generated)))
    return keys.select("doc", F.inline(both)).distinct()


def _propose(left: DataFrame, taken: DataFrame) -> DataFrame:
    """``(doc, uid, at, place, cite_key)``: the n-th record of a base gets its n-th free place.

    With the taken places t0 < t1 < .. of a base, t_j - j places are free before t_j. So free place
    number r is r plus the number of j with t_j - j <= r: a running count, over families of any size.
    """
    families = left.select("doc", "base").distinct()
    used = _occupied(taken).join(families, ["doc", "base"], "left_semi")
    nothing = {c: F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ("uid", "at")}
    gaps = scan.rank(used, ["doc", "base"], ["place"], "_r").select(
        "doc", "base", (F.col("place") - F.col("_r") + 1).alias("_free"), "place", *nothing.values()
    )
    wanted = scan.rank(left, ["doc", "base"], ["at", "uid"], "_r").select(
        "doc", "base", (F.col("_r") - 1).alias("_free"), F.lit(None).cast("bigint").alias("place"), "uid", "at"
    )
    # Taken places before records with as many free places.
    order = ["doc", "base", "_free", F.col("place").asc_nulls_last()]
    rows = scan.run(scan.place(gaps.union(wanted), order), ["doc", "base"], {"_before": ("count", F.col("place"))})
    place = F.col("_free") + F.col("_before")
    own = scan.unplace(rows).filter(F.col("place").isNull()).select("doc", "uid", "at", "base", place.alias("place"))
    suffix = F.when(F.col("place") > 0, F.concat(F.lit(":"), letters(F.col("place")))).otherwise(F.lit(""))
    return own.select("doc", "uid", "at", "base", "place", F.concat("base", suffix).alias("cite_key"))


def extend_alpha_keys(based: DataFrame, given: DataFrame) -> DataFrame:
    """``(doc, uid, cite_key)`` after a further batch of citations: every key already given stays.

    ``based`` is ``(doc, uid, at, base)``, one row for each record of a document, ``given`` the earlier
    ``(doc, uid, cite_key)``, keys of any origin. New records get, in order of citation, the first
    free one of base, base:a, base:b and so on. A key generated for one base may be a plain base
    elsewhere (``X`` and ``X:a``): the plain one has it, among generated ones the first cited, and the
    others take their next free place in a further round. Every round settles all families but
    those whose bases contain each other, so there are as many rounds as such bases are nested.
    """
    done = given.select("doc", "uid", "cite_key")
    left = cut(based.join(done.select("doc", "uid").distinct(), ["doc", "uid"], "left_anti").select("doc", "uid", "at", "base"))
    while not left.isEmpty():
        proposed = cut(_propose(left, done))
        claim = F.struct((F.col("place") > 0).alias("generated"), "at", "uid")
        first = proposed.groupBy("doc", "cite_key").agg(F.min(claim).alias("_first"))
        claims = cut(proposed.withColumn("_claim", claim).join(first, ["doc", "cite_key"]))
        done = done.union(claims.filter(F.col("_claim") == F.col("_first")).select("doc", "uid", "cite_key"))
        left = claims.filter(F.col("_claim") != F.col("_first")).select("doc", "uid", "at", "base")
    return done


def extend_numeric_keys(firsts: DataFrame, given: DataFrame) -> DataFrame:
    """``(doc, uid, cite_key)`` after a further batch: given numbers stay, new records of a document
    go on after its largest number. Given keys that are not numbers stay and are not counted."""
    done = given.select("doc", "uid", "cite_key")
    new = firsts.join(done.select("doc", "uid").distinct(), ["doc", "uid"], "left_anti")
    last = done.groupBy("doc").agg(F.max(F.col("cite_key").try_cast("bigint")).alias("_last"))
    number = F.coalesce("_last", F.lit(0).cast("bigint")) + F.col("_r")
    ranked = scan.rank(new, ["doc"], ["at", "uid"], "_r").join(last, "doc", "left")
    return done.union(ranked.select("doc", "uid", number.cast("string").alias("cite_key")))


def rekey_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys that differ between two assignments."""
    before = old.select("doc", "uid", F.col("cite_key").alias("old_key"))
    after = new.select("doc", "uid", F.col("cite_key").alias("new_key"))
    return before.join(after, ["doc", "uid"]).filter(~F.col("old_key").eqNullSafe(F.col("new_key")))


def reference_rows(records: DataFrame, items: DataFrame) -> DataFrame:
    """The columns the styles read, from nested records in the BibTeX schema."""
    first = lambda n: F.try_element_at(get_field(n), F.lit(1))
    rows = records.select(
        F.col("key").alias("uid"),
        F.transform(get_field("author"), lambda v: v["person"]).alias("authors"),
        *[first(n)["text"].alias(n) for n in ("title", "journal", "volume", "number", "pages", "abstract")],
        first("date")["date"]["year"].alias("year"),
        first("doctype")["txo"].alias("_type"),
    )
    names = items.select(
        F.col("grp").alias("_g"), F.col("id").alias("_i"), F.try_element_at("names", F.lit("C")).alias("doctype")
    )
    return rows.join(
        names, (F.col("_type.grp") == F.col("_g")) & (F.col("_type.id") == F.col("_i")), "left"
    ).drop("_type", "_g", "_i")


def bibliography(order: DataFrame, keys: DataFrame, rows: DataFrame, fmt=style.plain, out=style.text) -> DataFrame:
    """``(doc, pos, cite_key, reference)``: every citation of each document, formatted.

    A reference is formatted once per record, before it meets the citations. A citation of a
    record that does not exist keeps its place, with no reference; see ``dangling``.
    """
    formatted = rows.select("uid", fmt(out).alias("reference"))
    return (
        order.join(keys, ["doc", "uid"], "left")
        .join(formatted, "uid", "left")
        .select("doc", "pos", "cite_key", "reference")
    )


def dangling(firsts: DataFrame, records: DataFrame) -> DataFrame:
    """Violations ``(doc, uid, rule)``: citations of records that do not exist."""
    known = records.select(F.col("key").alias("uid")).distinct()
    return firsts.select("doc", "uid").join(known, "uid", "left_anti").select("doc", "uid", F.lit("unknown_record").alias("rule"))
