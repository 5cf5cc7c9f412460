"""Finding an external identifier by bibliographic coordinates, for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDINATES = ("title", "last", "volume", "page", "year")


def coordinates(title: Column, last: Column, volume: Column, page: Column, year: Column) -> list[Column]:
    """Comparable forms: lower case, one blank for every run of other characters."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    given = (title, last, volume, page, year)
    return [plain(c).alias(n) for c, n in zip(given, COORDINATES)]


def enrich_identifiers(records: DataFrame, reference: DataFrame) -> DataFrame:
    """``(key, n_hits, found)``: ``found`` is the identifier when there is exactly one.

    The reference is reduced to one row per coordinates first, so many records and many
    entries with the same coordinates do not multiply. Without a title or a last name there
    is nothing to look for: such records are unknown, and such entries are never found.
    """
    given = (F.col("title") != "") & (F.col("last") != "")
    hits = reference.filter(given).groupBy(*COORDINATES).agg(
        F.count_distinct("identifier").alias("n_hits"), F.min("identifier").alias("_one")
    )
    rows = records.select("key", *COORDINATES)
    found = rows.filter(given).join(hits, list(COORDINATES), "left").select("key", "n_hits", "_one")
    nothing = rows.filter(~given).select("key", F.lit(None).cast("bigint").alias("n_hits"), F.lit(None).cast("string").alias("_one"))
    return found.unionByName(nothing).select(
        "key",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.when(F.col("n_hits") == 1, F.col("_one")).alias("found"),
    )


def statistics(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count_if(F.col("n_hits") == 1).alias("resolved"),
        F.count_if(F.col("n_hits") == 0).alias("unknown"),
        F.count_if(F.col("n_hits") > 1).alias("ambiguous"),
    )
