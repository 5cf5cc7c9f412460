"""The operators as registered queries over their whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    exact_dedup,
    html_extract,
    langid,
    lm_score,
    merkle,
    packing,
    phrases,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    # A file on the driver; Spark's own file server gives it to the executors.
    file = Path(tempfile.mkdtemp(prefix="ship-")) / "folioframe.zip"
    with zipfile.ZipFile(file, "w") as archive:
        for source in sorted((root / "folioframe").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    context.addPyFile(str(file))
    context._llm_shipped = True


def documents(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


# The vocabulary is a file.
@query()
def op1_longest_match_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"))


# Removed bytes are judged byte by byte on all pairs of places, which SQL does not do on whole tables.
@query()
def op2_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf), length=400, keep="none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# The weights come from an iteration; the base columns alone are compared in the tests.
@query()
def op3_deleted_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(documents(spark, sf))


# Token ids come from a tokenizer file.
@query()
def op4_harmonic_packing(spark: SparkSession, sf: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    return packing.pack(documents(spark, sf), *paths)


# A fitted model.
@query()
def op5_string_kernel_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(documents(spark, sf), folds=5, held_out=0)


# Fertility figures come from a tokenizer file.
@query()
def op6_tokenizer_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return quality.measure(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    """
WITH texts AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN groups USING (text_sha256)
"""
)
def op7_tree_merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.classify(documents(spark, sf), largest=True)


# Ranks come from a tokenizer file.
@query()
def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(documents(spark, sf), path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# A fitted model.
@query()
def op9_crf_html_text(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet"))


# XXH64 and the transitive closure over all fingerprints have no SQL that ends on whole tables.
@query()
def op10_simhash_bk_tree(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# The nested list_reduce is the cyclic redundancy check of the decimal id, of which one bit is needed
# (its complement at the end turns that bit round).
@query(
    """
WITH RECURSIVE docs AS (
    SELECT doc_id, source,
        concat(
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
            coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'),
            coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        text,
        list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))
            & 1 = 1 AS tampered
    FROM documents
),
leaves AS (
    SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
        CASE WHEN tampered THEN sha256(concat(head,
            coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) END AS shown
    FROM docs
),
placed AS (
    SELECT doc_id, source, leaf, coalesce(shown, leaf) AS presented,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM leaves
),
nodes AS (
    SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n
),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
    SELECT 0 AS level, tree AS pos, digest, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3
    FROM uppers WHERE n > 1 GROUP BY level, pos // 3, n
),
low AS (
    SELECT tree, pos AS leaf_pos, 0 AS level, pos, n, presented AS node, '' AS proof FROM placed
    UNION ALL
    SELECT r.tree, leaf_pos, r.level + 1, r.pos // 3, (r.n + 2) // 3,
        sha256(concat(
            CASE WHEN r.pos % 3 = 0 THEN r.node ELSE a.digest END,
            CASE WHEN r.pos % 3 = 1 THEN r.node ELSE b.digest END,
            CASE WHEN r.pos % 3 = 2 THEN r.node ELSE c.digest END)),
        concat(r.proof,
            CASE WHEN r.pos % 3 <> 0 THEN a.digest END,
            CASE WHEN r.pos % 3 <> 1 THEN b.digest END,
            CASE WHEN r.pos % 3 <> 2 THEN c.digest END)
    FROM low r
    LEFT JOIN nodes a ON a.tree = r.tree AND a.level = r.level AND a.pos = r.pos // 3 * 3
    LEFT JOIN nodes b ON b.tree = r.tree AND b.level = r.level AND b.pos = r.pos // 3 * 3 + 1
    LEFT JOIN nodes c ON c.tree = r.tree AND c.level = r.level AND c.pos = r.pos // 3 * 3 + 2
    WHERE r.n > 1
),
high AS (
    SELECT tree, leaf_pos, 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, node, proof FROM low WHERE n = 1
    UNION ALL
    SELECT r.tree, leaf_pos, r.level + 1, r.pos // 3, (r.n + 2) // 3,
        sha256(concat(
            CASE WHEN r.pos % 3 = 0 THEN r.node ELSE a.digest END,
            CASE WHEN r.pos % 3 = 1 THEN r.node ELSE b.digest END,
            CASE WHEN r.pos % 3 = 2 THEN r.node ELSE c.digest END)),
        concat(r.proof,
            CASE WHEN r.pos % 3 <> 0 THEN a.digest END,
            CASE WHEN r.pos % 3 <> 1 THEN b.digest END,
            CASE WHEN r.pos % 3 <> 2 THEN c.digest END)
    FROM high r
    LEFT JOIN uppers a ON a.level = r.level AND a.pos = r.pos // 3 * 3
    LEFT JOIN uppers b ON b.level = r.level AND b.pos = r.pos // 3 * 3 + 1
    LEFT JOIN uppers c ON c.level = r.level AND c.pos = r.pos // 3 * 3 + 2
    WHERE r.n > 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(h.proof) AS proof_sha256,
    h.node AS folded_root, h.node = t.digest AS verified
FROM placed p
JOIN high h ON h.tree = p.tree AND h.leaf_pos = p.pos AND h.n = 1
JOIN subroots s ON s.tree = p.tree
JOIN uppers t ON t.n = 1
"""
)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.verify(documents(spark, sf), presented=shown)


@query(
    """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS place
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, q.place, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.place <> c.place
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""
)
def op12_sorted_list_topk(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return topk.search(table, "embedding", F.col("vec_id") % 50 == 0, k=5)


@query(
    """
WITH runs AS (
    SELECT lang, list_filter(string_split(piece, ' '), lambda w: w <> '') AS w
    FROM (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(string_split(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
                'abcdefghijklmnopqrstuvwxyz......... '), '.')) AS piece
        FROM documents
    )
),
grams AS (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM runs
    UNION ALL
    SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM runs
    UNION ALL
    SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM runs
),
counts AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
places AS (
    SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)
),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r,
        (1000000 * c.f::HUGEINT * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM places c
    JOIN counts l ON l.lang = c.lang AND l.phrase = head
    JOIN counts r ON r.lang = c.lang AND r.phrase = tail
),
lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_pairs AS (
    SELECT lang, phrase, max(f) AS longer
    FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM counts WHERE size = 3
        UNION ALL
        SELECT lang, array_to_string(w[2:3], ' '), f FROM counts WHERE size = 3
    ) GROUP BY ALL
),
ranked AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank,
        s.phrase, a, l, r, n, score
    FROM lowest s JOIN totals USING (lang)
    LEFT JOIN inner_pairs i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
)
SELECT * FROM ranked WHERE rank <= 2000
"""
)
def op13_tiled_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf))
