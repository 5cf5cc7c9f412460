"""The registered queries at the smallest scale, and the pipeline against a plain version."""

import collections

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from folioframe.llm import packing, quality, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"],
    "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9": ["page_id", "url", "text", "n_chars"],
    "op10": ["doc_id", "fingerprint", "component_id"],
}


def test_there_are_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("op", COLUMNS)
def test_columns_and_rows(spark, op):
    name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
    found = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[op]) <= set(found.columns)
    table, key = ("pages", "page_id") if op == "op9" else ("documents", "doc_id")
    ids = {r[key] for r in pq.read_table(f"{SF}/{table}.parquet", columns=[key]).to_pylist()}
    assert {r[0] for r in found.select(key).collect()} == ids


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.SQL["op7_tree_merge_dedup"]).fetchall()
    got = queries.QUERIES["op7_tree_merge_dedup"](spark, SF)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_held_out_language(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = [r for r in queries.QUERIES["op5_string_kernel_language"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.95


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept.append(docs.collect())
    rules, exact, near, cut, pieces = kept
    assert all(r.asDict().keys() == set(columns) for r in rules + exact + near + cut)
    path = queries.public_tokenizers.path("piece_bpe_32k.model")
    good = {r.doc_id for r in quality.measure(spark.read.parquet(f"{SF}/documents.parquet"), path).collect() if r.kept}
    assert {r.doc_id for r in rules} == good
    last = {}
    for r in rules:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert {r.doc_id for r in exact} == set(last.values())
    # No two near copies stay, nothing goes that has none.
    sets = {r.doc_id: shingles(r.text) for r in exact}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = sorted(r.doc_id for r in near)
    left = [(a, b) for i, a in enumerate(stay) for b in stay[:i] if alike(a, b)]
    assert not left, [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in left]
    for gone in set(sets) - set(stay):
        assert any(alike(gone, d) for d in sets if d != gone)
    # A passage of the first document that has it stays there and goes elsewhere.
    seen, length = set(), corpus_pipeline.PASSAGE
    texts = {r.doc_id: r.text.encode() for r in near}
    for r in sorted(cut, key=lambda r: r.doc_id):
        raw, flags = texts[r.doc_id], bytearray(len(texts[r.doc_id]))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                flags[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        want = bytes(b for b, f in zip(raw, flags) if not f)
        assert abs(len(r.text.encode()) - len(want)) <= 8 and r.n_chars == len(r.text)
    ids = collections.Counter()
    for p in pieces:
        ids[p.doc_id] += p.length
    assert ids == {p.doc_id: p.doc_tokens for p in pieces} and set(ids) == {r.doc_id for r in cut}
    assert all(p.length <= packing.CAPACITY for p in pieces)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
