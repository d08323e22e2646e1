"""The registered queries of this subpackage: each applies one operator, with production settings, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, inner, jaccard, langid, licenses, lm, maglev, paragraphs, rans, repair, tiff, vq, wfq


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.payload_digests(tiff.tiff_pages(tiff.texts_to_tiff(_documents(spark, sf_dir))))


def op2_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfq.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "weight")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(langid.training_rows(docs)))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return lm.score(docs, lm.fit(docs, good), good)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_index(rans.write_token_files(_documents(spark, sf_dir), tokenizer_path()))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir))


#: Shards of production size, some heavier.
SHARDS = {f"shard-{k:03d}": 2 if k % 8 == 0 else 1 for k in range(96)}


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.assign_shards(_documents(spark, sf_dir).select("doc_id", "source"), SHARDS)


def op10_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_documents(spark, sf_dir))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vq.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op9_sql() -> str:
    table = ",".join(f"'{s}'" for s in maglev.lookup_table(SHARDS))
    return f"""
        WITH placed AS (SELECT doc_id, source, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {maglev.SLOTS} AS INTEGER) AS slot FROM documents),
             filled AS (SELECT [{table}] AS owners)
        SELECT doc_id, source, slot, owners[slot + 1] AS shard FROM placed, filled"""


#: Vectors that take part, as integers.
_WHOLE = """
        whole AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    books = [f"""
        book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM cut QUALIFY entry < {entries})"""]
    for k in range(rounds + 1):
        books.append(f"""
        near{k} AS MATERIALIZED (
            SELECT row, part, any_value(v) AS v, min(struct_pack(d := d, entry := entry)) AS best
            FROM (SELECT c.row, c.part, c.v, b.entry, CAST(list_sum(list_transform(list_zip(c.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM cut c JOIN book{k} b USING (part))
            GROUP BY row, part)""")
        if k < rounds:
            books.append(f"""
        book{k + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(moved.v, book{k}.v) AS v FROM book{k} LEFT JOIN (
                SELECT part, entry, list(mean ORDER BY j) AS v FROM (
                    SELECT part, best.entry AS entry, j, (sum(v[j]) - ((sum(v[j]) % count(*) + count(*)) % count(*))) // count(*) AS mean
                    FROM near{k}, range(1, len(v) + 1) r(j) GROUP BY part, best.entry, j)
                GROUP BY part, entry) moved USING (part, entry))""")
    return f"""
        WITH{_WHOLE},
        cut AS MATERIALIZED (SELECT row, vec_id, part, ints[CAST(part * (len(ints) // {parts}) + 1 AS BIGINT):CAST((part + 1) * (len(ints) // {parts}) AS BIGINT)] AS v FROM whole, range({parts}) r(part)),{",".join(books)},
        coded AS MATERIALIZED (
            SELECT vec_id, label, code, error FROM whole JOIN (
                SELECT row, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row) USING (row)),
        digest AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, j, CAST(CAST(v[j] AS BIGINT) AS VARCHAR) AS x FROM book{rounds}, range(1, len(v) + 1) r(j)))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


_OP13_SQL = f"""
        WITH{_WHOLE}
        SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.row ORDER BY score DESC, v.vec_id) AS INTEGER) AS rank, v.vec_id AS vec_id, score
        FROM whole q JOIN whole v ON q.row <> v.row, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(q.ints, v.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score)
        WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_fair_mix": op2_fair_mix,
    "op3_language": op3_language,
    "op4_cross_entropy": op4_cross_entropy,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_rans_tokens": op7_rans_tokens,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_shards": op9_shards,
    "op10_repeated_paragraphs": op10_repeated_paragraphs,
    "op11_product_codes": op11_product_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_top_products": op13_top_products,
}
ORACLES: dict[str, str] = {"op9_shards": _op9_sql(), "op11_product_codes": _op11_sql(), "op13_top_products": _OP13_SQL}
