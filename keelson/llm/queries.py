"""The thin contract queries over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, byte_bpe, darts, language, licences, media, packing, planes, quality, warc
from .common import documents


def op1_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_crc32(packing.pack(documents(spark, sf_dir, "doc_id", "text"), "byte_bpe_50k.json", end_id=1, capacity=2048))


def op2_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = planes.plane_round_trip(documents(spark, sf_dir, "doc_id", "text"), vocabulary="byte_bpe_50k.json", end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir, "doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir, "doc_id", "text")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return darts.classes(documents(spark, sf_dir, "doc_id", "text"), size=5, least=0.8)


def op4_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit(docs.where(language.remainder(F.col("doc_id"), 5) != 0))
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", (language.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(documents(spark, sf_dir, "doc_id", "text"), "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 7 = 2")


def op9_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.media_round_trip(documents(spark, sf_dir, "doc_id", "text"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Base-32 of a digest in hex: each five hex digits are twenty bits, so four signs.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')"


def oracle_sql() -> dict[str, str]:
    """Models, tokenisers, archives' own bytes and crc32 have no SQL form; tests hold those queries against brute force."""
    return {
        "op3_dart_minhash": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM w WHERE len(words) > 0),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
            e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c)),
            r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
            SELECT doc_id, min(m) AS class_id FROM r GROUP BY doc_id""",
        "op4_dictionary_warc": f"""
            WITH d AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
            SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
        "op6_licence_digests": licences.sql(),
    }
