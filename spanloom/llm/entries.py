"""The registered queries of this subpackage, and the SQL that their results must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, linededup, media, mixing, neardup, packing, quality, urls, warc, winnow
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.EXTRA).alias("text"))
    return chat.digests(chat.format_records(chat.records_of(rows.union(extra))))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_media_columns": op2_media_columns,
        "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
        "op4_source_mixing": op4_source_mixing,
        "op5_warc": op5_warc,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_winnowing": op10_winnowing,
    }


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), q as (
  select *, count(*) over (partition by html) as c, max(page_id) over (partition by html) as top from p
)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and c > 1 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and c > 1 and page_id <> top then top end as refers_to
from q
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_duplicates": neardup.SQL, "op5_warc": OP5_SQL, "op6_chat_formatting": chat.SQL, "op7_line_dedup": linededup.SQL}
