"""Reports over message records (schemas.RECORDS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.schemas import ACTIVE_FROM, HIT, LEARNED, REASONS, RECORD_CAP, TOKENS


def hit_rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", hits * 100.0 / total)).otherwise("0.0%")


def counters(records: DataFrame) -> DataFrame:
    path = lambda p: F.count(F.when(F.col("path") == p, 1))
    low = F.count(F.when((F.col("path") == LEARNED) & (F.col("confidence") < ACTIVE_FROM), 1))
    return records.agg(F.count("*").alias("total"), path(HIT).alias("hits"), path(LEARNED).alias("llm_calls"), (path(LEARNED) - low).alias("learned"), low.alias("skipped_low_confidence"), F.count(F.when(F.col("path").isNull(), 1)).alias("failed"), F.count(F.when(F.col("redundant"), 1)).alias("redundant"))


def reason_breakdown(records: DataFrame) -> DataFrame:
    """Calls by reason, with a row for reasons that didn't occur."""
    domain = records.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    n = records.filter(F.col("path") == LEARNED).groupBy(F.col("fail_reason").alias("reason")).agg(F.count("*").alias("n"))
    return domain.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def latency_stats(records: DataFrame, column: str) -> DataFrame:
    """Count, truncated mean and the values at places int(n * p) of the sorted list (from 0, no interpolation); zeros where there is none.

    Equal latencies are counted first, so the window runs over distinct values (whole milliseconds), not over messages.
    """
    by = records.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    totals = by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.floor(F.sum(F.col("v") * F.col("c")) / F.sum("c")), F.lit(0)).alias("avg"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = by.withColumn("upto", upto).crossJoin(F.broadcast(totals))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col("v")))
    places = ranked.agg(at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return totals.crossJoin(places).select(F.lit(column).alias("metric"), "n", F.col("avg").cast("bigint").alias("avg"), *[F.coalesce(p, F.lit(0)).alias(p) for p in ("p50", "p95", "p99")])


def token_usage(responses: DataFrame) -> DataFrame:
    return responses.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS])


def record_log(records: DataFrame, cap: int = RECORD_CAP) -> DataFrame:
    """The first records by arrival."""
    return records.orderBy("seq").limit(cap)


def detail_page(records: DataFrame, page: int = 0, size: int = 10_000) -> DataFrame:
    return records.orderBy("seq").offset(page * size).limit(size)


def failed_learnings(records: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """What was learned with too little confidence, by arrival."""
    low = records.filter((F.col("path") == LEARNED) & (F.col("confidence") < ACTIVE_FROM))
    return low.select("seq", "msg_id", "sender_id", F.coalesce("fail_reason", F.lit("UNKNOWN")).alias("reason"), "confidence").orderBy("seq").offset(page * size).limit(size)


def snapshot(records: DataFrame) -> DataFrame:
    """Counters, hit rate, calls by reason, token sums and both latencies in one row."""
    row = counters(records).withColumn("hit_rate", hit_rate(F.col("hits"), F.col("total"))).crossJoin(token_usage(records))
    calls = records.filter(F.col("path") == LEARNED)
    row = row.crossJoin(calls.agg(*[F.count(F.when(F.col("fail_reason") == r, 1)).alias(r.lower()) for r in REASONS]))  # one row each
    for column, name in (("match_ms", "match"), ("llm_ms", "llm")):
        stats = latency_stats(records, column).select(*[F.col(c).alias(f"{name}_{c}") for c in ("n", "avg", "p50", "p95", "p99")])
        row = row.crossJoin(stats)
    return row


def hit_rate_by_sender(records: DataFrame) -> DataFrame:
    hits = F.count(F.when(F.col("path") == HIT, 1))
    return records.groupBy("sender_id").agg(F.count("*").alias("total"), hits.alias("hits")).withColumn("hit_rate", hit_rate(F.col("hits"), F.col("total")))
