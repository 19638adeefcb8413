"""The engine on a stream: each micro-batch takes the hit path; its misses are learned by sender, and the next batch reads the new rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import learning, rules
from spanloom.plans import pipeline
from spanloom.sources import messages as sources
from spanloom.sources import tables
from spanloom.sources.tables import Store


def process_batch(spark: SparkSession, store: Store, messages: DataFrame, teacher: learning.Teacher | None, batch: int) -> None:
    """One batch: what becomes of its messages is written under its number, so a replay of the batch replaces what it wrote."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return kept[-1]

    hits, misses, _ = pipeline.process(spark, messages, store.read("normalization_rules"), store.read("sender_entities"), store.read("templates"), keep)
    cols = ["msg_id", "seq", "sender_id", "raw", "normalized", "template_id", "category", "subcategory", "intent", "confidence", "entities", "path"]
    done = hits.select(*cols, F.lit(None).cast("string").alias("fail_reason"), F.lit(False).alias("redundant"))
    if teacher is not None:
        path = f"{store.root}/learned/batch={batch:09d}"
        learning.learn(misses, store.read("sender_entities"), store.read("templates"), teacher).write.mode("overwrite").parquet(path)
        learned = spark.read.parquet(path)
        done = done.unionByName(learned.filter("kind = 'message'").join(misses.select("msg_id", "raw"), "msg_id").select(*cols, "fail_reason", "redundant"))
        if not learned.filter("kind <> 'message'").isEmpty():
            store.write("templates", rules.upsert_by(store.read("templates"), learning.new_templates(learned), "template_id"))
            store.write("sender_entities", rules.upsert_by(store.read("sender_entities"), learning.new_rules(learned), "sender_id"))
    store.append("processed", done, batch)
    results = store.read_batch("processed", batch).filter("path is not null").withColumn("ts", F.current_timestamp())
    store.append("results", tables.stored_result(results), batch)
    for df in kept:
        df.unpersist()


def run(spark: SparkSession, messages: DataFrame, root: str, teacher: learning.Teacher | None = None, available_now: bool = False, alike: bool = True) -> StreamingQuery:
    """Starts the query on a stream of messages (sources.messages) over the tables in root. alike: several messages may have one id, as equal lines of
    a file do."""
    store = Store(spark, root)
    writer = messages.writeStream.option("checkpointLocation", f"{store.root}/_progress").foreachBatch(lambda df, n: process_batch(df.sparkSession, Store(df.sparkSession, root), sources.told_apart(df) if alike else df, teacher, n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sender_counts(messages: DataFrame, every: str = "1 minute", late: str = "10 minutes", at: str = "ts") -> DataFrame:
    """Messages a sender and window of event time; for monitoring."""
    return messages.withWatermark(at, late).groupBy(F.window(at, every), "sender_id").agg(F.count("*").alias("n")).select("window.start", "window.end", "sender_id", "n")
