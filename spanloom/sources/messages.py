"""Where messages come from: JSON lines, Kafka, rows; and what of them is let in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.schemas import MESSAGES

JSON = "senderId string, text string"


def from_json_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """(sender_id, text) of JSON objects {"senderId", "text"}; other keys are ignored. Malformed ones and those whose sender or text is
    null or blank are dropped."""
    m = F.from_json(F.col(column).cast("string"), JSON)
    rows = raw.withColumn("_m", m).select(*[c for c in raw.columns if c != column], F.col("_m.senderId").alias("sender_id"), F.col("_m.text").alias("text"))
    filled = lambda c: F.col(c).isNotNull() & F.col(c).rlike(r"[^\s\x00-\x20]")
    return rows.filter(filled("sender_id") & filled("text"))


def kafka(spark: SparkSession, servers: str, topic: str = "sms-inbound", **options: str) -> DataFrame:
    """The stream of a topic's messages, from its start; needs Spark's Kafka connector on the class path. seq is the offset, which orders a sender's messages where
    they are sent with the sender as the key."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    for k, v in options.items():
        reader = reader.option(k, v)
    return of_kafka(reader.load())


def of_kafka(records: DataFrame) -> DataFrame:
    """Messages of a topic's records (topic, partition, offset, value)."""
    return with_ids(from_json_lines(records.select("topic", "partition", F.col("offset").alias("seq"), "value")), "topic", "partition", "seq")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """The stream of lines that arrive as text files in a folder. seq is the file's time. Equal lines of a file share an id until told_apart()."""
    lines = spark.readStream.format("text").load(path)
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.unix_micros("_metadata.file_modification_time").alias("seq"))
    return with_ids(from_json_lines(rows), "file")


def told_apart(messages: DataFrame) -> DataFrame:
    """Rows of one id, which are alike, get ids of their own by counting them. A file is read in one batch, so a replay counts the same."""
    n = F.row_number().over(Window.partitionBy("msg_id").orderBy("seq"))
    return messages.withColumn("_n", n).withColumn("msg_id", F.when(F.col("_n") == 1, F.col("msg_id")).otherwise(F.sha2(F.concat_ws("\x1f", "msg_id", F.col("_n").cast("string")), 256))).drop("_n")


def batch(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A list of (sender, text), in order; nothing is filtered."""
    return with_ids(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "seq bigint, sender_id string, text string"), "seq")


def with_ids(messages: DataFrame, *place: str) -> DataFrame:
    """Messages with an id made of the columns that say where each was read, of sender and text, so a replay writes the same rows."""
    key = F.to_json(F.struct(*[F.col(c) for c in (*place, "sender_id", "text")]), {"ignoreNullFields": "false"})
    return messages.withColumn("msg_id", F.sha2(key, 256)).select(*[f.split(" ")[0] for f in MESSAGES.split(", ")])
