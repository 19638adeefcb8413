"""Rule, template and result tables as versioned Parquet folders, and point reads on them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run on this machine, one of our own; on a
    cluster that is an error, as others can't see this machine's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/spanloom-{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its plan is cut, and a lost executor loses no files."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """A folder with the engine's tables. A table of rules or templates is written as a new version and then read from it; results and records are
    appended, each batch under its number, so that a replay replaces what it wrote. A version is complete once
    Spark has committed it (its _SUCCESS mark), so readers never see half of one."""

    SCHEMAS = {"normalization_rules": schemas.NORMALIZATION_RULES, "sender_entities": schemas.SENDER_ENTITIES, "templates": schemas.TEMPLATES, "results": schemas.STORED_RESULTS, "records": schemas.RECORDS, "processed": schemas.PROCESSED}
    APPENDED = ("results", "records", "processed")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _parts(self, name: str, mark: str) -> list[int]:
        """Numbers of the complete folders <mark><number> of a table."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName().removeprefix(mark)) for p in found if p.getName().startswith(mark) and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The last version, or all batches; an empty table if there is none."""
        mark = "batch=" if name in self.APPENDED else "v"
        parts = self._parts(name, mark)
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        kept = parts if name in self.APPENDED else parts[-1:]
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{mark}{n:09d}" for n in kept])

    def read_batch(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.root}/{name}/batch={batch:09d}")

    def write(self, name: str, df: DataFrame) -> None:
        """A new version that replaces the table."""
        if name in self.APPENDED:
            raise ValueError(f"{name} is appended to")
        last = (self._parts(name, "v") or [0])[-1]
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{last + 1:09d}")

    def append(self, name: str, df: DataFrame, batch: int) -> None:
        """Adds a batch, in place of what the same batch has written before."""
        if name not in self.APPENDED:
            raise ValueError(f"{name} is replaced")
        df.select([f.name for f in self.spark.createDataFrame([], self.SCHEMAS[name]).schema]).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch:09d}")


def entities_of(messages: DataFrame, compiled: DataFrame) -> DataFrame:
    """messages with their sender's rules (null: none)."""
    return messages.join(compiled, "sender_id", "left")


def template_by_id(templates: DataFrame, ids: DataFrame) -> DataFrame:
    return templates.join(ids.select("template_id").distinct(), "template_id", "left_semi")


def stored_result(results: DataFrame) -> DataFrame:
    """Results (schemas.RESULTS; columns that it lacks are null) as a sink holds them: null texts as empty ones, the values as a JSON text with its keys in order."""
    fields = [f.strip().split(" ") for f in schemas.STORED_RESULTS.split(", ")]
    values = F.map_from_entries(F.array_sort(F.map_entries("entities"))) if "entities" in results.columns else None
    cols = {"entities": F.coalesce(F.to_json(values), F.lit("{}")) if values is not None else F.lit("{}")}
    for name, kind in fields:
        own = F.col(name) if name in results.columns else F.lit(None).cast(kind)
        cols.setdefault(name, F.coalesce(own, F.lit("")) if kind == "string" else own)
    return results.select(*[cols[name].cast(kind).alias(name) for name, kind in fields])


def read_results(stored: DataFrame) -> DataFrame:
    """Stored results with their values as a map."""
    return stored.withColumn("entities", F.from_json("entities", "map<string,string>"))
