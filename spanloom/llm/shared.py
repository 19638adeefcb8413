"""What the operators of this subpackage share: the shared folder, tables that cut lineage, names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.tables import new_dir

#: Whitespace of the word contract: space and \x09-\x0D.
SPACE = "\\x20\\x09-\\x0D"


#: Lists of the folders that settle() has made, one for each temporary() that is open.
_OPEN: list[list[str]] = []


def settle(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and a lost executor loses no files."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, what)
    for made in _OPEN:
        made.append(path)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(*tables: DataFrame) -> None:
    """Removes the files behind tables as settle() returned them, once no later plan reads them."""
    for df in tables:
        _delete(df.sparkSession, df._settled)


@contextmanager
def temporary(spark: SparkSession, kept: list[DataFrame]) -> Iterator[None]:
    """Removes, at the end, what settle() has written inside, but for the tables that were put in kept: for callers that settle a result."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for folder in set(made) - {df._settled for df in kept}:
            _delete(spark, folder)


#: What empties each operator's words in this Python worker.
_WORDS: dict[str, Callable[[], object]] = {}


def words_of(operator: str, clear: Callable[[], object]) -> None:
    _WORDS[operator] = clear


def keep_words_of(operator: str) -> None:
    """A worker is used for stage after stage. It keeps one operator's words at a time; called where a task begins."""
    for name, clear in _WORDS.items():
        if name != operator:
            clear()


#: Keys that are broadcast at most: under 10 MB. More are joined by shuffle.
BROADCAST_KEYS = 100_000


def semi(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """df's rows whose columns are among the keys, a settled table, whose rows its files count. Up to BROADCAST_KEYS are broadcast, so df isn't shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), list(on), "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df hasn't."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"{n}_"
        have.add(n.lower())
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark hand texts to Python in batches of at most so many rows (and bytes, by its own limit), so that a worker's memory stays small.
    The setting is the session's, as it is read when a plan runs; a smaller one is left alone."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once: a higher-order function would compute an expression again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))
