import hashlib
import json

from pyspark.sql import functions as F

from spanloom.llm import chat
from test_chat import RECORDS


def summed(df):
    return {r["k"]: r for r in chat.format_records(df).select("k", "layout", "turns", "formatted").collect()}


def test_readers_agree(spark, monkeypatch):
    """The reader of large records gives what the variant gives."""
    odd = [{"messages": [{"role": None, "content": "x", "more": [1]}, {"content": "y"}]}, {"messages": [{"role": "user"}]}, {"messages": []}, {"messages": "[]"}, {"prompt": None, "response": "r"}, {"a": 1}, {"prompt": 'q"\\\né😀', "response": "", "system": None}]
    rows = [(k, json.dumps(r)) for k, (r, _) in RECORDS.items()] + [(str(i), json.dumps(r)) for i, r in enumerate(odd)] + [("cut", '{"prompt": "x"'), ("bad", "{"), ("null", None), ("number", "3")]
    df = spark.createDataFrame(rows, "k string, record string")
    want = summed(df)
    monkeypatch.setattr(chat, "LARGE", 0)
    assert summed(df) == want and sum(r["turns"] is not None for r in want.values()) > 8


def test_large_text(spark):
    """Turns of 25 million characters, above the 20 million that a variant's texts may have, and just below: digests as hashlib gives them."""
    for n in (6_600_000, 8_400_000):
        text = F.repeat(F.lit("ab<"), n)
        rows = spark.range(2).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
        got = chat.digests(chat.format_records(chat.records_of(rows))).first()
        said = hashlib.sha256()
        for role in ("user", "assistant"):
            said.update(f"{role}\n".encode() + b"ab<" * n + b"\n")
        assert got["turns_sha256"] == said.hexdigest() and got["loss_sha256"] == hashlib.sha256(b"ab<" * n).hexdigest()
        assert (got["n_turns"], got["loss_chars"]) == (2, 3 * n)
        assert got["formatted_chars"] == 8 * n + len("userassistant") + 2 * len(chat.OPEN + chat.HEAD_END + chat.CLOSE)
