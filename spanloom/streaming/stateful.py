"""Learning as keyed streaming state: each sender's rules and templates live in the state store, so a message sees what every earlier one of its sender
taught, without a claim, a lock or a published version. The other form (stream.py) takes the hit path in the JVM and learns between batches."""

from __future__ import annotations

import contextlib
import itertools
import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanloom.operators.learning import SenderState, Teacher

OUT = "msg_id string, seq bigint, sender_id string, normalized string, template_id string, category string, confidence double, path string, fail_reason string, entities map<string,string>"


#: Rows of a sender that are sorted in memory; a batch with more is sorted on the task's disk. Rows that are given out at a time.
IN_MEMORY, ROWS_OUT = 20_000, 2_000


def in_order(frames: Iterator[pd.DataFrame], most: int = IN_MEMORY) -> Iterator[tuple[str | None, int | None, str | None]]:
    """(msg_id, seq, normalized) by seq and msg_id, nulls last. More rows than `most` go to a database in a temporary file that only this process sees and that goes
    with it, so memory doesn't grow with a sender's messages."""
    plain = lambda v: None if v is None or v != v else v
    rows = ((plain(m), None if plain(s) is None else int(s), plain(n)) for f in frames for m, s, n in zip(f["msg_id"], f["seq"], f["normalized"], strict=True))
    head = list(itertools.islice(rows, most + 1))
    if len(head) <= most:
        yield from sorted(head, key=lambda r: (r[1] is None, r[1] or 0, r[0] is None, r[0] or ""))
        return
    with contextlib.closing(sqlite3.connect("", isolation_level=None)) as db:
        db.execute("pragma temp_store = file")
        db.execute("create table rows (msg_id text, seq integer, normalized text)")
        db.execute("begin")
        db.executemany("insert into rows values (?, ?, ?)", itertools.chain(head, rows))
        del head
        yield from db.execute("select msg_id, seq, normalized from rows order by seq is null, seq, msg_id is null, msg_id")


class Learner(StatefulProcessor):
    """A sender's messages, a batch at a time in the order of seq."""

    def __init__(self, teacher: Teacher) -> None:
        self.teacher = teacher

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("sender", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803  Spark's names
        held = self.kept.get() if self.kept.exists() else None
        body = json.loads(held[0]) if held else {"entities": [], "templates": []}
        state = SenderState(key[0], body["entities"], body["templates"])
        names = [f.split(" ")[0] for f in OUT.split(", ")]
        done = ({"msg_id": m, "seq": q, "sender_id": key[0], "normalized": n, **state.process(n, self.teacher)} for m, q, n in in_order(rows))
        while out := list(itertools.islice(done, ROWS_OUT)):
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in out], columns=names)
        if state.new_rules or state.new_templates:
            self.kept.update((json.dumps({"entities": state.entities, "templates": list(state.templates.values())}),))

    def close(self) -> None:
        pass


def learn_stream(messages: DataFrame, teacher: Teacher) -> DataFrame:
    """messages: a stream (msg_id, seq, sender_id, normalized). Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    return messages.groupBy("sender_id").transformWithStateInPandas(statefulProcessor=Learner(teacher), outputStructType=OUT, outputMode="Append", timeMode="None")
