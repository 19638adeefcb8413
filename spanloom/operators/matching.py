"""Template matching: two hash lookups as equi-joins on candidates, anchor checks as expressions, one reduction by message.

Templates are few against messages; they are broadcast only if the optimizer's bound of their bytes is small, else joined by shuffle, which adaptive
execution turns into a broadcast where a side comes out small.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import engine
from spanloom.schemas import PRIORITY, SPAN

#: Bytes of a rule or template table that are broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if the optimizer estimates so many bytes at most; no job runs for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


#: Characters of a sender's templates as JSON up to which they go with each of its messages; the messages of a sender with more are matched by joins.
CARRIED = 1 << 16


def by_sender(templates: DataFrame) -> DataFrame:
    """A row a sender: templates_json (what matching needs of its templates, by id) and wins (what a result needs of each, in that order)."""
    cols = [c for c in templates.columns if c not in ("sender_id", "template_id")]
    ts = F.array_sort(F.collect_list(F.struct("template_id", *cols))).alias("ts")
    snap = lambda s: F.struct(*[s[k].alias(k) for k in ("name", "rule_type", "start_after", "end_before", "max_tokens")])
    need = lambda t: F.struct(*[t[k].alias(k) for k in ("category", "subcategory", "static_hash", "seq_hash", "active")], F.transform(t["snapshots"], snap).alias("snapshots"))
    return templates.groupBy("sender_id").agg(ts).select("sender_id", F.to_json(F.transform("ts", need)).alias("templates_json"), F.transform("ts", light).alias("wins"))


def light(t: Column) -> Column:
    """What a result needs of its template."""
    return F.struct(*[t[k].alias(k) for k in ("template_id", "category", "subcategory", "intent", "confidence", "snapshots")])


def static_index(templates: DataFrame) -> DataFrame:
    """One template for each sender and static hash: the one of the least id."""
    cols = [c for c in templates.columns if c not in ("sender_id", "static_hash")]
    return templates.groupBy("sender_id", "static_hash").agg(F.min_by(F.struct(*cols), "template_id").alias("t"))


def sequence_index(templates: DataFrame) -> DataFrame:
    """All templates for each sender and sequence hash, by id."""
    cols = [c for c in templates.columns if c not in ("sender_id", "seq_hash", "template_id")]
    return templates.groupBy("sender_id", "seq_hash").agg(F.array_sort(F.collect_list(F.struct("template_id", *cols))).alias("ts"))


def _literal(anchor: Column) -> Column:
    return F.coalesce(anchor != "", F.lit(False)) & ~T.is_entity_ref(anchor)


def _inner(anchor: Column) -> Column:
    return F.substr(anchor, F.lit(2), F.greatest(F.length(anchor) - 2, F.lit(0)))


def _quoted(anchor: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(F.upper(anchor), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def stands(text: Column, snap: Column, v: Column, values: Column) -> Column:
    """Whether value v stands where the snapshot's anchors say: a literal start right before it but for blanks, a literal end (with a letter or
    digit) right after it, an entity's first value before or after it."""
    start, end = snap["start_after"], snap["end_before"]
    before, after = F.upper(F.substr(text, F.lit(1), v["st"])), F.upper(F.substr(text, v["en"] + 1))
    first = lambda name: F.get(F.filter(values, lambda w: w["name"] == name), F.lit(0))
    start_ok = F.when(_literal(start) & ~T.is_start_mark(start), F.regexp_like(before, F.concat(_quoted(start), F.lit(r"[\x00-\x20]*\z")))).when(T.is_entity_ref(start), F.coalesce(first(_inner(start))["en"] <= v["st"], F.lit(False))).otherwise(F.lit(True))
    end_ok = F.when(_literal(end) & ~T.is_end_mark(end) & end.rlike("[0-9A-Za-z]"), F.regexp_like(after, F.concat(F.lit(r"^[\x00-\x20]*"), _quoted(end)))).when(T.is_entity_ref(end), F.coalesce(first(_inner(end))["st"] >= v["en"], F.lit(False))).otherwise(F.lit(True))
    return start_ok & end_ok


def validates(text: Column, snapshots: Column, values: Column) -> Column:
    """Each snapshot has a value of its name that stands right; no snapshots: true."""
    return F.forall(snapshots, lambda s: F.exists(values, lambda v: (v["name"] == s["name"]) & stands(text, s, v, values)))


_WALKED = "struct<template_id:string,values:array<" + SPAN + ">>"


def _walk(text: pa.Array, templates: pa.Array, values: pa.Array) -> pa.Array:
    out = []
    for t, ts, vs in zip(text.to_pylist(), templates.to_pylist(), values.to_pylist(), strict=True):
        got = None
        for x in json.loads(ts) if t is not None and ts else ():
            snaps = [{k: s.get(k) for k in ("name", "rule_type", "start_after", "end_before", "max_tokens")} for s in x.get("snapshots") or ()]
            w = engine.walk(t, {"snapshots": snaps}, [engine.Span(**v) for v in vs or ()])
            if w:
                got = {"template_id": x["template_id"], "values": [s._asdict() for s in w]}
                break
        out.append(got)
    return pa.array(out, pa.struct([("template_id", pa.string()), ("values", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("st", pa.int32()), ("en", pa.int32())])))]))


def first_hits(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """messages whose first candidate hits an active template by its static hash keep that candidate alone: it wins whatever the others are, so
    most messages go on as one row."""
    on = small(static_index(templates).filter("t.active").select("sender_id", F.col("static_hash").alias("_h"), F.lit(True).alias("_hit")))
    values = F.transform(F.get("cands", F.lit(0))["values"], lambda v: v["value"])
    m = messages.withColumn("_h", F.when(F.size("cands") > 1, T.static_hash(F.col("text"), values))).join(on, ["sender_id", "_h"], "left")
    return m.withColumn("cands", F.when(F.col("_hit"), F.slice("cands", 1, 1)).otherwise(F.col("cands"))).drop("_h", "_hit")


def explode_candidates(messages: DataFrame) -> DataFrame:
    """A row a candidate; a message without candidates keeps one row with no values."""
    rows = messages.select("*", F.posexplode_outer("cands").alias("_p", "c")).drop("cands", "_p")
    values = F.coalesce("c.values", F.array().cast(f"array<{SPAN}>"))
    return rows.withColumn("ord", F.coalesce("c.ord", F.lit(0))).withColumn("empty", F.col("c").isNull()).withColumn("values", values).drop("c")


def outcomes(cands: DataFrame, templates: DataFrame) -> DataFrame:
    """cands (sender_id, text, values, empty, …) with win (template struct or null), won (its values), reason (null if won)."""
    s, q = small(static_index(templates)), small(sequence_index(templates))
    names = F.transform("values", lambda v: v["name"])
    c = cands.withColumn("static_hash", T.static_hash(F.col("text"), F.transform("values", lambda v: v["value"]))).withColumn("seq_hash", F.when(~F.col("empty"), T.sequence_hash(names)))
    c = c.join(s, ["sender_id", "static_hash"], "left").withColumn("seq_hash", F.when(F.col("t").isNull(), F.col("seq_hash")))
    c = c.join(q, ["sender_id", "seq_hash"], "left")
    c = c.withColumn("live", F.filter("ts", lambda t: t["active"])).withColumn("good", F.filter("live", lambda t: validates(F.col("text"), t["snapshots"], F.col("values"))))
    ask = F.col("t").isNull() & (F.size("live") > 0) & (F.size("good") == 0)
    c = c.withColumn("walked", F.arrow_udf(_walk, _WALKED)(F.when(ask, F.col("text")), F.when(ask, F.to_json("live")), F.when(ask, F.col("values"))))
    head = F.get("good", F.lit(0))
    agree = F.forall("good", lambda t: t["category"].eqNullSafe(head["category"]) & t["subcategory"].eqNullSafe(head["subcategory"]))
    by_walk = F.get(F.filter("live", lambda t: t["template_id"] == F.col("walked.template_id")), F.lit(0))
    win = F.when(F.col("t").isNotNull(), F.when(F.col("t.active"), light(F.col("t")))).when(F.size("good") > 0, F.when(agree, light(head))).when(F.col("walked").isNotNull(), light(by_walk))
    low = F.lit("LOW_CONFIDENCE_TEMPLATE_INACTIVE")
    why = (
        F.when(F.col("t").isNotNull(), low)
        .when(F.col("empty"), "NO_EXTRACTION_CANDIDATES")
        .when(F.size("good") > 0, "AMBIGUOUS_TEMPLATE_CONFLICT")
        .when(F.size("live") > 0, "BOUNDARY_VALIDATION_FAILED")
        .when(F.size("ts") > 0, low)
        .otherwise("NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED")
    )
    c = c.withColumn("win", win).withColumn("won", F.when(F.col("t").isNull() & F.col("walked").isNotNull(), F.col("walked.values")).otherwise(F.col("values")))
    return c.withColumn("reason", F.when(F.col("win").isNull(), why)).drop("t", "ts", "live", "good", "walked", "static_hash", "seq_hash")


def priority(reason: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(reason == name, p).otherwise(out)
    return out


def reduce_outcomes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row a message: its first candidate that won, else the reason that says most (the first of equals). keep: columns of the message, carried by its
    first candidate alone so that they are shuffled once."""
    first = F.struct(*[F.col(k) for k in keep])
    won = F.min(F.when(F.col("win").isNotNull(), F.col("ord")))
    out = rows.groupBy("msg_id").agg(
        F.min_by(F.when(F.col("ord") == 0, first), "ord").alias("m"),
        won.alias("win_ord"),
        F.min_by(F.struct("win", "won"), F.when(F.col("win").isNotNull(), F.col("ord"))).alias("w"),
        F.max_by("reason", F.struct(priority(F.col("reason")), -F.col("ord"))).alias("reason"),
        F.max("empty").alias("no_candidates"),
    )
    return out.select("msg_id", *[F.col("m")[k].alias(k) for k in keep], "win_ord", F.col("w.win").alias("win"), F.col("w.won").alias("won"), F.when(F.col("win_ord").isNull(), F.col("reason")).alias("reason"), "no_candidates")


def discarded(reason: Column, no_candidates: Column, n_rules: Column) -> Column:
    """The reason, or that candidates were discarded where a message has none and its sender has rules."""
    return F.when(reason.isNotNull() & no_candidates & (n_rules > 0), "EXTRACTION_CANDIDATES_DISCARDED").otherwise(reason)


def typed_values(text: Column, values: Column, snapshots: Column) -> Column:
    """Values by semantic type: the first snapshot of the name whose type is free and whose start anchor, if literal, occurs before the value; else by name.
    A later value of the same key replaces the earlier one."""

    def key(acc: Column, v: Column, before: Column) -> Column:
        fits = lambda s: (s["name"] == v["name"]) & ~F.map_contains_key(acc, s["semantic_type"]) & (F.coalesce(s["start_after"], F.lit("")).rlike(r"^(\{|$)") | F.contains(before, F.upper(F.coalesce(s["start_after"], F.lit("")))))
        return F.coalesce(F.get(F.transform(F.filter(snapshots, fits), lambda s: s["semantic_type"]), F.lit(0)), v["name"])

    def step(acc: Column, v: Column) -> Column:
        put = lambda k: F.map_concat(F.map_filter(acc, lambda x, _: x != k), F.create_map(k, v["value"]))
        return T.bound(F.upper(F.substr(text, F.lit(1), v["st"])), lambda before: T.bound(key(acc, v, before), put))

    return F.aggregate(values, F.create_map().cast("map<string,string>"), step)
