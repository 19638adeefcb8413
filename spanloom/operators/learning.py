"""Learning: what a miss teaches. Templates and rules from a teacher's responses, and the loop that asks it.

The teacher is any callable (text, entities) -> response (the fields of schemas.TEACHER without sender and text) or None. It is asked for one message of a
sender at a time, in arrival order, and what it teaches counts for the sender's later messages; one task owns a sender, so no claim or lock is needed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import engine
from spanloom.schemas import ACTIVE_FROM, BOUNDARY_HINT, HIT, LEARNED, REGEX, SNAPSHOT, VARIANT

Teacher = Callable[[str, list[dict]], dict | None]
RETRY_SECONDS = (1, 2, 4, 8)


class RateLimited(Exception):
    """The teacher asks to be called later."""


def with_retry(teacher: Teacher, wait: Callable[[float], None] = time.sleep) -> Teacher:
    """Calls again after 1, 2, 4 and 8 seconds while the teacher is rate-limited; other errors pass."""

    def call(text: str, entities: list[dict]) -> dict | None:
        for pause in RETRY_SECONDS:
            try:
                return teacher(text, entities)
            except RateLimited:
                wait(pause)
        return teacher(text, entities)

    return call


# ---- a language model as the teacher

INSTRUCTIONS = """You are given one machine-written message, normalised to upper-case ASCII, and the extraction rules that its sender has so far.
Answer with one JSON object: category, subcategory, intent, confidenceScore (0 to 1), canonicalTemplate (the message with {NAME} in place of each value),
extractedFields (an object from rule name to the value as it stands in the message), entities (a list of rules) and ordering (rule names in message order).
A rule has name, semanticType, type (REGEX or BOUNDARY_HINT), regex and group for the first, startAfter, endBefore and maxTokens for the second. An anchor is a literal next to the value,
{NAME} of another rule, SOM for the start or EOM for the end of the message. Use known rules and their names where they fit."""


def request_for(text: str, entities: list[dict]) -> list[dict]:
    """The turns of a request: what is asked for, and the message with the sender's rules."""
    known = [{"name": e["name"], "type": e["rule_type"], "regex": [v["regex"] for v in e["regex_variants"] or ()], "anchors": [[p["start_after"], p["end_before"], p["max_tokens"]] for p in e["boundary_pairs"] or ()]} for e in entities]
    return [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": json.dumps({"message": text, "rules": known})}]


def read_response(content: str, usage: dict[str, int] | None = None) -> dict:
    """An answer as the loop takes it, with the defaults of parse_responses()."""
    r = json.loads(content)
    rules = [
        {
            "name": e.get("name"), "semantic_type": e.get("semanticType") or e.get("name"), "rule_type": e.get("type") if e.get("type") in (REGEX, BOUNDARY_HINT) else REGEX,
            "regex": e.get("regex"), "grp": e.get("group") or 0, "start_after": e.get("startAfter") or "", "end_before": e.get("endBefore") or "", "max_tokens": 3 if e.get("maxTokens") is None else e["maxTokens"],
        }
        for e in r.get("entities") or ()
    ]
    fields = {k: str(v) for k, v in (r.get("extractedFields") or {}).items() if v is not None and str(v) != "null" and str(v).strip()}
    tokens = {k: (usage or {}).get(k, 0) for k in ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens")}
    return {"category": r.get("category"), "subcategory": r.get("subcategory"), "intent": r.get("intent"), "confidence": float(r.get("confidenceScore") or 0.0), "canonical": r.get("canonicalTemplate"), "fields": fields, "entities": rules, "ordering": r.get("ordering") or []} | tokens


def chat_teacher(send: Callable[[list[dict]], tuple[str, dict[str, int]]], wait: Callable[[float], None] = time.sleep) -> Teacher:
    """A teacher that sends the turns of a request somewhere and reads (content, token usage) back; send raises RateLimited to be called later."""
    return with_retry(lambda text, entities: read_response(*send(request_for(text, entities))), wait)


# ---- responses

_ENTITIES = "array<struct<name:string,semanticType:string,type:string,regex:string,group:int,startAfter:string,endBefore:string,maxTokens:int>>"
_RESPONSE = f"struct<category:string,subcategory:string,intent:string,confidenceScore:double,canonicalTemplate:string,extractedFields:map<string,string>,entities:{_ENTITIES},ordering:array<string>>"


def parse_responses(content: Column) -> Column:
    """A teacher's JSON answer with the defaults: unknown rule types are REGEX, the semantic type is the name, anchors are empty, 3 tokens, group 0;
    fields that are null, "null" or blank are left out."""
    r = F.from_json(content, _RESPONSE)
    one = lambda e: F.struct(
        e["name"].alias("name"),
        F.coalesce(e["semanticType"], e["name"]).alias("semantic_type"),
        F.when(e["type"].isin(REGEX, BOUNDARY_HINT), e["type"]).otherwise(REGEX).alias("rule_type"),
        e["regex"].alias("regex"),
        F.coalesce(e["group"], F.lit(0)).alias("grp"),
        F.coalesce(e["startAfter"], F.lit("")).alias("start_after"),
        F.coalesce(e["endBefore"], F.lit("")).alias("end_before"),
        F.coalesce(e["maxTokens"], F.lit(3)).alias("max_tokens"),
    )
    fields = F.map_filter(r["extractedFields"], lambda k, v: v.isNotNull() & (v != "null") & (F.trim(v) != ""))
    return F.when(r.isNotNull(), F.struct(r["category"].alias("category"), r["subcategory"].alias("subcategory"), r["intent"].alias("intent"), F.coalesce(r["confidenceScore"], F.lit(0.0)).alias("confidence"), fields.alias("fields"), r["canonicalTemplate"].alias("canonical"), F.transform(r["entities"], one).alias("entities"), r["ordering"].alias("ordering")))


def learned_values(fields: Column, text: Column) -> Column:
    """Each field's value at its first place in the text, at (0, 0) if it isn't there."""
    entries = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull() & (e["value"] != "null") & (F.trim(e["value"]) != ""))

    def one(e: Column) -> Column:
        at = F.instr(text, e["value"]) - 1
        there = at >= 0
        return F.struct(e["key"].alias("name"), e["value"].alias("value"), F.when(there, at).otherwise(0).alias("st"), F.when(there, at + F.length(e["value"])).otherwise(0).alias("en"))

    return F.transform(entries, one)


def templates_of(responses: DataFrame) -> DataFrame:
    """Templates (schemas.TEMPLATES) of teacher responses (schemas.TEACHER); values are taken out of the text in map order."""
    values = F.transform(learned_values(F.col("fields"), F.col("normalized")), lambda v: v["value"])
    return responses.select(
        T.template_id(F.col("sender_id"), F.col("canonical")).alias("template_id"), "sender_id", "category", "subcategory", "intent", "confidence", "canonical",
        F.col("entities").alias("snapshots"), "ordering", T.static_hash(F.col("normalized"), values).alias("static_hash"),
        T.sequence_hash(F.coalesce("ordering", F.array().cast("array<string>"))).alias("seq_hash"), (F.col("confidence") >= ACTIVE_FROM).alias("active"),
    )


def redundant(responses: DataFrame, templates: DataFrame) -> DataFrame:
    """responses with redundant: whether their template is stored already."""
    known = templates.select("template_id").distinct().withColumn("known", F.lit(True))
    return responses.withColumn("template_id", T.template_id(F.col("sender_id"), F.col("canonical"))).join(known, "template_id", "left").withColumn("redundant", F.coalesce("known", F.lit(False))).drop("known")


def learned_result(fields: Column, entities: Column) -> Column:
    """Values by semantic type: the field of the rule's name, else of its type; null ones left out, the last of a type counts."""
    pair = lambda e: F.struct(e["semantic_type"].alias("key"), F.coalesce(F.element_at(fields, e["name"]), F.element_at(fields, e["semantic_type"])).alias("value"))
    pairs = F.filter(F.transform(entities, pair), lambda p: p["value"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def learned_rules(responses: DataFrame) -> DataFrame:
    """A row a learned rule, as rules.merge_entities() takes them."""
    e = responses.select("sender_id", F.posexplode("entities").alias("lord", "e"))
    return e.select("sender_id", "lord", "e.name", "e.rule_type", "e.regex", F.coalesce("e.grp", F.lit(0)).alias("grp"), "e.start_after", "e.end_before", "e.max_tokens")


# ---- the loop

def merge_rules(entities: list[dict], learned: list[dict]) -> list[dict]:
    """The sender's rules with the learned ones, as rules.merge_entities() has them; new names come last."""
    out = {e["name"]: {**e, "regex_variants": list(e["regex_variants"] or ()), "boundary_pairs": list(e["boundary_pairs"] or ())} for e in entities}
    for r in learned:
        new = r["name"] not in out
        e = out.setdefault(r["name"], {"name": r["name"], "rule_type": r["rule_type"], "regex_variants": [], "boundary_pairs": []})
        pair = {k: r.get(k) for k in ("start_after", "end_before", "max_tokens")}
        has = any((p["start_after"], p["end_before"]) == (pair["start_after"], pair["end_before"]) for p in e["boundary_pairs"])
        if not has and not (new and pair["start_after"] is None and pair["end_before"] is None):
            e["boundary_pairs"].append(pair)
        variant = {"regex": r.get("regex"), "grp": r.get("grp") or 0}
        if variant["regex"] and variant not in e["regex_variants"]:
            e["regex_variants"].append(variant)
    return list(out.values())


def template_of(sender: str, text: str, r: dict) -> dict:
    fields = {k: v for k, v in (r.get("fields") or {}).items() if v is not None and v != "null" and v.strip()}
    canonical = r.get("canonical")
    return {
        "template_id": engine.sha256(f"{sender}::{'null' if canonical is None else canonical}"), "sender_id": sender, "category": r.get("category"), "subcategory": r.get("subcategory"),
        "intent": r.get("intent"), "confidence": float(r.get("confidence") or 0.0), "canonical": canonical, "snapshots": r.get("entities") or [], "ordering": list(r.get("ordering") or ()),
        "static_hash": engine.static_hash(text, fields.values()), "seq_hash": engine.sequence_hash(r.get("ordering") or ()), "active": float(r.get("confidence") or 0.0) >= ACTIVE_FROM,
    }


class SenderState:
    """A sender's rules and templates while its messages pass."""

    def __init__(self, sender: str, entities: list[dict] | None = None, templates: list[dict] | None = None) -> None:
        self.sender, self.entities = sender, list(entities or ())
        self.templates = {t["template_id"]: t for t in templates or ()}
        self.new_rules = False
        self.new_templates: set[str] = set()
        self._read()

    def _read(self) -> None:
        self.rules, self.known = engine.Rules(self.entities), engine.Templates([self.templates[k] for k in sorted(self.templates)])

    def look(self, text: str) -> tuple[dict, list[engine.Span]] | str:
        return engine.match(text, engine.extract(text, self.rules), self.known, self.rules.any)

    def process(self, text: str, teacher: Teacher) -> dict:
        """The record of one message: a hit, or what the teacher says, or a failure (nothing learned, path null)."""
        got = self.look(text)
        if not isinstance(got, str):
            t, values = got
            return {"path": HIT, "fail_reason": None, "template_id": t["template_id"], "category": t["category"], "subcategory": t["subcategory"], "intent": t["intent"], "confidence": t["confidence"], "entities": engine.typed_values(text, values, t["snapshots"]), "redundant": False}
        r = teacher(text, self.entities)
        if r is None:
            return {"path": None, "fail_reason": got, "template_id": None, "category": None, "subcategory": None, "intent": None, "confidence": 0.0, "entities": {}, "redundant": False}
        t = template_of(self.sender, text, r)
        redundant_ = t["template_id"] in self.templates
        self.templates[t["template_id"]] = t
        self.new_templates.add(t["template_id"])
        self.entities = merge_rules(self.entities, r.get("entities") or [])
        self.new_rules = True
        self._read()
        fields = r.get("fields") or {}
        values = {}
        for e in r.get("entities") or ():
            v = fields.get(e["name"]) if fields.get(e["name"]) is not None else fields.get(e["semantic_type"])
            if v is not None:
                values[e["semantic_type"]] = v
        return {"path": LEARNED, "fail_reason": got, "template_id": t["template_id"], "category": t["category"], "subcategory": t["subcategory"], "intent": t["intent"], "confidence": t["confidence"], "entities": values, "redundant": redundant_}


LEARN_OUT = (
    "kind string, msg_id string, seq bigint, sender_id string, normalized string, template_id string, category string, subcategory string, intent string, confidence double, "
    "entities map<string,string>, path string, fail_reason string, redundant boolean, body string"
)


def _rows_of(v: str | None) -> list[dict]:
    return [] if v is None else json.loads(v)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def learn(misses: DataFrame, entities: DataFrame, templates: DataFrame, teacher: Teacher, calls: int = 100) -> DataFrame:
    """misses (msg_id, seq, sender_id, normalized), asked about by sender in the order of seq. Rows of kind message (records), and of kind
    template and rules (the new version of what the sender learned, as JSON in body).

    A sender's messages pass through one task, in a stream sorted by sender and seq, so a large sender needs no memory of its size; the loop is
    sequential by nature, which is why only misses come here. At most `calls` senders are asked about at a time.
    """
    ents = entities.groupBy("sender_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ord", "name", "rule_type", "regex_variants", "boundary_pairs")))).alias("ents"))
    tmps = templates.groupBy("sender_id").agg(F.to_json(F.collect_list(F.struct(*templates.columns))).alias("tmps"))
    state = ents.join(tmps, "sender_id", "full_outer").select("sender_id", F.lit(None).cast("string").alias("msg_id"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("normalized"), "ents", "tmps")
    state = state.join(misses.select("sender_id").distinct(), "sender_id", "left_semi")
    rows = misses.select("sender_id", "msg_id", "seq", "normalized", F.lit(None).cast("string").alias("ents"), F.lit(None).cast("string").alias("tmps")).unionByName(state)
    tasks = max(1, min(calls, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = rows.repartition(tasks, "sender_id").sortWithinPartitions("sender_id", F.col("seq").asc_nulls_first(), "msg_id")

    order = [ordered.columns.index(c) for c in ("sender_id", "msg_id", "seq", "normalized", "ents", "tmps")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {n: _KINDS[k] for n, k in (x.split(" ") for x in LEARN_OUT.split(", "))}
        s: SenderState | None = None

        def news(s: SenderState | None) -> list[dict]:
            if s is None:
                return []
            out = [{"kind": "template", "sender_id": s.sender, "template_id": k, "body": json.dumps(s.templates[k])} for k in sorted(s.new_templates)]
            return out + ([{"kind": "rules", "sender_id": s.sender, "body": json.dumps([{**e, "ord": i} for i, e in enumerate(s.entities)])}] if s.new_rules else [])

        def frame(out: list[dict]) -> pa.RecordBatch:
            cols = {n: [r.get(n) for r in out] for n in kinds}
            cols["entities"] = [v if v is None else list(v.items()) for v in cols["entities"]]
            return pa.RecordBatch.from_arrays([pa.array(cols[n], k) for n, k in kinds.items()], names=list(kinds))

        for b in batches:
            out: list[dict] = []
            for sender, msg_id, seq, text, ents_, tmps_ in zip(*(b.column(k).to_pylist() for k in order), strict=True):
                if s is None or s.sender != sender:
                    out += news(s)
                    s = SenderState(sender)
                if msg_id is None:
                    s = SenderState(sender, [_full_rule(e) for e in _rows_of(ents_)], [_full_template(t) for t in _rows_of(tmps_)])
                else:
                    out.append({"kind": "message", "msg_id": msg_id, "seq": seq, "sender_id": sender, "normalized": text, **s.process(text, teacher)})
            yield frame(out)
        yield frame(news(s))

    return ordered.mapInArrow(run, LEARN_OUT)


def _full_rule(e: dict) -> dict:
    return {"name": e.get("name"), "rule_type": e.get("rule_type"), "regex_variants": [{"regex": v.get("regex"), "grp": v.get("grp") or 0} for v in e.get("regex_variants") or ()], "boundary_pairs": [{k: p.get(k) for k in ("start_after", "end_before", "max_tokens")} for p in e.get("boundary_pairs") or ()]}


def _full_template(t: dict) -> dict:
    snap = ("name", "semantic_type", "rule_type", "regex", "grp", "start_after", "end_before", "max_tokens")
    keys = ("template_id", "sender_id", "category", "subcategory", "intent", "confidence", "canonical", "ordering", "static_hash", "seq_hash", "active")
    return {k: t.get(k) for k in keys} | {"snapshots": [{k: s.get(k) for k in snap} for s in t.get("snapshots") or ()]}


def new_templates(learned: DataFrame) -> DataFrame:
    body = f"struct<template_id:string,sender_id:string,category:string,subcategory:string,intent:string,confidence:double,canonical:string,snapshots:array<{SNAPSHOT}>,ordering:array<string>,static_hash:string,seq_hash:string,active:boolean>"
    return learned.filter("kind = 'template'").select(F.from_json("body", body).alias("t")).select("t.*")


def new_rules(learned: DataFrame) -> DataFrame:
    body = f"array<struct<ord:int,name:string,rule_type:string,regex_variants:array<{VARIANT}>,boundary_pairs:array<struct<start_after:string,end_before:string,max_tokens:int>>>>"
    return learned.filter("kind = 'rules'").select("sender_id", F.explode(F.from_json("body", body)).alias("e")).select("sender_id", "e.*")
