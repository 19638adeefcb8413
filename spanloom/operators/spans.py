"""Spans of rules in normalised texts, as arrays in the message's row, so nothing is shuffled to find them."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import bound
from spanloom.operators import engine
from spanloom.schemas import CANDIDATE, SPAN


def regex_spans(text: Column, name: Column, pattern: Column) -> Column:
    """All matches with their places. Matches and the pieces between them alternate, so running lengths give the places;
    the pattern must not match nothing."""

    def places(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            end = acc["at"] + F.length(m)
            span = F.struct(name.alias("name"), m.alias("value"), acc["at"].alias("st"), end.alias("en"))
            return F.struct((acc["i"] + 1).alias("i"), (end + F.length(F.get(pieces, acc["i"] + 1))).alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(F.regexp_extract_all(text, pattern, F.lit(0)), start, step, lambda acc: acc["out"])

    return bound(F.split(text, pattern, -1), places)


def regex_spans_of(text: str = "text", entities: str = "entities") -> Column:
    """The spans of all REGEX rules with whole-match patterns in an array of rules, in rule, variant and text order."""
    one = lambda e: F.flatten(F.transform(F.filter(e["regex_variants"], lambda v: F.coalesce(v["grp"], F.lit(0)) == 0), lambda v: regex_spans(F.col(text), e["name"], v["regex"])))
    return F.flatten(F.transform(F.filter(F.col(entities), lambda e: e["rule_type"] == "REGEX"), one))


def distinct_matches(spans: DataFrame) -> DataFrame:
    """(msg_id, ent_ord, variant_ord, match_ord, name, value, st, en) without an entity's repeats of start and value."""
    w = Window.partitionBy("msg_id", "ent_ord", "st", "value").orderBy("variant_ord", "match_ord")
    return spans.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def position_slots(spans: DataFrame) -> DataFrame:
    """(msg_id, slot, st, names, values): the alternatives at each start, slots in the order in which starts are first seen."""
    seen = F.struct("ent_ord", "variant_ord", "match_ord")
    by = spans.groupBy("msg_id", "st").agg(F.min(seen).alias("first"), F.array_sort(F.collect_list(F.struct(seen.alias("o"), "name", "value"))).alias("a"))
    slot = F.row_number().over(Window.partitionBy("msg_id").orderBy("first")) - 1
    return by.select("msg_id", slot.alias("slot"), "st", F.array_join("a.name", ",").alias("names"), F.array_join("a.value", ",").alias("values"))


def claimed(spans: Column, st: Column, en: Column) -> Column:
    """Whether [st, en) overlaps one of the spans."""
    return F.exists(spans, lambda s: (s["st"] < en) & (s["en"] > st))


def claimed_at(spans: Column, at: Column) -> Column:
    return F.exists(spans, lambda s: (s["st"] <= at) & (at < s["en"]))


def shortest_per_start(spans: DataFrame) -> DataFrame:
    """(msg_id, name, value, st, en): of each start the shortest span, the first of equals (by ord)."""
    return spans.groupBy("msg_id", "name", "st").agg(F.min(F.struct("en", "ord", "value")).alias("s")).select("msg_id", "name", "s.value", "st", "s.en")


def overlap_islands(spans: DataFrame) -> DataFrame:
    """spans with island: runs of spans of a message and name that overlap, numbered from 0 by start."""
    w = Window.partitionBy("msg_id", "name").orderBy("st", "en")
    reach = F.max("en").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("st") >= reach), 1).otherwise(0)
    return spans.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("new")


@lru_cache(10_000)
def _rules(text: str) -> tuple[engine.Rules, bool]:
    """Parsed rules with all keys, and whether Python has to search patterns itself (a group, or a match of nothing)."""
    rules = [{"name": e.get("name"), "rule_type": e.get("rule_type"), "regex_variants": [{"regex": v.get("regex"), "grp": v.get("grp") or 0} for v in e.get("regex_variants") or ()], "boundary_pairs": [{k: p.get(k) for k in ("start_after", "end_before", "max_tokens")} for p in e.get("boundary_pairs") or ()]} for e in json.loads(text)]
    rules = engine.distinct_rules(rules)
    return engine.Rules(rules, distinct=True), any(v["grp"] for e in rules for v in e["regex_variants"])


#: Candidates of one message that are kept in its row. With more, the row says so, and learning.learn() tries them one by one.
KEPT = 10_000


def candidates_array(found: Iterable[Iterable[list[engine.Span]]]) -> pa.Array:
    """An array of candidates for each message, put together from flat columns: nested Python objects take longer to make than to find."""
    flat: list[engine.Span] = []
    ords, ends, upto = [], [0], [0]
    for cands in found:
        for i, c in enumerate(cands):
            ords.append(i)
            flat += c
            ends.append(len(flat))
        upto.append(len(ords))
    name, value, st, en = ([s[k] for s in flat] for k in range(4))
    names, at = pa.array(name, pa.string()), pa.array(ends, pa.int32())
    values = pa.StructArray.from_arrays([names, pa.array(value, pa.string()), pa.array(st, pa.int32()), pa.array(en, pa.int32())], ["name", "value", "st", "en"])
    rows = pa.StructArray.from_arrays([pa.array(ords, pa.int32()), pa.ListArray.from_arrays(at, values), pa.ListArray.from_arrays(at, names)], ["ord", "values", "names"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows)


def spans_of_rows(column: pa.Array) -> list[list[engine.Span] | None]:
    """The spans of each row of a list column; none (null) where the column is null."""
    if column.null_count == len(column):
        return [None] * len(column)
    parts = column.flatten()
    flat = list(map(engine.Span, *(parts.field(k).to_pylist() for k in range(4))))
    n = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    ends = list(itertools.accumulate(n))
    return [flat[e - k : e] if there else None for k, e, there in zip(n, ends, column.is_valid().to_pylist(), strict=True)]


def repeated(column: pa.Array) -> list[str | None]:
    """The texts of a column of few different ones: equal texts are one object."""
    d = column.dictionary_encode()
    texts = [*d.dictionary.to_pylist(), None]
    return [texts[-1 if x is None else x] for x in d.indices.to_pylist()]


def _found(t: str | None, r: str | None, spans: list[engine.Span] | None) -> Iterator[list[engine.Span]]:
    if not t or not r:
        return iter(())
    parsed, own = _rules(r)
    by: dict[str, list[engine.Span]] | None = None
    if not own and spans is not None:
        by = {}
        for s in spans:
            by.setdefault(s.name, []).append(s)
    return engine.extract(t, parsed, by)


def with_candidates(rows: DataFrame, text: str = "text", rules_json: str = "rules_json", spans: str = "spans") -> DataFrame:
    """rows with cands, the candidates of each message, in place of the rules and the spans; more: whether there are others beyond KEPT.

    Spans of REGEX rules come from the JVM (regex_spans_of); boundary rules and combinations are made in Arrow batches, with each sender's
    rules parsed once a worker.
    """
    kept = [f for f in rows.schema.fields if f.name not in (rules_json, spans)]
    at = [rows.columns.index(f.name) for f in kept]
    i, j, k = (rows.columns.index(c) for c in (text, rules_json, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_found(t, r, s) for t, r, s in zip(b.column(i).to_pylist(), repeated(b.column(j)), spans_of_rows(b.column(k)), strict=True)]
            cands = candidates_array(itertools.islice(f, KEPT) for f in found)
            more = [next(f, None) is not None for f in found]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in at), cands, pa.array(more, pa.bool_())], names=[*(b.schema.names[x] for x in at), "cands", "more"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{ddl}, cands array<{CANDIDATE}>, more boolean")


@lru_cache(200)
def _templates(text: str) -> engine.Templates:
    """Parsed templates, each with its place in the list."""
    out = []
    for i, t in enumerate(json.loads(text)):
        none = [dict.fromkeys(("name", "rule_type", "start_after", "end_before", "max_tokens"))]  # null snapshots hold nowhere
        snaps = none if t.get("snapshots") is None else [{k: s.get(k) for k in none[0]} for s in t["snapshots"]]
        out.append({k: t.get(k) for k in ("category", "subcategory", "static_hash", "seq_hash", "active")} | {"snapshots": snaps, "at": i})
    return engine.Templates(out)


def with_outcomes(rows: DataFrame, text: str = "normalized", rules_json: str = "rules_json", spans: str = "spans", templates_json: str = "templates_json") -> DataFrame:
    """rows with what became of each message, in place of the rules, the spans and the templates: win_at (the place in its sender's list of the template that won), won
    (the values), win_ord (the place of its candidate), reason (if none won), more (there are candidates beyond KEPT, and none of those won). A message's candidates never leave
    its task: the search ends with the first that matches."""
    kept = [f for f in rows.schema.fields if f.name not in (rules_json, spans, templates_json)]
    at = [rows.columns.index(f.name) for f in kept]
    i, j, k, m = (rows.columns.index(c) for c in (text, rules_json, spans, templates_json))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            win, ords, reasons, more = [], [], [], []
            ends, flat, there = [0], [], []
            for t, r, s, x in zip(b.column(i).to_pylist(), repeated(b.column(j)), spans_of_rows(b.column(k)), repeated(b.column(m)), strict=True):
                found = _found(t, r, s)
                got, values, ord_, reason = engine.outcome(t or "", itertools.islice(found, KEPT), _templates(x or "[]"), bool(r) and _rules(r)[0].any)
                win.append(None if got is None else got["at"])
                ords.append(ord_)
                reasons.append(reason)
                more.append(got is None and next(found, None) is not None)
                there.append(got is None)
                flat += values
                ends.append(len(flat))
            name, value, st, en = ([v[c] for v in flat] for c in range(4))
            values = pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(value, pa.string()), pa.array(st, pa.int32()), pa.array(en, pa.int32())], ["name", "value", "st", "en"])
            won = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(there, pa.bool_()))
            cols = [pa.array(win, pa.int32()), won, pa.array(ords, pa.int32()), pa.array(reasons, pa.string()), pa.array(more, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in at), *cols], names=[*(b.schema.names[x] for x in at), "win_at", "won", "win_ord", "reason", "more"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{ddl}, win_at int, won array<{SPAN}>, win_ord int, reason string, more boolean")


class Extract:
    """The handler of a table function: a row a span of each candidate of one text under rules given as JSON."""

    def eval(self, text: str, rules_json: str):
        for i, c in enumerate(_found(text, rules_json, None)):
            for v in c:
                yield i, *v


def register_extract(spark: SparkSession, name: str = "extract_spans") -> None:
    """SELECT * FROM extract_spans(text, rules_json): for looking at single messages; tables of them go through with_candidates()."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Extract, returnType="ord int, name string, value string, st int, en int"))
