"""Rule tables: validation, compilation, and the changes that the rule administration makes (each gives a new table)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.engine import java_pattern
from spanloom.schemas import KEYWORD_MAPPING, REGEX, SPECIAL_CHAR


#: Normalization rules up to which each is a part of the plan's expression; more are carried as arrays.
UNROLLED = 200


def normalized(messages: DataFrame, rules: DataFrame, text: str = "text", to: str = "normalized") -> DataFrame:
    """messages with their normalized text. Few rules are unrolled, which keeps them in generated code; more are one row of arrays, to the same result."""
    bad = F.coalesce(F.col("key") == "", F.lit(True)) | F.concat("key", F.coalesce("value", F.lit(""))).rlike(r"[^\x00-\x7F]")
    if odd := rules.filter(bad).limit(1).collect():
        raise ValueError(f"normalization rules need a key and ASCII: {odd[0]}")
    rows = rules.orderBy("rule_type", "ord").limit(UNROLLED + 1).collect()
    if len(rows) <= UNROLLED:
        return messages.withColumn(to, T.normalize(F.col(text), [(r["rule_type"], r["key"], r["value"] or "") for r in rows]))
    entry = F.struct("ord", "key", F.coalesce("value", F.lit("")).alias("value"))
    of = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("rule_type") == kind, entry))).alias(name)
    one = rules.agg(of(KEYWORD_MAPPING, "_keywords"), of(SPECIAL_CHAR, "_digits"))
    return messages.crossJoin(F.broadcast(one)).withColumn(to, T.normalize_by(F.col(text), F.col("_keywords"), F.col("_digits"))).drop("_keywords", "_digits")  # one row


# ---- normalization rules (rule_type, ord, key, value)

def list_rules(rules: DataFrame) -> DataFrame:
    return rules.select("rule_type", "ord", "key", "value")


def from_json_mappings(stored: DataFrame) -> DataFrame:
    """(rule_type, mappings as a JSON object) to one row an entry; an unreadable object gives none."""
    entries = F.map_entries(F.from_json("mappings", "map<string,string>"))
    return stored.select("rule_type", F.posexplode(entries).alias("ord", "e")).select("rule_type", "ord", "e.key", "e.value")


def replace_mappings(rules: DataFrame, new: DataFrame) -> DataFrame:
    """All entries of the types in new are replaced."""
    return rules.join(new.select("rule_type").distinct(), "rule_type", "left_anti").select("rule_type", "ord", "key", "value").unionByName(new)


def put_mapping(rules: DataFrame, rule_type: str, key: str, value: str) -> DataFrame:
    """Adds or changes one entry; a new one comes last."""
    is_it = (F.col("rule_type") == rule_type) & (F.col("key") == key)
    place = rules.filter(F.col("rule_type") == rule_type).agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("ord"))), F.max("ord") + 1, F.lit(0)).cast("int").alias("ord"))
    return rules.filter(~is_it).select("rule_type", "ord", "key", "value").unionByName(place.select(F.lit(rule_type).alias("rule_type"), "ord", F.lit(key).alias("key"), F.lit(value).alias("value")))


def remove_mapping(rules: DataFrame, rule_type: str, key: str) -> DataFrame:
    """Without one entry; an absent key changes nothing, an absent type is an error."""
    if rules.filter(F.col("rule_type") == rule_type).isEmpty():
        raise KeyError(rule_type)
    return rules.filter((F.col("rule_type") != rule_type) | (F.col("key") != key))


def delete_type(rules: DataFrame, rule_type: str) -> DataFrame:
    return rules.filter(F.col("rule_type") != rule_type)


# ---- sender entities

def fingerprints(entities: DataFrame) -> DataFrame:
    """entities with fingerprint (sorted patterns) and duplicate: a REGEX rule whose fingerprint an earlier one of the sender has."""
    mark = F.when(F.col("rule_type") == REGEX, F.array_join(F.array_sort(F.transform("regex_variants", lambda v: v["regex"])), "|"))
    w = Window.partitionBy("sender_id", "fingerprint").orderBy("ord")
    out = entities.withColumn("fingerprint", mark)
    return out.withColumn("duplicate", F.coalesce((F.col("fingerprint") != "") & (F.row_number().over(w) > 1), F.lit(False)))


_ALIKE = {"LITERAL", "NOT_LITERAL", "IN", "RANGE", "NEGATE", "CATEGORY", "ANY", "AT", "BRANCH", "MAX_REPEAT", "MIN_REPEAT", "SUBPATTERN", "ASSERT", "ASSERT_NOT"}
_AT = {"AT_BEGINNING", "AT_END", "AT_BOUNDARY", "AT_NON_BOUNDARY"}


def alike(pattern: str) -> bool:
    """Whether a pattern surely finds the same in Python as in Java, in ASCII texts without \\r: plain parts only, no flags, no sets in sets, no repeated part that can be empty."""
    if re.search(r"\(\?[^:=!<]|&&|\[\^?\]|\\[^dDsSwWbBtnrf\W]", pattern) or re.search(r"[^\x20-\x7e]", pattern):
        return False
    inside = False
    for c in re.sub(r"\\.", "", pattern):
        if c == "[" and inside:
            return False
        inside = c == "[" or inside and c != "]"

    def plain(node) -> bool:
        if isinstance(node, re._parser.SubPattern):
            return all(plain(x) for x in node)
        op, av = node
        if str(op) not in _ALIKE or str(op) == "AT" and str(av) not in _AT:
            return False
        if str(op) in ("MAX_REPEAT", "MIN_REPEAT"):
            return av[2].getwidth()[0] > 0 and plain(av[2])
        if str(op) == "BRANCH":
            return all(plain(x) for x in av[1])
        return plain(av[-1]) if str(op) in ("SUBPATTERN", "ASSERT", "ASSERT_NOT") else True

    try:
        re.compile(pattern, re.ASCII)
        return plain(re._parser.parse(pattern))
    except Exception:  # noqa: BLE001  not a pattern of Python's
        return False


def odd_patterns(spark: SparkSession, entities: DataFrame) -> tuple[list[tuple[str, int]], list[str]]:
    """(variants that Java rejects, whole-match patterns that can match nothing)."""
    return _patterns(spark, entities)[:2]


def _patterns(spark: SparkSession, entities: DataFrame) -> tuple[list[tuple[str, int]], list[str], list[str]]:
    """odd_patterns(), and the other whole-match patterns that Python may read differently. Distinct variants stream through the driver one by one, once
    for each version of the rules; only the odd ones are kept."""
    pattern_class, bad, empty, javas = spark._jvm.java.util.regex.Pattern, [], [], []
    for r in entities.select(F.explode("regex_variants").alias("v")).select("v.regex", F.coalesce("v.grp", F.lit(0)).alias("grp")).distinct().toLocalIterator():
        try:
            ok = bool(r["regex"]) and pattern_class.compile(r["regex"]).matcher("").groupCount() >= r["grp"]
        except Exception:  # noqa: BLE001  Java's syntax error, wrapped by the gateway
            ok = False
        if not ok:
            bad.append((r["regex"], r["grp"]))
        elif not r["grp"]:
            try:
                least = re._parser.parse(java_pattern(r["regex"])).getwidth()[0]
            except Exception:  # noqa: BLE001  Java syntax that this parser doesn't know
                least = 0
            if not least:
                empty.append(r["regex"])
            elif not alike(r["regex"]):
                javas.append(r["regex"])
    return bad, empty, javas


def _without(variants: Column, regex: str, grp: int) -> Column:
    return F.filter(variants, lambda v: ~(v["regex"].eqNullSafe(regex) & (F.coalesce(v["grp"], F.lit(0)) == grp)))


def compile_entities(spark: SparkSession, entities: DataFrame) -> DataFrame:
    """One row a sender: its rules in order, without duplicates, as an array and as the JSON that the Arrow function caches by text; javas: whether one of its
    patterns has to be searched by Java.

    Variants that Java rejects are left out, as they would find nothing. Whole-match patterns that can match nothing get group -1, which has
    Python search them, as places can't be told from the pieces between such matches.
    """
    bad, empty, javas = _patterns(spark, entities)
    kept = fingerprints(entities).filter("not duplicate")
    variants = F.filter("regex_variants", lambda v: v["regex"].isNotNull() & (v["regex"] != ""))
    for regex, grp in bad:
        variants = _without(variants, regex, grp) if regex else variants
    if empty:
        variants = F.transform(variants, lambda v: F.struct(v["regex"].alias("regex"), F.when(v["regex"].isin(empty) & (F.coalesce(v["grp"], F.lit(0)) == 0), -1).otherwise(F.coalesce(v["grp"], F.lit(0))).alias("grp")))
    kept = kept.withColumn("regex_variants", F.coalesce(variants, F.array().cast("array<struct<regex:string,grp:int>>")))
    rules = F.array_sort(F.collect_list(F.struct("ord", "name", "rule_type", "regex_variants", "boundary_pairs"))).alias("entities")
    by_java = F.exists("regex_variants", lambda v: v["regex"].isin(javas) & (F.coalesce(v["grp"], F.lit(0)) == 0)) if javas else F.lit(False)
    return kept.groupBy("sender_id").agg(rules, F.max(by_java).alias("javas")).withColumn("rules_json", F.to_json("entities"))


def merge_entities(existing: DataFrame, learned: DataFrame) -> DataFrame:
    """Upserts learned rules (sender_id, lord, name, rule_type, regex, grp, start_after, end_before, max_tokens) into sender entities.

    A known name keeps its type and gets the pair unless it has one with the same anchors, and the pattern unless it has it with the same group;
    of repeats among the learned ones the first counts. A new name comes last, with a pair if an anchor is given.
    """
    keyed = learned.withColumn("first", F.row_number().over(Window.partitionBy("sender_id", "name").orderBy("lord")))
    pairs = learned.withColumn("n", F.row_number().over(Window.partitionBy("sender_id", "name", "start_after", "end_before").orderBy("lord"))).filter("n = 1")
    new_pairs = pairs.groupBy("sender_id", "name").agg(F.array_sort(F.collect_list(F.struct("lord", F.struct("start_after", "end_before", "max_tokens").alias("p")))).alias("np"))
    pats = learned.filter("regex is not null and regex <> ''").withColumn("n", F.row_number().over(Window.partitionBy("sender_id", "name", "regex", "grp").orderBy("lord"))).filter("n = 1")
    new_pats = pats.groupBy("sender_id", "name").agg(F.array_sort(F.collect_list(F.struct("lord", F.struct("regex", "grp").alias("v")))).alias("nv"))
    heads = keyed.filter("first = 1").select("sender_id", "name", F.col("rule_type").alias("new_type"), "lord", (F.col("start_after").isNotNull() | F.col("end_before").isNotNull()).alias("has_pair"))
    both = existing.join(heads, ["sender_id", "name"], "full_outer").join(new_pairs, ["sender_id", "name"], "left").join(new_pats, ["sender_id", "name"], "left")
    old_p, old_v = F.coalesce("boundary_pairs", F.array().cast("array<struct<start_after:string,end_before:string,max_tokens:int>>")), F.coalesce("regex_variants", F.array().cast("array<struct<regex:string,grp:int>>"))
    known = F.col("ord").isNotNull()
    add_p = F.expr("filter(transform(coalesce(np, array()), x -> x.p), x -> not exists(coalesce(boundary_pairs, array()), y -> y.start_after <=> x.start_after and y.end_before <=> x.end_before))")
    add_p = F.when(known, add_p).otherwise(F.filter(add_p, lambda p: F.col("has_pair") & (p["start_after"].isNotNull() | p["end_before"].isNotNull())))
    add_v = F.expr("filter(transform(coalesce(nv, array()), x -> x.v), x -> not exists(coalesce(regex_variants, array()), y -> y.regex <=> x.regex and y.grp <=> x.grp))")
    last = Window.partitionBy("sender_id")
    place = F.row_number().over(last.orderBy(F.col("ord").asc_nulls_last(), "lord", "name")) - 1
    return both.select("sender_id", place.cast("int").alias("ord"), "name", F.coalesce("rule_type", "new_type").alias("rule_type"), F.concat(old_v, F.when(F.col("nv").isNotNull(), add_v).otherwise(F.array().cast("array<struct<regex:string,grp:int>>"))).alias("regex_variants"), F.concat(old_p, F.when(F.col("np").isNotNull(), add_p).otherwise(F.array().cast("array<struct<start_after:string,end_before:string,max_tokens:int>>"))).alias("boundary_pairs"))


def upsert_by(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(new.select(old.columns))
