"""The registered queries of the extraction engine, and the SQL that their results must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import text as T
from spanloom.operators import candidates as C
from spanloom.operators import engine, learning, matching, metrics, rules, spans
from spanloom.plans import inputs as I
from spanloom.plans import pipeline
from spanloom.sources import messages as sources
from spanloom.sources import tables
from spanloom.streaming import stateful, stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL. {messages}, {records} and the like in the SQL stand for shared parts."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    parts = {"{messages}": I.MESSAGES_SQL, "{records}": I.RECORDS_SQL, "{rules}": RULES_SQL, "{docs}": DOCS_SQL}
    out = {}
    for name, sql in _SQL.items():
        for mark, part in parts.items():
            sql = sql.replace(mark, part)
        out[name] = sql
    return out


# ---- normalization

DOCS_SQL = r"""d as (
  select doc_id, coalesce(text, '') as text,
    regexp_replace(replace(replace(upper(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]+', ' ', 'g')), 'RS.', 'INR'), 'A/C', 'ACCOUNT'), '([0-9])/([0-9])', '\1-\2', 'g') as mapped
  from documents
), nd as (
  select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(mapped, '([0-9]),([0-9])', '\1\2', 'g'), '[\t\n\r\f]', ' ', 'g'), ' {2,}', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as t from d
)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _normal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text"), I.MAPPINGS).alias("t"))


@query("with {docs} select doc_id, t as text from nd")
def normalize_full(spark, sf_dir):
    return _normal_docs(spark, sf_dir).withColumnRenamed("t", "text")


@query(r"select doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]+', ' ', 'g') as text from documents")
def normalize_ascii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_non_ascii(F.col("text")).alias("text"))


@query("with {messages} select seq, replace(replace(upper(text), 'RS.', 'INR'), 'A/C', 'ACCOUNT') as text from m")
def normalize_keywords(spark, sf_dir):
    return I.messages(spark, sf_dir).select("seq", T.map_keywords(F.upper("text"), I.MAPPINGS).alias("text"))


@query(r"with {messages} select seq, regexp_replace(text, '([0-9])/([0-9])', '\1-\2', 'g') as text from m")
def normalize_digits(spark, sf_dir):
    return I.messages(spark, sf_dir).select("seq", T.map_between_digits(F.col("text"), I.MAPPINGS).alias("text"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\t\n\r\f]', ' ', 'g'), ' {2,}', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as text from documents")
def normalize_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold_space(F.col("text")).alias("text"))


@query("with {messages} select seq, sender_id, normalized from n")
def normalize_messages(spark, sf_dir):
    return I.normalized(spark, sf_dir).select("seq", "sender_id", "normalized")


@query("with {messages} select seq, normalized from n")
def normalize_by_table(spark, sf_dir):
    """As many rules as aren't unrolled any more: the same result by arrays."""
    none = [("KEYWORD_MAPPING", f"~{i}~", "X") for i in range(rules.UNROLLED)]
    return rules.normalized(I.messages(spark, sf_dir), _normalization(spark, none)).select("seq", "normalized")


def _normalization(spark: SparkSession, before=()) -> DataFrame:
    return spark.createDataFrame([(k, i, a, b) for i, (k, a, b) in enumerate((*before, *I.MAPPINGS))], schemas.NORMALIZATION_RULES)


_FOREIGN = r"""g as (select doc_id, case when doc_id % 2 = 0 then text else regexp_replace(text, '[a-zA-Z]', '', 'g') end as text from documents where text is not null),
f as (select *, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) as foreign_units, length(regexp_replace(text, '\P{L}', '', 'g')) as letters from g)"""


def _gate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document without its ASCII letters, so that both sides of the gate have some."""
    d = I.table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[a-zA-Z]", "")).alias("text"))


@query(f"with {_FOREIGN} select doc_id, letters > 0 and foreign_units > 0.3 * letters as is_foreign from f")
def non_english_filter(spark, sf_dir):
    return _gate_docs(spark, sf_dir).select("doc_id", T.non_english(F.col("text")).alias("is_foreign"))


@query(f"with {_FOREIGN} select doc_id::varchar as msg_id, 'D' as sender_id, text as raw, null::varchar as template_id, 0.0::double as confidence from f where letters > 0 and foreign_units > 0.3 * letters")
def non_english_skip_result(spark, sf_dir):
    m = _gate_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("msg_id"), F.lit("D").alias("sender_id"), "text")
    _, skipped = pipeline.prepared(m, spark.createDataFrame([], schemas.NORMALIZATION_RULES))
    return skipped.select("msg_id", "sender_id", F.col("text").alias("raw"), F.lit(None).cast("string").alias("template_id"), F.lit(0.0).alias("confidence"))


# ---- sources

@query("select user_id::varchar as sender_id, event_type || ' ' || event_id::varchar as text from events where event_id % 10 not in (0, 1, 2)")
def json_ingest(spark, sf_dir):
    e, i = I.table(spark, sf_dir, "events"), F.col("event_id") % 10
    body = F.to_json(F.struct(F.when(i != 2, F.col("user_id")).alias("senderId"), F.when(i == 1, "  ").otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("text"), F.lit(1).alias("other")))
    return sources.from_json_lines(e.select(F.when(i == 0, '{"senderId": ').otherwise(body).alias("value")))


RULES_SQL = "u as (select case when n_regionkey < 3 then 'KEYWORD_MAPPING' else 'SPECIAL_CHAR' end as rule_type, n_nationkey as ord, n_name as key, 'R' || n_regionkey::varchar as value from nation)"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.table(spark, sf_dir, "nation")
    return n.select(F.when(F.col("n_regionkey") < 3, schemas.KEYWORD_MAPPING).otherwise(schemas.SPECIAL_CHAR).alias("rule_type"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("key"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("value"))


@query("with {rules} select * from u")
def rules_list(spark, sf_dir):
    return rules.list_rules(_rules(spark, sf_dir))


@query("with {rules} select rule_type, (row_number() over (partition by rule_type order by ord) - 1)::int as ord, key, value from u")
def rules_scan(spark, sf_dir):
    """Stored as a JSON object a type, read back as rows."""
    by = _rules(spark, sf_dir).groupBy("rule_type").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))).alias("e"))
    return rules.from_json_mappings(by.select("rule_type", F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], x["value"])))).alias("mappings")))


@query("with {rules} select * from u where rule_type <> 'SPECIAL_CHAR' union all select 'SPECIAL_CHAR', 0, '/', '-'")
def rules_upsert(spark, sf_dir):
    return rules.replace_mappings(_rules(spark, sf_dir), spark.createDataFrame([(schemas.SPECIAL_CHAR, 0, "/", "-")], schemas.NORMALIZATION_RULES))


@query("with {rules} select * from u where not (rule_type = 'KEYWORD_MAPPING' and key = 'INDIA') union all select 'KEYWORD_MAPPING', coalesce((select ord from u where rule_type = 'KEYWORD_MAPPING' and key = 'INDIA'), (select max(ord) + 1 from u where rule_type = 'KEYWORD_MAPPING')), 'INDIA', 'X' union all select 'SPECIAL_CHAR', (select max(ord) + 1 from u where rule_type = 'SPECIAL_CHAR'), ';', ','")
def rules_add(spark, sf_dir):
    return rules.put_mapping(rules.put_mapping(_rules(spark, sf_dir), schemas.KEYWORD_MAPPING, "INDIA", "X"), schemas.SPECIAL_CHAR, ";", ",")


@query("with {rules} select * from u where not (rule_type = 'KEYWORD_MAPPING' and key = 'FRANCE')")
def rules_remove(spark, sf_dir):
    return rules.remove_mapping(rules.remove_mapping(_rules(spark, sf_dir), schemas.KEYWORD_MAPPING, "FRANCE"), schemas.KEYWORD_MAPPING, "absent")


@query("with {rules} select * from u where rule_type <> 'KEYWORD_MAPPING'")
def rules_delete(spark, sf_dir):
    return rules.delete_type(_rules(spark, sf_dir), schemas.KEYWORD_MAPPING)


@query("with {messages} select sender_id, case when region < 3 then 5 when region = 3 then 1 else 0 end::bigint as n_rules, count(*) as n_msgs from m group by sender_id, region")
def entity_lookup(spark, sf_dir):
    """Senders with all rules, with one, and with none."""
    by = I.entities(spark, sf_dir).join(F.broadcast(I.senders(spark, sf_dir)), "sender_id").filter("region < 3 or region = 3 and ord = 0").drop("region")
    rows = tables.entities_of(I.messages(spark, sf_dir), matching.small(rules.compile_entities(spark, by)))
    return rows.groupBy("sender_id").agg(F.coalesce(F.max(F.size("entities")), F.lit(0)).cast("bigint").alias("n_rules"), F.count("*").alias("n_msgs"))


@query("select 'S' || (user_id % 50)::varchar as sender_id, 2 * count(*) as n_rows, 2 * count(*) as n_ids from events group by 1")
def kafka_ids(spark, sf_dir):
    """Equal messages at equal offsets of two partitions have ids of their own."""
    e = I.table(spark, sf_dir, "events")
    value = F.to_json(F.struct(F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("senderId"), F.lit("SAME TEXT").alias("text")))
    records = e.select(F.lit("inbound").alias("topic"), F.col("event_id").alias("offset"), value.alias("value"))
    m = sources.of_kafka(records.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("partition")))
    return m.groupBy("sender_id").agg(F.count("*").alias("n_rows"), F.countDistinct("msg_id").alias("n_ids"))


@query("""select (2 * k + j)::bigint as seq, 'BANK-' || n_name as sender_id, case when n_regionkey < 4 then n_nationkey::varchar || '.25' end as amount
  from (select *, row_number() over (order by n_nationkey) - 1 as k from nation) cross join (values (0), (1)) t(j)""")
def batch_api(spark, sf_dir):
    """A list of messages in its order, each one twice: two results for two equal messages. Nations are a fixed few."""
    n = I.table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()
    text = lambda r: f"Rs. {r['n_nationkey']}.25 debited from A/C XX0001 on 01/02/2024 at SHOP Avl Bal INR 9.5" if r["n_regionkey"] < 4 else "nothing"
    m = sources.batch(spark, [(f"BANK-{r['n_name']}", text(r)) for r in n for _ in (0, 1)])
    found, missed, _ = pipeline.process(spark, m, _normalization(spark), I.entities(spark, sf_dir), I.bank_templates(spark, sf_dir))
    return found.select("seq", "sender_id", F.col("entities")["amount"].alias("amount")).union(missed.select("seq", "sender_id", F.lit(None).cast("string"))).orderBy("seq")


@query("select 'BANK-' || n_name as sender_id, sha256('BANK-' || n_name || '::INR {AMOUNT} DEBITED') as template_id from nation where n_regionkey = 1")
def template_by_id(spark, sf_dir):
    t = I.bank_templates(spark, sf_dir)
    ids = I.senders(spark, sf_dir).filter("region = 1").select(T.template_id(F.col("sender_id"), F.lit("INR {AMOUNT} DEBITED")).alias("template_id"))
    return tables.template_by_id(t, ids).select("sender_id", "template_id")


# ---- hashes, anchors

@query("select p_partkey, sha256(p_name) as h from part")
def sha256_hex(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select("p_partkey", T.sha256(F.col("p_name")).alias("h"))


@query("with {messages} select seq, sha256(replace(replace(replace(replace(replace(replace(normalized, amount, ''), account, ''), day, ''), merchant, ''), balance, ''), ' ', '')) as static_hash from v")
def static_hash(spark, sf_dir):
    values = F.array(*[F.regexp_extract("normalized", p, 0) for p in (I.AMOUNT, I.ACCOUNT, I.DATE, "(?<= AT ).*(?= AVL )", I.BALANCE)])
    return I.normalized(spark, sf_dir).select("seq", T.static_hash(F.col("normalized"), values).alias("static_hash"))


@query("select n_nationkey, sha256('AMOUNT:' || n_name) as seq_hash from nation union all select -1, sha256('')")
def sequence_hash(spark, sf_dir):
    n = I.table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.lit("AMOUNT"), "n_name").alias("names"))
    none = spark.range(1).select(F.lit(-1).alias("n_nationkey"), F.array().cast("array<string>").alias("names"))
    return n.union(none).select("n_nationkey", T.sequence_hash(F.col("names")).alias("seq_hash"))


@query("select o_orderkey, sha256('S' || o_custkey::varchar || '::' || o_orderpriority) as template_id from orders")
def template_id(spark, sf_dir):
    return I.table(spark, sf_dir, "orders").select("o_orderkey", T.template_id(F.concat(F.lit("S"), F.col("o_custkey").cast("string")), F.col("o_orderpriority")).alias("template_id"))


@query("select * from (values ('{A}', true, false, false), ('{}', false, false, false), ('som', false, true, false), ('EOM', false, false, true), ('AT', false, false, false)) t(anchor, is_ref, is_som, is_eom)")
def anchor_kinds(spark, sf_dir):
    a = spark.createDataFrame([("{A}",), ("{}",), ("som",), ("EOM",), ("AT",)], "anchor string")
    c = F.col("anchor")
    return a.select("anchor", T.is_entity_ref(c).alias("is_ref"), T.is_start_mark(c).alias("is_som"), T.is_end_mark(c).alias("is_eom"))


@query("with {docs} select doc_id, case when regexp_matches(t, '(?s)^(?:.*?[^0-9A-Za-z])??THE(?:[^A-Za-z]|$)') then length(regexp_extract(t, '(?s)^(.*?[^0-9A-Za-z])??THE(?:[^A-Za-z]|$)', 1)) else -1 end::int as at, strpos(t, ', ') - 1 as comma from nd")
def token_search(spark, sf_dir):
    return _normal_docs(spark, sf_dir).select("doc_id", T.anchor_at(F.col("t"), "the").cast("int").alias("at"), T.anchor_at(F.col("t"), ", ").cast("bigint").alias("comma"))


@query("with {messages} select seq, strpos(normalized, ' ON ')::int as at from n")
def token_search_matching(spark, sf_dir):
    return I.normalized(spark, sf_dir).select("seq", T.anchor_at(F.lower("normalized"), "on", matching=True).cast("int").alias("at"))


@query("with {docs} select doc_id, regexp_extract(t, '^(?: *[^ ]+){1,3}', 0) as head, len(string_split_regex(t, '\\s+'))::int as n_words from nd")
def greedy_words(spark, sf_dir):
    return _normal_docs(spark, sf_dir).select("doc_id", T.first_words(F.col("t"), 3).alias("head"), T.word_count(F.col("t")).alias("n_words"))


# ---- spans

def _spans(name: str, pattern: str) -> Column:
    return spans.regex_spans(F.col("normalized"), F.lit(name), F.lit(pattern))


_SPANS_SQL = """s as (
  select seq, string_split_regex(normalized, '{p}') as g, regexp_extract_all(normalized, '{p}') as x from n
), e as (select seq, g, x, unnest(x) as value, generate_subscripts(x, 1) as i from s),
p as (select seq, (i - 1)::int as i, value, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y))), 0))::int as st from e)"""


@query("with {messages}, " + _SPANS_SQL.replace("{p}", "[0-9]+") + " select seq, i, value, st, (st + length(value))::int as en from p")
def regex_spans(spark, sf_dir):
    s = I.normalized(spark, sf_dir).select("seq", F.posexplode(_spans("N", "[0-9]+")).alias("i", "s"))
    return s.select("seq", "i", "s.value", "s.st", "s.en")


def _numbers(spark: SparkSession, sf_dir: str, *patterns: str) -> DataFrame:
    """The spans of several variants of one entity, as a table."""
    n, out = I.normalized(spark, sf_dir), None
    for k, p in enumerate(patterns):
        rows = n.select(F.col("seq").alias("msg_id"), F.lit(0).alias("ent_ord"), F.lit(k).alias("variant_ord"), F.posexplode(_spans("N", p)).alias("match_ord", "s")).select("msg_id", "ent_ord", "variant_ord", "match_ord", "s.*")
        out = rows if out is None else out.union(rows)
    return out


@query("with {messages}, " + _SPANS_SQL.replace("{p}", "[0-9]+") + " select seq, st, value from p")
def regex_dedup(spark, sf_dir):
    return spans.distinct_matches(_numbers(spark, sf_dir, "[0-9]+", "(?<![0-9])[0-9]{2,}", "[0-9]+(?![0-9])")).select(F.col("msg_id").alias("seq"), "st", "value")


@query("select p_brand as sender_id, p_partkey::int as ord, row_number() over (partition by p_brand, p_size order by p_partkey) > 1 as duplicate from part")
def regex_fingerprint(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    e = p.select(F.col("p_brand").alias("sender_id"), F.col("p_partkey").cast("int").alias("ord"), F.lit(schemas.REGEX).alias("rule_type"), F.array(F.struct(F.concat(F.lit("b"), size).alias("regex"), F.lit(0).alias("grp")), F.struct(F.concat(F.lit("a"), size).alias("regex"), F.lit(0).alias("grp"))).alias("regex_variants"))
    return rules.fingerprints(e).select("sender_id", "ord", "duplicate")


@query("with {messages}, " + _SPANS_SQL.replace("{p}", "[0-9]+") + """
, w as (select seq, st, value, regexp_extract(substr(normalized, st + 1), '^[0-9]+(\\.[0-9]+)?', 0) as wide from p join n using (seq)),
a as (select seq, st, value, wide, wide <> value as two from w)
select seq, (row_number() over (partition by seq order by st) - 1)::int as slot, st, case when two then value || ',' || wide else value end as values from a""")
def position_slots(spark, sf_dir):
    s = spans.distinct_matches(_numbers(spark, sf_dir, "[0-9]+", r"[0-9]+\.[0-9]+"))
    return spans.position_slots(s).select(F.col("msg_id").alias("seq"), F.col("slot").cast("int").alias("slot"), "st", "values")


def _first_values(spark: SparkSession, sf_dir: str, name: str, only) -> DataFrame:
    """The named value of each message's first candidate, under the given rules."""
    compiled = rules.compile_entities(spark, I.entities(spark, sf_dir, only))
    rows = pipeline.with_candidates(I.normalized(spark, sf_dir).withColumnRenamed("text", "raw_text"), compiled)
    value = F.get(F.filter(F.get("cands", F.lit(0))["values"], lambda v: v["name"] == name), F.lit(0))
    return rows.select("seq", value.alias("v")).select("seq", "v.value", "v.st", "v.en")


def _rule(pair) -> tuple:
    return (("V", None, pair),)


@query("with {messages} select seq, merchant as value, (strpos(normalized, ' AT ') + 3)::int as st, (strpos(normalized, ' AVL ') - 1)::int as en from v")
def boundary_literal(spark, sf_dir):
    return _first_values(spark, sf_dir, "V", _rule(("AT", "AVL", 3)))


@query("with {messages} select seq, 'INR ' || amount as value, 0 as st, length('INR ' || amount)::int as en from v")
def boundary_som(spark, sf_dir):
    return _first_values(spark, sf_dir, "V", _rule(("SOM", "DEBITED", 5)))


@query("with {messages} select seq, 'INR ' || balance as value, (strpos(normalized, ' BAL ') + 4)::int as st, length(normalized)::int as en from v")
def boundary_eom(spark, sf_dir):
    return _first_values(spark, sf_dir, "V", _rule(("BAL", "EOM", 5)))


@query("with {messages} select seq, merchant || ' AVL' as value, (strpos(normalized, ' AT ') + 3)::int as st, (strpos(normalized, ' AT ') + 3 + length(merchant) + 4)::int as en from v")
def boundary_greedy(spark, sf_dir):
    return _first_values(spark, sf_dir, "V", _rule(("AT", "", 2)))


@query("with {messages} select seq, 'DEBITED' as value, (length('INR ' || amount) + 1)::int as st, (length('INR ' || amount) + 8)::int as en from v")
def boundary_entity_ref(spark, sf_dir):
    return _first_values(spark, sf_dir, "V", (I.RULES[0], ("V", None, ("{AMOUNT}", "FROM", 3))))


@query("with {messages} select seq, merchant as value, (strpos(normalized, ' AT ') + 3)::int as st, (strpos(normalized, ' AVL ') - 1)::int as en from v")
def boundary_fixpoint(spark, sf_dir):
    """V waits for W, which waits for the REGEX entity DATE."""
    return _first_values(spark, sf_dir, "V", (("V", None, ("{W}", "AVL", 3)), ("W", None, ("{DATE}", "", 1)), I.RULES[2]))


def _values(spark: SparkSession, sf_dir: str, name: str, only, tail: Column | None = None) -> DataFrame:
    """(seq, all values of the name in each message's first candidate, as text@start), of messages with something added."""
    n = I.normalized(spark, sf_dir)
    n = n if tail is None else n.withColumn("v", F.regexp_extract("normalized", " AT (.*) AVL ", 1)).withColumn("normalized", F.concat("normalized", tail)).drop("v")
    rows = pipeline.with_candidates(n.withColumnRenamed("text", "raw_text"), rules.compile_entities(spark, I.entities(spark, sf_dir, only)))
    of = F.transform(F.filter(F.get("cands", F.lit(0))["values"], lambda v: v["name"] == name), lambda v: F.concat(v["value"], F.lit("@"), v["st"].cast("string")))
    return rows.select("seq", F.coalesce(F.array_join(of, "|"), F.lit("")).alias("found"))


@query("with {messages} select seq, amount || '@4' || case when amount = balance then '' else '|' || balance || '@' || (strpos(normalized, ' BAL INR ') + 8)::varchar end as found from v")
def boundary_occurrences(spark, sf_dir):
    """Each place of a literal anchor; a value whose text was there before counts once."""
    return _values(spark, sf_dir, "V", (("V", None, ("INR", "", 1)),))


@query("with {messages} select seq, merchant || '@' || (length(normalized) + length(' AGAIN AT '))::varchar as found from v")
def boundary_specificity(spark, sf_dir):
    """The longer anchors come first though they are listed last, so the value is kept at their place."""
    return _values(spark, sf_dir, "V", (("V", None, (("AT", "", 1), ("AGAIN AT", "EOM", 3))),), F.concat(F.lit(" AGAIN AT "), "v"))


@query("with {messages} select seq, merchant || '@' || (length(normalized) + length(' ACCOUNT '))::varchar as found from v")
def boundary_retry(spark, sf_dir):
    """The span from the first place of the anchor crosses a pattern's; the next place is taken."""
    return _values(spark, sf_dir, "V", (I.RULES[2], ("V", None, ("ACCOUNT", "AT", 9))), F.concat(F.lit(" ACCOUNT "), "v", F.lit(" AT END")))


@query("with {messages} select seq, '' as found from v")
def boundary_no_retry(spark, sf_dir):
    """Up to the end of the message there is no later place that could do."""
    return _values(spark, sf_dir, "V", (I.RULES[2], ("V", None, ("ACCOUNT", "EOM", 9))), F.concat(F.lit(" ACCOUNT "), "v"))


@query("with {messages}, " + _SPANS_SQL.replace("{p}", "[0-9]+") + " select seq, i, st, st < strpos(normalized, ' DEBITED') - 1 as taken, st >= 4 and st < 4 + length(amount) as inside from p join v using (seq)")
def claimed_filter(spark, sf_dir):
    n = I.normalized(spark, sf_dir).withColumn("own", _spans("AMOUNT", I.AMOUNT)).select("seq", "own", F.posexplode(_spans("N", "[0-9]+")).alias("i", "s"))
    return n.select("seq", "i", "s.st", spans.claimed(F.col("own"), F.col("s.st"), F.col("s.en")).alias("taken"), spans.claimed_at(F.col("own"), F.col("s.st")).alias("inside"))


_LINES = "l as (select l_orderkey as msg_id, l_returnflag as name, (l_partkey % 50)::int as st, (l_partkey % 50 + 1 + l_suppkey % 7)::int as en, l_linenumber as ord from lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = I.table(spark, sf_dir, "lineitem")
    st = (F.col("l_partkey") % 50).cast("int")
    return l.select(F.col("l_orderkey").alias("msg_id"), F.col("l_returnflag").alias("name"), st.alias("st"), (st + 1 + F.col("l_suppkey") % 7).cast("int").alias("en"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("value"))


@query(f"with {_LINES} select msg_id, name, st, en, ord::varchar as value from l qualify row_number() over (partition by msg_id, name, st order by en, ord) = 1")
def shortest_per_start(spark, sf_dir):
    return spans.shortest_per_start(_lines(spark, sf_dir)).select("msg_id", "name", "st", "en", "value")


@query(f"""with {_LINES}, s as (select * from l qualify row_number() over (partition by msg_id, name, st order by en, ord) = 1),
a as (select *, coalesce(max(en) over (partition by msg_id, name order by st rows between unbounded preceding and 1 preceding), -1) as reach from s)
select msg_id, name, st, en, sum((st >= reach)::int) over (partition by msg_id, name order by st)::bigint - 1 as island from a""")
def overlap_islands(spark, sf_dir):
    one = spans.shortest_per_start(_lines(spark, sf_dir))
    return spans.overlap_islands(one).select("msg_id", "name", "st", "en", F.col("island").cast("bigint").alias("island"))


# ---- candidates

def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, a): the line numbers of each order, sorted."""
    l = I.table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("a"))


_ARRAYS = "x as (select l_orderkey, list_sort(list(distinct l_linenumber::varchar)) as a from lineitem group by l_orderkey)"


@query(f"with {_ARRAYS} select l_orderkey, ((row_number() over (partition by l_orderkey order by i, j)) - 1)::int as ord, a[i] || '/' || b as combo from (select l_orderkey, a, unnest(range(1, len(a) + 1)) as i from x) cross join (values (1, 'u'), (2, 'v')) t(j, b)")
def cartesian_combos(spark, sf_dir):
    slots = F.array(F.col("a"), F.array(F.lit("u"), F.lit("v")))
    rows = _arrays(spark, sf_dir).select("l_orderkey", F.posexplode(C.product(slots)).alias("ord", "c"))
    return rows.select("l_orderkey", "ord", F.array_join("c", "/").alias("combo"))


@query(f"with {_ARRAYS}, m as (select l_orderkey, a, unnest(range(1, (1 << len(a)) - 1)) as mask from x where len(a) > 1) select l_orderkey, (mask - 1)::int as ord, array_to_string(list_filter(a, lambda y, i: (mask >> (i - 1)) & 1 = 1), '|') as subset from m")
def power_set(spark, sf_dir):
    rows = _arrays(spark, sf_dir).select("l_orderkey", F.posexplode(C.proper_subsets(F.col("a"))).alias("ord", "s"))
    return rows.select("l_orderkey", "ord", F.array_join("s", "|").alias("subset"))


def _span_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lines(spark, sf_dir).select("msg_id", F.struct("name", "value", "st", "en").alias("s"), "ord")
    return s.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]).alias("spans"))


@query(f"with {_LINES}, a as (select *, lead(st) over (partition by msg_id order by st, ord) as nxt from l) select msg_id, coalesce(bool_or(en > nxt), false) as discarded from a group by msg_id")
def overlap_discard(spark, sf_dir):
    return _span_arrays(spark, sf_dir).select("msg_id", C.overlaps(C.by_start(F.col("spans"))).alias("discarded"))


def _apart(rows: pa.Array) -> pa.Array:
    return pa.array([["|".join(s.value for s in v) for v in engine.apart([engine.Span(**s) for s in r])] for r in rows.to_pylist()], pa.list_(pa.string()))


@query(f"""with recursive {_LINES}, b as (select msg_id, list(struct_pack(st := st, en := en, v := ord::varchar) order by st, ord, name, en) as s from l group by msg_id),
r as (
  select msg_id, '' as path, s from b
  union all
  select msg_id, path || branch, case branch when '0' then s[1:i - 1] || s[i + 1:] else s[1:i] || s[i + 2:] end
  from (select *, list_position(list_transform(range(1, len(s)), lambda k: s[k].en > s[k + 1].st), true) as i from r) cross join (values ('0'), ('1')) t(branch) where i > 0
)
select msg_id, (row_number() over (partition by msg_id order by path) - 1)::int as ord, array_to_string(list_transform(s, lambda x: x.v), '|') as variant
from r where not list_contains(list_transform(range(1, len(s)), lambda k: s[k].en > s[k + 1].st), true)""")
def nonoverlap_variants(spark, sf_dir):
    """Without the left, then without the right one of the first two that overlap, again and again."""
    rows = _span_arrays(spark, sf_dir).select("msg_id", F.posexplode(F.arrow_udf(_apart, "array<string>")("spans")).alias("ord", "variant"))
    return rows.select("msg_id", "ord", "variant")


@query("""with {messages} select seq, ord, case ord when 0 then 'AMOUNT=' || amount || '|ACCOUNT_NUMBER=' || account || '|DATE=' || day || '|MERCHANT=' || merchant || '|AVAILABLE_BALANCE=' || balance
  else 'AMOUNT=' || amount || '|ACCOUNT_NUMBER=' || account || '|DATE=' || day || '|AVAILABLE_BALANCE=' || balance end as candidate from v cross join (values (0), (1)) t(ord)""")
def candidates_full(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("seq", F.explode("cands").alias("c"))
    return rows.select("seq", "c.ord", F.array_join(F.transform("c.values", lambda v: F.concat(v["name"], F.lit("="), v["value"])), "|").alias("candidate"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = rules.compile_entities(spark, I.entities(spark, sf_dir))
    return pipeline.with_candidates(I.normalized(spark, sf_dir).withColumnRenamed("text", "raw_text"), compiled)


# ---- matching

def _matched(spark: SparkSession, sf_dir: str, templates: DataFrame, only=I.RULES) -> DataFrame:
    compiled = rules.compile_entities(spark, I.entities(spark, sf_dir, only))
    return pipeline.decided(I.normalized(spark, sf_dir).withColumnRenamed("text", "raw_text"), compiled, templates).select("seq", "sender_id", "normalized", F.col("win.template_id").alias("template_id"), F.col("win.category").alias("category"), "reason", "win_ord", "won", "win")


def _two(spark: SparkSession, sf_dir: str, start: str, end: str, category="BANKING", canonical="A", active=True) -> DataFrame:
    """A template for AMOUNT alone that only the sequence finds."""
    s = I.senders(spark, sf_dir)
    return s.select(*I.template(F.col("sender_id"), canonical, category, "none", ("AMOUNT",), (("AMOUNT", "amount", "REGEX", I.AMOUNT, 0, start, end, 0),), active=active))


ONLY_AMOUNT = I.RULES[:1]


@query("with {messages} select seq, case when region < 4 then sha256(sender_id || '::INR {AMOUNT} DEBITED') end as template_id, case when region = 4 then 'NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED' end as reason from m")
def match_static(spark, sf_dir):
    known = F.broadcast(I.senders(spark, sf_dir).filter("region < 4").select("sender_id"))
    return _matched(spark, sf_dir, I.bank_templates(spark, sf_dir).join(known, "sender_id", "left_semi")).select("seq", "template_id", "reason")


@query("""select event_id as seq, case when event_id % 3 = 0 then sha256('A::greeting') end as template_id,
  case event_id % 3 when 1 then 'LOW_CONFIDENCE_TEMPLATE_INACTIVE' when 2 then 'NO_EXTRACTION_CANDIDATES' end as reason from events""")
def match_zero_entity(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    m = e.select(F.col("event_id").cast("string").alias("msg_id"), F.col("event_id").alias("seq"), F.when(k == 0, "A").when(k == 1, "B").otherwise("C").alias("sender_id"), F.lit("DEAR CUSTOMER WELCOME").alias("normalized"), F.lit("").alias("raw_text"), F.lit(0).alias("n_rules"), F.lit(None).cast(f"array<{schemas.CANDIDATE}>").alias("cands"), F.lit(False).alias("more"), F.col("event_type").alias("text"))
    h = T.sha256(F.lit("DEARCUSTOMERWELCOME"))
    t = spark.range(2).select(F.when(F.col("id") == 0, "A").otherwise("B").alias("sender_id"), (F.col("id") == 0).alias("on"))
    templates = t.select(*I.template(F.col("sender_id"), "greeting", "INFO", h, (), (), active=F.col("on")))
    got = pipeline.matched(m.withColumn("text", F.col("normalized")), templates)
    return got.select("seq", F.col("win.template_id").alias("template_id"), "reason")


@query("with {messages} select seq, sha256(sender_id || '::A') as template_id from m")
def match_sequence(spark, sf_dir):
    return _matched(spark, sf_dir, _two(spark, sf_dir, "INR", "DEBITED"), ONLY_AMOUNT).select("seq", "template_id")


@query("with {messages} select seq, case when region < 3 then sha256(sender_id || '::A') end as template_id, case when region >= 3 then 'BOUNDARY_VALIDATION_FAILED' end as reason from m")
def match_validate(spark, sf_dir):
    """The start anchor stands right before the value for some senders, an anchor is nowhere for others."""
    s = I.senders(spark, sf_dir)
    start, end = F.when(F.col("region") == 3, "CREDITED").otherwise("INR"), F.when(F.col("region") == 4, "NOWHERE").otherwise("DEBITED")
    t = s.select("region", *I.template(F.col("sender_id"), "A", "BANKING", "none", ("AMOUNT",), (("AMOUNT", "amount", "REGEX", I.AMOUNT, 0, "", "", 0),)))
    named = F.transform("snapshots", lambda x: x.withField("start_after", start).withField("end_before", end))
    return _matched(spark, sf_dir, t.withColumn("snapshots", F.when(F.col("region") < 5, named)).drop("region"), ONLY_AMOUNT).select("seq", "template_id", "reason")


@query("""with {messages} select seq, case when region < 2 then null else case when sha256(sender_id || '::A') < sha256(sender_id || '::B') then sha256(sender_id || '::A') else sha256(sender_id || '::B') end end as template_id,
  case when region < 2 then 'AMBIGUOUS_TEMPLATE_CONFLICT' end as reason from m""")
def match_conflict(spark, sf_dir):
    s = I.senders(spark, sf_dir)
    snaps = (("AMOUNT", "amount", "REGEX", I.AMOUNT, 0, "INR", "DEBITED", 0),)
    b = s.select(*I.template(F.col("sender_id"), "B", F.when(F.col("region") < 2, "ECOMMERCE").otherwise("BANKING"), "none", ("AMOUNT",), snaps))
    return _matched(spark, sf_dir, _two(spark, sf_dir, "INR", "DEBITED").union(b), ONLY_AMOUNT).select("seq", "template_id", "reason")


@query("""with {messages} select seq, case region when 0 then null when 1 then 'LOW_CONFIDENCE_TEMPLATE_INACTIVE' when 2 then 'BOUNDARY_VALIDATION_FAILED' else 'NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED' end as reason from m""")
def match_reason(spark, sf_dir):
    s = I.senders(spark, sf_dir)
    static = T.sha256(F.lit("INRDEBITEDFROMACCOUNTONATAVLBALINR"))
    snaps = lambda start: (("AMOUNT", "amount", "REGEX", I.AMOUNT, 0, start, "DEBITED", 0),)
    on = s.filter("region < 2").select(*I.template(F.col("sender_id"), "A", "BANKING", static, I.ORDERING, I.SNAPSHOTS, active=F.col("region") == 0))
    off = s.filter("region = 1").select(*I.template(F.col("sender_id"), "B", "BANKING", "none", ("AMOUNT", "ACCOUNT_NUMBER", "DATE", "AVAILABLE_BALANCE"), snaps("INR"), active=False))
    bad = s.filter("region = 2").select(*I.template(F.col("sender_id"), "A", "BANKING", "none", I.ORDERING, snaps("CREDITED")))
    return _matched(spark, sf_dir, on.union(off).union(bad)).select("seq", "reason")


@query("with {messages} select seq, sha256(sender_id || '::A') as template_id, amount as value, 4 as st, (5 + length(amount))::int as en from v")
def match_fallback(spark, sf_dir):
    """A second anchor that isn't next to the value: validation fails, the walk from anchor to anchor succeeds."""
    s = I.senders(spark, sf_dir)
    snaps = (("AMOUNT", "amount", "REGEX", I.AMOUNT, 0, "INR", "DEBITED", 0), ("AMOUNT", "other", "BOUNDARY_HINT", None, 0, "FROM", "ON", 4))
    t = s.select(*I.template(F.col("sender_id"), "A", "BANKING", "none", ("AMOUNT",), snaps))
    v = F.get("won", F.lit(0))
    return _matched(spark, sf_dir, t, ONLY_AMOUNT).select("seq", "template_id", v["value"].alias("value"), v["st"].alias("st"), v["en"].alias("en"))


@query("""select event_id as seq, case when event_id % 5 = 4 then sha256('S4::greeting') end as template_id,
  case event_id % 5 when 0 then 'EXTRACTION_CANDIDATES_DISCARDED' when 1 then 'NO_EXTRACTION_CANDIDATES' when 2 then 'LOW_CONFIDENCE_TEMPLATE_INACTIVE' when 3 then 'EXTRACTION_CANDIDATES_DISCARDED' end as reason from events""")
def match_discarded(spark, sf_dir):
    """No candidates: with rules (0), without (1), without and with an inactive template (2), with both (3), with rules and an active template (4)."""
    e = I.table(spark, sf_dir, "events")
    m = e.select(F.col("event_id").cast("string").alias("msg_id"), F.col("event_id").alias("seq"), F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string")).alias("sender_id"), F.lit("Dear customer, welcome").alias("text"))
    s = spark.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("sender_id"), "id")
    own = s.filter("id in (0, 3, 4)").select("sender_id", F.inline(F.array(I.rule(0, *I.RULES[0]), I.rule(1, "V", None, ("ABSENT", "", 2)))))
    templates = s.filter("id > 1").select(*I.template(F.col("sender_id"), "greeting", "INFO", T.sha256(F.lit("DEARCUSTOMER,WELCOME")), (), (), active=F.col("id") == 4))
    found, missed, _ = pipeline.process(spark, m, _normalization(spark), own, templates)
    return found.select("seq", "template_id", F.lit(None).cast("string").alias("reason")).union(missed.select("seq", F.lit(None).cast("string"), "reason"))


@query("""with {messages} select seq, case when region = 4 then sha256(sender_id || '::M') end as template_id,
  case region when 0 then 'BOUNDARY_VALIDATION_FAILED' when 1 then 'LOW_CONFIDENCE_TEMPLATE_INACTIVE' when 2 then 'AMBIGUOUS_TEMPLATE_CONFLICT' when 3 then 'BOUNDARY_VALIDATION_FAILED' end as reason from m""")
def match_priority(spark, sf_dir):
    """Two candidates of a message that fail for different reasons: the reason that says more is given, whichever comes first."""
    s = I.senders(spark, sf_dir)
    r = F.col("region")

    def t(only, name, canonical, start, category="BANKING", active=True):
        return s.filter(only).select(*I.template(F.col("sender_id"), canonical, category, "none", (name,), ((name, "x", "REGEX", None, 0, start, "DEBITED", 0),), active=active))

    parts = [
        t(r == 0, "AMOUNT", "A", "CREDITED"), t(r == 0, "MONEY", "M", "INR", active=False),
        t(r == 1, "AMOUNT", "A", "INR", active=False),
        t(r == 2, "AMOUNT", "A", "INR"), t(r == 2, "AMOUNT", "B", "INR", "ECOMMERCE"), t(r == 2, "MONEY", "M", "CREDITED"),
        t(r == 3, "MONEY", "M", "CREDITED"),
        t(r == 4, "AMOUNT", "A", "CREDITED"), t(r == 4, "MONEY", "M", "INR"),
    ]
    templates = parts[0]
    for p in parts[1:]:
        templates = templates.union(p)
    return _matched(spark, sf_dir, templates, (I.RULES[0], ("MONEY", r"(?<=INR )[0-9]+(?:\.[0-9]{1,2})?(?= DEBITED)", None))).select("seq", "template_id", "reason")


@query("with {messages} select seq, amount as early, balance as late, day as by_name from v")
def semantic_collisions(spark, sf_dir):
    """Four values of one name and two snapshots: the first takes the type that is free without an anchor, the last the one whose anchor came before; of those in
    between, which find no free type, the later one stays under the name."""
    s = I.senders(spark, sf_dir)
    snaps = (("NUM", "late", "REGEX", None, 0, "BAL INR", "", 0), ("NUM", "early", "REGEX", None, 0, "", "", 0))
    t = s.select(*I.template(F.col("sender_id"), "N", "BANKING", "none", ("NUM",) * 4, snaps))
    m = _matched(spark, sf_dir, t, (("NUM", (I.AMOUNT, I.ACCOUNT, I.DATE, I.BALANCE), None),))
    typed = m.select("seq", matching.typed_values(F.col("normalized"), F.col("won"), F.col("win.snapshots")).alias("e"))
    return typed.select("seq", F.col("e")["early"].alias("early"), F.col("e")["late"].alias("late"), F.col("e")["NUM"].alias("by_name"))


@query("with {messages} select seq, amount, account, day, balance, merchant from v")
def semantic_types(spark, sf_dir):
    m = _matched(spark, sf_dir, I.bank_templates(spark, sf_dir))
    typed = m.select("seq", matching.typed_values(F.col("normalized"), F.col("won"), F.col("win.snapshots")).alias("e"))
    return typed.select("seq", *[F.col("e")[k].alias(k) for k in ("amount", "account", "day", "balance", "merchant")])


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hit path over all messages."""
    return pipeline.process(spark, I.messages(spark, sf_dir), _normalization(spark), I.entities(spark, sf_dir), I.bank_templates(spark, sf_dir))[0]


@query("with {messages} select seq, sender_id, text as raw, normalized, sha256(sender_id || '::INR {AMOUNT} DEBITED') as template_id, 'BANKING' as category, 'CARD' as subcategory, 'DEBIT' as intent, 0.9::double as confidence, 'TEMPLATE_HIT' as path from n")
def result_projection(spark, sf_dir):
    return hits(spark, sf_dir).drop("msg_id", "entities")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and sums by sender and merchant, from the hit path."""
    h = hits(spark, sf_dir).select("sender_id", F.col("entities")["merchant"].alias("merchant"), F.col("entities")["amount"].cast("decimal(18,2)").alias("amount"))
    return h.groupBy("sender_id", "merchant").agg(F.count("*").alias("n_msgs"), F.sum("amount").cast("double").alias("sum_amount"))


query("with {messages} select sender_id, merchant, count(*) as n_msgs, sum(amount::decimal(18,2))::double as sum_amount from v group by 1, 2")(flagship)


def _store(spark: SparkSession) -> tables.Store:
    return tables.Store(spark, tables.new_dir(spark, "store"))


@query("""with {messages} select seq::varchar as msg_id, sender_id, text as raw, normalized, '{"account":"' || account || '","amount":"' || amount || '","balance":"' || balance || '","day":"' || day || '","merchant":"' || merchant || '"}' as entities,
  sha256(sender_id || '::INR {AMOUNT} DEBITED') as template_id, 'BANKING' as category, case when region = 1 then '' else 'CARD' end as subcategory, 'DEBIT' as intent, 0.9::double as confidence from v""")
def result_sink_roundtrip(spark, sf_dir):
    """Results written in two batches, one of them again, and read back: null texts are empty, the values are a JSON text."""
    store = _store(spark)
    no_sub = I.senders(spark, sf_dir).select("sender_id", (F.col("region") == 1).alias("none"))
    h = hits(spark, sf_dir).join(F.broadcast(no_sub), "sender_id").withColumn("subcategory", F.when(~F.col("none"), F.col("subcategory")))  # nations
    stored = tables.stored_result(h).persist()
    odd = F.pmod(F.col("msg_id").cast("long"), F.lit(2)) == 1
    store.append("results", stored.filter(odd), 0)
    store.append("results", stored.filter(~odd), 1)
    store.append("results", stored.filter(odd), 0)
    stored.unpersist()
    return store.read("results").drop("ts")


@query("with {messages} select seq::varchar as msg_id, merchant, amount from v")
def result_sink_values(spark, sf_dir):
    """The stored JSON text read as a map again."""
    store = _store(spark)
    store.append("results", tables.stored_result(hits(spark, sf_dir)), 0)
    return tables.read_results(store.read("results")).select("msg_id", F.col("entities")["merchant"].alias("merchant"), F.col("entities")["amount"].alias("amount"))


@query("""select 'BANK-' || n_name as sender_id, sha256('BANK-' || n_name || '::INR {AMOUNT} DEBITED') as template_id, case when n_regionkey = 1 then 0.4 else 0.9 end::double as confidence,
  n_regionkey <> 1 as active, 5 as n_snapshots, 'AMOUNT:ACCOUNT_NUMBER:DATE:MERCHANT:AVAILABLE_BALANCE' as ordering from nation""")
def template_sink(spark, sf_dir):
    """Templates stored, some of them stored again under their ids, read back: the last write of an id counts."""
    store, t = _store(spark), I.bank_templates(spark, sf_dir)
    store.write("templates", t)
    known = F.broadcast(I.senders(spark, sf_dir).filter("region = 1").select("sender_id"))
    new = t.join(known, "sender_id", "left_semi").withColumn("confidence", F.lit(0.4).cast("double")).withColumn("active", F.lit(False))
    store.write("templates", rules.upsert_by(store.read("templates"), new, "template_id"))
    return store.read("templates").select("sender_id", "template_id", "confidence", "active", F.size("snapshots").alias("n_snapshots"), F.array_join("ordering", ":").alias("ordering"))


@query("""select 'BANK-' || n_name as sender_id, case when n_regionkey = 2 then 'ONLY' else 'AMOUNT,ACCOUNT_NUMBER,DATE,AVAILABLE_BALANCE,MERCHANT' end as names, case when n_regionkey = 2 then 'AT>EOM' else 'AT>AVL' end as pairs from nation""")
def entity_sink(spark, sf_dir):
    """Rules stored, the whole list of some senders replaced, read back in order."""
    store = _store(spark)
    store.write("sender_entities", I.entities(spark, sf_dir))
    new = I.senders(spark, sf_dir).filter("region = 2").select("sender_id", F.inline(F.array(I.rule(0, "ONLY", None, ("AT", "EOM", 4)))))
    store.write("sender_entities", rules.upsert_by(store.read("sender_entities"), new, "sender_id"))
    by = store.read("sender_entities").groupBy("sender_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "boundary_pairs"))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda r: F.transform(r["boundary_pairs"], lambda p: F.concat(p["start_after"], F.lit(">"), p["end_before"]))))
    return by.select("sender_id", F.array_join(F.transform("r", lambda r: r["name"]), ",").alias("names"), F.array_join(pairs, ",").alias("pairs"))


# ---- learning

def _teacher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's answer (as JSON, parsed) for the messages of every sender's least order."""
    n = I.normalized(spark, sf_dir)
    first = n.groupBy("sender_id").agg(F.min_by("normalized", "seq").alias("normalized"))
    value = F.regexp_extract("normalized", I.AMOUNT, 0)
    body = F.concat(F.lit('{"category":"BANKING","subcategory":"CARD","intent":"DEBIT","confidenceScore":0.8,"canonicalTemplate":"INR {AMOUNT}","extractedFields":{"AMOUNT":"'), value, F.lit('","NOTE":"null","BLANK":" "},"entities":[{"name":"AMOUNT","type":"REGEX","regex":"[0-9.]+"},{"name":"PLACE","type":"ODD","startAfter":"AT"}],"ordering":["AMOUNT"]}'))
    r = first.select("sender_id", "normalized", learning.parse_responses(body).alias("r"))
    return r.select("sender_id", "normalized", "r.*")


_FIRST = "f as (select * from v qualify row_number() over (partition by sender_id order by seq) = 1)"


@query("with {messages}, " + _FIRST + " select sender_id, 'AMOUNT=' || amount as fields, 'AMOUNT:AMOUNT:REGEX:::3:0|PLACE:PLACE:REGEX:AT::3:0' as rules, 0.8::double as confidence from f")
def teacher_parse(spark, sf_dir):
    rule = F.transform("entities", lambda e: F.concat_ws(":", e["name"], e["semantic_type"], e["rule_type"], e["start_after"], e["end_before"], e["max_tokens"].cast("string"), e["grp"].cast("string")))
    fields = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return _teacher_rows(spark, sf_dir).select("sender_id", fields.alias("fields"), F.array_join(rule, "|").alias("rules"), "confidence")


@query("with {messages}, " + _FIRST + " select sender_id, sha256(sender_id || '::INR {AMOUNT}') as template_id, sha256(replace(replace(normalized, amount, ''), ' ', '')) as static_hash, sha256('AMOUNT') as seq_hash, true as active from f")
def learn_template(spark, sf_dir):
    return learning.templates_of(_teacher_rows(spark, sf_dir)).select("sender_id", "template_id", "static_hash", "seq_hash", "active")


@query("with {messages}, " + _FIRST + " select sender_id, 'AMOUNT/AMOUNT/REGEX/[0-9.]+/0///3|PLACE/PLACE/REGEX/-/0/AT//3' as snapshots, 'AMOUNT' as ordering, 'BANKING' as category, 0.8::double as confidence from f")
def learn_snapshots(spark, sf_dir):
    """The learned template's frozen rules, field by field."""
    one = lambda x: F.concat_ws("/", x["name"], x["semantic_type"], x["rule_type"], F.coalesce(x["regex"], F.lit("-")), x["grp"].cast("string"), x["start_after"], x["end_before"], x["max_tokens"].cast("string"))
    return learning.templates_of(_teacher_rows(spark, sf_dir)).select("sender_id", F.array_join(F.transform("snapshots", one), "|").alias("snapshots"), F.array_join("ordering", ",").alias("ordering"), "category", "confidence")


@query("with {messages}, " + _FIRST + " select sender_id, amount as value, 4 as st, (4 + length(amount))::int as en, amount as by_type from f")
def learn_values(spark, sf_dir):
    r = _teacher_rows(spark, sf_dir)
    v = F.get(learning.learned_values(F.col("fields"), F.col("normalized")), F.lit(0))
    return r.select("sender_id", v["value"].alias("value"), v["st"].alias("st"), v["en"].alias("en"), learning.learned_result(F.col("fields"), F.col("entities"))["AMOUNT"].alias("by_type"))


@query("select 'BANK-' || n_name as sender_id, n_regionkey = 2 as redundant from nation where 'BANK-' || n_name in (select 'BANK-' || n.n_name from orders join customer on o_custkey = c_custkey join nation n on c_nationkey = n.n_nationkey)")
def learn_redundant(spark, sf_dir):
    r = _teacher_rows(spark, sf_dir)
    stored = I.senders(spark, sf_dir).filter("region = 2").select(*I.template(F.col("sender_id"), "INR {AMOUNT}", "X", "h", (), ()))
    return learning.redundant(r, stored).select("sender_id", "redundant")


@query(f"""select 'BANK-' || n_name as sender_id, ord, name, rule_type, variants, pairs from nation cross join (values
  (0, 'AMOUNT', 'REGEX', '{I.AMOUNT}/0|{I.AMOUNT}/1', '>>3'), (1, 'ACCOUNT_NUMBER', 'REGEX', '{I.ACCOUNT}/0', ''), (2, 'DATE', 'REGEX', '{I.DATE}/0', ''), (3, 'AVAILABLE_BALANCE', 'REGEX', '{I.BALANCE}/0', ''),
  (4, 'MERCHANT', 'BOUNDARY_HINT', '', 'AT>AVL>3|AT>>2'), (5, 'CARD', 'BOUNDARY_HINT', '', 'XX>>1'), (6, 'BARE', 'REGEX', 'b+/2', '')) t(ord, name, rule_type, variants, pairs)""")
def rule_merge(spark, sf_dir):
    """A known pattern with another group, a known pair with another limit, a repeat inside the answer, new names with and without anchors: the merged rules, field by field."""
    fields = ("lord", "name", "rule_type", "regex", "grp", "start_after", "end_before", "max_tokens")
    rows = [(0, "AMOUNT", "BOUNDARY_HINT", I.AMOUNT, 1, "", "", 3), (1, "MERCHANT", "REGEX", None, 0, "AT", "AVL", 9), (2, "MERCHANT", "REGEX", None, 0, "AT", "", 2), (3, "MERCHANT", "REGEX", None, 0, "AT", "", 4), (4, "CARD", "BOUNDARY_HINT", "", 0, "XX", "", 1), (5, "BARE", "REGEX", "b+", 2, None, None, 3)]
    answer = F.array(*[F.struct(*[F.lit(v).cast("string" if n in ("regex", "start_after", "end_before") else "int" if isinstance(v, int) else "string").alias(n) for n, v in zip(fields, r, strict=True)]) for r in rows])
    new = I.senders(spark, sf_dir).select("sender_id", F.inline(answer))
    m = rules.merge_entities(I.entities(spark, sf_dir), new)
    variants = F.transform("regex_variants", lambda v: F.concat(v["regex"], F.lit("/"), v["grp"].cast("string")))
    pairs = F.transform("boundary_pairs", lambda p: F.concat_ws(">", p["start_after"], p["end_before"], p["max_tokens"].cast("string")))
    return m.select("sender_id", "ord", "name", "rule_type", F.array_join(variants, "|").alias("variants"), F.array_join(pairs, "|").alias("pairs"))


def _teacher(text: str, entities: list[dict]) -> dict | None:
    """Learns the amount of a debit message; for tests and the registered query."""
    import re

    m = re.match(r"INR ([0-9.]+) DEBITED FROM ACCOUNT (XX[0-9]{4})", text)
    if not m:
        return None
    rest = text[m.end() :]
    snap = lambda name, kind, regex, start, end: {"name": name, "semantic_type": name.lower(), "rule_type": kind, "regex": regex, "grp": 0, "start_after": start, "end_before": end, "max_tokens": 0}
    return {
        "category": "BANKING", "subcategory": "CARD", "intent": "DEBIT", "confidence": 0.9, "canonical": "INR {AMOUNT} DEBITED FROM ACCOUNT {ACCOUNT}{REST}",
        "fields": {"AMOUNT": m[1], "ACCOUNT": m[2], "REST": rest.strip()},
        "entities": [snap("AMOUNT", "REGEX", I.AMOUNT, "", ""), snap("ACCOUNT", "REGEX", I.ACCOUNT, "", ""), snap("REST", "BOUNDARY_HINT", None, "{ACCOUNT}", "EOM")],
        "ordering": ["AMOUNT", "ACCOUNT", "REST"],
    }


@query("with {messages} select seq, sender_id, case when row_number() over (partition by sender_id order by seq) = 1 then 'LLM' else 'TEMPLATE_HIT' end as path, case when row_number() over (partition by sender_id order by seq) = 1 then 'NO_EXTRACTION_CANDIDATES' end as fail_reason, amount from v")
def learn_loop(spark, sf_dir):
    """All messages with nothing known: each sender's first one is learned, the others are hits by what it taught."""
    n = I.normalized(spark, sf_dir).select("msg_id", "seq", "sender_id", "normalized")
    none = lambda s: spark.createDataFrame([], s)
    got = learning.learn(n, none(schemas.SENDER_ENTITIES), none(schemas.TEMPLATES), _teacher)
    return got.filter("kind = 'message'").select("seq", "sender_id", "path", "fail_reason", F.col("entities")["amount"].alias("amount"))


_SHAPES = """, o as (select *, seq % 3 = 0 as note from v), p as (
  select *, row_number() over (partition by sender_id, note order by seq) = 1 as asked, row_number() over (partition by sender_id order by seq) = 1 as first, first_value(note) over (partition by sender_id order by seq) as note_first from o
)"""


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two shapes, a third of them notes."""
    note = F.concat(F.lit("NOTE "), F.regexp_extract("normalized", " AT (.*) AVL ", 1))
    return I.normalized(spark, sf_dir).select("msg_id", "seq", "sender_id", F.when(F.col("seq") % 3 == 0, note).otherwise(F.col("normalized")).alias("normalized"))


def _teacher_of_two(text: str, entities: list[dict]) -> dict | None:
    """Learns both shapes; its category says how many rules it was told of."""
    if not text.startswith("NOTE "):
        r = _teacher(text, entities)
    else:
        rule = {"name": "W", "semantic_type": "what", "rule_type": "BOUNDARY_HINT", "regex": None, "grp": 0, "start_after": "NOTE", "end_before": "EOM", "max_tokens": 0}
        r = {"subcategory": "S", "intent": "I", "confidence": 0.9, "canonical": "NOTE {W}", "fields": {"W": text[5:]}, "entities": [rule], "ordering": ["W"]}
    return r and r | {"category": f"R{len(entities)}"}


@query("with {messages}" + _SHAPES + """ select seq, sender_id, case when asked then 'LLM' else 'TEMPLATE_HIT' end as path, case when first then 'NO_EXTRACTION_CANDIDATES' when asked then 'EXTRACTION_CANDIDATES_DISCARDED' end as fail_reason,
  'R' || case when note = note_first then 0 when note_first then 1 else 3 end::varchar as category, case when note then merchant else amount end as value from p""")
def learn_two_shapes(spark, sf_dir):
    """Each sender's two shapes are learned when they first come; the second time the teacher is told of the rules that it taught the first time."""
    none = lambda s: spark.createDataFrame([], s)
    got = learning.learn(_shaped(spark, sf_dir), none(schemas.SENDER_ENTITIES), none(schemas.TEMPLATES), _teacher_of_two)
    return got.filter("kind = 'message'").select("seq", "sender_id", "path", "fail_reason", "category", F.coalesce(F.col("entities")["what"], F.col("entities")["amount"]).alias("value"))


@query("with {messages}" + _SHAPES + """ select seq, sender_id, case when asked then 'LLM' else 'TEMPLATE_HIT' end as path, case when first then 'NO_EXTRACTION_CANDIDATES' when asked then 'EXTRACTION_CANDIDATES_DISCARDED' end as fail_reason,
  'R' || case when note = note_first then 0 when note_first then 1 else 3 end::varchar as category, case when note then merchant else amount end as value from p""")
def learn_rounds(spark, sf_dir):
    """The same in rounds, in which a sender's messages are matched in the plan."""
    none = lambda s: spark.createDataFrame([], s)
    got, _, _ = pipeline.learn_in_rounds(spark, _shaped(spark, sf_dir), none(schemas.SENDER_ENTITIES), none(schemas.TEMPLATES), _teacher_of_two)
    return got.select("seq", "sender_id", "path", "fail_reason", "category", F.coalesce(F.col("entities")["what"], F.col("entities")["amount"]).alias("value"))


@query("with {messages}" + _SHAPES + """ select seq, sender_id, case when note and asked then 'LLM' else 'TEMPLATE_HIT' end as path from p""")
def learn_from_known(spark, sf_dir):
    """With one shape's rules and templates stored, only the other one is asked about; what matches at once doesn't go through the loop."""
    m = _shaped(spark, sf_dir).withColumnRenamed("normalized", "text")
    e, t = I.entities(spark, sf_dir), I.bank_templates(spark, sf_dir)
    found, missed, _ = pipeline.process(spark, m, spark.createDataFrame([], schemas.NORMALIZATION_RULES), e, t)
    got = learning.learn(missed.select("msg_id", "seq", "sender_id", "normalized"), e, t, _teacher_of_two).filter("kind = 'message'")
    return found.select("seq", "sender_id", "path").union(got.select("seq", "sender_id", "path"))


def _asked(rows: pa.Array) -> pa.Array:
    rule = {"name": "MERCHANT", "rule_type": "BOUNDARY_HINT", "regex_variants": [], "boundary_pairs": [{"start_after": "AT", "end_before": "AVL", "max_tokens": 3}]}
    turns = [learning.request_for(t, [rule]) for t in rows.to_pylist()]
    return pa.array([{"roles": ",".join(x["role"] for x in r), "message": r[-1]["content"]} for r in turns], pa.struct([("roles", pa.string()), ("message", pa.string())]))


@query("""with {messages} select seq, 'system,user' as roles, '{"message": "' || normalized || '", "rules": [{"name": "MERCHANT", "type": "BOUNDARY_HINT", "regex": [], "anchors": [["AT", "AVL", 3]]}]}' as message from n""")
def teacher_request(spark, sf_dir):
    """What a teacher is sent: instructions, then the message with the sender's rules."""
    asked = F.arrow_udf(_asked, "struct<roles:string,message:string>")("normalized")
    return I.normalized(spark, sf_dir).select("seq", asked.alias("a")).select("seq", "a.roles", "a.message")


def _busy(batches):
    """For each row a teacher that is busy so many times: its answer, or the error, and the seconds that were waited."""
    for b in batches:
        out = []
        for times in b["busy"]:
            left, waits = [times], []

            def teacher(text, entities, left=left):
                if left[0]:
                    left[0] -= 1
                    raise learning.RateLimited
                return {"text": text}

            try:
                said = learning.with_retry(teacher, waits.append)("asked", [])["text"]
            except learning.RateLimited:
                said = "given up"
            out.append((said, sum(waits)))
        yield b.assign(said=[x[0] for x in out], waited=[x[1] for x in out])[["n_nationkey", "said", "waited"]]


@query("select n_nationkey, case when n_nationkey % 6 < 5 then 'asked' else 'given up' end as said, case when n_nationkey % 6 < 5 then (1 << (n_nationkey % 6)) - 1 else 15 end::bigint as waited from nation")
def teacher_retry(spark, sf_dir):
    """A teacher that is busy up to four times is asked again after 1, 2, 4 and 8 seconds (counted, not waited for here); beyond that it is given up."""
    n = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), (F.col("n_nationkey") % 6).cast("int").alias("busy"))
    return n.mapInPandas(_busy, "n_nationkey int, said string, waited bigint")


@query("with {messages} select count(distinct sender_id) as senders, count(*) as n_msgs, true as within from m")
def teacher_cap(spark, sf_dir):
    """At most so many senders are asked about at a time: the loop has no more tasks."""
    none = lambda s: spark.createDataFrame([], s)
    n = I.normalized(spark, sf_dir).select("msg_id", "seq", "sender_id", "normalized")
    got = learning.learn(n, none(schemas.SENDER_ENTITIES), none(schemas.TEMPLATES), _teacher, calls=3).filter("kind = 'message'")
    return got.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("sender_id").alias("senders"), F.count("*").alias("n_msgs"), (F.countDistinct("task") <= 3).alias("within"))


# ---- streams and the table function

@query("with {messages}, k as (select sender_id, count(*) as n from m group by sender_id) select sender_id, 'LLM' as path, 1::bigint as n from k union all select sender_id, 'TEMPLATE_HIT', n - 1 from k where n > 1")
def stream_learns(spark, sf_dir):
    """Messages as lines of files, taken by a stream with the hit path and the learning loop, until nothing is left; what it wrote, read back."""
    root = tables.new_dir(spark, "stream")
    m = I.messages(spark, sf_dir)
    lines = m.select(F.to_json(F.struct(F.col("sender_id").alias("senderId"), F.col("text"))).alias("value"))
    lines.write.text(f"{root}/in")
    store = tables.Store(spark, f"{root}/store")
    store.write("normalization_rules", _normalization(spark))
    q = stream.run(spark, sources.json_files(spark, f"{root}/in"), store.root, _teacher, available_now=True)
    q.awaitTermination()
    return store.read("processed").groupBy("sender_id", "path").agg(F.count("*").alias("n"))


@query("with {messages}, k as (select sender_id, count(*) as n from m group by sender_id) select sender_id, 'LLM' as path, 1::bigint as n from k union all select sender_id, 'TEMPLATE_HIT', n - 1 from k where n > 1")
def stream_keeps_state(spark, sf_dir):
    """The same by keyed state, without stored versions of the rules."""
    root = tables.new_dir(spark, "state")
    I.normalized(spark, sf_dir).select("msg_id", "seq", "sender_id", "normalized").write.parquet(f"{root}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        m = spark.readStream.schema("msg_id string, seq bigint, sender_id string, normalized string").parquet(f"{root}/in")
        out = stateful.learn_stream(m, _teacher).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{root}/out").groupBy("sender_id", "path").agg(F.count("*").alias("n"))


@query("""with {messages} select seq, 0 as ord, 'AMOUNT' as name, amount as value, 4 as st from v
union all select seq, 0, 'MERCHANT', merchant, (strpos(normalized, ' AT ') + 3)::int from v union all select seq, 1, 'AMOUNT', amount, 4 from v""")
def extract_table_function(spark, sf_dir):
    """SELECT from the table function, with a message and rules as JSON."""
    spans.register_extract(spark)
    own = F.to_json(F.array(I.rule(0, *I.RULES[0]), I.rule(1, *I.RULES[4])))
    I.normalized(spark, sf_dir).select("seq", "normalized", own.alias("own")).createOrReplaceTempView("messages_with_rules")
    return spark.sql("select seq, x.ord, x.name, x.value, x.st from messages_with_rules, lateral extract_spans(normalized, own) x")


# ---- metrics

_LOW = "confidence < 0.5"


@query("""with {records}, c as (select count(*) as total, count(*) filter (where path = 'TEMPLATE_HIT') as hits, count(*) filter (where path = 'LLM') as llm_calls,
  count(*) filter (where path = 'LLM' and confidence >= 0.5) as learned, count(*) filter (where path = 'LLM' and confidence < 0.5) as skipped_low_confidence, count(*) filter (where path is null) as failed,
  count(*) filter (where redundant) as redundant, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cached_tokens)::bigint as cached_tokens, sum(reasoning_tokens)::bigint as reasoning_tokens,
  """ + ", ".join(f"count(*) filter (where path = 'LLM' and fail_reason = '{r}') as {r.lower()}" for r in schemas.REASONS) + """ from r),
m as (select list_sort(list(match_ms)) as x from r where match_ms is not null), l as (select list_sort(list(llm_ms)) as x from r where llm_ms is not null)
select c.*, replace(round((hits * 100.0 / total)::decimal(18,6), 1)::decimal(18,1)::varchar, ',', '') || '%' as hit_rate,
  len(m.x)::bigint as match_n, floor(list_sum(m.x)::double / len(m.x))::bigint as match_avg, m.x[floor(len(m.x) * 0.5)::int + 1] as match_p50, m.x[floor(len(m.x) * 0.95::double)::int + 1] as match_p95, m.x[floor(len(m.x) * 0.99::double)::int + 1] as match_p99,
  len(l.x)::bigint as llm_n, floor(list_sum(l.x)::double / len(l.x))::bigint as llm_avg, l.x[floor(len(l.x) * 0.5)::int + 1] as llm_p50, l.x[floor(len(l.x) * 0.95::double)::int + 1] as llm_p95, l.x[floor(len(l.x) * 0.99::double)::int + 1] as llm_p99
from c, m, l""")
def metrics_snapshot(spark, sf_dir):
    return metrics.snapshot(I.records(spark, sf_dir))


@query("""with {records} select reason, count(r.seq) as n from (select unnest(['NO_EXTRACTION_CANDIDATES', 'EXTRACTION_CANDIDATES_DISCARDED', 'NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED', 'BOUNDARY_VALIDATION_FAILED', 'AMBIGUOUS_TEMPLATE_CONFLICT', 'LOW_CONFIDENCE_TEMPLATE_INACTIVE']) as reason) d
left join r on r.fail_reason = d.reason and r.path = 'LLM' group by reason""")
def reason_breakdown(spark, sf_dir):
    return metrics.reason_breakdown(I.records(spark, sf_dir))


@query("""with {records}, m as (select list_sort(list(match_ms)) as x from r where match_ms is not null)
select 'match_ms' as metric, len(x)::bigint as n, floor(list_sum(x)::double / len(x))::bigint as avg, x[floor(len(x) * 0.5)::int + 1] as p50, x[floor(len(x) * 0.95::double)::int + 1] as p95, x[floor(len(x) * 0.99::double)::int + 1] as p99 from m""")
def latency_stats(spark, sf_dir):
    return metrics.latency_stats(I.records(spark, sf_dir), "match_ms")


@query("select sum(l_quantity)::bigint as input_tokens, sum(l_linenumber)::bigint as output_tokens, sum(l_suppkey)::bigint as cached_tokens, sum(l_partkey)::bigint as reasoning_tokens from lineitem")
def token_usage(spark, sf_dir):
    l = I.table(spark, sf_dir, "lineitem")
    return metrics.token_usage(l.select(F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").cast("bigint").alias("output_tokens"), F.col("l_suppkey").alias("cached_tokens"), F.col("l_partkey").alias("reasoning_tokens")))


@query("with {records} select seq, msg_id, sender_id, coalesce(fail_reason, 'UNKNOWN') as reason, confidence from r where path = 'LLM' and confidence < 0.5 order by seq limit 50 offset 50")
def failed_learnings(spark, sf_dir):
    return metrics.failed_learnings(I.records(spark, sf_dir), page=1)


@query("with {records} select seq, sender_id, path from r order by seq limit 500 offset 1000")
def detail_page(spark, sf_dir):
    return metrics.detail_page(I.records(spark, sf_dir), page=2, size=500).select("seq", "sender_id", "path")


@query("with {records} select seq, msg_id, path from r order by seq limit 200000")
def record_log(spark, sf_dir):
    return metrics.record_log(I.records(spark, sf_dir)).select("seq", "msg_id", "path")


@query("with {records} select sender_id, count(*) as total, count(*) filter (where path = 'TEMPLATE_HIT') as hits, round((count(*) filter (where path = 'TEMPLATE_HIT') * 100.0 / count(*))::decimal(18,8), 1)::decimal(18,1)::varchar || '%' as hit_rate from r group by sender_id")
def hit_rate_by_sender(spark, sf_dir):
    return metrics.hit_rate_by_sender(I.records(spark, sf_dir))


@query("with {messages} select seq, sender_id, region = 3 as missed from m")
def hits_and_misses(spark, sf_dir):
    """Every message ends in one of the two outputs."""
    known = I.senders(spark, sf_dir).filter("region <> 3").select("sender_id")
    templates = I.bank_templates(spark, sf_dir).join(F.broadcast(known), "sender_id", "left_semi")  # nations
    found, missed, _ = pipeline.process(spark, I.messages(spark, sf_dir), _normalization(spark), I.entities(spark, sf_dir), templates)
    return found.select("seq", "sender_id", F.lit(False).alias("missed")).union(missed.select("seq", "sender_id", F.lit(True).alias("missed")))
