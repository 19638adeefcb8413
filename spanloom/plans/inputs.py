"""Messages, rules and templates derived from the driver's tables, in Spark and (as text) in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import text as T

#: (rule_type, key, value), in order.
MAPPINGS = (("KEYWORD_MAPPING", "Rs.", "INR"), ("KEYWORD_MAPPING", "A/C", "ACCOUNT"), ("SPECIAL_CHAR", "/", "-"), ("SPECIAL_CHAR", ",", ""))

AMOUNT = r"(?<=^INR )[0-9]+(?:\.[0-9]{1,2})?"
ACCOUNT = r"(?<=ACCOUNT )XX[0-9]{4}"
DATE = r"(?<=ON )[0-9]{2}-[0-9]{2}-[0-9]{4}"
BALANCE = r"(?<=BAL INR )-?[0-9]+(?:\.[0-9]{1,2})?"

#: (name, pattern or None, (start_after, end_before, max_tokens) or None), the rules of every bank.
RULES = (("AMOUNT", AMOUNT, None), ("ACCOUNT_NUMBER", ACCOUNT, None), ("DATE", DATE, None), ("AVAILABLE_BALANCE", BALANCE, None), ("MERCHANT", None, ("AT", "AVL", 3)))
ORDERING = ("AMOUNT", "ACCOUNT_NUMBER", "DATE", "MERCHANT", "AVAILABLE_BALANCE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, seq, sender_id, text): a debit message for each order. Orders come as one row group, which is one task, so they are dealt out first."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    money = lambda x: F.col(x).cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("Rs. "), money("o_totalprice"), F.lit(" debited from A/C XX"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" at "), F.col("c_mktsegment"), F.lit(" Avl Bal INR "), money("c_acctbal"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("o_orderkey").cast("string").alias("msg_id"), F.col("o_orderkey").cast("bigint").alias("seq"), F.concat(F.lit("BANK-"), "n_name").alias("sender_id"), text.alias("text"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("normalized", T.normalize(F.col("text"), MAPPINGS))


#: DuckDB: m (seq, sender_id, nation, region, text) and n with normalized.
MESSAGES_SQL = """m as (
  select o_orderkey as seq, 'BANK-' || n_name as sender_id, n_name as nation, n_regionkey as region, c_mktsegment as segment,
    'Rs. ' || cast(o_totalprice as decimal(18,2))::varchar || ' debited from A/C XX' || lpad((c_custkey % 10000)::varchar, 4, '0') || ' on '
      || strftime(o_orderdate, '%d/%m/%Y') || ' at ' || c_mktsegment || ' Avl Bal INR ' || cast(c_acctbal as decimal(18,2))::varchar as text
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
), n as (
  select *, regexp_replace(replace(replace(upper(text), 'RS.', 'INR'), 'A/C', 'ACCOUNT'), '([0-9])/([0-9])', '\\1-\\2', 'g') as normalized from m
), v as (
  select *, regexp_extract(normalized, '^INR ([0-9.]+)', 1) as amount, regexp_extract(normalized, 'ACCOUNT (XX[0-9]{4})', 1) as account,
    regexp_extract(normalized, ' ON ([0-9]{2}-[0-9]{2}-[0-9]{4})', 1) as day, regexp_extract(normalized, 'BAL INR (-?[0-9.]+)', 1) as balance,
    regexp_extract(normalized, ' AT (.*) AVL ', 1) as merchant
  from n
)"""


def senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("BANK-"), "n_name").alias("sender_id"), F.col("n_regionkey").alias("region"))


def entities(spark: SparkSession, sf_dir: str, rules=RULES) -> DataFrame:
    """Every sender with the given rules (schemas.SENDER_ENTITIES)."""
    own = F.array(*[rule(i, *r) for i, r in enumerate(rules)])
    return senders(spark, sf_dir).select("sender_id", F.inline(own)).select("sender_id", "ord", "name", "rule_type", "regex_variants", "boundary_pairs")


def rule(ord_: int, name: str, patterns: str | tuple[str, ...] | None, pairs=None) -> Column:
    """A rule with its patterns (one or several) or its pairs (one or several), as a struct."""
    patterns = (patterns,) if isinstance(patterns, str) else patterns or ()
    pairs = (pairs,) if pairs and isinstance(pairs[0], str) else pairs or ()
    variants = F.array(*[F.struct(F.lit(p).alias("regex"), F.lit(0).alias("grp")) for p in patterns]).cast(f"array<{schemas.VARIANT}>")
    bounds = F.array(*[F.struct(F.lit(a).alias("start_after"), F.lit(b).alias("end_before"), F.lit(n).alias("max_tokens")) for a, b, n in pairs]).cast(f"array<{schemas.PAIR}>")
    return F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("name"), F.lit(schemas.REGEX if patterns else schemas.BOUNDARY_HINT).alias("rule_type"), variants.alias("regex_variants"), bounds.alias("boundary_pairs"))


def template(sender, canonical, category, static_hash, ordering, snapshots, active=True, subcategory="CARD", intent="DEBIT", confidence=0.9):
    """Columns of a template (schemas.TEMPLATES)."""
    lit = lambda x: x if not isinstance(x, (str, float, bool)) and x is not None else F.lit(x)
    c, s = lit(canonical), F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip((x.split(":") for x in schemas.SNAPSHOT[7:-1].split(",")), snap, strict=True)]) for snap in snapshots])
    return [
        T.template_id(sender, c).alias("template_id"), sender.alias("sender_id"), lit(category).alias("category"), lit(subcategory).alias("subcategory"), lit(intent).alias("intent"),
        lit(confidence).cast("double").alias("confidence"), c.alias("canonical"), s.cast(f"array<{schemas.SNAPSHOT}>").alias("snapshots"), F.array(*[F.lit(x) for x in ordering]).cast("array<string>").alias("ordering"),
        lit(static_hash).cast("string").alias("static_hash"), T.sequence_hash(F.array(*[F.lit(x) for x in ordering]).cast("array<string>")).alias("seq_hash"), lit(active).alias("active"),
    ]


#: The messages' fixed text without its values and blanks; the same for all of them.
STATIC_TEXT = "INRDEBITEDFROMACCOUNTONATAVLBALINR"
SNAPSHOTS = (
    ("AMOUNT", "amount", "REGEX", AMOUNT, 0, "", "", 0),
    ("ACCOUNT_NUMBER", "account", "REGEX", ACCOUNT, 0, "", "", 0),
    ("DATE", "day", "REGEX", DATE, 0, "", "", 0),
    ("MERCHANT", "merchant", "BOUNDARY_HINT", None, 0, "AT", "AVL", 3),
    ("AVAILABLE_BALANCE", "balance", "REGEX", BALANCE, 0, "", "", 0),
)


def bank_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sender the template that its messages match by their fixed text."""
    s = senders(spark, sf_dir)
    return s.select(*template(F.col("sender_id"), "INR {AMOUNT} DEBITED", "BANKING", T.sha256(F.lit(STATIC_TEXT)), ORDERING, SNAPSHOTS))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message records (schemas.RECORDS) made of events."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    path = F.when(i % 10 < 7, schemas.HIT).when(i % 10 < 9, schemas.LEARNED)
    reason = F.when(path == schemas.LEARNED, F.element_at(F.array(*[F.lit(r) for r in schemas.REASONS[:4]]), (i % 4 + 1).cast("int")))
    return e.select(
        i.cast("string").alias("msg_id"), i.alias("seq"), F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("sender_id"), F.lit("t").alias("template_id"), F.lit("c").alias("category"), F.lit("s").alias("subcategory"),
        ((i % 7) / 7.0).cast("double").alias("confidence"), path.alias("path"), reason.alias("fail_reason"), F.floor(F.col("value") * 3).cast("bigint").alias("total_ms"),
        F.when(path == schemas.LEARNED, F.floor(F.col("value") * 2)).cast("bigint").alias("llm_ms"), F.when(path == schemas.HIT, F.floor(F.col("value"))).cast("bigint").alias("match_ms"),
        ((path == schemas.LEARNED) & (i % 3 == 0)).alias("redundant"), *[F.when(path == schemas.LEARNED, i % n).cast("bigint").alias(c) for c, n in zip(schemas.TOKENS, (1000, 100, 10, 7), strict=True)],
    )


RECORDS_SQL = """r as (
  select event_id::varchar as msg_id, event_id as seq, 'S' || (user_id % 50)::varchar as sender_id, (event_id % 7) / 7.0::double as confidence,
    case when event_id % 10 < 7 then 'TEMPLATE_HIT' when event_id % 10 < 9 then 'LLM' end as path,
    case when event_id % 10 in (7, 8) then ['NO_EXTRACTION_CANDIDATES', 'EXTRACTION_CANDIDATES_DISCARDED', 'NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED', 'BOUNDARY_VALIDATION_FAILED'][event_id % 4 + 1] end as fail_reason,
    event_id % 10 in (7, 8) and event_id % 3 = 0 as redundant, case when event_id % 10 in (7, 8) then event_id % 1000 end as input_tokens, case when event_id % 10 in (7, 8) then event_id % 100 end as output_tokens,
    case when event_id % 10 in (7, 8) then event_id % 10 end as cached_tokens, case when event_id % 10 in (7, 8) then event_id % 7 end as reasoning_tokens,
    case when event_id % 10 in (7, 8) then floor(value * 2)::bigint end as llm_ms, case when event_id % 10 < 7 then floor(value)::bigint end as match_ms
  from events
)"""
