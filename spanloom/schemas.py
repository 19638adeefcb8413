"""Schemas of the tables that the extraction engine reads and writes, as Spark DDL."""

SPAN = "struct<name:string,value:string,st:int,en:int>"
CANDIDATE = f"struct<ord:int,values:array<{SPAN}>,names:array<string>>"
VARIANT = "struct<regex:string,grp:int>"
PAIR = "struct<start_after:string,end_before:string,max_tokens:int>"
SNAPSHOT = "struct<name:string,semantic_type:string,rule_type:string,regex:string,grp:int,start_after:string,end_before:string,max_tokens:int>"

MESSAGES = "msg_id string, seq bigint, sender_id string, text string"
NORMALIZATION_RULES = "rule_type string, ord int, key string, value string"
SENDER_ENTITIES = f"sender_id string, ord int, name string, rule_type string, regex_variants array<{VARIANT}>, boundary_pairs array<{PAIR}>"
ENTITY = f"struct<ord:int,name:string,rule_type:string,regex_variants:array<{VARIANT}>,boundary_pairs:array<{PAIR}>>"
CANDIDATES = f"msg_id string, ord int, values array<{SPAN}>, names array<string>"
TEMPLATES = (
    "template_id string, sender_id string, category string, subcategory string, intent string, confidence double, canonical string, "
    f"snapshots array<{SNAPSHOT}>, ordering array<string>, static_hash string, seq_hash string, active boolean"
)
TEACHER = (
    "sender_id string, normalized string, category string, subcategory string, intent string, confidence double, fields map<string,string>, canonical string, "
    f"entities array<{SNAPSHOT}>, ordering array<string>, input_tokens bigint, output_tokens bigint, cached_tokens bigint, reasoning_tokens bigint"
)
RESULTS = "msg_id string, sender_id string, raw string, normalized string, template_id string, category string, subcategory string, intent string, entities map<string,string>, confidence double, ts timestamp"
#: Results as a sink holds them: the values are a JSON text.
STORED_RESULTS = "msg_id string, sender_id string, raw string, normalized string, template_id string, category string, subcategory string, intent string, entities string, confidence double, ts timestamp"
TOKENS = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens")
RECORDS = (
    "msg_id string, seq bigint, sender_id string, template_id string, category string, subcategory string, confidence double, path string, fail_reason string, "
    "total_ms bigint, llm_ms bigint, match_ms bigint, redundant boolean, input_tokens bigint, output_tokens bigint, cached_tokens bigint, reasoning_tokens bigint"
)
#: What a stream writes of each message.
PROCESSED = (
    "msg_id string, seq bigint, sender_id string, raw string, normalized string, template_id string, category string, subcategory string, intent string, confidence double, entities map<string,string>, "
    "path string, fail_reason string, redundant boolean"
)

#: The reasons why a message goes to the teacher, in order; the two kinds of rules; the two paths.
REASONS = (
    "NO_EXTRACTION_CANDIDATES",
    "EXTRACTION_CANDIDATES_DISCARDED",
    "NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED",
    "BOUNDARY_VALIDATION_FAILED",
    "AMBIGUOUS_TEMPLATE_CONFLICT",
    "LOW_CONFIDENCE_TEMPLATE_INACTIVE",
)
REGEX, BOUNDARY_HINT = "REGEX", "BOUNDARY_HINT"
HIT, LEARNED = "TEMPLATE_HIT", "LLM"
#: How much each reason says when several candidates of a message fail.
PRIORITY = {
    "AMBIGUOUS_TEMPLATE_CONFLICT": 4,
    "BOUNDARY_VALIDATION_FAILED": 3,
    "LOW_CONFIDENCE_TEMPLATE_INACTIVE": 2,
    "NO_TEMPLATE_MATCH_BOTH_HASHES_MISSED": 1,
}
KEYWORD_MAPPING, SPECIAL_CHAR = "KEYWORD_MAPPING", "SPECIAL_CHAR"
#: The confidence from which a template is active, the record log's cap.
ACTIVE_FROM, RECORD_CAP = 0.50, 200_000
