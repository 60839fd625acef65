"""Row types at the edges of the engine. Schemas are fixed; open parts are JSON strings."""

from __future__ import annotations

ENTITY = "kb_id string, version string, entity_ord long, entity_id string, canonical_name string, aliases array<string>, entity_type string, keywords array<string>, description string, metadata_json string"
MENTION = "mention_id string, text string, start int, end int, entity_type string, sentence string, candidate_aliases array<string>, coreference_hint boolean"
ENTITY_COLUMNS = ("kb_id", "version", "entity_ord", "entity_id", "canonical_name", "aliases", "entity_type", "keywords", "description", "metadata_json")
OPTIONS = "top_k int, nil_threshold double, ambiguity_margin double"
KB_ENTITIES = "array<struct<entity_id:string, canonical_name:string, aliases:array<string>, entity_type:string, keywords:array<string>, metadata:string>>"
REQUEST = (
    "request_id string, trace_id string, kb_id string, text string, mentions array<struct<mention_id:string, text:string, start:int, end:int, entity_type:string, sentence:string, "
    "candidate_aliases:array<string>, coreference_hint:boolean>>, options struct<top_k:int, nil_threshold:double, ambiguity_margin:double>, "
    f"inline_kb struct<kb_id:string, entities:{KB_ENTITIES}>"
)
KB_FILE = f"kb_id string, version string, entities {KB_ENTITIES}"
CCKS_ENTITY = "subject_id string, subject string, alias array<string>, type array<string>, data array<struct<predicate:string, object:string>>"
CCKS_DOCUMENT = "text_id string, text string, mention_data array<struct<mention:string, offset:string, kb_id:string>>"
BENCHMARK_FILE = (
    "knowledge_base_id string, documents array<struct<doc_id:string, text:string, "
    "mentions:array<struct<mention_id:string, text:string, start:int, end:int, entity_type:string, sentence:string, metadata:struct<candidate_aliases:array<string>, coreference_hint:boolean>>>, "
    "gold:array<struct<mention_id:string, entity_id:string, status:string, is_alias:boolean>>>>"
)
PRIOR = "norm_mention string, entity_id string, prior double"
ACTION_TYPE = "struct<action:string,kb_id:string,text:string,mentions:array<string>,mention_aliases:map<string,array<string>>,run_requested:boolean,reply:string,confidence:double>"
