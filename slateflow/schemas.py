"""Explicit schemas of the engine's tables."""

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _fields(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


#: A catalog row: one documentation or skill source.
SOURCE = _fields(
    source_id=_S, title=_S, aliases=_A, trust=_S, domain=_S, skill_kind=_S, targets=_A, capabilities=_A,
    shard_ids=_A, supported_versions=_A, retrieved_at=_S, citations=_A,
)
CHILDREN = ("aliases", "targets", "capabilities", "shard_ids", "supported_versions", "citations")
PARENT = ("source_id", "title", "trust", "domain", "skill_kind", "retrieved_at")

#: A stored memory record: an embedding and a payload, which is JSON or plain text.
MEMORY = _fields(shard_id=_S, hit_pos=T.LongType(), embedding=T.ArrayType(T.FloatType()), payload=_S)

#: One piece of evidence.
SNIPPET = _fields(
    source_id=_S, title=_S, snippet=_S, citation=_S, trust=_S, retrieved_at=_S, version=_S, stale=T.BooleanType(), score=T.FloatType(),
)
WARNING = _fields(kind=_S, message=_S)
PACK = _fields(
    query=_S, resolved_sources=_A, evidence=T.ArrayType(SNIPPET), warnings=T.ArrayType(WARNING), pack_summary=_S, token_budget=T.LongType(),
)

#: A chunk as it is stored: the canonical payload.
PAYLOAD = _fields(
    source_id=_S, title=_S, snippet=_S, citation=_S, version=_S, content=_S, section=_S, tags=_A, retrieved_at=_S,
    chunk_index=T.IntegerType(), section_index=T.IntegerType(),
)

#: What normalization had to say of a source.
META = _fields(source_id=_S, warning_count=T.IntegerType(), warnings=T.ArrayType(_fields(url=_S, kind=_S)))

ITEM = _fields(
    url=_S, final_url=_S, content_type=_S, status_code=T.IntegerType(), etag=_S, last_modified=_S, body=_S, sha256=_S, label=_S, role=_S,
)
RAW = _fields(source_id=_S, collected_at=_S, items=T.ArrayType(ITEM))

_LINK = T.ArrayType(_fields(label=_S, url=_S))
REGISTRY = _fields(
    source_id=_S, kind=_S, enabled=T.BooleanType(), public_urls=_LINK, discovery_urls=_LINK, normalization_profile=_S,
    catalog_metadata=_fields(
        title=_S, aliases=_A, domain=_S, trust=_S, skill_kind=_S, targets=_A, capabilities=_A, supported_versions=_A, citations=_A, retrieved_at=_S,
    ),
    memory_targets=_fields(staging_shard_ids=_A, prod_shard_ids=_A), cadence=_S, version_strategy=_S,
    extraction_hints=_fields(content_roots=_A, drop_selectors=_A, chunk_target_chars=T.IntegerType()),
    smoke_queries=_fields(resolve=_S, query=_S, pack=_S),
)

#: A source's state. `hashes_run` and `success_snapshot` name the runs that hold its record hashes and its last published payloads.
STATE = _fields(
    source_id=_S, status=_S, normalized_fingerprint=_S, metadata_hash=_S, hashes_run=_S, success_snapshot=_S, success_entry=_S, last_run_at=_S,
)
