"""The engine's operators as queries over the driver's tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateflow import schemas
from slateflow.functions import text as X
from slateflow.operators import catalog, ingest, memory, pack, refresh, resolve
from slateflow.operators import record_state as R
from slateflow.plans import bindings as B
from slateflow.plans import oracles
from slateflow.sources import tables


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, floats as rounded doubles: what a hash of values can compare."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out.append(F.array_join(f.name, "|").alias(f.name))
        elif kind in ("float", "double"):
            out.append(F.round(F.col(f.name).cast("double"), 4).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- catalog


def catalog_list(s, d):
    return _flat(catalog.list_sources(B.parts_catalog(s, d)))


def catalog_list_with_skills(s, d):
    return _flat(catalog.list_sources(B.parts_catalog(s, d), include_skills=True))


def catalog_get(s, d):
    return _flat(catalog.get_source(B.parts_catalog(s, d), "/Brand#17/1"))


def catalog_filter_domain_trust_version(s, d):
    return _flat(catalog.filter_sources(B.parts_catalog(s, d), catalog.SourceFilters("skill_knowledge", "official", "12")))


def catalog_filter_limit_before_hide(s, d):
    return _flat(catalog.filter_sources(B.parts_catalog(s, d), catalog.SourceFilters(limit=50)))


def _updates(s, d) -> DataFrame:
    p = B.parts_catalog(s, d)
    key = F.regexp_extract("source_id", "/(\\d+)$", 1).cast("long")
    new = p.where(key % 5 == 0).withColumns({"title": F.concat(F.lit("new "), "title"), "aliases": F.array(F.lit("z"), F.lit("b"))})
    return new.withColumn("source_id", F.when(key % 10 == 0, F.concat("source_id", F.lit("/more"))).otherwise(F.col("source_id")))


def catalog_upsert(s, d):
    return _flat(catalog.upsert(B.parts_catalog(s, d), _updates(s, d)))


def catalog_replace(s, d):
    p = B.parts_catalog(s, d)
    key = F.regexp_extract("source_id", "/(\\d+)$", 1).cast("long")
    rows = p.withColumns({"source_id": F.concat(F.lit("/r/"), (key % 100).cast("string")), "position": key})
    return _flat(catalog.replace(rows, "position"))


def catalog_seed_ignore(s, d):
    """Seeds beside the catalog of `part`, two of whose sources have the ids of seeds."""
    p = B.parts_catalog(s, d)
    ours = F.when(p.source_id == "/Brand#17/1", "/supabase/docs").when(p.source_id.endswith("/2"), "/react/docs").otherwise(p.source_id)
    return _flat(catalog.seed_ignore(p.withColumn("source_id", ours), tables.seed_catalog(s, partial=True)))


def catalog_child_arrays(s, d):
    p = B.parts_catalog(s, d)
    shuffled = {c: tables.children_of(p, c) for c in schemas.CHILDREN}
    return _flat(tables.assemble(p.select(*schemas.PARENT), shuffled))


# ---------------------------------------------------------------- resolve


def resolve_seed(s, d):
    return _flat(resolve.resolve(B.spoken(s, d), B.seed(s), 5, include_skills=False))


def resolve_skill_reranked(s, d):
    return _flat(resolve.resolve(B.skill_queries(s, d), B.skills_catalog(s, d), 5, include_skills=True))


def resolve_scale(s, d):
    return _flat(resolve.catalog_resolve(B.name_queries(s, d), B.parts_catalog(s, d), 10).select("query_id", "rank", "source_id", "title", "score", "reasons"))


def resolve_skill_excluded(s, d):
    return _flat(resolve.resolve(B.name_queries(s, d), B.parts_catalog(s, d), 5))


def resolve_overfetch_cut(s, d):
    return _flat(resolve.resolve(B.name_queries(s, d, " migration"), B.parts_catalog(s, d), 3, include_skills=True))


def query_intent(s, d):
    q = B.table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query")).unionByName(B.seed_queries(s).withColumn("query_id", F.col("query_id").cast("string")))
    return q.select("query_id", X.intent(F.coalesce("query", F.lit(""))).alias("intent"))


def query_entities(s, d):
    return resolve.describe(B.spoken(s, d)).select("query_id", F.array_join("entities", "|").alias("entities"))


def query_task_kind_topics(s, d):
    q = X.normalize_engine(F.col("query"))
    return B.spoken(s, d).select("query_id", X.task_kind(q).alias("kind"), F.array_join(X.skill_topics(q), "|").alias("topics"), F.array_join(X.skill_entities(q), "|").alias("targets"))


def normalize_catalog_text(s, d):
    x = X.normalize_catalog(F.coalesce("text", F.lit("")))
    return B.table(s, d, "documents").select("doc_id", F.sha2(x, 256).alias("digest"), F.size(X.tokens(x)).alias("n_tokens"))


def normalize_engine_text(s, d):
    return B.table(s, d, "documents").select("doc_id", F.sha2(X.normalize_engine(F.coalesce("text", F.lit(""))), 256).alias("digest"))


# ---------------------------------------------------------------- memory and packs


def _asked_all(s, d, version=None, k=5):
    pairs = B.asked(s, d).withColumn("source_id", F.explode(F.array(*[F.lit(r["source_id"]) for r in B.LABELS])))
    return pairs.select("query_id", "source_id", "vector", F.lit(version).cast("string").alias("version"), F.lit(k).alias("top_k"))


def vector_topk_query(s, d):
    q = B.asked(s, d).select("query_id", F.lit("/label/3").alias("source_id"), "vector", F.lit(None).cast("string").alias("version"), F.lit(5).alias("top_k"))
    return _flat(memory.query(q, B.labels(s), B.memory(s, d), most=5).drop("src_rank"))


def vector_topk_per_source(s, d):
    return _flat(memory.query(_asked_all(s, d, k=3), B.labels(s), B.memory(s, d), most=3).select("query_id", "source_id", "hit_rank", "citation", "score"))


def vector_version_filter(s, d):
    return _flat(memory.query(_asked_all(s, d, "2"), B.labels(s), B.memory(s, d), most=5).select("query_id", "source_id", "hit_rank", "version", "citation", "score"))


def payload_parse(s, d):
    m = B.memory(s, d).withColumn("source_id", F.concat(F.lit("/shard/"), "shard_id"))
    return memory.parse_payload(m).select("hit_pos", "p_title", F.sha2("p_snippet", 256).alias("snippet_digest"), "p_citation", "p_version")


def payload_parse_non_string(s, d):
    e = B.table(s, d, "events").select("event_id", F.concat(F.lit("/events/"), "event_type").alias("source_id"), F.coalesce("props", F.lit("")).alias("payload"))
    return memory.parse_payload(e).select("event_id", "p_title", "p_snippet", "p_citation", "p_version")


def _evidence(s, d):
    return pack.evidence(B.asked(s, d), B.labels(s), B.memory(s, d), 5)


def pack_dedup(s, d):
    return _flat(_evidence(s, d)[1].select("query_id", "source_id", "hit_rank", "title", "citation", "score"))


def pack_budget(s, d):
    return _flat(pack.trim(_evidence(s, d)[1], 300).select("query_id", "position", "cost", "source_id", "citation", "score"))


def pack_warnings(s, d):
    return pack.warnings_of(_evidence(s, d)[2]).select("query_id", "kind", "message")


def pack_summary(s, d):
    p = pack.pack(B.asked(s, d), B.labels(s), B.memory(s, d), max_tokens=300)
    return p.select("query_id", "query", F.array_join("resolved_sources", "|").alias("resolved_sources"), F.size("evidence").alias("n_evidence"), F.size("warnings").alias("n_warnings"), "pack_summary", "token_budget", "failed")


def _failing(s) -> dict:
    errors = s.createDataFrame([(x, "no answer") for x in B.FAILED_SHARDS], "shard_id string, error string")
    return {"errors": errors, "metadata": B.labels(s).where(F.col("source_id") != B.LOST_SOURCE)}


def pack_warnings_failing(s, d):
    return pack.warnings_of(pack.evidence(B.asked(s, d), B.labels(s), B.memory(s, d), 5, **_failing(s))[2]).select("query_id", "kind", "message")


def pack_summary_failing(s, d):
    p = pack.pack(B.asked(s, d), B.labels(s), B.memory(s, d), max_tokens=3000, **_failing(s))
    return p.select("query_id", F.array_join("resolved_sources", "|").alias("resolved_sources"), F.size("evidence").alias("n_evidence"), F.size("warnings").alias("n_warnings"), "pack_summary", "failed")


def pack_flagship(s, d):
    p = pack.pack(B.asked(s, d), B.labels(s), B.memory(s, d))
    return _flat(p.select("query_id", F.posexplode("evidence").alias("pos", "e")).select("query_id", "pos", "e.source_id", "e.title", F.sha2("e.snippet", 256).alias("snippet_digest"), "e.citation", "e.trust", "e.version", "e.score"))


def cite_pack(s, d):
    return pack.cite(pack.pack(B.asked(s, d), B.labels(s), B.memory(s, d), max_tokens=300))


# ---------------------------------------------------------------- pages and documents


def page_title(s, d):
    return B.table(s, d, "pages").select("page_id", X.page_title(F.coalesce("html", F.lit("")), F.lit("Untitled")).alias("title"))


def page_clean_text(s, d):
    return B.table(s, d, "pages").select("page_id", F.sha2(X.clean_text(F.coalesce("html", F.lit(""))), 256).alias("digest"))


def page_sections(s, d):
    x = ingest.extract_sections(B.table(s, d, "pages").select("page_id", F.col("html").alias("body")))
    return x.select("page_id", F.posexplode("sections").alias("section_index", "s")).select("page_id", "section_index", "s.heading_id", "s.heading", "s.text")


def _raw(s, d) -> DataFrame:
    item = F.struct(
        "url", F.col("url").alias("final_url"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.coalesce("html", F.lit("")).alias("body"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.lit("page").alias("label"), F.lit("public_urls").alias("role"),
    )
    # A source for each page keeps items small: nothing gathers a host's pages in one row.
    return B.table(s, d, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("source_id"), F.lit("2026-03-01T00:00:00Z").alias("collected_at"), F.array(item).alias("items"))


def _page_registry(s, d) -> DataFrame:
    none = F.array().cast("array<string>")
    meta = F.struct(F.lit("Pages").alias("title"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")).alias("aliases"), F.lit("code_docs").alias("domain"), F.lit("official").alias("trust"), F.array(F.lit("1"), F.lit("2")).alias("supported_versions"), none.alias("citations"))
    hints = F.struct(F.array(*map(F.lit, ingest.CONTENT_ROOTS)).alias("content_roots"), F.array(*map(F.lit, ingest.DROP_SELECTORS)).alias("drop_selectors"), F.lit(ingest.CHUNK_CHARS).alias("chunk_target_chars"))
    return B.table(s, d, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("source_id"), meta.alias("catalog_metadata"), hints.alias("extraction_hints"))


def page_chunks(s, d):
    p, _ = ingest.normalize(_raw(s, d), _page_registry(s, d))
    return _flat(p)


def extraction_guard(s, d):
    _, meta = ingest.normalize(_raw(s, d), _page_registry(s, d))
    return _flat(meta.select("source_id", "url", "warnings", "suspicious"))


def doc_chunks(s, d):
    x = B.table(s, d, "documents").select("doc_id", F.posexplode(ingest.split_paragraph(X.collapse(F.coalesce("text", F.lit(""))), 900)).alias("chunk_index", "chunk"))
    return x.select("doc_id", "chunk_index", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("digest"))


def doc_summaries(s, d):
    return B.table(s, d, "documents").select("doc_id", X.shorten(X.collapse(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]+>", " "))).alias("summary"))


def doc_token_estimate(s, d):
    t = F.coalesce("text", F.lit(""))
    return B.table(s, d, "documents").select("doc_id", X.approximate_tokens(X.summarize_title(t), t, F.coalesce("source", F.lit(""))).alias("tokens"))


def _payloads(s, d) -> DataFrame:
    n = F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    return B.table(s, d, "documents").select(
        n.alias("position"), F.when(n % 11 == 0, "/other").otherwise("/react/docs").alias("source_id"), F.when(n % 5 == 0, "  ").otherwise(t).alias("title"),
        t.alias("snippet"), F.when(n % 3 == 0, t).otherwise(F.lit("short")).alias("content"), F.when(n % 4 == 0, "ftp://x").otherwise("https://example.org").alias("citation"), F.when(n % 6 == 0, "").when(n % 6 == 1, None).otherwise("19").alias("version"),
    )


def payload_validate(s, d):
    return ingest.validate_payloads(_payloads(s, d), F.lit("/react/docs"), F.col("position")).select("position", "message")


def _entries(s, d) -> DataFrame:
    """A registry entry as JSON for each customer, keys left out by its number; every seventh has the id of its nation, so that ids repeat."""
    n = F.col("c_custkey")
    left = lambda k, x, name: F.when(n % k != 0, x).alias(name)
    words = F.array(F.lit("w"))
    meta = F.struct(left(2, F.lit("t"), "title"), words.alias("aliases"), F.lit("d").alias("domain"), left(3, F.lit("official"), "trust"), words.alias("supported_versions"), words.alias("citations"))
    targets = F.struct(left(5, words, "staging_shard_ids"), words.alias("prod_shard_ids"))
    smoke = F.struct(F.lit("r").alias("resolve"), left(4, F.lit("q"), "query"), F.lit("p").alias("pack"))
    hints = F.struct(words.alias("content_roots"), words.alias("drop_selectors"), left(6, F.lit(900), "chunk_target_chars"))
    source_id = F.when(n % 11 != 0, F.when(n % 7 == 0, F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("/c/"), n.cast("string"))))
    entry = F.struct(
        source_id.alias("source_id"), left(8, F.lit("docs"), "kind"), F.lit(True).alias("enabled"), words.alias("public_urls"), words.alias("discovery_urls"), F.lit("p").alias("normalization_profile"),
        left(9, meta, "catalog_metadata"), targets.alias("memory_targets"), F.lit("daily").alias("cadence"), F.lit("v").alias("version_strategy"), hints.alias("extraction_hints"), left(10, smoke, "smoke_queries"))
    return B.table(s, d, "customer").select(n.alias("position"), F.to_json(entry).alias("entry"))


def registry_validate(s, d):
    return ingest.validate_registry(_entries(s, d))


def registry_duplicates(s, d):
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("source_id"))
    return ingest.duplicate_ids(o).select("position", "source_id")


# ---------------------------------------------------------------- refresh


def _hashes(df: DataFrame) -> DataFrame:
    return df.select("source_id", X.record_key(F.col("citation"), F.col("section_index"), F.col("chunk_index")).alias("record_key"), F.sha2("content", 256).alias("hash"))


def _changes(s, d) -> DataFrame:
    old, new = B.snapshots(s, d)
    return refresh.diff_records(_hashes(old), _hashes(new))


def diff_records(s, d):
    return _changes(s, d).where("change <> 'same'")


def diff_counts(s, d):
    return refresh.diff_status(_changes(s, d)).select("source_id", "added_records", "removed_records", "changed_records", "total_changes")


def diff_status(s, d):
    return refresh.diff_status(_changes(s, d), 3, 2).select("source_id", "status", "needs_review")


def diff_fingerprint(s, d):
    return refresh.fingerprint(_hashes(B.snapshots(s, d)[1]))


def diff_keys(s, d):
    return refresh.diff_report(_changes(s, d))


def diff_by_digest(s, d):
    """Status and counts of each source by digests: records meet only in buckets that differ."""
    old, new = (R.bucketed(_hashes(x)) for x in B.snapshots(s, d))
    return refresh.diff_states(old, new, R.digests(old), R.digests(new)).status(3, 2)


def page_meta(s, d):
    _, meta = ingest.normalize(_raw(s, d), _page_registry(s, d))
    return tables.warnings_by_source(meta).select("source_id", "warning_count", F.array_join(F.transform("warnings", lambda w: F.concat(w["url"], F.lit(" "), w["kind"])), "|").alias("warnings"))


def _gate_rows(s, d) -> DataFrame:
    n = F.col("o_orderkey")
    return B.table(s, d, "orders").select(
        F.concat(F.lit("/o/"), n.cast("string")).alias("source_id"), F.when(n % 17 == 0, 1).otherwise(0).alias("errors"), F.when(n % 3 == 0, "noop").otherwise("updated").alias("status"),
        (n % 2 == 0).alias("metadata_changed"), (n % 13 == 0).alias("needs_review"), F.when(n % 19 == 0, 2).otherwise(0).alias("warnings"), (n % 7 != 0).alias("staging_ok"),
        (n % 5 != 0).alias("prod_ok"), (n % 4 != 0).alias("has_snapshot"), (n % 11 != 0).alias("rollback_ok"),
    )


def refresh_gate(s, d):
    return refresh.gate(_gate_rows(s, d)).select("source_id", "decision", "merges_state", "partial")


def refresh_report_status(s, d):
    return refresh.report_status(refresh.gate(_gate_rows(s, d)))


def refresh_merge_state(s, d):
    c = B.table(s, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("status"), F.col("c_mktsegment").alias("success_snapshot"))
    state = c.where("source_id % 3 <> 0")
    new = c.where("source_id % 2 = 0").withColumns({"status": F.concat(F.lit("new "), "status"), "success_snapshot": F.when(F.col("source_id") % 4 == 0, F.col("success_snapshot"))})
    return refresh.merge_state(state, new)


def rollback_snapshot(s, d):
    o = B.table(s, d, "orders")
    snaps = o.select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("source_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot"), F.col("o_orderkey").alias("record"))
    failed = o.where("o_custkey % 3 = 0").select(F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("source_id")).distinct()
    # The state names the newest snapshot of half the sources and the oldest of the others; of some none.
    named = F.when(F.col("o_custkey") % 5 != 0, F.when(F.col("o_custkey") % 2 == 0, F.max("snapshot")).otherwise(F.min("snapshot")))
    state = snaps.withColumn("o_custkey", F.substring_index("source_id", "/", -1).cast("long")).groupBy("source_id", "o_custkey").agg(named.alias("success_snapshot"))
    return refresh.last_success(snaps, failed, state).select("source_id", "snapshot", "record")


def raw_union_roles(s, d):
    p = B.table(s, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    link = F.array(F.struct(F.lit("page").alias("label"), F.col("url")))
    other = F.array(F.struct(F.lit("host").alias("label"), F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("url")))
    reg = p.select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("source_id"), link.alias("public_urls"), other.alias("discovery_urls"))
    return tables.raw_urls(reg)


def latest_snapshot(s, d):
    e = B.table(s, d, "events").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("source_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("collected_at"), "event_id")
    return tables.latest_snapshot(e)


def enabled_daily(s, d):
    r = B.table(s, d, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("source_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("enabled"), F.when(F.col("p_type") == "PROMO", "weekly").otherwise("daily").alias("cadence"))
    return tables.enabled_sources(r, cadence="daily")


# ---------------------------------------------------------------- text


def embedding_text(s, d):
    t = F.coalesce("text", F.lit(""))
    return B.table(s, d, "documents").select("doc_id", F.sha2(X.embedding_text(X.summarize_title(t), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(t), t), 256).alias("digest"))


def slugs(s, d):
    return B.parts_catalog(s, d).select("source_id", X.slug(F.col("source_id")).alias("slug"), X.slug(F.concat(F.lit("//v1.2"), "source_id", F.lit("/"))).alias("deep"))


def record_keys(s, d):
    n = F.col("doc_id")
    return B.table(s, d, "documents").select("doc_id", X.record_key(F.concat(F.lit("https://example.org/"), n.cast("string")), F.when(n % 2 == 0, (n % 5).cast("int")), F.when(n % 3 == 0, (n % 7).cast("int"))).alias("record_key"))


def memory_tags(s, d):
    p = B.parts_catalog(s, d)
    return p.select("source_id", X.memory_tag(F.col("source_id"), F.when(F.col("trust") == "curated", F.array().cast("array<string>")).otherwise(F.concat("supported_versions", F.array(F.lit("9"))))).alias("tag"))


def citation_fragments(s, d):
    p = B.table(s, d, "pages").withColumn("url", F.coalesce("url", F.lit("")))
    return p.select("page_id", X.with_fragment(F.col("url"), F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.concat(F.lit("h"), F.col("page_id").cast("string")))).alias("citation"), X.is_absolute(F.col("url")).alias("absolute"), X.section_slug(F.col("url")).alias("section"))


_QUERIES = [
    catalog_list, catalog_list_with_skills, catalog_get, catalog_filter_domain_trust_version, catalog_filter_limit_before_hide, catalog_upsert, catalog_replace, catalog_seed_ignore, catalog_child_arrays,
    resolve_seed, resolve_scale, resolve_skill_excluded, resolve_skill_reranked, resolve_overfetch_cut, query_intent, query_entities, query_task_kind_topics, normalize_catalog_text, normalize_engine_text,
    vector_topk_query, vector_topk_per_source, vector_version_filter, payload_parse, payload_parse_non_string, pack_dedup, pack_budget, pack_warnings, pack_warnings_failing, pack_summary, pack_summary_failing, pack_flagship, cite_pack,
    page_title, page_clean_text, page_sections, page_chunks, extraction_guard, page_meta, doc_chunks, doc_summaries, doc_token_estimate, payload_validate, registry_validate, registry_duplicates,
    diff_records, diff_counts, diff_status, diff_fingerprint, diff_keys, diff_by_digest, refresh_gate, refresh_report_status, refresh_merge_state, rollback_snapshot, raw_union_roles, latest_snapshot, enabled_daily,
    embedding_text, slugs, record_keys, memory_tags, citation_fragments,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
