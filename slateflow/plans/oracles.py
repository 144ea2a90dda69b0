"""SQL for the driver queries, from the same bindings."""

from __future__ import annotations

from slateflow.plans import bindings as B

_FLAT = """source_id, title, array_to_string(aliases, '|') AS aliases, trust, domain, skill_kind, array_to_string(targets, '|') AS targets, array_to_string(capabilities, '|') AS capabilities,
 array_to_string(shard_ids, '|') AS shard_ids, array_to_string(supported_versions, '|') AS supported_versions, retrieved_at, array_to_string(citations, '|') AS citations"""

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def cat(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^A-Za-z0-9./]', ' ', 'g'))"


def eng(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def hints(x: str, words: list[str]) -> str:
    return f"list_filter({words!r}, lambda h: contains({x}, h))"


def title_of(x: str) -> str:
    t = strip(x)
    return f"CASE WHEN {t} = '' THEN 'Untitled memory result' WHEN length({t}) > 80 THEN substring({t}, 1, 80) || '...' ELSE {t} END"


KINDS = ["migration", "upgrade", "debug", "checklist", "playbook", "workflow"]
TOPICS = ["auth", "middleware", "routing", "cookies", "server", "hooks", "deploy"]


def skill_entities(q: str) -> str:
    return f"list_filter([CASE WHEN contains({q}, 'next') THEN 'nextjs' END, CASE WHEN contains({q}, 'supabase') THEN 'supabase' END, CASE WHEN contains({q}, 'react') THEN 'react' END], lambda e: e IS NOT NULL)"


def scored(queries: str, sources: str) -> str:
    return f"""q AS (SELECT query_id, query, {cat('query')} AS qn, list_filter(string_split({cat('query')}, ' '), lambda t: t <> '') AS toks, {eng('query')} AS eq FROM ({queries})),
src AS ({sources}),
pts AS (SELECT q.*, s.*, list_transform(s.aliases, lambda a: CASE WHEN len(list_filter(q.toks, lambda t: NOT contains({cat('a')}, t))) = 0 THEN 1.0 WHEN contains(q.qn, {cat('a')}) THEN 0.5 ELSE 0.0 END) AS p,
  contains(q.qn, {cat('s.title')}) AS ht, contains(q.qn, {cat('s.source_id')}) AS hi FROM q, src s),
scored AS (SELECT *, (coalesce(list_sum(p), 0.0)::FLOAT + CASE WHEN ht THEN 0.7::FLOAT ELSE 0::FLOAT END + CASE WHEN hi THEN 0.8::FLOAT ELSE 0::FLOAT END)::FLOAT AS score,
  list_filter(list_concat(list_transform(range(1, len(aliases) + 1), lambda i: CASE WHEN p[i] = 1.0 THEN 'matched alias `' || aliases[i] || '`' WHEN p[i] = 0.5 THEN 'partially matched alias `' || aliases[i] || '`' END),
   [CASE WHEN ht THEN 'matched title' END, CASE WHEN hi THEN 'matched source_id' END]), lambda r: r IS NOT NULL) AS reasons FROM pts),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank1 FROM scored WHERE score > 0)"""


_OUT = "query_id, rank::INT AS rank, source_id, title, round(score::DOUBLE, 4) AS score, array_to_string(reasons, '|') AS reasons"


def resolved(queries: str, sources: str, n: int, skills: bool) -> str:
    base = "WITH " + scored(queries, sources)
    if not skills:
        return base + f", kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank1) AS rank FROM top WHERE rank1 <= {max(2 * n, 1)} AND domain <> 'skill_knowledge') SELECT {_OUT} FROM kept WHERE rank <= {n}"
    kind = f"{hints('eq', KINDS)}[1]"
    return base + f""", k AS (SELECT * EXCLUDE (score, reasons), score AS s0, reasons AS r0, domain = 'skill_knowledge' AND skill_kind IS NOT NULL AND skill_kind IS NOT DISTINCT FROM {kind} AS by_kind FROM top WHERE rank1 <= {max(2 * n, 1)}),
b AS (SELECT *, by_kind AND len(list_filter(targets, lambda t: list_contains({skill_entities('eq')}, {eng('t')}))) > 0 AS by_target, by_kind AND len(list_filter(capabilities, lambda t: list_contains({hints('eq', TOPICS)}, {eng('t')}))) > 0 AS by_cap,
  domain = 'skill_knowledge' AND len(list_filter(aliases, lambda a: {eng('a')} = eq)) > 0 AS by_alias FROM k),
c AS (SELECT *, (((s0 + CASE WHEN by_kind THEN 0.7::FLOAT ELSE 0::FLOAT END) + CASE WHEN by_target THEN 0.8::FLOAT ELSE 0::FLOAT END) + CASE WHEN by_cap THEN 0.45::FLOAT ELSE 0::FLOAT END) + CASE WHEN by_alias THEN 0.45::FLOAT ELSE 0::FLOAT END AS score,
  list_concat(r0, list_filter([CASE WHEN by_kind THEN 'skill kind matched query' END, CASE WHEN by_target THEN 'skill target matched query entity' END, CASE WHEN by_cap THEN 'skill capability matched query topic' END, CASE WHEN by_alias THEN 'skill alias exactly matched query' END], lambda r: r IS NOT NULL)) AS reasons FROM b),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank1) AS rank FROM c) SELECT {_OUT} FROM kept WHERE rank <= {n}"""


def hits(pairs: str, k: int, version: str | None = None, all_rows: str = "") -> str:
    """CTEs q, src, hit: ranked snippets of (query_id, source_id, src_rank, vector) pairs."""
    keep = f"WHERE p_version = '{version}'" if version else ""
    return f"""lab AS ({B.LABELS_SQL}), mem AS ({B.MEMORY_SQL}), asked AS ({B.ASKED_SQL}), pairs AS ({pairs}),
sh AS (SELECT p.*, lab.trust, lab.retrieved_at, unnest(list_sort(lab.shard_ids)) AS shard_id, generate_subscripts(list_sort(lab.shard_ids), 1) AS shard_pos FROM pairs p JOIN lab USING (source_id)),
raw AS (SELECT sh.*, m.hit_pos, list_inner_product(sh.vector::DOUBLE[], m.embedding::DOUBLE[]) AS score, m.p_snippet AS snippet, m.p_version AS p_version,
  coalesce(m.given_title, {title_of('m.p_snippet')}) AS title, coalesce(m.given_citation, 'memory://' || sh.source_id) AS citation FROM sh JOIN mem m USING (shard_id)),
hit AS (SELECT *, p_version AS version FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, shard_pos, hit_pos)::INT AS hit_rank FROM raw {keep}) WHERE hit_rank <= {k})"""


ALL_PAIRS = "SELECT a.query_id, l.source_id, 1 AS src_rank, a.vector FROM asked a, lab l"
RESOLVED_PAIRS = "SELECT r.query_id, r.source_id, r.rank AS src_rank, a.vector FROM r5 r JOIN asked a USING (query_id)"

_R5 = f"r5 AS ({resolved(B.ASKED_SQL, B.LABELS_SQL, 5, False)}), "

PACKED = (
    "WITH RECURSIVE " + _R5 + hits(RESOLVED_PAIRS, 3)
    + """, ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id, title, citation ORDER BY src_rank, hit_rank) AS n FROM hit) WHERE n = 1),
srt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score::FLOAT DESC, src_rank, hit_rank) AS i, (length(title) + length(snippet) + length(citation) + 3) // 4 AS cost FROM ded),
fold AS (SELECT query_id, i, cost, CASE WHEN cost <= {budget} THEN cost ELSE 0 END AS used, cost <= {budget} AS kept FROM srt WHERE i = 1
  UNION ALL SELECT s.query_id, s.i, s.cost, CASE WHEN f.used + s.cost <= {budget} THEN f.used + s.cost ELSE f.used END, f.used + s.cost <= {budget} FROM fold f JOIN srt s ON s.query_id = f.query_id AND s.i = f.i + 1),
ev AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.i)::INT AS position FROM srt s JOIN fold f ON f.query_id = s.query_id AND f.i = s.i WHERE f.kept),
outc AS (SELECT p.query_id, p.source_id, p.src_rank, CASE WHEN len(lab.shard_ids) = 0 THEN 'error' WHEN coalesce(h.n, 0) > 0 THEN 'ok' ELSE 'empty' END AS outcome FROM pairs p JOIN lab USING (source_id)
  LEFT JOIN (SELECT query_id, source_id, count(*) AS n FROM hit GROUP BY ALL) h ON h.query_id = p.query_id AND h.source_id = p.source_id)
"""
)


def packed(select: str, budget: int = 3000) -> str:
    return PACKED.replace("{budget}", str(budget)) + select


def failing(select: str, budget: int = 3000) -> str:
    """packed() with failed shards and a source whose metadata is gone."""
    shards = "[" + ", ".join(f"'{x}'" for x in B.FAILED_SHARDS) + "]"
    out = packed(select, budget)
    for old, new in (
        ("FROM pairs p JOIN lab USING (source_id)),\nraw", f"FROM pairs p JOIN lab USING (source_id) WHERE p.source_id <> '{B.LOST_SOURCE}'),\nraw"),
        ("FROM sh JOIN mem m USING (shard_id))", f"FROM sh JOIN mem m USING (shard_id) WHERE NOT list_contains({shards}, sh.shard_id))"),
        ("CASE WHEN len(lab.shard_ids) = 0", f"CASE WHEN p.source_id = '{B.LOST_SOURCE}' THEN 'missing' WHEN len(lab.shard_ids) = 0"),
        ("THEN 'ok' ELSE 'empty' END AS outcome", f"THEN 'ok' WHEN list_has_any(lab.shard_ids, {shards}) THEN 'error' ELSE 'empty' END AS outcome"),
    ):
        assert out.count(old) == 1, old
        out = out.replace(old, new)
    return out


_WARNED = """SELECT query_id, CASE WHEN outcome = 'empty' THEN 'empty_source' ELSE 'source_error' END AS kind,
 CASE outcome WHEN 'empty' THEN 'No snippets matched for ' WHEN 'missing' THEN 'Failed to load source metadata for ' ELSE 'Failed to query source canisters for ' END || source_id AS message FROM outc WHERE outcome <> 'ok'"""

_CHANGES = "WITH " + B.SNAPSHOT_SQL + " "


def _clean(x: str) -> str:
    refs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")]
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in refs:
        out = f"replace({out}, '{a}', '{b}')"
    return collapse(out)


GATE_ROWS = """SELECT '/o/' || o_orderkey AS source_id, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN o_orderkey % 3 = 0 THEN 'noop' ELSE 'updated' END AS status, o_orderkey % 2 = 0 AS metadata_changed,
 o_orderkey % 13 = 0 OR o_orderkey % 19 = 0 AS review, o_orderkey % 7 <> 0 AS staging_ok, o_orderkey % 5 <> 0 AS prod_ok, o_orderkey % 4 <> 0 AS has_snapshot, o_orderkey % 11 <> 0 AS rollback_ok FROM orders"""
GATED = f"""SELECT *, decision IN ('noop', 'applied') AS merges_state, decision NOT IN ('noop', 'applied', 'dry_run') AS partial FROM (SELECT source_id, CASE WHEN errors > 0 THEN 'failed' WHEN status = 'noop' AND NOT metadata_changed THEN 'noop' WHEN NOT staging_ok THEN 'failed' WHEN review THEN 'needs_review'
 WHEN NOT prod_ok THEN CASE WHEN NOT has_snapshot THEN 'unavailable' WHEN rollback_ok THEN 'rolled_back' ELSE 'rollback_failed' END ELSE 'applied' END AS decision FROM ({GATE_ROWS}))"""

_PARTS = f"WITH p AS ({B.PARTS_SQL}), k AS (SELECT *, regexp_extract(source_id, '/(\\d+)$', 1)::BIGINT AS key FROM p) "
_SPLIT = f"string_split(regexp_replace(t, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1))"

def registry_messages() -> str:
    """What a customer's entry lacks: top-level keys, and all keys below one that is left out."""
    sid = "coalesce(CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN '/n/' || c_nationkey ELSE '/c/' || c_custkey END END, '<missing>')"
    keys = {"catalog_metadata": ["title", "aliases", "domain", "trust", "supported_versions", "citations"], "memory_targets": ["staging_shard_ids"], "smoke_queries": ["resolve", "query", "pack"], "extraction_hints": ["chunk_target_chars"]}
    gone = {"title": 2, "trust": 3, "staging_shard_ids": 5, "query": 4, "chunk_target_chars": 6}
    whole = {"catalog_metadata": 9, "smoke_queries": 10}
    rules = [(f"c_custkey % {k} = 0", f"missing `{name}`") for name, k in (("source_id", 11), ("kind", 8), *whole.items())]
    for parent, names in keys.items():
        for name in names:
            tests = [f"c_custkey % {k} = 0" for k in (gone.get(name), whole.get(parent)) if k]
            if tests:
                rules.append((" OR ".join(tests), f"{parent} missing `{name}`"))
    said = " UNION ALL ".join(f"SELECT position, sid || ': {text}' AS message FROM e WHERE {test}" for test, text in rules)
    return f"""WITH e AS (SELECT c_custkey AS position, *, {sid} AS sid FROM customer), f AS (SELECT *, min(position) OVER (PARTITION BY sid) AS first FROM e WHERE sid <> '<missing>')
        {said} UNION ALL SELECT position, sid || ': duplicate source_id' FROM f WHERE position > first"""


SQL: dict[str, str] = {
    "catalog_list": f"WITH p AS ({B.PARTS_SQL}) SELECT {_FLAT} FROM p WHERE domain <> 'skill_knowledge'",
    "catalog_list_with_skills": f"WITH p AS ({B.PARTS_SQL}) SELECT {_FLAT} FROM p",
    "catalog_get": f"WITH p AS ({B.PARTS_SQL}) SELECT {_FLAT} FROM p WHERE source_id = '/Brand#17/1'",
    "catalog_filter_domain_trust_version": f"WITH p AS ({B.PARTS_SQL}) SELECT {_FLAT} FROM p WHERE domain = 'skill_knowledge' AND trust = 'official' AND list_contains(supported_versions, '12')",
    "catalog_filter_limit_before_hide": f"WITH p AS ({B.PARTS_SQL}), l AS (SELECT * FROM p ORDER BY source_id LIMIT 50) SELECT {_FLAT} FROM l WHERE domain <> 'skill_knowledge'",
    "catalog_upsert": _PARTS + f""", u AS (SELECT * EXCLUDE (key) REPLACE ('new ' || title AS title, ['b', 'z'] AS aliases, CASE WHEN key % 10 = 0 THEN source_id || '/more' ELSE source_id END AS source_id) FROM k WHERE key % 5 = 0),
        a AS (SELECT * FROM p WHERE source_id NOT IN (SELECT source_id FROM u) UNION ALL BY NAME SELECT * FROM u) SELECT {_FLAT} FROM a""",
    "catalog_replace": _PARTS + f", r AS (SELECT * REPLACE ('/r/' || (key % 100) AS source_id) FROM k QUALIFY row_number() OVER (PARTITION BY key % 100 ORDER BY key DESC) = 1) SELECT {_FLAT} FROM r",
    "catalog_seed_ignore": f"""WITH s AS ({B.SEED_SQL}), p AS ({B.PARTS_SQL}), have AS (SELECT * REPLACE (CASE WHEN source_id = '/Brand#17/1' THEN '/supabase/docs' WHEN ends_with(source_id, '/2') THEN '/react/docs' ELSE source_id END AS source_id) FROM p),
        a AS (SELECT * FROM have UNION ALL BY NAME SELECT * REPLACE (NULL AS skill_kind, []::VARCHAR[] AS targets, []::VARCHAR[] AS capabilities, []::VARCHAR[] AS shard_ids) FROM s WHERE source_id NOT IN (SELECT source_id FROM have)) SELECT {_FLAT} FROM a""",
    "catalog_child_arrays": f"WITH p AS ({B.PARTS_SQL}) SELECT {_FLAT} FROM p",
    "resolve_seed": resolved(B.SPOKEN_SQL, B.SEED_SQL, 5, False),
    "resolve_skill_reranked": resolved(B.SKILL_QUERIES_SQL, B.SKILLS_SQL, 5, True),
    "resolve_scale": "WITH " + scored(B.name_queries_sql(), B.PARTS_SQL) + f", kept AS (SELECT *, rank1 AS rank FROM top WHERE rank1 <= 10) SELECT {_OUT} FROM kept",
    "resolve_skill_excluded": resolved(B.name_queries_sql(), B.PARTS_SQL, 5, False),
    "resolve_overfetch_cut": resolved(B.name_queries_sql(" migration"), B.PARTS_SQL, 3, True),
    "query_intent": f"""WITH q AS (SELECT conv_id || ':' || turn AS query_id, text AS query FROM conversations UNION ALL SELECT query_id::VARCHAR, query FROM ({B.SEED_QUERIES_SQL}))
        SELECT query_id, CASE WHEN len(list_filter(['next', 'nextjs', 'next.js', 'react', 'supabase', 'hook'], lambda w: contains({low("coalesce(query, '')")}, w))) > 0 THEN 'Code' WHEN len(list_filter(['travel', 'trip', 'hotel'], lambda w: contains({low("coalesce(query, '')")}, w))) > 0 THEN 'Travel' ELSE 'General' END AS intent FROM q""",
    "query_entities": f"SELECT query_id, array_to_string(list_filter(['next.js', 'supabase', 'react', 'middleware', 'auth'], lambda e: contains({low('query')}, e) OR contains({low('query')}, replace(e, '.', ''))), '|') AS entities FROM ({B.SPOKEN_SQL})",
    "query_task_kind_topics": f"SELECT query_id, {hints('eq', KINDS)}[1] AS kind, array_to_string({hints('eq', TOPICS)}, '|') AS topics, array_to_string({skill_entities('eq')}, '|') AS targets FROM (SELECT query_id, {eng('query')} AS eq FROM ({B.SPOKEN_SQL}))",
    "normalize_catalog_text": f"SELECT doc_id, sha256(x) AS digest, len(list_filter(string_split(x, ' '), lambda t: t <> ''))::INT AS n_tokens FROM (SELECT doc_id, {cat("coalesce(text, '')")} AS x FROM documents)",
    "normalize_engine_text": f"SELECT doc_id, sha256({eng("coalesce(text, '')")}) AS digest FROM documents",
    "vector_topk_query": "WITH " + hits("SELECT query_id, '/label/3' AS source_id, 1 AS src_rank, vector FROM asked", 5) + "SELECT query_id, hit_rank, source_id, title, snippet, citation, trust, retrieved_at, version, false AS stale, round(score::FLOAT::DOUBLE, 4) AS score FROM hit",
    "vector_topk_per_source": "WITH " + hits(ALL_PAIRS, 3) + "SELECT query_id, source_id, hit_rank, citation, round(score::FLOAT::DOUBLE, 4) AS score FROM hit",
    "vector_version_filter": "WITH " + hits(ALL_PAIRS, 5, "2") + "SELECT query_id, source_id, hit_rank, version, citation, round(score::FLOAT::DOUBLE, 4) AS score FROM hit",
    "payload_parse": f"WITH mem AS ({B.MEMORY_SQL}) SELECT hit_pos, coalesce(given_title, {title_of('p_snippet')}) AS p_title, sha256(p_snippet) AS snippet_digest, coalesce(given_citation, 'memory:///shard/' || shard_id) AS p_citation, p_version FROM mem",
    "payload_parse_non_string": f"SELECT event_id, {title_of('props')} AS p_title, props AS p_snippet, 'memory:///events/' || event_type AS p_citation, NULL::VARCHAR AS p_version FROM events",
    "pack_dedup": packed("SELECT query_id, source_id, hit_rank, title, citation, round(score::FLOAT::DOUBLE, 4) AS score FROM ded"),
    "pack_budget": packed("SELECT query_id, position, cost, source_id, citation, round(score::FLOAT::DOUBLE, 4) AS score FROM ev", 300),
    "pack_warnings": packed(_WARNED),
    "pack_warnings_failing": failing(_WARNED),
    "pack_summary": packed("""SELECT a.query_id, a.query, coalesce(r.ids, '') AS resolved_sources, coalesce(e.n, 0)::INT AS n_evidence, coalesce(w.n, 0)::INT AS n_warnings,
        CASE WHEN coalesce(e.n, 0) > 0 THEN 'Top evidence came from: ' || e.titles ELSE 'No evidence found for the query.' END AS pack_summary, 300::BIGINT AS token_budget, coalesce(w.answered, 0) = 0 AND coalesce(dd.n, 0) = 0 AS failed
        FROM asked a LEFT JOIN (SELECT query_id, string_agg(source_id, '|' ORDER BY rank) AS ids FROM r5 GROUP BY 1) r USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(title, ', ' ORDER BY position) FILTER (position <= 3) AS titles FROM ev GROUP BY 1) e USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) FILTER (outcome <> 'ok') AS n, count(*) FILTER (outcome <> 'error') AS answered FROM outc GROUP BY 1) w USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM ded GROUP BY 1) dd USING (query_id)""", 300),
    "pack_summary_failing": failing("""SELECT a.query_id, coalesce(r.ids, '') AS resolved_sources, coalesce(e.n, 0)::INT AS n_evidence, coalesce(w.n, 0)::INT AS n_warnings,
        CASE WHEN coalesce(e.n, 0) > 0 THEN 'Top evidence came from: ' || e.titles ELSE 'No evidence found for the query.' END AS pack_summary, coalesce(w.answered, 0) = 0 AND coalesce(dd.n, 0) = 0 AS failed
        FROM asked a LEFT JOIN (SELECT query_id, string_agg(source_id, '|' ORDER BY rank) AS ids FROM r5 GROUP BY 1) r USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(title, ', ' ORDER BY position) FILTER (position <= 3) AS titles FROM ev GROUP BY 1) e USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) FILTER (outcome <> 'ok') AS n, count(*) FILTER (outcome IN ('ok', 'empty')) AS answered FROM outc GROUP BY 1) w USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS n FROM ded GROUP BY 1) dd USING (query_id)"""),
    "pack_flagship": packed("SELECT query_id, (position - 1)::INT AS pos, source_id, title, sha256(snippet) AS snippet_digest, citation, trust, version, round(score::FLOAT::DOUBLE, 4) AS score FROM ev"),
    "cite_pack": packed("SELECT query_id, a.query, (position - 1)::INT AS position, source_id, title, citation, trust, retrieved_at, version, false AS stale FROM ev JOIN (SELECT query_id, query FROM asked) a USING (query_id)", 300),
    "page_title": f"SELECT page_id, coalesce(nullif({_clean("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, ''), 'Untitled') AS title FROM pages",
    "page_clean_text": f"SELECT page_id, sha256({_clean("coalesce(html, '')")}) AS digest FROM pages",
    "doc_chunks": f"""WITH RECURSIVE d AS (SELECT doc_id, {collapse("coalesce(text, '')")} AS t FROM documents), s AS (SELECT doc_id, t, CASE WHEN length(t) <= 900 THEN [t] ELSE {_SPLIT} END AS parts FROM d),
        f AS (SELECT doc_id, parts, 1 AS i, parts[1] AS cur, 0 AS k FROM s
          UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN length(cur || ' ' || parts[i + 1]) <= 900 AND cur <> '' THEN cur || ' ' || parts[i + 1] ELSE parts[i + 1] END, CASE WHEN cur = '' OR length(cur || ' ' || parts[i + 1]) <= 900 THEN k ELSE k + 1 END FROM f WHERE i < len(parts)),
        g AS (SELECT doc_id, k, arg_max(cur, i) AS chunk FROM f GROUP BY doc_id, k)
        SELECT doc_id, k::INT AS chunk_index, length(chunk)::INT AS n, sha256(chunk) AS digest FROM g""",
    "doc_summaries": f"""WITH d AS (SELECT doc_id, {collapse("regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')")} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 240 THEN regexp_replace(substring(t, 1, 237), '{SPACE}+$', '') || '...' ELSE t END AS summary FROM d""",
    "doc_token_estimate": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS s FROM documents) SELECT doc_id, ((length({title_of('t')}) + length(t) + length(s) + 3) // 4)::BIGINT AS tokens FROM d""",
    "payload_validate": f"""WITH p AS (SELECT doc_id AS position, CASE WHEN doc_id % 11 = 0 THEN '/other' ELSE '/react/docs' END AS source_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE coalesce(text, '') END AS title, coalesce(text, '') AS snippet,
          CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE 'short' END AS content, CASE WHEN doc_id % 4 = 0 THEN 'ftp://x' ELSE 'https://example.org' END AS citation, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN NULL ELSE '19' END AS version FROM documents),
        m AS (SELECT position, unnest([CASE WHEN {strip('title')} = '' THEN 'missing `title`' END, CASE WHEN {strip('snippet')} = '' THEN 'missing `snippet`' END, CASE WHEN source_id <> '/react/docs' THEN 'payload source_id mismatch' END,
          CASE WHEN citation LIKE 'ftp%' THEN 'citation must be absolute' END, CASE WHEN version = '' THEN 'version is required' END, CASE WHEN length(content) > 280 AND content = snippet THEN 'snippet should not duplicate long content' END]) AS m FROM p)
        SELECT position, '/react/docs[' || position || ']: ' || m AS message FROM m WHERE m IS NOT NULL""",
    "registry_validate": registry_messages(),
    "registry_duplicates": "SELECT o_orderkey AS position, '/c/' || o_custkey AS source_id FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) WHERE o_orderkey > f",
    "diff_records": _CHANGES + "SELECT * FROM changes WHERE change <> 'same'",
    "diff_counts": _CHANGES + "SELECT source_id, count(*) FILTER (change = 'added') AS added_records, count(*) FILTER (change = 'removed') AS removed_records, count(*) FILTER (change = 'changed') AS changed_records, count(*) FILTER (change <> 'same') AS total_changes FROM changes GROUP BY 1",
    "diff_status": _CHANGES + "SELECT source_id, CASE WHEN bool_and(change = 'added') THEN 'new' WHEN bool_and(change = 'removed') THEN 'deleted' WHEN bool_or(change <> 'same') THEN 'updated' ELSE 'noop' END AS status, count(*) FILTER (change <> 'same') > 3 OR count(*) FILTER (change = 'removed') > 2 AS needs_review FROM changes GROUP BY 1",
    "diff_fingerprint": _CHANGES + "SELECT source_id, count(*) || ':' || sum(('0x' || substr(m, 1, 15))::BIGINT) % 1152921504606846976 || ':' || sum(('0x' || substr(m, 16, 15))::BIGINT) % 1152921504606846976 AS fingerprint FROM (SELECT source_id, sha256(record_key || chr(10) || hash) AS m FROM new) GROUP BY 1",
    "diff_keys": _CHANGES + "SELECT source_id, change, record_key FROM changes WHERE change <> 'same'",
    "diff_by_digest": _CHANGES + """SELECT source_id, count(*) FILTER (change = 'added') AS added_records, count(*) FILTER (change = 'removed') AS removed_records, count(*) FILTER (change = 'changed') AS changed_records, count(*) FILTER (change <> 'same') AS total_changes,
        CASE WHEN bool_and(change = 'added') THEN 'new' WHEN bool_and(change = 'removed') THEN 'deleted' WHEN bool_or(change <> 'same') THEN 'updated' ELSE 'noop' END AS status, count(*) FILTER (change <> 'same') > 3 OR count(*) FILTER (change = 'removed') > 2 AS needs_review FROM changes GROUP BY 1""",
    "refresh_gate": GATED,
    "refresh_report_status": f"SELECT CASE WHEN coalesce(bool_or(partial), false) THEN 'partial' ELSE 'ok' END AS status FROM ({GATED})",
    "refresh_merge_state": """WITH s AS (SELECT c_custkey AS source_id, c_name AS status, c_mktsegment AS success_snapshot FROM customer), n AS (SELECT source_id, 'new ' || status AS status, CASE WHEN source_id % 4 = 0 THEN success_snapshot END AS success_snapshot FROM s WHERE source_id % 2 = 0),
        o AS (SELECT * FROM s WHERE source_id % 3 <> 0) SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(n.status, o.status) AS status, coalesce(n.success_snapshot, o.success_snapshot) AS success_snapshot FROM o FULL JOIN n USING (source_id)""",
    "rollback_snapshot": "WITH s AS (SELECT '/c/' || o_custkey AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS snapshot, o_orderkey AS record, o_custkey FROM orders) SELECT source_id, snapshot, record FROM s WHERE o_custkey % 3 = 0 AND o_custkey % 5 <> 0 QUALIFY snapshot = CASE WHEN o_custkey % 2 = 0 THEN max(snapshot) OVER (PARTITION BY source_id) ELSE min(snapshot) OVER (PARTITION BY source_id) END",
    "raw_union_roles": "SELECT '/pages/' || page_id AS source_id, 'page' AS label, coalesce(url, '') AS url, 'public_urls' AS role FROM pages UNION ALL SELECT '/pages/' || page_id, 'host', regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*'), 'discovery_urls' FROM pages",
    "latest_snapshot": "SELECT '/u/' || user_id AS source_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS collected_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "enabled_daily": "SELECT '/p/' || p_partkey AS source_id, true AS enabled, 'daily' AS cadence FROM part WHERE p_size % 3 = 1 AND p_type <> 'PROMO'",
    "embedding_text": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, list_filter([{strip(title_of('t'))}, {strip("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE t END")}, {strip('t')}], lambda x: x <> '') AS parts FROM d) SELECT doc_id, sha256(array_to_string(parts, chr(10) || chr(10))) AS digest FROM p",
    "slugs": f"WITH p AS ({B.PARTS_SQL}) SELECT source_id, replace(replace(trim(source_id, '/'), '/', '__'), '.', '_') AS slug, replace(replace(trim('//v1.2' || source_id || '/', '/'), '/', '__'), '.', '_') AS deep FROM p",
    "record_keys": "SELECT doc_id, 'https://example.org/' || doc_id || '#' || CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 0 END || ':' || CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE 0 END AS record_key FROM documents",
    "memory_tags": f"WITH p AS ({B.PARTS_SQL}) SELECT source_id, 'source:' || source_id || ':' || CASE WHEN trust = 'curated' THEN 'unversioned' ELSE '9' END AS tag FROM p",
    "citation_fragments": "WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 0 OR contains(url, '#') THEN url ELSE url || '#h' || page_id END AS citation, regexp_matches(url, '^(http|https|file)://') AS absolute, substring(replace(lower(url), ' ', '-'), 1, 80) AS section FROM p",
}
