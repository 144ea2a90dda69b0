"""The engine's tables bound to the driver's: catalog from `part`, memory from `embeddings` and `documents`, snapshots from `documents`.

Each binding exists twice, as a DataFrame and as SQL, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateflow.sources.tables import SEED, sources_from

SEED_QUERIES = [
    "next middleware", "next migration", "next migration auth changes", "protect route in next.js with supabase auth", "next", "upgrade", "Next.js Docs",
    "/vercel/next.js", "next react hooks", "migrate next auth code and react hooks", "", "zzz",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql_value, sorted(v))) + "]::VARCHAR[]"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


COLUMNS = ["source_id", "title", "aliases", "trust", "domain", "skill_kind", "targets", "capabilities", "shard_ids", "supported_versions", "retrieved_at", "citations"]


def values_sql(rows: list[dict]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql_value(r[c]) for c in COLUMNS) + ")" for r in rows) + f") t({', '.join(COLUMNS)})"


SEED_SQL = values_sql(SEED)


def seed(spark: SparkSession) -> DataFrame:
    from slateflow.sources.tables import seed_catalog

    return seed_catalog(spark)


def seed_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SEED_QUERIES)), "query_id int, query string")


SEED_QUERIES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_sql_value(q)})" for i, q in enumerate(SEED_QUERIES)) + ") t(query_id, query)"


def parts_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    size = F.col("p_size").cast("string")
    return p.select(
        F.concat(F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("source_id"), F.col("p_name").alias("title"),
        F.array_sort(F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_name")))).alias("aliases"),
        F.when(F.col("p_size") % 3 == 0, "official").when(F.col("p_size") % 3 == 1, "curated").otherwise("community").alias("trust"),
        F.when(F.col("p_type") == "PROMO", "skill_knowledge").otherwise("code_docs").alias("domain"),
        F.when(F.col("p_type") == "PROMO", F.when(F.col("p_size") % 2 == 0, "migration").otherwise("debug")).alias("skill_kind"),
        none.alias("targets"), none.alias("capabilities"), none.alias("shard_ids"), F.array(size).alias("supported_versions"),
        F.lit("2026-01-01T00:00:00Z").alias("retrieved_at"), F.array(F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string"))).alias("citations"),
    )


PARTS_SQL = """SELECT '/' || p_brand || '/' || p_partkey AS source_id, p_name AS title, list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_name]))) AS aliases,
  CASE WHEN p_size % 3 = 0 THEN 'official' WHEN p_size % 3 = 1 THEN 'curated' ELSE 'community' END AS trust,
  CASE WHEN p_type = 'PROMO' THEN 'skill_knowledge' ELSE 'code_docs' END AS domain,
  CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size % 2 = 0 THEN 'migration' ELSE 'debug' END END AS skill_kind,
  []::VARCHAR[] AS targets, []::VARCHAR[] AS capabilities, []::VARCHAR[] AS shard_ids, [p_size::VARCHAR] AS supported_versions,
  '2026-01-01T00:00:00Z' AS retrieved_at, ['https://example.org/' || p_partkey] AS citations FROM part"""


def name_queries(spark: SparkSession, sf_dir: str, suffix: str = "") -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(suffix)).alias("query")).distinct()
    return names.select(F.col("query").alias("query_id"), "query")


def name_queries_sql(suffix: str = "") -> str:
    return f"SELECT DISTINCT p_name || '{suffix}' AS query_id, p_name || '{suffix}' AS query FROM part"


#: What is asked beside a part's name: words of kinds, entities and topics; and what skills of parts are for.
PHRASES = ["", " next migration auth", " debug React hooks", " supabase", " upgrade middleware"]
TARGETS, CAPABILITIES = [["nextjs", "Vue"], ["React"], []], [["auth"], ["hooks", "Middleware"], [], ["deploy"]]


def skills_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of `part` with targets and capabilities, by the part's key."""
    key = F.regexp_extract("source_id", "/(\\d+)$", 1).cast("long")
    pick = lambda lists: F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in lists]), (key % len(lists) + 1).cast("int"))
    return parts_catalog(spark, sf_dir).withColumns({"targets": pick(TARGETS), "capabilities": pick(CAPABILITIES)})


def _picked(lists: list[list[str]]) -> str:
    return f"[{', '.join(_sql_value(x) for x in [sorted(y) for y in lists])}][(p_partkey % {len(lists)} + 1)::INT]"


SKILLS_SQL = f"SELECT p.* REPLACE ({_picked(TARGETS)} AS targets, {_picked(CAPABILITIES)} AS capabilities) FROM ({PARTS_SQL.replace('AS citations FROM', 'AS citations, p_partkey FROM')}) p"


def skill_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different name of a part with one of PHRASES: alone, it is an alias of its parts."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_size") % len(PHRASES) + 1).cast("int"))
    asked = table(spark, sf_dir, "part").select(F.concat("p_name", phrase).alias("query")).distinct()
    return asked.select(F.col("query").alias("query_id"), "query")


SKILL_QUERIES_SQL = f"SELECT DISTINCT query AS query_id, query FROM (SELECT p_name || [{', '.join(map(_sql_value, PHRASES))}][(p_size % {len(PHRASES)} + 1)::INT] AS query FROM part)"


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different text of `conversations` with one of PHRASES, by its length."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.length("text") % len(PHRASES) + 1).cast("int"))
    said = table(spark, sf_dir, "conversations").where("text is not null").select(F.concat("text", phrase).alias("query")).distinct()
    return said.select(F.sha2("query", 256).alias("query_id"), "query")


SPOKEN_SQL = f"SELECT DISTINCT sha256(query) AS query_id, query FROM (SELECT text || [{', '.join(map(_sql_value, PHRASES))}][(length(text) % {len(PHRASES)} + 1)::INT] AS query FROM conversations WHERE text IS NOT NULL)"


# ---------------------------------------------------------------- memory

LABELS = [
    {"source_id": f"/label/{i}", "title": f"Label {i}", "aliases": sorted(["label", f"group {i}"]), "trust": "official" if i % 2 else "curated", "domain": "skill_knowledge" if i == 9 else "code_docs", "skill_kind": None, "targets": [], "capabilities": [], "shard_ids": [] if i == 8 else sorted([str(2 * i), str(2 * i + 1)]), "supported_versions": ["1", "2"], "retrieved_at": "2026-02-01T00:00:00Z", "citations": [f"https://example.org/label/{i}"]}
    for i in range(10)
]
#: What fails in the failing variants: shards, and a source whose metadata is gone.
FAILED_SHARDS, LOST_SOURCE = ["0", "4", "5"], "/label/1"
#: Queries, each with the vector of one record.
ASKED = [(0, "label", 7), (1, "group 3", 11), (2, "group 8", 20), (3, "group 9 label", 42), (4, "group 4 /label/4", 100), (5, "nothing fits", 3)]


def labels(spark: SparkSession) -> DataFrame:
    return sources_from(spark, LABELS)


LABELS_SQL = values_sql(LABELS)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    text = F.coalesce("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    n = F.col("vec_id")
    url = F.concat(F.lit("https://example.org/doc/"), (n % 50).cast("string"))
    payload = (
        F.when(n % 4 == 0, F.to_json(F.struct(text.alias("snippet"), F.concat(F.lit("Doc "), (n % 7).cast("string")).alias("title"), url.alias("citation"), F.lit("1").alias("version"))))
        .when(n % 4 == 1, F.to_json(F.struct(text.alias("text"), url.alias("url"), F.lit("2").alias("version"))))
        .when(n % 4 == 2, text)
        .otherwise(F.to_json(F.struct(text.alias("content"), F.lit(3).alias("version"), F.lit(5).alias("title"))))
    )
    return e.join(d, "vec_id", "left").select((F.col("label") * 2 + n % 2).cast("string").alias("shard_id"), n.alias("hit_pos"), "embedding", payload.alias("payload"))


MEMORY_SQL = """SELECT (e.label * 2 + e.vec_id % 2)::VARCHAR AS shard_id, e.vec_id AS hit_pos, e.embedding,
  t AS p_snippet,
  CASE WHEN e.vec_id % 4 = 0 THEN 'Doc ' || (e.vec_id % 7) END AS given_title,
  CASE WHEN e.vec_id % 4 IN (0, 1) THEN 'https://example.org/doc/' || (e.vec_id % 50) END AS given_citation,
  CASE WHEN e.vec_id % 4 = 0 THEN '1' WHEN e.vec_id % 4 = 1 THEN '2' END AS p_version
  FROM (SELECT *, coalesce(d.text, 'vector ' || v.vec_id) AS t FROM embeddings v LEFT JOIN (SELECT doc_id, text FROM documents) d ON v.vec_id = d.doc_id WHERE embedding IS NOT NULL) e"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame(ASKED, "query_id int, query string, vec_id long")
    return q.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


ASKED_SQL = "SELECT a.query_id, a.query, v.embedding AS vector FROM (VALUES " + ", ".join(f"({i}, {_sql_value(q)}, {v})" for i, q, v in ASKED) + ") a(query_id, query, vec_id) JOIN embeddings v USING (vec_id)"


# ---------------------------------------------------------------- snapshots


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new (source_id, citation, section_index, chunk_index, content) of documents, by source."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    cols = [F.concat(F.lit("/src/"), "source").alias("source_id"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("citation"), F.lit(0).alias("section_index"), (F.col("doc_id") % 3).cast("int").alias("chunk_index")]
    old = d.where("doc_id % 10 <> 0").select(*cols, F.col("text").alias("content"))
    new = d.where("doc_id % 7 <> 0 or doc_id % 10 = 0").select(*cols, F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("content"))
    return old, new


SNAPSHOT_SQL = """d AS (SELECT '/src/' || source AS source_id, 'https://example.org/' || doc_id || '#0:' || (doc_id % 3) AS record_key, doc_id, coalesce(text, '') AS text FROM documents),
old AS (SELECT source_id, record_key, sha256(text) AS hash FROM d WHERE doc_id % 10 <> 0),
new AS (SELECT source_id, record_key, sha256(CASE WHEN doc_id % 13 = 0 THEN text || ' changed' ELSE text END) AS hash FROM d WHERE doc_id % 7 <> 0 OR doc_id % 10 = 0),
changes AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.record_key, n.record_key) AS record_key,
  CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'changed' ELSE 'same' END AS change
  FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.record_key = n.record_key)"""
