"""Sources and sinks: the seed catalog, child tables, JSON and JSON-lines files, documents, state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateflow import schemas
from slateflow.sources.versions import exists, names, write_json, write_text

# The four built-in sources.
SEED = [
    {"source_id": "/vercel/next.js", "title": "Next.js Docs", "aliases": ["next", "nextjs", "next.js", "middleware"], "trust": "official", "domain": "code_docs", "skill_kind": None, "targets": [], "capabilities": [], "shard_ids": [], "supported_versions": ["14", "15"], "retrieved_at": "2026-03-17T00:00:00Z", "citations": ["https://nextjs.org/docs"]},
    {"source_id": "/supabase/docs", "title": "Supabase Docs", "aliases": ["supabase", "auth"], "trust": "official", "domain": "code_docs", "skill_kind": None, "targets": [], "capabilities": [], "shard_ids": [], "supported_versions": ["2026"], "retrieved_at": "2026-03-17T00:00:00Z", "citations": ["https://supabase.com/docs"]},
    {"source_id": "/react/docs", "title": "React Docs", "aliases": ["react", "hooks"], "trust": "official", "domain": "code_docs", "skill_kind": None, "targets": [], "capabilities": [], "shard_ids": [], "supported_versions": ["19"], "retrieved_at": "2026-03-17T00:00:00Z", "citations": ["https://react.dev"]},
    {"source_id": "/skills/nextjs/migration", "title": "Next.js Migration Skill", "aliases": ["next migration", "nextjs migration", "upgrade"], "trust": "curated", "domain": "skill_knowledge", "skill_kind": "migration", "targets": ["nextjs"], "capabilities": ["auth", "middleware", "routing"], "shard_ids": [], "supported_versions": [], "retrieved_at": "2026-03-17T00:00:00Z", "citations": ["https://example.org/skills/nextjs/migration"]},
]


def sources_from(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f] for f in schemas.SOURCE.names) for r in rows], schemas.SOURCE)


def seed_catalog(spark: SparkSession, partial: bool = False) -> DataFrame:
    """The built-in sources; `partial` gives only what a fresh catalog is seeded with: no skill kind, targets, capabilities or shards."""
    df = sources_from(spark, SEED)
    if partial:
        none = F.array().cast("array<string>")
        df = df.withColumns({"skill_kind": F.lit(None).cast("string"), "targets": none, "capabilities": none, "shard_ids": none})
    return assemble(df.select(*schemas.PARENT), {c: children_of(df, c) for c in schemas.CHILDREN})


def children_of(sources: DataFrame, child: str) -> DataFrame:
    """(source_id, value) of one child table."""
    return sources.select("source_id", F.explode(child).alias("value"))


def assemble(parents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with their child values as sorted arrays, empty where there is none.

    One union and one aggregation for all six tables, in place of six aggregations and six joins.
    """
    rows = None
    for name, df in children.items():
        part = df.select("source_id", F.lit(name).alias("child"), F.col("value").cast("string").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    lists = rows.groupBy("source_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("child") == c, F.col("value")))).alias(c) for c in children])
    out = parents.join(lists, "source_id", "left")
    return out.select(*[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in children else F.col(c) for c in schemas.SOURCE.names])


#: Catalog schemas by version: what a table must have, and what later versions added.
CATALOG_VERSIONS = [
    ("source_id", "title", "domain", "trust", "retrieved_at", "aliases", "shard_ids", "supported_versions", "citations"),
    ("skill_kind", "targets", "capabilities"),
]


def catalog_version(rows: DataFrame) -> int:
    """The newest version whose columns a catalog table has; without those of the first it is no catalog."""
    have, version = set(rows.columns), -1
    for added in CATALOG_VERSIONS:
        if not have.issuperset(added):
            break
        version += 1
    if version < 0:
        raise ValueError(f"not a catalog: no {', '.join(sorted(set(CATALOG_VERSIONS[0]) - have))}")
    return version


def migrate(rows: DataFrame) -> DataFrame:
    """A catalog table of any version as schemas.SOURCE: what an older one lacks is null, or an empty list."""
    catalog_version(rows)
    none = F.array().cast("array<string>")
    missing = {f.name: F.lit(None).cast("string") for f in schemas.SOURCE if f.name not in rows.columns}
    rows = rows.withColumns(missing | {c: none for c in schemas.CHILDREN if c not in rows.columns})
    return rows.select(*[F.coalesce(c, none).alias(c) if c in schemas.CHILDREN else F.col(c) for c in schemas.SOURCE.names])


# ---------------------------------------------------------------- files


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a missing file is an empty table and blank lines are skipped."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, nulls kept, non-ASCII escaped."""
    cols = [F.col(c) for c in sorted(df.columns)]
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry: one top-level array of entries; any other document is an error."""
    return spark.read.schema(schemas.REGISTRY).json(_array_at(spark, path), multiLine=True)


def registry_entries(spark: SparkSession, path: str) -> DataFrame:
    """(position, entry) of the registry's array, each entry as JSON text."""
    whole = F.try_parse_json("value")
    rows = spark.read.text(_array_at(spark, path), wholetext=True).select(F.posexplode(F.try_variant_get(whole, "$", "array<variant>")).alias("position", "v"))
    return rows.select("position", F.to_json("v").alias("entry"))


def _array_at(spark: SparkSession, path: str) -> str:
    kind = spark.read.text(path, wholetext=True).select(F.schema_of_variant(F.try_parse_json("value")).alias("k")).first()
    if kind is None or not (kind["k"] or "").startswith("ARRAY"):
        raise ValueError(f"{path} must contain a top-level array")
    return path


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows written as JSON, or none where the path doesn't exist."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_report(spark: SparkSession, report: dict, folder: str) -> str:
    """A refresh report as JSON, and Markdown beside it, named by its time; gives the JSON's path."""
    path = f"{folder.rstrip('/')}/{file_safe(report['run_at'])}"
    write_json(spark, path + ".json", report)
    lines = [f"# Source refresh report {report['run_at']}", "", f"Status: {report['status']}", "", *[f"- {s['source_id']}: {s['status']}" for s in report["sources"]]]
    write_text(spark, path + ".md", "\n".join(lines) + "\n")
    return path + ".json"


def file_safe(timestamp: str) -> str:
    return timestamp.replace(":", "-")


#: What came of one URL: an item, or why there is none.
FETCHED = T.StructType([T.StructField("source_id", T.StringType()), *schemas.ITEM.fields, T.StructField("error", T.StringType())])


def _fetch(frames):
    """One request for each row (source_id, url, label, role, etag, last_modified); whatever goes wrong is the row's error."""
    import hashlib
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    def one(url: str, etag: str | None, modified: str | None, timeout: float) -> tuple:
        asks = {"User-Agent": "slateflow/1"} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": modified} if modified else {})
        try:
            with urlopen(Request(url, headers=asks), timeout=timeout) as r:  # noqa: S310
                h, body = r.headers, r.read().decode("utf-8")
                return r.geturl(), h.get("Content-Type", ""), r.status, h.get("ETag"), h.get("Last-Modified"), body, hashlib.sha256(body.encode()).hexdigest(), None
        except HTTPError as e:
            kept = e.code == 304
            return e.geturl() or url, None, e.code, etag if kept else None, modified if kept else None, None, None, None if kept else f"HTTP {e.code}"
        except (OSError, ValueError) as e:  # no connection, a time limit, a bad URL, bytes that aren't UTF-8
            return url, None, None, None, None, None, None, str(e) or type(e).__name__

    for pdf in frames:
        rows = []
        for s, u, label, role, etag, modified, timeout in pdf.itertuples(index=False):
            final, kind, status, new_etag, new_modified, body, digest, error = one(u, etag, modified, timeout)
            rows.append((s, u, final, kind, status, new_etag, new_modified, body, digest, label, role, error))
        out = pd.DataFrame(rows, columns=FETCHED.names)
        out["status_code"] = out["status_code"].astype("Int32")
        yield out


def _files(spark: SparkSession, urls: DataFrame) -> DataFrame:
    """FETCHED of file:// URLs, by Spark's reader: plain text with status 200. The list of their paths, which a registry gives, is taken by the driver."""
    paths = [r["url"] for r in urls.select("url").distinct().collect()]
    there = [p for p in paths if exists(spark, p)]
    none = F.lit(None).cast("string")
    text = spark.createDataFrame([], "path string, body string")
    if there:
        text = spark.read.format("binaryFile").load([p.removeprefix("file://") for p in there]).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("body"))
    rows = urls.withColumn("path", F.regexp_replace("url", "^file:/+", "/")).join(text, "path", "left")
    found = F.col("body").isNotNull()
    return rows.select(
        "source_id", "url", F.col("url").alias("final_url"), F.when(found, "text/plain").alias("content_type"), F.when(found, 200).alias("status_code"), none.alias("etag"), none.alias("last_modified"),
        "body", F.sha2("body", 256).alias("sha256"), "label", "role", F.when(~found, "no such file").alias("error"))


def fetch_documents(spark: SparkSession, urls: DataFrame, timeout: float = 20.0, previous: DataFrame | None = None) -> DataFrame:
    """FETCHED of (source_id, url, label, role): file:// as plain text with status 200, http(s) with its headers.

    Requests go out from the executors, those to one host from one task after another. `previous` (FETCHED or
    ITEM with source_id) makes them conditional: what hasn't changed since (304) is taken from there, with its
    status and type. A request that fails is a row with `error`, and keeps no other back.
    """
    urls = urls.select("source_id", "url", "label", "role")
    none = F.lit(None).cast("string")
    known = None if previous is None else previous.where("body is not null").dropDuplicates(["source_id", "url", "role"])
    web = urls.where(~F.startswith("url", F.lit("file://")))
    if known is None:
        web = web.withColumns({"etag": none, "last_modified": none})
    else:
        web = web.join(known.select("source_id", "url", "role", "etag", "last_modified"), ["source_id", "url", "role"], "left")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    web = web.select("source_id", "url", "label", "role", "etag", "last_modified", F.lit(float(timeout)).alias("timeout"))
    got = web.repartition(parts, F.try_parse_url("url", F.lit("HOST"))).mapInPandas(_fetch, FETCHED)
    if known is not None:
        old = known.select("source_id", "url", "role", *[F.col(c).alias(f"_{c}") for c in ("final_url", "content_type", "status_code", "body", "sha256")])
        same = F.col("status_code") == 304
        got = got.join(old, ["source_id", "url", "role"], "left").select(
            *[F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in old.columns else F.col(c) for c in FETCHED.names])
    return got.unionByName(_files(spark, urls.where(F.startswith("url", F.lit("file://")))))


def raw_urls(registry: DataFrame) -> DataFrame:
    """Public and discovery URLs of every entry, tagged with their role."""
    part = lambda c: registry.select("source_id", F.explode(c).alias("u"), F.lit(c).alias("role")).select("source_id", "u.label", "u.url", "role")
    return part("public_urls").unionByName(part("discovery_urls"))


def latest_snapshot(raw: DataFrame) -> DataFrame:
    """The newest collection of each source of any table; for stored collections read_latest_raw() reads less."""
    return raw.groupBy("source_id").agg(F.max_by(F.struct(*raw.columns), "collected_at").alias("r")).select("r.*")


def enabled_sources(registry: DataFrame, source_id: str | None = None, cadence: str | None = None) -> DataFrame:
    out = registry.where(F.coalesce("enabled", F.lit(False)))
    if source_id is not None:
        out = out.where(F.col("source_id") == source_id)
    return out.where(F.col("cadence") == cadence) if cadence is not None else out


def collect(spark: SparkSession, registry: DataFrame, collected_at: str, timeout: float = 20.0, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One snapshot (schemas.RAW) of the sources whose URLs could all be fetched, items in order of role, label and URL; and (source_id, url, error) of what couldn't.

    `previous`: the snapshots before (schemas.RAW), for conditional requests. Both tables come from one persisted
    table of what was fetched, so that nothing is asked for twice.
    """
    if previous is not None:
        previous = previous.select("source_id", F.explode("items").alias("i")).select("source_id", "i.*")
    items = fetch_documents(spark, raw_urls(registry), timeout, previous).persist()
    failed = items.where("error is not null").select("source_id", "url", "error")
    row = F.struct(*schemas.ITEM.names)
    rows = items.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("role", "label", "url", row.alias("i")))).alias("x"))
    found = registry.select("source_id").join(rows, "source_id", "left").join(failed.select("source_id"), "source_id", "left_anti")
    none = F.array().cast(schemas.RAW["items"].dataType)
    return found.select("source_id", F.lit(collected_at).alias("collected_at"), F.coalesce(F.transform("x", lambda x: x["i"]), none).alias("items")), failed


def write_raw(raw: DataFrame, path: str) -> None:
    """Add a snapshot: a folder for each source, and below it for each collection of it."""
    raw.withColumn("snapshot", F.replace("collected_at", F.lit(":"), F.lit("-"))).write.mode("append").partitionBy("source_id", "snapshot").json(path)


def read_latest_raw(spark: SparkSession, path: str) -> DataFrame:
    """The newest collection of each source (schemas.RAW): the folders' names tell which, so that older pages are neither read nor shuffled."""
    newest = [f"{path}/{s}/{found[-1]}" for s in names(spark, path) if s.startswith("source_id=") and (found := [n for n in names(spark, f"{path}/{s}") if n.startswith("snapshot=")])]
    if not newest:
        return spark.createDataFrame([], schemas.RAW)
    schema = T.StructType([*schemas.RAW, T.StructField("snapshot", T.StringType())])
    return spark.read.schema(schema).option("basePath", path).json(newest).select(*schemas.RAW.names)


def _by_source(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("source_id").json(path)


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Normalized payloads, a folder for each source; sources not among them keep what they have."""
    _by_source(payloads.select(*schemas.PAYLOAD.names), path)


def read_payloads(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """Normalized payloads; one source's folder alone if `source_id` is given."""
    rows = read_rows(spark, path, schemas.PAYLOAD)
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)


def warnings_by_source(meta: DataFrame) -> DataFrame:
    """schemas.META from a row for each item (source_id, url, item_pos, warnings): each source's warnings in order of items."""
    each = meta.select("source_id", "item_pos", "url", F.posexplode_outer("warnings").alias("pos", "kind"))
    said = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("item_pos", "pos", F.struct("url", "kind").alias("w")))))
    return each.groupBy("source_id").agg(F.transform(said, lambda x: x["w"]).alias("warnings")).select("source_id", F.size("warnings").alias("warning_count"), "warnings")


def write_meta(meta: DataFrame, path: str) -> None:
    """What normalization had to say of each source, beside its payloads."""
    _by_source(meta.select(*schemas.META.names), path)


def read_meta(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """The meta of every source; one without any has no warnings."""
    known = sources.select("source_id").join(read_rows(spark, path, schemas.META), "source_id", "left")
    none = F.array().cast(schemas.META["warnings"].dataType)
    return known.select("source_id", F.coalesce("warning_count", F.lit(0)).alias("warning_count"), F.coalesce("warnings", none).alias("warnings"))


#: An instance's state as rows: a kind, and what that kind carries.
INSTANCE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("principal", T.StringType()), T.StructField("message", T.StringType())])
# Kinds of states, and whether each carries a principal and a message.
INSTANCE_KINDS = {"Empty": (False, True), "Pending": (False, True), "Creation": (False, True), "Installation": (True, True), "SettingUp": (True, False), "Running": (True, False)}


def list_instances(spark: SparkSession, path: str) -> DataFrame:
    """Deployed instances in order of kind and principal; a row of another kind, or without what its kind carries, fails the read."""
    rows = read_jsonl(spark, path, INSTANCE)
    fits = F.lit(False)
    for kind, (principal, message) in INSTANCE_KINDS.items():
        fits = fits | ((F.col("kind") == kind) & (F.col("principal").isNotNull() == F.lit(principal)) & (F.col("message").isNotNull() == F.lit(message)))
    bad = F.concat(F.lit("not an instance state: "), F.to_json(F.struct("kind", "principal", "message")))
    checked = F.when(F.coalesce(fits, F.lit(False)), F.col("kind")).otherwise(F.raise_error(bad).cast("string"))
    return rows.select(checked.alias("kind"), "principal", "message").orderBy("kind", "principal")
