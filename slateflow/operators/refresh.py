"""Incremental refresh: differences to the last state, the gate from staging to production, rollback, one commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slateflow import schemas
from slateflow.functions import text as X
from slateflow.operators import catalog, ingest, pack as packs
from slateflow.operators import record_state as R
from slateflow.operators.memory import TableStore, search
from slateflow.operators.resolve import resolve
from slateflow.sources.tables import file_safe, warnings_by_source
from slateflow.sources.versions import BucketTable, Commits, delete, names, read_version, versions, write_version


def record_hashes(payloads: DataFrame, position: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, record_key, hash) of payloads; of rows with one key the last by `position` wins. `volatile` fields don't count."""
    fields = [(f, F.col(f)) for f in payloads.columns if f not in (*volatile, position)]
    rows = payloads.select("source_id", X.record_key(F.col("citation"), F.col("section_index"), F.col("chunk_index")).alias("record_key"), X.canonical_hash(*fields).alias("hash"), F.col(position).alias("_p"))
    return rows.groupBy("source_id", "record_key").agg(F.max_by("hash", "_p").alias("hash"))


def diff_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, record_key, change): added, removed, changed or same, from (source_id, record_key, hash) tables."""
    o = old.select("source_id", "record_key", F.col("hash").alias("old_hash"))
    n = new.select("source_id", "record_key", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return o.join(n, ["source_id", "record_key"], "full_outer").select("source_id", "record_key", change.alias("change"))


def diff_status(changes: DataFrame, max_changed: int = 200, max_deleted: int = 25) -> DataFrame:
    """A row for each source: counts, status (new, deleted, updated, noop) and needs_review."""
    n = lambda c: F.count_if(F.col("change") == c)
    out = changes.groupBy("source_id").agg(n("added").alias("added_records"), n("removed").alias("removed_records"), n("changed").alias("changed_records"), F.count("*").alias("_all"))
    total = F.col("added_records") + F.col("removed_records") + F.col("changed_records")
    status = (
        F.when(F.col("added_records") == F.col("_all"), "new").when(F.col("removed_records") == F.col("_all"), "deleted").when(total > 0, "updated").otherwise("noop")
    )
    return out.select("source_id", "added_records", "removed_records", "changed_records", total.alias("total_changes"), status.alias("status"), ((total > max_changed) | (F.col("removed_records") > max_deleted)).alias("needs_review"))


def diff_report(changes: DataFrame) -> DataFrame:
    """(source_id, change, record_key) of what was added, removed or changed, a row for each, in order of source, change and key."""
    return changes.where("change <> 'same'").select("source_id", "change", "record_key").orderBy("source_id", "change", "record_key")


def fingerprint(hashes: DataFrame) -> DataFrame:
    """One digest of each source's records (source_id, record_key, hash), whatever their order."""
    return R.fingerprint(hashes)


@dataclass
class Diff:
    """What digests tell of each source (source_id, n_old, n_new, equal), and the changes (source_id, record_key, change) of the records in buckets that differ."""

    sources: DataFrame
    changes: DataFrame

    def status(self, max_changed: int = 200, max_deleted: int = 25) -> DataFrame:
        """As diff_status(), of every source that has records or had some."""
        n = lambda c: F.count_if(F.col("change") == c).alias(f"{c}_records")
        got = self.sources.join(self.changes.groupBy("source_id").agg(n("added"), n("removed"), n("changed")), "source_id", "left").na.fill(0)
        total = F.col("added_records") + F.col("removed_records") + F.col("changed_records")
        status = F.when((F.col("n_old") == 0) & (F.col("n_new") > 0), "new").when((F.col("n_old") > 0) & (F.col("n_new") == 0), "deleted").when(total > 0, "updated").otherwise("noop")
        return got.select("source_id", "added_records", "removed_records", "changed_records", total.alias("total_changes"), status.alias("status"), ((total > max_changed) | (F.col("removed_records") > max_deleted)).alias("needs_review"))


def diff_states(old: DataFrame, new: DataFrame, old_digests: DataFrame, new_digests: DataFrame) -> Diff:
    """The difference of two states of HASHES and DIGESTS: records meet only in buckets whose digests differ."""
    sources, places = R.differing(old_digests, new_digests)
    return Diff(sources, diff_records(R.within(old, places), R.within(new, places)))


def metadata_changed(old_hash: Column, new_hash: Column) -> Column:
    return ~old_hash.eqNullSafe(new_hash)


def gate(rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """The decision for each source and the state's and report's part in it.

    rows: source_id, errors (count), status, metadata_changed, needs_review, warnings (count), staging_ok,
    prod_ok, has_snapshot, rollback_ok.
    """
    review = F.col("needs_review") | (F.col("warnings") > 0)
    back = F.when(~F.col("has_snapshot"), "unavailable").when(F.col("rollback_ok"), "rolled_back").otherwise("rollback_failed")
    decision = (
        F.when(F.col("errors") > 0, "failed").when((F.col("status") == "noop") & ~F.col("metadata_changed"), "noop").when(~F.col("staging_ok"), "failed")
        .when(review, "needs_review").when(F.lit(dry_run), "dry_run").when(~F.col("prod_ok"), back).otherwise("applied")
    )
    out = rows.withColumn("decision", decision)
    return out.withColumns({"merges_state": F.col("decision").isin("noop", "applied"), "partial": ~F.col("decision").isin("noop", "applied", "dry_run")})


def report_status(decided: DataFrame) -> DataFrame:
    return decided.agg(F.when(F.coalesce(F.bool_or("partial"), F.lit(False)), "partial").otherwise("ok").alias("status"))


def merge_state(state: DataFrame, updates: DataFrame, key: str = "source_id") -> DataFrame:
    """State rows with new values in place of old; a null in an update keeps what was there (the success snapshot)."""
    cols = state.columns
    u = updates.select(F.col(key), *[F.col(c).alias(f"u_{c}") for c in cols if c != key])
    return state.join(u, key, "full_outer").select(*[F.col(c) if c == key else F.coalesce(f"u_{c}", c).alias(c) for c in cols])


def last_success(snapshots: DataFrame, failed: DataFrame, state: DataFrame) -> DataFrame:
    """For sources whose publication failed, the records of the snapshot that their state (source_id, success_snapshot) names, whatever newer ones there are."""
    named = state.where("success_snapshot is not null").select("source_id", F.col("success_snapshot").alias("snapshot")).join(failed.select("source_id"), "source_id", "left_semi")
    return snapshots.join(named, ["source_id", "snapshot"], "left_semi")


# ---------------------------------------------------------------- one cycle


@dataclass
class Stores:
    """Where a cycle reads and writes: records and catalog of each environment, state, record hashes, snapshots, and the commits that say what counts.

    Every write is a new version or a new run, beside what readers use. A commit names, for both environments
    and the state, the versions that belong together; it is the cycle's last write. So a crash at any
    point leaves the commit before it, whole, and what was written for nothing is dropped later by vacuum().
    """

    staging: TableStore
    prod: TableStore
    staging_catalog: str
    prod_catalog: str
    state: str
    snapshots: str
    commits: str | None = None
    hashes: str | None = None

    def __post_init__(self):
        self.commits = self.commits or f"{self.state.rstrip('/')}-commits"
        self.hashes = self.hashes or f"{self.state.rstrip('/')}-records"

    @property
    def spark(self) -> SparkSession:
        return self.prod.spark

    def catalog(self, env: str) -> BucketTable:
        return BucketTable(self.spark, self.staging_catalog if env == "staging" else self.prod_catalog, schemas.SOURCE, "source_id")

    def store(self, env: str) -> TableStore:
        return self.staging if env == "staging" else self.prod

    def log(self) -> Commits:
        return Commits(self.spark, self.commits)

    def records(self) -> R.RecordStore:
        return R.RecordStore(self.spark, self.hashes)

    def read_state(self, head: dict | None = None) -> DataFrame:
        """The state of a commit, the newest unless it is given."""
        head = self.log().read() if head is None else head
        return read_version(self.spark, self.state, schemas.STATE, head["state"]) if head.get("state") is not None else self.spark.createDataFrame([], schemas.STATE)

    def published(self, env: str, head: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Catalog and records of an environment, of one commit: the newest unless it is given."""
        at = (self.log().read() if head is None else head).get(env) or {}
        none = self.spark.createDataFrame([], schemas.SOURCE)
        sources = none if at.get("catalog") is None else self.catalog(env).read(at["catalog"])
        records = self.spark.createDataFrame([], schemas.MEMORY) if at.get("memory") is None else self.store(env).at(at["memory"]).read()
        return sources, records

    def snapshot(self, name: str) -> DataFrame:
        """The payloads of one snapshot, by its name."""
        return self.spark.read.schema(schemas.PAYLOAD).parquet(f"{self.snapshots}/snapshot={name}")

    def vacuum(self, keep: int = 2) -> None:
        """Drop what none of the last `keep` commits names. Readers that lag further behind lose what they read; no cycle may run meanwhile."""
        log = self.log()
        heads = [log.read(n) for n in log.numbers()[-keep:]]
        for env in ("staging", "prod"):
            at = [h[env] for h in heads if h.get(env)]
            self.catalog(env).vacuum({a["catalog"] for a in at if a.get("catalog") is not None})
            self.store(env).vacuum({a["memory"] for a in at if a.get("memory") is not None})
        states = {h["state"] for h in heads if h.get("state") is not None}
        for n in versions(self.spark, self.state):
            if n not in states:
                delete(self.spark, f"{self.state}/v={n}")
        named = [read_version(self.spark, self.state, schemas.STATE, n).select("hashes_run", "success_snapshot") for n in states]
        rows = [r for x in named for r in x.distinct().collect()]  # names of runs
        self.records().vacuum({r["hashes_run"] for r in rows})
        for name in names(self.spark, self.snapshots):
            if name.removeprefix("snapshot=") not in {r["success_snapshot"] for r in rows}:
                delete(self.spark, f"{self.snapshots}/{name}")


@dataclass
class Report:
    run_at: str
    status: str = "ok"
    sources: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def records_for(payloads: DataFrame, registry: DataFrame, env: str, embed) -> DataFrame:
    """Records of an environment: each payload, tagged, for every shard of its source, with what kept it from an embedding in `error`.

    `embed` adds an embedding to (text) rows and, if it can fail for a row alone, a text to `error`.

    hit_pos puts a shard's records in order of source, citation, section and chunk: a sort by ranges, whose
    rows are numbered where they lie, so that no task holds a whole shard.
    """
    target = registry.select("source_id", F.explode(f"memory_targets.{env}_shard_ids").alias("shard_id"), F.col("catalog_metadata.supported_versions").alias("_versions"))
    rows = payloads.join(target, "source_id").withColumn("memory_tag", X.memory_tag(F.col("source_id"), F.col("_versions")))
    fields = [F.col(c) for c in sorted([*schemas.PAYLOAD.names, "memory_tag"])]
    rows = rows.orderBy("shard_id", "source_id", "citation", "section_index", "chunk_index", "content").withColumn("hit_pos", F.monotonically_increasing_id())
    rows = rows.select("source_id", "shard_id", "hit_pos", X.embedding_text(F.col("title"), F.col("snippet"), F.col("content")).alias("text"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
    got = embed(rows)
    error = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
    return got.select("source_id", "shard_id", "hit_pos", "embedding", "payload", F.when(F.col("embedding").isNull(), F.coalesce(error, F.lit("no embedding"))).alias("error"))


def without_shards(registry: DataFrame, env: str) -> DataFrame:
    """(source_id, message) of entries that name no shard of an environment: nothing could be written for them."""
    none = F.coalesce(F.size(f"memory_targets.{env}_shard_ids"), F.lit(0)) <= 0
    return registry.where(none).select("source_id", F.concat("source_id", F.lit(f": no {env} memory shard ids configured")).alias("message"))


def catalog_rows(registry: DataFrame, env: str) -> DataFrame:
    return registry.select(
        "source_id", *[F.col(f"catalog_metadata.{c}").alias(c) for c in ("title", "aliases", "trust", "domain", "skill_kind", "targets", "capabilities")],
        F.col(f"memory_targets.{env}_shard_ids").alias("shard_ids"), *[F.col(f"catalog_metadata.{c}").alias(c) for c in ("supported_versions", "retrieved_at", "citations")],
    )


def smoke(registry: DataFrame, sources: DataFrame, memory: DataFrame, embed) -> DataFrame:
    """(source_id, failures) of each entry's smoke queries: resolve names it, query finds an absolute citation, pack has evidence."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"smoke_queries.{k}").alias("query")) for k in ("resolve", "query", "pack")])
    asks = registry.select("source_id", F.explode(kinds).alias("a")).select(F.struct("a.kind", F.col("source_id").alias("of")).alias("query_id"), "a.query", F.col("a.query").alias("text"))
    asks = embed(asks).select("query_id", "query", F.col("embedding").alias("vector")).where("vector is not null")
    found = resolve(asks.where("query_id.kind <> 'query'").select("query_id", "query"), sources, 5, True)
    resolved = found.where("query_id.kind = 'resolve' and query_id.of = source_id").select("query_id.of", F.lit("resolve").alias("step"))
    pairs = found.where("query_id.kind = 'pack'").select("query_id", "source_id", F.col("rank").alias("src_rank"), F.lit(packs.HITS_PER_SOURCE).alias("top_k"))
    own = asks.where("query_id.kind = 'query'").select("query_id", F.col("query_id.of").alias("source_id"), F.lit(1).alias("src_rank"), F.lit(5).alias("top_k"))
    asked = pairs.unionByName(own).join(asks.select("query_id", "vector"), "query_id").withColumn("version", F.lit(None).cast("string"))
    hits = search(asked, sources, memory, most=5)[0].select(F.col("query_id.kind").alias("kind"), F.col("query_id.of").alias("of"), "title", "snippet", "citation", "hit_rank")
    fits = X.approximate_tokens(F.col("title"), F.col("snippet"), F.col("citation")) <= packs.TOKENS  # a snippet alone that fits the budget is evidence
    steps = F.array_compact(F.array(F.when(F.col("kind") == "query", "query"), F.when((F.col("kind") == "query") & (F.col("hit_rank") == 1) & X.is_absolute(F.col("citation")), "query-citation"), F.when((F.col("kind") == "pack") & fits, "pack")))
    passed = resolved.unionByName(hits.select("of", F.explode(steps).alias("step"))).groupBy(F.col("of").alias("source_id")).agg(F.collect_set("step").alias("passed"))
    has = lambda step: F.coalesce(F.array_contains("passed", step), F.lit(False))
    fails = F.array_compact(F.array(F.when(~has("resolve"), "resolve"), F.when(~has("query"), "query"), F.when(has("query") & ~has("query-citation"), "query-citation"), F.when(~has("pack"), "pack")))
    return registry.select("source_id").join(passed, "source_id", "left").select("source_id", fails.alias("failures"))


def isolated(ids: list[str], job: Callable[[list[str]], list], failed: dict[str, str]) -> list:
    """What `job` gives for the ids, together. If it raises, it runs anew on each half, down to single ids, whose errors go to `failed`.

    One failing source among n costs about 2 log2(n) more runs, and keeps none of the others back.
    """
    if not ids:
        return []
    try:
        return job(ids)
    except Exception as e:  # whatever a source's rows or its storage raise
        if len(ids) == 1:
            failed[ids[0]] = (str(e).strip().splitlines() or [type(e).__name__])[0][:500]
            return []
    half = len(ids) // 2
    return isolated(ids[:half], job, failed) + isolated(ids[half:], job, failed)


class Publisher:
    """Writes to environments for one cycle, from the versions of commit `head` on; `at` has the versions that it has come to.

    In a dry run nothing is written, and smoke queries run on what would be.
    """

    def __init__(self, stores: Stores, head: dict, run: str, embed, dry_run: bool):
        self.stores, self.run, self.embed, self.dry_run = stores, run, embed, dry_run
        self.at = {env: dict(head.get(env) or {"catalog": None, "memory": None}) for env in ("staging", "prod")}

    def publish(self, env: str, ids: list[str], entries: DataFrame, content: DataFrame) -> dict[str, list[str]]:
        """Write memory and catalog of the registry entries of some ids; the failures of each id: steps that failed, else those of its smoke queries.

        A source whose records or catalog row can't be written keeps what it had there.
        """
        spark, stores = self.stores.spark, self.stores
        some = lambda df, ids: df.join(spark.createDataFrame([(i,) for i in ids], "source_id string"), "source_id", "left_semi")
        failed: dict[str, dict[str, str]] = {"memory": {}, "catalog": {}, "smoke": {}}
        ok = lambda: [i for i in ids if not any(i in f for f in failed.values())]
        if self.dry_run:
            sources = lambda some_ids: catalog_rows(some(entries, some_ids), env)
            memory = lambda some_ids: records_for(some(content, some_ids), some(entries, some_ids), env, self.embed).where("error is null").select(*schemas.MEMORY.names)
        else:
            def write(some_ids):
                run = f"{self.run}-{uuid.uuid4().hex[:8]}"
                bad = dict(stores.store(env).add(records_for(some(content, some_ids), some(entries, some_ids), env, self.embed), run))
                failed["memory"].update(bad)
                return [(i, run) for i in some_ids if i not in bad]

            runs = dict(isolated(ids, write, failed["memory"]))

            def enter(some_ids):
                self.at[env]["catalog"] = stores.catalog(env).upsert(catalog.checked(catalog_rows(some(entries, some_ids), env)), self.at[env]["catalog"])
                return some_ids

            entered = isolated(ok(), enter, failed["catalog"])
            if entered:
                self.at[env]["memory"] = stores.store(env).switch({i: runs[i] for i in entered}, self.at[env]["memory"])
            now = stores.published(env, {env: self.at[env]})
            sources, memory = lambda _: now[0], lambda _: now[1]
        got = isolated(ok(), lambda some_ids: [(r["source_id"], list(r["failures"])) for r in smoke(some(entries, some_ids), sources(some_ids), memory(some_ids), self.embed).collect()], failed["smoke"])
        return dict(got) | {i: [f"{step}: {error}"] for step, found in failed.items() for i, error in found.items()}


def problems_of(registry: DataFrame, payloads: DataFrame, meta: DataFrame) -> DataFrame:
    """(source_id, message): why a source can't be published: suspicious pages first, else no payloads, else payloads that break a rule."""
    small = meta.where("suspicious").select("source_id", F.concat("source_id", F.lit(": extracted text from `"), "url", F.lit("` looks too small; upstream HTML may have changed")).alias("message"))
    fine = registry.select("source_id").join(small.select("source_id"), "source_id", "left_anti")
    none = fine.join(payloads.select("source_id"), "source_id", "left_anti").select("source_id", F.concat("source_id", F.lit(": payload collection is empty")).alias("message"))
    w = Window.partitionBy("source_id").orderBy("citation", "section_index", "chunk_index", "item_pos")
    rows = payloads.join(fine, "source_id", "left_semi").withColumn("_pos", F.row_number().over(w) - 1)
    broken = ingest.validate_payloads(rows, F.col("source_id"), F.col("_pos")).select(F.col("expected_id").alias("source_id"), "message")
    return small.unionByName(none).unionByName(broken)


def assess(registry: DataFrame, payloads: DataFrame, meta: DataFrame, state: DataFrame, records: R.RecordStore, run: str | None, max_changed: int = 200, max_deleted: int = 25, volatile: tuple[str, ...] = ()) -> tuple[list, T.StructType]:
    """What gate() needs to know of each source before anything is published, with its counts, messages and new fingerprint: a row for each, and their schema.

    The hashes of sources whose digest is another than the state's are written as a run of `records`, for
    which no state stands yet; those of the others aren't read or written, but for their digests. Without a
    `run` nothing is written.
    """
    ours = lambda df: df.join(registry.select("source_id"), "source_id", "left_semi")
    now = R.bucketed(ours(record_hashes(payloads, "item_pos", volatile)))
    named = ours(state)
    old_digests, digests = records.digests(named), R.digests(now).persist()
    sources, _ = R.differing(old_digests, digests)
    apart = sources.where("not equal and n_new > 0").select("source_id")
    changed = now.join(apart, "source_id", "left_semi")
    if run is not None:
        records.write(changed, digests.join(apart, "source_id", "left_semi"), run)
        changed = records.hashes(apart.select("source_id", F.lit(run).alias("hashes_run")))
    found = diff_states(records.hashes(named), changed, old_digests, digests).status(max_changed, max_deleted)
    prints = digests.where(F.col("bucket") == R.WHOLE).select("source_id", F.col("digest").alias("fingerprint"))
    meta_hash = registry.select("source_id", X.canonical_hash(*[(f, F.col(f"catalog_metadata.{f}")) for f in schemas.REGISTRY["catalog_metadata"].dataType.names]).alias("new_meta"))
    problems = problems_of(registry, payloads, meta).groupBy("source_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))
    parts = (found, prints, meta_hash, state.select("source_id", "metadata_hash", "success_snapshot"), problems, warnings_by_source(meta).withColumnRenamed("warnings", "extraction_warnings"))
    rows = reduce(lambda x, part: x.join(part, "source_id", "left"), parts, registry.select("source_id"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("added_records", "removed_records", "changed_records", "total_changes")]
    no_words, no_warnings = F.array().cast("array<string>"), F.array().cast(schemas.META["warnings"].dataType)
    rows = rows.select(
        "source_id", F.coalesce(F.size("messages"), F.lit(0)).alias("errors"), F.coalesce("messages", no_words).alias("messages"), F.coalesce("status", F.lit("noop")).alias("status"), *counts, "new_meta", "fingerprint",
        metadata_changed(F.col("metadata_hash"), F.col("new_meta")).alias("metadata_changed"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce("warning_count", F.lit(0)).alias("warnings"),
        F.coalesce("extraction_warnings", no_warnings).alias("extraction_warnings"), F.col("success_snapshot").isNotNull().alias("has_snapshot"), F.col("success_snapshot").alias("snapshot"),
    )
    got = rows.collect()
    digests.unpersist()
    return got, rows.schema


def run_refresh(spark: SparkSession, registry: DataFrame, raw: DataFrame, stores: Stores, embed, dry_run: bool = False, max_changed: int = 200, max_deleted: int = 25, volatile: tuple[str, ...] = ()) -> Report:
    """One batch cycle over all given sources at once: normalize, validate, diff, stage, smoke, gate, publish or roll back, commit.

    A source without payloads, with a suspicious page or with a broken payload fails and stays as it was; so
    does one whose embedding or writing fails, and it alone. gate() decides three times: with nothing
    published yet, who goes to staging; with staging's result, who goes to production; and with
    production's, what each source ends as. One row a source reaches the driver, for these decisions and the
    report. Readers see all of it at once, with the commit at the end.
    """
    at = datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    entries = registry.select(F.monotonically_increasing_id().alias("position"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("entry"))
    bad = [r["message"] for r in ingest.validate_registry(entries).orderBy("position", "message").collect()]
    for env in ("staging", "prod"):
        bad += [r["message"] for r in without_shards(registry, env).orderBy("source_id").collect()]
    if bad:
        return Report(at, "invalid_registry", errors=bad)
    run = f"{file_safe(at)}-{uuid.uuid4().hex[:8]}"
    work = f"{stores.state.rstrip('/')}-work/{run}"
    try:
        written = []
        for name, df in zip(("payloads", "meta"), ingest.normalize(raw, registry)):  # written, so that extraction runs once, whatever executors are lost
            df.write.parquet(f"{work}/{name}")
            written.append(spark.read.schema(df.schema).parquet(f"{work}/{name}"))
        return _cycle(spark, registry, *written, stores, embed, at, run, dry_run, max_changed, max_deleted, volatile)
    finally:
        delete(spark, work)


def _cycle(spark, registry, payloads, meta, stores, embed, at, run, dry_run, max_changed, max_deleted, volatile) -> Report:
    number, head = stores.log().last(), stores.log().read()
    state = stores.read_state(head)
    rows, shape = assess(registry, payloads, meta, state, stores.records(), None if dry_run else run, max_changed, max_deleted, volatile)
    publisher = Publisher(stores, head, run, embed, dry_run)
    told: dict[str, dict[str, list[str]]] = {"staging": {}, "prod": {}, "rollback": {}}

    def decide() -> DataFrame:
        """gate() over what is known so far, on a local table; a step that hasn't run counts as passed."""
        known = [(*r, *[x for step in told.values() for x in (not step.get(r["source_id"]), step.get(r["source_id"], []))]) for r in rows]
        fields = [T.StructField(f"{step}_{c}", kind) for step in told for c, kind in (("ok", T.BooleanType()), ("failures", T.ArrayType(T.StringType())))]
        return gate(spark.createDataFrame(known, T.StructType([*shape, *fields])), dry_run)

    ids = lambda decision: [r["source_id"] for r in decide().where(decision).select("source_id").collect()]
    live = ids("errors = 0 and decision <> 'noop'")
    told["staging"] = publisher.publish("staging", live, registry, payloads) if live else {}
    go = ids("decision = 'applied'")
    if go:
        told["prod"] = publisher.publish("prod", go, registry, payloads)
        good = ids("decision = 'applied'")
        if good:
            local = spark.createDataFrame([(i,) for i in good], "source_id string")
            payloads.join(local, "source_id", "left_semi").select(*schemas.PAYLOAD.names).write.parquet(f"{stores.snapshots}/snapshot={run}")
        lost = {r["source_id"]: r["snapshot"] for r in decide().where("decision = 'rolled_back'").select("source_id", "snapshot").collect()}
        if lost:
            before = state.where(F.col("source_id").isin(list(lost))).select(F.from_json("success_entry", schemas.REGISTRY).alias("e")).select("e.*")
            held = reduce(DataFrame.unionByName, [stores.snapshot(n).where(F.col("source_id").isin([i for i in lost if lost[i] == n])) for n in sorted(set(lost.values()))])
            told["rollback"] = publisher.publish("prod", sorted(lost), before, held)
    final = decide()
    report = Report(at, report_status(final).first()["status"], [_told(r) for r in final.orderBy("source_id").collect()])
    if not dry_run:
        applied = F.col("decision") == "applied"
        whole = registry.select("source_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_entry"))
        new_run = F.when(applied & (F.col("total_changes") > 0), F.lit(run))
        updates = final.where("merges_state").join(whole, "source_id").select(
            "source_id", "status", F.col("fingerprint").alias("normalized_fingerprint"), F.col("new_meta").alias("metadata_hash"), new_run.alias("hashes_run"),
            F.when(applied, F.lit(run)).alias("success_snapshot"), F.when(applied, F.col("_entry")).alias("success_entry"), F.lit(at).alias("last_run_at"))
        version = write_version(merge_state(state, updates.select(*schemas.STATE.names)).withColumn("last_run_at", F.lit(at)), stores.state, keep=None)
        stores.log().write({"run": run, "state": version, **publisher.at}, number)
    return report


def _told(r) -> dict:
    """A source's part of the report."""
    out = {"source_id": r["source_id"], "status": r["decision"]}
    if r["errors"]:
        return out | {"errors": list(r["messages"])}
    out["diff"] = {k: r[k] for k in ("status", "metadata_changed", "added_records", "removed_records", "changed_records", "total_changes")}
    out["diff"]["needs_review"] = bool(r["needs_review"] or r["warnings"])
    if r["warnings"]:
        out["diff"]["extraction_warning_count"] = r["warnings"]
        out["warnings"] = [w.asDict() for w in r["extraction_warnings"]]
    failed = {step: list(r[f"{step}_failures"] or []) for step in ("staging", "prod", "rollback")}
    return out | {"failures": {k: v for k, v in failed.items() if v}} if any(failed.values()) else out
