"""Stages of a refresh from the command line: collect, normalize, validate, diff, apply-memory, apply-catalog, smoke, refresh.

Each prints one JSON document and exits with 0 only if its status is ok; a refresh that isn't ok is printed to
stderr. Paths lie under --root: raw, normalized, meta, reports, state, snapshots, and a memory and a catalog
for each environment.
"""

from __future__ import annotations

import argparse
import json
import sys

from slateflow import schemas
from slateflow.settings import RefreshSettings, load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="slateflow.ops", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--registry")
    p.add_argument("--root")
    p.add_argument("--embedding-endpoint")
    p.add_argument("--vector", help="in place of an embedding service: one vector for every text, comma-separated")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("collect", "normalize", "validate", "diff"):
        sub.add_parser(name).add_argument("--source")
    for name in ("apply-memory", "apply-catalog", "smoke"):
        c = sub.add_parser(name)
        c.add_argument("--source", required=True)
        c.add_argument("--env", choices=["staging", "prod"], required=True)
        c.add_argument("--dry-run", action="store_true")
    r = sub.add_parser("refresh")
    r.add_argument("--source")
    r.add_argument("--dry-run", action="store_true")
    return p


def embedder(endpoint: str | None, vector: str | None, timeout: float = 30.0):
    """A function that gives (text) rows their embedding."""
    from pyspark.sql import functions as F

    from slateflow.operators.memory import HttpEmbedder

    if vector:
        values = [float(x) for x in vector.split(",")]
        return lambda rows: rows.withColumn("embedding", F.array(*[F.lit(v).cast("float") for v in values]))
    if endpoint:
        service = HttpEmbedder(endpoint, timeout)
        return lambda rows: service.embed(rows, "text", "embedding", "error")
    raise SystemExit("an embedding endpoint or a vector is needed")


def stores_of(spark, s: RefreshSettings):
    from slateflow.operators.memory import TableStore
    from slateflow.operators.refresh import Stores

    store = lambda env: TableStore(spark, s.path(f"memory/{env}"))
    return Stores(store("staging"), store("prod"), s.path("catalog/staging"), s.path("catalog/prod"), s.path("state"), s.path("snapshots"))


def run(spark, a: argparse.Namespace) -> dict:
    import uuid
    from datetime import UTC, datetime

    from pyspark.sql import functions as F

    from slateflow.operators import catalog, ingest, refresh
    from slateflow.operators import record_state as R
    from slateflow.sources import tables, versions

    s = load(RefreshSettings, registry=a.registry, root=a.root, embedding_endpoint=a.embedding_endpoint)
    registry = tables.read_registry(spark, s.registry)
    chosen = tables.enabled_sources(registry, a.source, "daily" if a.command == "refresh" else None)
    ids = lambda df: [r["source_id"] for r in df.select("source_id").distinct().orderBy("source_id").collect()]
    raw = lambda: tables.read_latest_raw(spark, s.path("raw"))
    registry_errors = lambda: [r["message"] for r in ingest.validate_registry(tables.registry_entries(spark, s.registry)).orderBy("position", "message").collect()]
    ours = lambda df: df.join(chosen.select("source_id"), "source_id", "left_semi")

    if a.command in ("collect", "refresh"):
        bad = registry_errors() if a.command == "refresh" else []
        if bad:
            return {"status": "invalid_registry", "errors": bad, "sources": []}
        at = datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
        got, failed = tables.collect(spark, chosen, at, s.http_timeout, raw())
        tables.write_raw(got, s.path("raw"))
        lost: dict[str, list[str]] = {}
        for r in failed.orderBy("source_id", "url").collect():
            lost.setdefault(r["source_id"], []).append(f"{r['source_id']}: {r['url']}: {r['error']}")
        if a.command == "collect":
            told = {"status": "failed" if lost else "ok", "sources": ids(got)}
            return told | {"errors": [e for x in lost.values() for e in x]} if lost else told
        embed = embedder(s.embedding_endpoint, a.vector, s.embedding_timeout)
        fetched = chosen.join(spark.createDataFrame([(i,) for i in lost], "source_id string"), "source_id", "left_anti")
        report = refresh.run_refresh(spark, fetched, ours(raw()), stores_of(spark, s), embed, a.dry_run, s.max_changed_records, s.max_deleted_records)
        if lost:  # what can't be fetched fails alone and stays as it was
            report.status = "partial"
            report.sources = sorted([*report.sources, *({"source_id": i, "status": "failed", "errors": e} for i, e in lost.items())], key=lambda x: x["source_id"])
        out = vars(report)
        if report.status != "invalid_registry":
            tables.write_report(spark, out, s.path("reports"))
        return out
    if a.command == "normalize":
        payloads, meta = ingest.normalize(ours(raw()), chosen)
        small = [r["message"] for r in refresh.problems_of(chosen, payloads, meta).where("message like '%looks too small%'").orderBy("message").collect()]
        if small:
            return {"status": "failed", "errors": small}
        tables.write_payloads(ingest.ordered(payloads), s.path("normalized"))
        tables.write_meta(tables.warnings_by_source(meta), s.path("meta"))
        return {"status": "ok", "sources": ids(chosen)}
    payloads = ours(tables.read_payloads(spark, s.path("normalized")))
    if a.command == "validate":
        errors = registry_errors()
        no_meta = spark.createDataFrame([], "source_id string, url string, suspicious boolean")
        # Written payloads have lost their items' places: the order within one citation and index is open.
        errors += [r["message"] for r in refresh.problems_of(chosen, payloads.withColumn("item_pos", F.lit(0)), no_meta).orderBy("message").collect()]
        return {"status": "failed" if errors else "ok", "errors": errors}
    if a.command == "diff":
        stores = stores_of(spark, s)
        records, state = stores.records(), ours(stores.read_state())
        now = R.bucketed(refresh.record_hashes(payloads.withColumn("item_pos", F.lit(0)), "item_pos"))
        found = refresh.diff_states(records.hashes(state), now, records.digests(state), R.digests(now))
        results = [r.asDict() for r in found.status(s.max_changed_records, s.max_deleted_records).orderBy("source_id").collect()]
        path, keys = s.path("reports/latest-diff.json"), s.path("reports/latest-diff-keys")
        versions.write_json(spark, path, {"results": results})
        tables.write_jsonl(refresh.diff_report(found.changes), keys)
        return {"status": "ok", "report_path": path, "keys_path": keys, "results": results}
    if chosen.isEmpty():
        return {"status": "failed", "errors": [f"source not found: {a.source}"]}
    missing = [r["message"] for r in refresh.without_shards(chosen, a.env).collect()]
    if missing:
        return {"status": "failed", "errors": missing}
    told = {"source_id": a.source, "environment": a.env, "status": "ok"}
    if a.dry_run:
        return told
    stores = stores_of(spark, s)
    number, head = stores.log().last(), stores.log().read()
    at = dict(head.get(a.env) or {"catalog": None, "memory": None})
    if a.command == "apply-catalog":
        at["catalog"] = stores.catalog(a.env).upsert(catalog.checked(refresh.catalog_rows(chosen, a.env)), at["catalog"])
        stores.log().write(head | {a.env: at}, number)
        return told
    embed = embedder(s.embedding_endpoint, a.vector, s.embedding_timeout)
    if a.command == "apply-memory":
        store, new = stores.store(a.env), uuid.uuid4().hex
        failed = store.add(refresh.records_for(payloads, chosen, a.env, embed), new)
        if failed:
            return told | {"status": "failed", "errors": [f"{i}: {e}" for i, e in failed]}
        at["memory"] = store.switch(dict.fromkeys(ids(chosen), new), at["memory"])
        stores.log().write(head | {a.env: at}, number)
        return told
    failures = list(refresh.smoke(chosen, *stores.published(a.env, head), embed).first()["failures"])
    return told | {"status": "failed" if failures else "ok", "failures": failures}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    out = run(SparkSession.builder.appName("slateflow-ops").getOrCreate(), a)
    ok = out["status"] == "ok"
    print(json.dumps(out, indent=2), file=sys.stderr if a.command == "refresh" and not ok else sys.stdout)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
