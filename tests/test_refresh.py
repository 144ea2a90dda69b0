"""The refresh cycle when things fail: sources apart from each other, commits, rollback by the state's pointer, state as rows."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from slateflow import schemas
from slateflow.operators import memory, record_state, refresh
from slateflow.sources import tables, versions


@pytest.fixture(autouse=True)
def few_partitions(spark, request):
    """Cycles over a few rows need one partition; that saves most of their time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", before if "million" in request.node.name else "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def entry(name, **kw):
    docs = {"title": f"Docs {name}", "aliases": [name], "domain": "code_docs", "trust": "official", "skill_kind": None, "targets": [], "capabilities": [], "supported_versions": ["1"], "citations": [], "retrieved_at": "x"}
    out = {
        "source_id": f"/{name}", "kind": "docs", "enabled": True, "public_urls": [{"label": "a", "url": f"https://{name}.dev/"}], "discovery_urls": [], "normalization_profile": "p", "catalog_metadata": docs,
        "memory_targets": {"staging_shard_ids": [f"s{name}"], "prod_shard_ids": [f"p{name}"]}, "cadence": "daily", "version_strategy": "v",
        "extraction_hints": {"content_roots": ["article"], "drop_selectors": [], "chunk_target_chars": 900}, "smoke_queries": {"resolve": name, "query": "hooks", "pack": name},
    }
    return out | kw


def registry(spark, *entries):
    return spark.createDataFrame(list(entries), schemas.REGISTRY)


def raw(spark, **texts):
    item = lambda n, t: {"url": f"https://{n}.dev/", "final_url": f"https://{n}.dev/", "content_type": "text/html", "status_code": 200, "etag": None, "last_modified": None, "body": f"<article><p>{t}</p></article>", "sha256": "", "label": "a", "role": "public_urls"}
    return spark.createDataFrame([{"source_id": f"/{n}", "collected_at": "2026-01-01T00:00:00Z", "items": [item(n, t)]} for n, t in texts.items()], schemas.RAW)


def stores_at(spark, tmp_path):
    place = lambda n: str(tmp_path / n)
    return refresh.Stores(memory.TableStore(spark, place("sm")), memory.TableStore(spark, place("pm")), place("sc"), place("pc"), place("state"), place("snap"))


def embed(rows):
    """A vector for each text, but for `poison` an error as a value, and for `bomb` an exception that ends the job."""
    bad = F.contains("text", F.lit("poison"))
    vector = F.array(F.when(F.contains("text", F.lit("bomb")), F.raise_error(F.lit("a bomb went off")).cast("float")).otherwise(F.lit(1.0).cast("float")), F.lit(0.5).cast("float"))
    return rows.withColumn("embedding", F.when(~bad, vector)).withColumn("error", F.when(bad, "no vector for poison"))


def contents(stores, env="prod"):
    sources, records = stores.published(env)
    return {r["source_id"]: r["title"] for r in sources.collect()}, sorted(json.loads(r["payload"])["content"] for r in records.collect())


def statuses(report):
    return {x["source_id"]: x["status"] for x in report.sources}


def test_one_source_fails_and_the_others_go_on(spark, tmp_path):
    stores = stores_at(spark, tmp_path)
    reg = registry(spark, entry("a"), entry("b"), entry("c"), entry("d"), entry("e", catalog_metadata=entry("e")["catalog_metadata"] | {"aliases": ["e", "e"]}))
    got = refresh.run_refresh(spark, reg, raw(spark, a="About hooks", b="poison", c="More hooks", d="a bomb", e="hooks here"), stores, embed)
    assert statuses(got) == {"/a": "applied", "/b": "failed", "/c": "applied", "/d": "failed", "/e": "failed"} and got.status == "partial"
    why = {x["source_id"]: x.get("failures", {}).get("staging") for x in got.sources}
    assert why["/b"] == ["memory: no vector for poison"] and "a bomb went off" in why["/d"][0] and why["/e"][0].startswith("catalog: /e: repeated value")
    assert contents(stores) == ({"/a": "Docs a", "/c": "Docs c"}, ["About hooks", "More hooks"])
    assert {r["source_id"] for r in stores.read_state().collect()} == {"/a", "/c"}
    # A source that was fine stays as it was when it fails later.
    again = refresh.run_refresh(spark, registry(spark, entry("a"), entry("c")), raw(spark, a="poison", c="Other hooks"), stores, embed)
    assert statuses(again) == {"/a": "failed", "/c": "applied"}
    assert contents(stores)[1] == ["About hooks", "Other hooks"]


def test_isolation_runs_few_jobs_more():
    runs, failed = [], {}

    def job(ids):
        runs.append(len(ids))
        if "x37" in ids:
            raise ValueError("no\nmore")
        return ids

    ids = [f"x{i}" for i in range(128)]
    assert refresh.isolated(ids, job, failed) == [i for i in ids if i != "x37"]
    assert failed == {"x37": "no"} and len(runs) == 1 + 2 * 7
    assert refresh.isolated([], job, failed) == []


class Crash(BaseException):
    """The end of the process: nothing catches it."""


def test_a_crash_between_any_two_writes_leaves_the_commit_before(spark, tmp_path, monkeypatch):
    stores, reg = stores_at(spark, tmp_path), registry(spark, entry("a"))
    new = registry(spark, entry("a", catalog_metadata=entry("a")["catalog_metadata"] | {"title": "New"}))
    assert refresh.run_refresh(spark, reg, raw(spark, a="Old hooks"), stores, embed).status == "ok"
    state, left, tables_ = stores.read_state().collect(), [], []
    for name, df in zip(("payloads", "meta"), refresh.ingest.normalize(raw(spark, a="New hooks"), new)):
        df.write.parquet(f"{tmp_path}/normal/{name}")
        tables_.append(spark.read.schema(df.schema).parquet(f"{tmp_path}/normal/{name}"))

    def counted(f):
        def run(*args, **kw):
            if left:
                left[0] -= 1
                if left[0] < 0:
                    raise Crash
            return f(*args, **kw)

        return run

    monkeypatch.setattr(refresh.ingest, "normalize", lambda *args: tuple(tables_))
    # What is known of the sources before anything is published, and the smoke queries, are the same each time.
    known, assess = [], refresh.assess
    monkeypatch.setattr(refresh, "assess", lambda *args: known[0] if known else known.append(assess(*args)) or known[0])
    monkeypatch.setattr(refresh, "smoke", lambda entries, *rest: entries.select("source_id", F.array().cast("array<string>").alias("failures")))
    for where, name in ((memory.TableStore, "add"), (memory.TableStore, "switch"), (versions.BucketTable, "upsert"), (refresh, "write_version"), (versions.Commits, "write")):
        monkeypatch.setattr(where, name, counted(getattr(where, name)))
    left.append(0)
    crashes, points = 0, [0, 2, 4, 6, 8, 9]  # of ten writes: the first, the last, and after each of the others' kinds
    while True:
        left[0] = points[crashes] if crashes < len(points) else 1000
        try:
            got = refresh.run_refresh(spark, new, raw(spark, a="New hooks"), stores, embed)
            break
        except Crash:
            crashes += 1
            assert contents(stores) == ({"/a": "Docs a"}, ["Old hooks"]) and stores.read_state().collect() == state
    assert crashes == len(points) and statuses(got) == {"/a": "applied"} and contents(stores) == ({"/a": "New"}, ["New hooks"])
    left.clear()
    runs = lambda: len(versions.names(spark, f"{tmp_path}/pm/records"))
    assert runs() > 2
    stores.vacuum(keep=1)
    assert runs() == 1 and len(versions.names(spark, stores.snapshots)) == 1 and contents(stores) == ({"/a": "New"}, ["New hooks"])


def test_rollback_takes_the_snapshot_that_the_state_names(spark, tmp_path, monkeypatch):
    stores, reg = stores_at(spark, tmp_path), registry(spark, entry("a"))
    refresh.run_refresh(spark, reg, raw(spark, a="Old hooks"), stores, embed)
    # A later cycle that died before its commit has left a snapshot.
    stray = stores.snapshot(stores.read_state().first()["success_snapshot"]).withColumn("content", F.lit("stray"))
    stray.write.parquet(f"{stores.snapshots}/snapshot=9999-01-01T00-00-00Z")
    real, calls = refresh.smoke, []

    def smoke(entries, *rest):
        calls.append(1)
        out = real(entries, *rest)
        return out.withColumn("failures", F.array(F.lit("query"))) if len(calls) == 2 else out  # that of production

    monkeypatch.setattr(refresh, "smoke", smoke)
    got = refresh.run_refresh(spark, reg, raw(spark, a="New hooks"), stores, embed)
    assert statuses(got) == {"/a": "rolled_back"} and contents(stores)[1] == ["Old hooks"]
    rows = spark.createDataFrame([("/a", "1", "old"), ("/a", "2", "new"), ("/b", "1", "b")], "source_id string, snapshot string, record string")
    state = spark.createDataFrame([("/a", "1"), ("/b", None)], "source_id string, success_snapshot string")
    assert [r["record"] for r in refresh.last_success(rows, rows, state).collect()] == ["old"]


def test_two_writers_of_one_commit(spark, tmp_path):
    log = versions.Commits(spark, str(tmp_path / "log"))
    assert log.last() == -1 and log.read() == {}
    assert log.write({"state": 1}, -1) == 0
    with pytest.raises(FileExistsError):
        log.write({"state": 2}, -1)
    assert log.read() == {"state": 1} and versions.names(spark, log.path) == ["v=0.json"]


def test_an_update_writes_the_buckets_that_it_touches(spark, tmp_path):
    table = versions.BucketTable(spark, str(tmp_path / "t"), spark.range(0).selectExpr("cast(id as string) as k", "id as v").schema, "k", 16)
    rows = lambda lo, hi, add=0: spark.range(lo, hi).selectExpr("cast(id as string) as k", f"id + {add} as v")
    assert table.read().count() == 0
    first = table.replace(rows(0, 2000))
    files = lambda: {str(f) for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    second = table.upsert(rows(5, 6, 100).unionByName(rows(5000, 5001)))
    assert 1 <= len(files() - before) <= 2 and len(before) == 16
    assert {r["k"]: r["v"] for r in table.read().collect()} == {str(i): i for i in range(2000)} | {"5": 105, "5000": 5000}
    assert table.read(first).count() == 2000 and table.versions() == [first, second]
    assert table.read(table.upsert(rows(7, 8, 1), first)).count() == 2000  # from a version that is named
    table.vacuum({second})
    assert table.versions() == [second] and table.read().count() == 2001 and len(files()) == 16


# ---------------------------------------------------------------- state as rows


def hashes(spark, n, change=lambda i: F.lit("h")):
    i = F.col("id")
    return record_state.bucketed(spark.range(n).select(F.when(i % 10 == 0, "/small").otherwise("/large").alias("source_id"), F.concat(F.lit("k"), i.cast("string")).alias("record_key"), F.sha2(change(i).cast("string"), 256).alias("hash")))


def test_equal_buckets_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(record_state, "WHOLE_RECORDS", 2000)
    old = hashes(spark, 5000)
    new = hashes(spark, 5030, lambda i: F.when(i.isin(7, 11, 20), "changed").otherwise("h")).where("record_key not in ('k13', 'k40')")
    d_old, d_new = record_state.digests(old), record_state.digests(new)
    got = refresh.diff_states(old, new, d_old, d_new)
    want = refresh.diff_records(old, new).where("change <> 'same'")
    assert sorted(map(tuple, got.changes.where("change <> 'same'").collect())) == sorted(map(tuple, want.collect())) and want.count() == 35
    assert got.changes.where("source_id = '/large'").count() < 40  # of 4,527: those of buckets that differ
    by_all = refresh.diff_status(refresh.diff_records(old, new), 3, 2)
    assert sorted(map(tuple, got.status(3, 2).collect())) == sorted(map(tuple, by_all.collect()))
    same = refresh.diff_states(old, old, d_old, d_old)
    assert same.changes.count() == 0 and {r["status"] for r in same.status().collect()} == {"noop"}
    none, no_digests = old.limit(0), d_old.limit(0)
    assert {r["status"] for r in refresh.diff_states(none, new, no_digests, d_new).status().collect()} == {"new"}
    assert {r["status"] for r in refresh.diff_states(old, none, d_old, no_digests).status().collect()} == {"deleted"}


def test_ten_million_records_of_one_source(spark):
    """Digests and differences of one large source; no row of the result or of a shuffle holds more than one record or bucket."""
    n = 10_000_000
    rows = lambda changed: spark.range(n).select(F.lit("/s").alias("source_id"), F.conv(F.pmod(F.xxhash64("id"), F.lit(65_536)), 10, 16).alias("bucket"), F.col("id").cast("string").alias("record_key"), F.when(F.col("id") % 2_000_003 == changed, "new").otherwise("old").alias("hash"))
    old, new = rows(-1), rows(5)
    d_old, d_new = record_state.digests(old).persist(), record_state.digests(new).persist()
    got = refresh.diff_states(old, new, d_old, d_new)
    assert d_old.count() == 65_537 and {r["change"] for r in got.changes.collect()} == {"changed", "same"}
    told = got.status().first()
    assert (told["changed_records"], told["added_records"], told["removed_records"], told["status"]) == (5, 0, 0, "updated")
    assert got.changes.count() < 5000
    d_old.unpersist(), d_new.unpersist()


# ---------------------------------------------------------------- collections


class Pages(BaseHTTPRequestHandler):
    asked = []

    def do_GET(self):
        self.asked.append((self.path, self.headers.get("If-None-Match"), self.headers.get("If-Modified-Since")))
        if self.path == "/broken":
            self.send_error(500)
        elif self.headers.get("If-None-Match") == '"1"':
            self.send_response(304)
            self.end_headers()
        else:
            body = b"\xff" if self.path == "/bytes" else f"<p>{self.path}</p>".encode()
            self.send_response(200)
            for k, v in (("Content-Type", "text/html"), ("ETag", '"1"'), ("Last-Modified", "Thu, 01 Jan 2026 00:00:00 GMT"), ("Content-Length", str(len(body)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_conditional_requests_and_errors_as_rows(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "f.txt").write_text("from a file")
    link = lambda *urls: [{"label": "x", "url": u} for u in urls]
    reg = registry(spark, entry("good", public_urls=link(f"{base}/one", f"file://{tmp_path}/f.txt"), discovery_urls=link(f"{base}/two")), entry("bad", public_urls=link(f"{base}/ok", f"{base}/broken", "no url at all")), entry("odd", public_urls=link(f"{base}/bytes", f"file://{tmp_path}/none")), entry("bare", public_urls=[]))
    got, failed = tables.collect(spark, reg, "2026-01-01T00:00:00Z")
    first = {r["source_id"]: [(i["url"].rsplit("/", 1)[1], i["body"]) for i in r["items"]] for r in got.collect()}
    assert first == {"/good": [("two", "<p>/two</p>"), ("f.txt", "from a file"), ("one", "<p>/one</p>")], "/bare": []}
    errors = {(r["source_id"], r["url"].rsplit("/", 1)[-1]): r["error"] for r in failed.collect()}
    assert set(errors) == {("/bad", "broken"), ("/bad", "no url at all"), ("/odd", "bytes"), ("/odd", "none")} and errors["/bad", "broken"] == "HTTP 500" and all(errors.values())
    tables.write_raw(got, f"{tmp_path}/raw")
    Pages.asked.clear()
    before = tables.read_latest_raw(spark, f"{tmp_path}/raw")
    later, _ = tables.collect(spark, reg, "2026-01-02T00:00:00Z", previous=before)
    rows = {r["source_id"]: r for r in later.collect()}
    server.shutdown()
    assert {a for a in Pages.asked if a[0] in ("/one", "/two")} == {(p, '"1"', "Thu, 01 Jan 2026 00:00:00 GMT") for p in ("/one", "/two")}
    assert [(i["body"], i["status_code"], i["content_type"], i["etag"]) for i in rows["/good"]["items"] if i["etag"]] == [("<p>/two</p>", 200, "text/html", '"1"'), ("<p>/one</p>", 200, "text/html", '"1"')]
    assert [i["sha256"] for i in rows["/good"]["items"]] == [i["sha256"] for i in before.where("source_id = '/good'").first()["items"]]


def test_the_newest_collection_is_read_from_folder_names(spark, tmp_path):
    assert tables.read_latest_raw(spark, f"{tmp_path}/raw").count() == 0
    for day, texts in (("01", {"a": "old", "b/x%": "only"}), ("02", {"a": "new"})):
        tables.write_raw(raw(spark, **texts).withColumn("collected_at", F.lit(f"2026-01-{day}T00:00:00Z")), f"{tmp_path}/raw")
    newest = tables.read_latest_raw(spark, f"{tmp_path}/raw")
    assert {r["source_id"]: (r["collected_at"][8:10], r["items"][0]["body"]) for r in newest.collect()} == {"/a": ("02", "<article><p>new</p></article>"), "/b/x%": ("01", "<article><p>only</p></article>")}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(newest.inputFiles()) == 2
