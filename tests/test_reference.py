"""The reference's pinned behaviours on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateflow import schemas
from slateflow.functions import text as X
from slateflow.operators import catalog, ingest, memory, pack, refresh, resolve
from slateflow.plans import bindings as B
from slateflow.sources import tables, versions


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string'}" for k in values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("query", "base", "reranked"), [
    ("next middleware", [("/vercel/next.js", 1.0)], None),
    ("next migration", [("/vercel/next.js", 0.5)], [("/skills/nextjs/migration", 3.95), ("/vercel/next.js", 0.5)]),
    ("next migration auth changes", [("/supabase/docs", 0.5), ("/vercel/next.js", 0.5)], [("/skills/nextjs/migration", 2.45), ("/supabase/docs", 0.5), ("/vercel/next.js", 0.5)]),
    ("protect route in next.js with supabase auth", [("/supabase/docs", 1.0), ("/vercel/next.js", 1.0)], None),
    ("next", [("/vercel/next.js", 3.0)], [("/vercel/next.js", 3.0), ("/skills/nextjs/migration", 2.0)]),
    ("upgrade", [], [("/skills/nextjs/migration", 1.45)]),
    ("Next.js Docs", [("/vercel/next.js", 1.7)], None),
    ("/vercel/next.js", [("/vercel/next.js", 1.8)], None),
    ("", [("/vercel/next.js", 4.0), ("/react/docs", 2.0), ("/supabase/docs", 2.0)], None),
    ("zzz", [], None),
])
def test_resolve_examples(spark, query, base, reranked):
    q = spark.createDataFrame([(0, query)], "query_id int, query string")
    got = [(r["source_id"], round(r["score"], 4)) for r in resolve.resolve(q, tables.seed_catalog(spark)).orderBy("rank").collect()]
    assert got == base
    if reranked:
        got = [(r["source_id"], round(r["score"], 4)) for r in resolve.resolve(q, tables.seed_catalog(spark), include_skills=True).orderBy("rank").collect()]
        assert got == reranked


@pytest.mark.parametrize(("small", "chars"), [(4096, 4_000_000), (0, 4_000_000), (0, 60)])
def test_resolve_by_automata_is_resolve_by_all_pairs(spark, monkeypatch, small, chars):
    import random

    from slateflow.functions import text as X

    monkeypatch.setattr(resolve, "SMALL_CATALOG", small)
    monkeypatch.setattr(resolve, "AUTOMATON_CHARS", chars)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc9./ -É") for _ in range(rng.randrange(0, 6)))
    rows = [dict(tables.SEED[0], source_id=f"/{word()}/{i}", title=word(), aliases=sorted({word() for _ in range(rng.randrange(0, 4))})) for i in range(150)]
    src = tables.sources_from(spark, rows)
    texts = [" ".join(word() for _ in range(rng.randrange(0, 5))) for _ in range(120)] + ["", "...", "a", "  ", rows[3]["source_id"], rows[4]["title"]]
    q = spark.createDataFrame([*enumerate(texts), (999, None)], "query_id int, query string")
    n = X.normalize_catalog
    both = q.crossJoin(src).withColumn("q", n(F.col("query"))).withColumn("toks", X.tokens(F.col("q")))
    has = lambda c, x: F.when(F.contains("q", n(F.col(c))), F.lit(x)).otherwise(F.lit(0.0)).cast("float")
    points = F.aggregate(F.transform("aliases", lambda a: X.alias_points(n(a), F.col("q"), F.col("toks"))), F.lit(0.0).cast("float"), lambda s, p: s + p)
    want = both.withColumn("score", points + has("title", 0.7) + has("source_id", 0.8)).where("score > 0")
    got = resolve.score_sources(q, src).collect()
    assert sorted((r["query_id"], r["source_id"], r["score"]) for r in got) == sorted((r["query_id"], r["source_id"], r["score"]) for r in want.collect()) and len(got) > 2000
    assert all(r["reasons"] for r in got)


def test_reasons_intent_entities(spark):
    q = spark.createDataFrame([(0, "next middleware"), (1, "stripe plan"), (2, "hello")], "query_id int, query string")
    r = resolve.resolve(q, tables.seed_catalog(spark)).where("query_id = 0").first()
    assert r["reasons"] == ["partially matched alias `middleware`", "partially matched alias `next`"]
    d = {r["query_id"]: (r["intent"], r["entities"]) for r in resolve.describe(q).collect()}
    assert d == {0: ("Code", ["middleware"]), 1: ("Travel", []), 2: ("General", [])}


def test_list_and_filter(spark):
    c = tables.seed_catalog(spark)
    assert catalog.list_sources(c).count() == 3 and catalog.list_sources(c, True).count() == 4
    f = catalog.SourceFilters
    assert [r["source_id"] for r in catalog.filter_sources(c, f("code_docs", "official", "15")).collect()] == ["/vercel/next.js"]
    assert catalog.filter_sources(c, f(domain="skill_knowledge")).count() == 1
    assert catalog.filter_sources(c, f(limit=0)).count() == 0
    assert [r["source_id"] for r in catalog.filter_sources(c, f(limit=2)).collect()] == ["/react/docs"]  # the skill took a place
    assert catalog.get_source(c, "/none").count() == 0


def test_writes(spark):
    c = tables.seed_catalog(spark)
    bad = tables.sources_from(spark, [dict(tables.SEED[0], aliases=["a", "a"])])
    with pytest.raises(catalog.DuplicateValues, match="/vercel/next.js: repeated value in `aliases`"):
        catalog.upsert(c, bad)
    up = catalog.upsert(c, tables.sources_from(spark, [dict(tables.SEED[0], title="T", aliases=["z", "b"])]))
    r = catalog.get_source(up, "/vercel/next.js").first()
    assert (r["title"], r["aliases"], up.count()) == ("T", ["b", "z"], 4)
    rows = tables.sources_from(spark, [dict(tables.SEED[0], title=t) for t in "ab"]).withColumn("position", F.when(F.col("title") == "a", 0).otherwise(1))
    assert [r["title"] for r in catalog.replace(rows, "position").collect()] == ["b"]
    seeded = tables.seed_catalog(spark, partial=True).where("source_id = '/skills/nextjs/migration'").first()
    assert seeded["skill_kind"] is None and seeded["targets"] == []


def records(spark, rows):
    return spark.createDataFrame(rows, schemas.MEMORY)


def source(spark, **kw):
    return dict(tables.SEED[0], **kw)


def test_search_in_blocks_is_search_by_pairs(spark, monkeypatch):
    """Ties, equal vectors, versions, odd lengths, nulls, NaN and infinite components, several blocks of queries and lanes; and the limit is in the plan."""
    import random

    monkeypatch.setattr(memory, "HELD", 3)
    rng = random.Random(6)
    some = [[rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(6)] for _ in range(20)] + [[float("nan")] * 6, [float("inf"), 1.0, 0.0, 0.0, 0.0, 0.0], [1.0] * 5, []]
    s = tables.sources_from(spark, [source(spark, source_id=f"/{i}", shard_ids=sorted({str(i), str(i // 2), "all"})) for i in range(4)])
    m = records(spark, [(rng.choice(["0", "1", "2", "all"]), k, rng.choice([*some, None]), json.dumps({"text": f"t{k}", "version": rng.choice(["1", "2", 3])})) for k in range(300)])
    ask = spark.createDataFrame([(f"q{k}", f"/{k % 4}", rng.choice([*some, None]), rng.choice([None, None, "1"]), rng.choice([0, 1, 3, 200]), k) for k in range(24)], "query_id string, source_id string, vector array<float>, version string, top_k int, src_rank int")
    got = [sorted(map(str, memory.search(ask, s, m, blocks=b)[0].collect())) for b in (False, True)]
    assert len(got[0]) > 500 and [x for x in zip(*got) if x[0] != x[1]][:1] == [] and len(got[0]) == len(got[1])
    plan = memory.search(ask, s, m)[0]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    with pytest.raises(Exception, match="top_k is 2 at most"):
        memory.search(ask, s, m, most=2)[0].collect()


@pytest.mark.parametrize("blocks", [False, True])
def test_query_ranks_filters_and_fails(spark, blocks):
    s = tables.sources_from(spark, [source(spark, shard_ids=["b", "a"]), source(spark, source_id="/none", shard_ids=[]), source(spark, source_id="/bad", shard_ids=["x"])])
    m = records(spark, [
        ("a", 0, [1.0, 0.0], json.dumps({"snippet": "one", "title": "T", "citation": "c", "version": "15"})), ("a", 1, [0.5, 0.0], "plain"), ("b", 0, [1.0, 0.0], json.dumps({"text": "two", "url": "u", "version": 3})),
    ])
    ask = spark.createDataFrame([(0, "/vercel/next.js", [1.0, 0.0], None, 5, 1), (1, "/vercel/next.js", [1.0, 0.0], "15", 0, 1), (2, "/none", [1.0, 0.0], None, 5, 1), (3, "/bad", [1.0, 0.0], None, 5, 1)], "query_id int, source_id string, vector array<float>, version string, top_k int, src_rank int")
    err = spark.createDataFrame([("x", "boom")], "shard_id string, error string")
    snippets, outcomes = memory.search(ask, s, m, errors=err, blocks=blocks)
    rows = [(r["query_id"], r["hit_rank"], r["title"], r["snippet"], r["citation"], r["version"]) for r in snippets.orderBy("query_id", "hit_rank").collect()]
    assert rows == [
        (0, 1, "T", "one", "c", "15"), (0, 2, "two", "two", "u", None), (0, 3, "plain", "plain", "memory:///vercel/next.js", None), (1, 1, "T", "one", "c", "15"),
    ]
    assert {r["query_id"]: r["outcome"] for r in outcomes.collect()} == {0: "ok", 1: "ok", 2: "error", 3: "error"}
    gone = memory.search(ask, s.where("source_id <> '/bad'"), m, errors=err)[1]
    assert {r["query_id"]: r["outcome"] for r in gone.collect()}[3] == "missing"
    said = {r["query_id"]: r["message"] for r in pack.warnings_of(gone).collect()}
    assert said == {2: "Failed to query source canisters for /none", 3: "Failed to load source metadata for /bad"}


def test_pack_budget_dedup_summary_cite(spark, tmp_path):
    s = tables.sources_from(spark, [source(spark, shard_ids=["a"]), source(spark, source_id="/e", title="next e", aliases=["next"], shard_ids=["e"])])
    j = lambda t, n: json.dumps({"title": t, "snippet": "x" * n, "citation": "c" + t})
    m = records(spark, [("a", 0, [1.0], j("A", 21)), ("a", 1, [0.9], j("A", 21)), ("a", 2, [0.8], j("B", 17)), ("a", 3, [0.7], j("never", 1))])
    ask = lambda t: spark.createDataFrame([(0, t, [1.0])], "query_id int, query string, vector array<float>")
    p = pack.pack_one(ask("next"), s, m, max_tokens=3000)
    assert [e["title"] for e in p["evidence"]] == ["A", "B"]  # the repeat used one of the three places
    assert p["warnings"] == [{"kind": "empty_source", "message": "No snippets matched for /e"}]
    assert p["pack_summary"] == "Top evidence came from: A, B"
    small = pack.pack_one(ask("next"), s, m, max_tokens=4)
    assert small["evidence"] == [] and small["pack_summary"] == "No evidence found for the query."
    skip = pack.pack_one(ask("next"), s, m, max_tokens=5)
    assert [e["title"] for e in skip["evidence"]] == ["B"]  # A costs 6
    with pytest.raises(pack.NoSources):
        pack.pack_one(ask("zzz"), s, m)
    text = json.dumps(p)
    f = tmp_path / "pack.json"
    f.write_text(text)
    for given in (text, str(f)):
        got = pack.cite_json(spark, given).orderBy("position").collect()
        assert [r["citation"] for r in got] == ["cA", "cB"] and "snippet" not in got[0].asDict()
    with pytest.raises(ValueError, match="failed to parse"):
        pack.cite_json(spark, "{")


def test_greedy_budget_skips_and_goes_on(spark):
    rows = [(0, 1, i + 1, "/s", "t", "x" * (4 * c - 2), "c", "o", "r", None, False, 1.0 - i / 10) for i, c in enumerate((6, 5, 4))]
    df = spark.createDataFrame(rows, "query_id int, src_rank int, hit_rank int, source_id string, title string, snippet string, citation string, trust string, retrieved_at string, version string, stale boolean, score float")
    assert [r["cost"] for r in pack.trim(df, 10).orderBy("position").collect()] == [6, 4]


@pytest.mark.parametrize(("page", "drops", "want"), [
    ("<title>Next.js Middleware</title><body>Use middleware.", None, [("", "", "Use middleware.")]),
    ("<article><h1 id=m>Mid</h1><p>A. B.</p></article>", None, [("m", "Mid", "A. B.")]),
    ("<main><p>Hello</p></main>", None, [("", "p", "Hello")]),
    ("<main><h2>S</h2><p>Use <code>x</code> now</p></main>", None, [("", "S", "Use"), ("", "S", "x"), ("", "S", "now")]),
    ("<div>promo</div><main><p>Hi</p></main><div>after</div>", None, [("", "", "promo"), ("", "p", "Hi")]),
    ("<div class=ad>x</div><p>lost</p><footer>f</footer><p>kept</p>", [".ad"], [("", "p", "kept")]),
    ("<p>a &lt;div&gt; b</p>", None, [("", "p", "a b")]),
    ("<h1>A</h1><svg><title>icon</title></svg><p>b</p>", None, [("", "p", "b")]),
])
def test_sections(page, drops, want):
    s = ingest.read_sections(page, ingest.CONTENT_ROOTS, drops or ingest.DROP_SELECTORS)
    assert s.sections == want


def test_class_roots_never_close():
    assert [x[2] for x in ingest.read_sections("<div class=c><p>in</p></div><p>out</p>", [".c"], []).sections] == ["in", "out"]


def test_split_paragraph(spark):
    df = spark.createDataFrame([("One two. Three! Four? " + "x" * 30 + ". End.",)], "t string")
    assert df.select(ingest.split_paragraph(F.col("t"), 16).alias("c")).first()["c"] == ["One two. Three!", "Four?", "x" * 30 + ".", "End."]


def registry(spark, **kw):
    entry = {
        "source_id": "/react/docs", "kind": "docs", "enabled": True, "public_urls": [], "discovery_urls": [], "normalization_profile": "p",
        "catalog_metadata": {"title": "React Docs", "aliases": ["react", "hooks"], "domain": "code_docs", "trust": "official", "skill_kind": None, "targets": [], "capabilities": [], "supported_versions": ["19"], "citations": ["https://react.dev"], "retrieved_at": "x"},
        "memory_targets": {"staging_shard_ids": ["s"], "prod_shard_ids": ["p"]}, "cadence": "daily", "version_strategy": "v",
        "extraction_hints": {"content_roots": ["main", "article"], "drop_selectors": ["nav"], "chunk_target_chars": 900}, "smoke_queries": {"resolve": "react", "query": "hooks", "pack": "react"},
    } | kw
    return spark.createDataFrame([entry], schemas.REGISTRY)


def raw(spark, body, at="2026-01-01T00:00:00Z", kind="text/html", role="public_urls"):
    item = {"url": "https://react.dev/a", "final_url": "https://react.dev/a", "content_type": kind, "status_code": 200, "etag": None, "last_modified": None, "body": body, "sha256": "", "label": "a", "role": role}
    return spark.createDataFrame([{"source_id": "/react/docs", "collected_at": at, "items": [item]}], schemas.RAW)


def test_normalize(spark):
    body = "<article><h1 id='h'>Head</h1><p>" + " ".join(f"Sentence number {i}." for i in range(250)) + "</p></article>"
    p, meta = ingest.normalize(raw(spark, body), registry(spark))
    rows = ingest.ordered(p).collect()
    assert len(rows) > 1 and rows[0]["citation"] == "https://react.dev/a#h" and rows[0]["title"] == "Head (1)" and rows[0]["tags"] == ["react", "hooks"]
    assert all(len(r["content"]) <= 900 and r["version"] == "19" for r in rows)
    assert meta.first()["warnings"] == []
    assert ingest.normalize(raw(spark, body, role="discovery_urls"), registry(spark))[0].count() == 0
    bad = ingest.normalize(raw(spark, "<script>" + "x" * 100 + "</script>" + " " * 3000 + "<p>a</p>"), registry(spark))[1].first()
    assert bad["suspicious"] and bad["warnings"] == ["content_roots_unmatched"]
    plain = ingest.normalize(raw(spark, "words", kind="text/plain"), registry(spark))[1].first()
    assert "non_html_content_type" in plain["warnings"]


def test_refresh_cycle(spark, tmp_path):
    place = lambda n: str(tmp_path / n)
    stores = refresh.Stores(memory.TableStore(spark, place("sm")), memory.TableStore(spark, place("pm")), place("sc"), place("pc"), place("state"), place("snap"))
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(0.5).cast("float")))
    page = "<article><p>About hooks and react.</p></article>"
    reg = registry(spark)
    dry = refresh.run_refresh(spark, reg, raw(spark, page), stores, embed, dry_run=True)
    assert [x["status"] for x in dry.sources] == ["dry_run"] and dry.status == "ok"
    first = refresh.run_refresh(spark, reg, raw(spark, page), stores, embed)
    assert [x["status"] for x in first.sources] == ["applied"] and stores.published("prod")[1].count() == 1
    again = refresh.run_refresh(spark, reg, raw(spark, page), stores, embed)
    assert [x["status"] for x in again.sources] == ["noop"]
    kept = stores.read_state().first()
    assert kept["success_snapshot"] is not None and kept["status"] == "noop"
    later = refresh.run_refresh(spark, reg, raw(spark, page.replace("About", "Now about")), stores, embed)
    assert [x["status"] for x in later.sources] == ["applied"]
    warned = refresh.run_refresh(spark, reg, raw(spark, "<p>About hooks and react, again.</p>"), stores, embed)
    assert [x["status"] for x in warned.sources] == ["needs_review"] and warned.status == "partial"
    twice = reg.unionByName(reg)
    assert refresh.run_refresh(spark, twice, raw(spark, page), stores, embed).status == "invalid_registry"


class Lossy(memory.TableStore):
    """A store that shows nothing for its first reads."""

    def __init__(self, spark, path, blind):
        super().__init__(spark, path)
        self.blind = [blind]  # shared by all views of the store

    def read(self):
        self.blind[0] -= 1
        return super().read().limit(0) if self.blind[0] >= 0 else super().read()


def stores_at(spark, tmp_path, blind=0):
    place = lambda n: str(tmp_path / n)
    return refresh.Stores(memory.TableStore(spark, place("sm")), Lossy(spark, place("pm"), blind), place("sc"), place("pc"), place("state"), place("snap"))


def same_vector(df):
    return df.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(0.5).cast("float")))


PAGE = "<article><p>About hooks and react.</p></article>"


def test_refresh_of_an_empty_collection(spark, tmp_path):
    stores, reg = stores_at(spark, tmp_path), registry(spark)
    one_more = reg.withColumn("source_id", F.lit("/other"))
    empty = raw(spark, PAGE).withColumn("items", F.slice("items", 1, 0))
    first = refresh.run_refresh(spark, reg, empty, stores, same_vector)
    assert first.sources == [{"source_id": "/react/docs", "status": "failed", "errors": ["/react/docs: payload collection is empty"]}] and first.status == "partial"
    both = raw(spark, PAGE).unionByName(raw(spark, PAGE).withColumn("source_id", F.lit("/other")))
    smoke_of = lambda x: x.withColumn("smoke_queries", F.struct(F.lit("react").alias("resolve"), F.lit("hooks").alias("query"), F.lit("react").alias("pack")))
    assert [x["status"] for x in refresh.run_refresh(spark, reg.unionByName(smoke_of(one_more)), both, stores, same_vector).sources] == ["applied", "applied"]
    gone = refresh.run_refresh(spark, reg.unionByName(smoke_of(one_more)), raw(spark, PAGE.replace("About", "More about")).unionByName(empty.withColumn("source_id", F.lit("/other"))), stores, same_vector)
    assert {x["source_id"]: x["status"] for x in gone.sources} == {"/other": "failed", "/react/docs": "applied"}
    kept = {r["source_id"]: r for r in stores.read_state().collect()}
    assert stores.records().hashes(stores.read_state().where("source_id = '/other'")).count() == 1 and kept["/other"]["last_run_at"] == gone.run_at
    assert stores.published("prod")[0].count() == 2


@pytest.mark.parametrize(("before", "blind", "status"), [(True, 1, "rolled_back"), (True, 2, "rollback_failed"), (False, 1, "unavailable")])
def test_failed_publication(spark, tmp_path, before, blind, status):
    stores, reg = stores_at(spark, tmp_path), registry(spark)
    if before:
        assert refresh.run_refresh(spark, reg, raw(spark, PAGE), stores, same_vector).status == "ok"
    stores.prod.blind[0] = blind
    titled = reg.withColumn("catalog_metadata", F.col("catalog_metadata").withField("title", F.lit("React, renamed")))
    got = refresh.run_refresh(spark, titled, raw(spark, PAGE.replace("About", "Much about")), stores, same_vector)
    assert [x["status"] for x in got.sources] == [status] and got.status == "partial"
    assert "query" in got.sources[0]["failures"]["prod"]
    state = stores.read_state().collect()
    assert len(state) == before
    stores.prod.blind[0] = 0
    sources, records = stores.published("prod")
    live, text = sources.first()["title"], json.loads(records.first()["payload"])["content"]
    assert (live, text) == (("React Docs", "About hooks and react.") if before else ("React, renamed", "Much about hooks and react."))


def test_failed_staging_and_review(spark, tmp_path):
    stores, reg = stores_at(spark, tmp_path), registry(spark)
    blind = reg.withColumn("smoke_queries", F.col("smoke_queries").withField("resolve", F.lit("nothing")))
    got = refresh.run_refresh(spark, blind, raw(spark, PAGE), stores, same_vector)
    assert got.sources[0]["status"] == "failed" and got.sources[0]["failures"] == {"staging": ["resolve"]}
    assert refresh.run_refresh(spark, reg, raw(spark, PAGE), stores, same_vector, max_changed=0).sources[0]["status"] == "needs_review"
    small = raw(spark, "<script>" + "x" * 100 + "</script>" + " " * 3000 + "<p>a</p>")
    assert refresh.run_refresh(spark, reg, small, stores, same_vector).sources[0]["errors"] == ["/react/docs: extracted text from `https://react.dev/a` looks too small; upstream HTML may have changed"]
    bare = reg.withColumn("memory_targets", F.col("memory_targets").withField("prod_shard_ids", F.array().cast("array<string>")))
    assert refresh.run_refresh(spark, bare, raw(spark, PAGE), stores, same_vector).errors == ["/react/docs: no prod memory shard ids configured"]


def test_reports_meta_and_versions(spark, tmp_path):
    stores, reg = stores_at(spark, tmp_path), registry(spark)
    got = refresh.run_refresh(spark, reg, raw(spark, "<p>About hooks and react.</p>"), stores, same_vector)
    assert got.sources[0]["warnings"] == [{"url": "https://react.dev/a", "kind": "content_roots_unmatched"}]
    assert got.sources[0]["diff"]["extraction_warning_count"] == 1 and got.sources[0]["diff"]["status"] == "new"
    path = tables.write_report(spark, vars(got), str(tmp_path / "reports"))
    text = open(path, encoding="ascii").read()
    assert json.loads(text)["status"] == "partial" and text.endswith("}\n") and ":" not in path.rsplit("/", 1)[1]
    assert "- /react/docs: needs_review" in open(path[:-5] + ".md").read()
    payloads, meta = ingest.normalize(raw(spark, "<p>About hooks and react.</p>"), reg)
    tables.write_payloads(payloads, str(tmp_path / "norm"))
    tables.write_meta(tables.warnings_by_source(meta), str(tmp_path / "meta"))
    assert tables.read_payloads(spark, str(tmp_path / "norm"), "/react/docs").first()["content"] == "About hooks and react."
    more = reg.unionByName(reg.withColumn("source_id", F.lit("/new")))
    assert {r["source_id"]: (r["warning_count"], len(r["warnings"])) for r in tables.read_meta(spark, str(tmp_path / "meta"), more).collect()} == {"/react/docs": (1, 1), "/new": (0, 0)}
    h = "source_id string, record_key string, change string"
    keys = refresh.diff_report(spark.createDataFrame([("/s", "b", "added"), ("/s", "a", "added"), ("/s", "c", "removed"), ("/s", "d", "same")], h)).collect()
    assert [tuple(r) for r in keys] == [("/s", "added", "a"), ("/s", "added", "b"), ("/s", "removed", "c")]
    p = str(tmp_path / "table")
    for n in range(4):
        versions.write_version(spark.range(n), p)
    (tmp_path / "table" / "v=9").mkdir()  # an unfinished one doesn't count
    assert versions.versions(spark, p) == [2, 3] and versions.read_version(spark, p, spark.range(0).schema).count() == 3


def test_registry_files_and_instances(spark, tmp_path):
    f = tmp_path / "registry.json"
    f.write_text(json.dumps([{"source_id": "/a", "enabled": True}, {"source_id": "/a"}]))
    assert tables.read_registry(spark, str(f)).count() == 2
    said = [r["message"] for r in ingest.validate_registry(tables.registry_entries(spark, str(f))).collect()]
    assert "/a: duplicate source_id" in said and "/a: missing `kind`" in said and said.count("/a: missing `enabled`") == 1
    f.write_text('{"source_id": "/a"}')
    with pytest.raises(ValueError, match="must contain a top-level array"):
        tables.read_registry(spark, str(f))
    i = tmp_path / "instances.jsonl"
    i.write_text('{"kind": "Running", "principal": "aa"}\n\n{"kind": "Empty", "message": "none"}\n')
    assert [(r["kind"], r["principal"]) for r in tables.list_instances(spark, str(i)).collect()] == [("Empty", None), ("Running", "aa")]
    i.write_text('{"kind": "Running", "message": "no principal"}\n')
    with pytest.raises(Exception, match="not an instance state"):
        tables.list_instances(spark, str(i)).collect()


def test_the_last_payload_of_a_key_counts(spark):
    row = ("/s", "t", "n", "https://a", "1", "é", "sec", ["x"], "r", 0, None)
    rows = [(*row, 0), (*row[:5], "later", *row[6:], 2), (*row[:5], "between", *row[6:], 1)]
    df = spark.createDataFrame(rows, T.StructType([*schemas.PAYLOAD.fields, T.StructField("item_pos", T.IntegerType())]))
    got = refresh.record_hashes(df, "item_pos").collect()
    want = refresh.record_hashes(df.where("content = 'later'"), "item_pos").first()["hash"]
    assert [(r["record_key"], r["hash"]) for r in got] == [("https://a#0:0", want)]
    assert refresh.record_hashes(df.withColumn("retrieved_at", F.lit("z")), "item_pos", ("retrieved_at",)).first()["hash"] == refresh.record_hashes(df, "item_pos", ("retrieved_at",)).first()["hash"]


def test_catalogs_of_older_versions(spark):
    new = tables.seed_catalog(spark)
    old = new.drop("skill_kind", "targets", "capabilities").withColumn("citations", F.lit(None).cast("array<string>"))
    assert (tables.catalog_version(new), tables.catalog_version(old)) == (1, 0)
    got = tables.migrate(old)
    assert got.schema.names == schemas.SOURCE.names and got.where("size(targets) = 0 and skill_kind is null and size(citations) = 0").count() == 4
    assert tables.migrate(new).collect() == new.select(*schemas.SOURCE.names).collect()
    with pytest.raises(ValueError, match="not a catalog: no title"):
        tables.migrate(new.drop("title"))


def test_settings():
    from slateflow import settings

    assert [settings.is_yes(x) for x in ("1", "true", "TRUE", "yes", "True", "on", "YES", "0")] == [True] * 4 + [False] * 4
    assert [settings.is_on(x) for x in ("1", "True", "YES", "On", "0", "")] == [True] * 4 + [False] * 2
    got = settings.load(settings.RefreshSettings, {"SLATEFLOW_MAX_DELETED_RECORDS": "3", "SLATEFLOW_PROD_LOCAL": "ON"}, root="/x/", registry=None)
    assert (got.max_deleted_records, got.prod_local, got.staging_local, got.path("raw"), got.registry) == (3, True, True, "/x/raw", "registry.json")
    assert settings.load(settings.ReadSettings, {"SLATEFLOW_LOCAL": "on", "SLATEFLOW_CATALOG": "c"}) == settings.ReadSettings("c")


def test_stream(spark, tmp_path):
    from slateflow.streaming.refresh import refresh_stream

    place = lambda n: str(tmp_path / n)
    stores = refresh.Stores(memory.TableStore(spark, place("sm")), memory.TableStore(spark, place("pm")), place("sc"), place("pc"), place("state"), place("snap"))
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    raw(spark, "<article><p>About react hooks.</p></article>").write.json(place("raw"))
    seen = []
    refresh_stream(spark, place("raw"), registry(spark), stores, embed, place("cp"), lambda i, r: seen.append([x["status"] for x in r.sources])).awaitTermination()
    assert seen == [["applied"]]


def test_diff_counts_by_chunk(spark):
    h = "source_id string, record_key string, hash string"
    old = spark.createDataFrame([("/s", "c#0:0", "1"), ("/s", "c#0:1", "2"), ("/gone", "k", "1"), ("/same", "k", "1")], h)
    new = spark.createDataFrame([("/s", "c#0:0", "1"), ("/s", "c#0:1", "9"), ("/s", "c#0:2", "3"), ("/new", "k", "1"), ("/same", "k", "1")], h)
    got = {r["source_id"]: (r["status"], r["added_records"], r["removed_records"], r["changed_records"]) for r in refresh.diff_status(refresh.diff_records(old, new)).collect()}
    assert got == {"/s": ("updated", 1, 0, 1), "/gone": ("deleted", 0, 1, 0), "/new": ("new", 1, 0, 0), "/same": ("noop", 0, 0, 0)}


def test_files(spark, tmp_path):
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.PAYLOAD).count() == 0
    df = spark.createDataFrame([("é", None)], "b string, a string")
    tables.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"].lower() == '{"a":null,"b":"\\u00e9"}'
    f = tmp_path / "page.txt"
    f.write_text("hello")
    urls = spark.createDataFrame([("/s", f"file://{f}", "l", "public_urls")], "source_id string, url string, label string, role string")
    r = tables.fetch_documents(spark, urls).first()
    assert (r["body"], r["content_type"], r["status_code"]) == ("hello", "text/plain", 200)


@pytest.mark.parametrize(("f", "x", "want"), [
    (X.normalize_catalog, "Next.js, Ünï/9", "next.js   n /9"), (X.normalize_engine, "  Next.js -- K!", "next js k"), (X.slug, "/vercel/next.js", "vercel__next_js"), (X.slug, "/", "root"),
    (X.summarize_title, "   ", "Untitled memory result"), (X.summarize_title, "y" * 81, "y" * 80 + "..."), (X.clean_text, "<b>a</b>&amp;  b", "a & b"),
])
def test_text(spark, f, x, want):
    df = spark.createDataFrame([(x,)], "x string")
    assert df.select(f(F.col("x")).alias("y")).first()["y"] == want


def test_oracle_keys():
    from slateflow.plans import driver_queries

    assert set(driver_queries.oracle_sql()) <= set(driver_queries.queries())
    assert B.SEED_QUERIES


def test_collect_and_embed_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            n = len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["content"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [n, 0.5]}).encode())

        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>hi</p>")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    q = spark.createDataFrame([(0, "abc")], "query_id int, query string")
    assert memory.HttpEmbedder(base).embed(q).first()["vector"] == [3.0, 0.5]
    link = lambda x: [{"label": x, "url": f"{base}/{x}"}]
    got, failed = tables.collect(spark, registry(spark, public_urls=link("p"), discovery_urls=link("d")), "2026-01-01T00:00:00Z")
    assert failed.count() == 0
    tables.write_raw(got, str(tmp_path / "raw"))
    back = tables.read_latest_raw(spark, str(tmp_path / "raw")).first()
    server.shutdown()
    assert [(i["role"], i["body"], i["content_type"]) for i in back["items"]] == [("discovery_urls", "<p>hi</p>", "text/html"), ("public_urls", "<p>hi</p>", "text/html")]
