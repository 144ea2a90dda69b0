import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from slateflow import ops
from slateflow.__main__ import parser, run


def ask(spark, *argv):
    return run(spark, parser().parse_args(argv))


def test_commands(spark):
    assert ask(spark, "list")["count"] == 3 and ask(spark, "list", "--include-skills")["count"] == 4
    assert [s["source_id"] for s in ask(spark, "filter", "--version", "15")["sources"]] == ["/vercel/next.js"]
    assert ask(spark, "filter", "--trust", "official", "--limit", "2")["filters"] == {"domain": None, "trust": "official", "version": None, "limit": 2}
    assert ask(spark, "list")["filters"] is None
    got = ask(spark, "resolve", "next middleware")
    assert got["intent"] == "Code" and got["candidates"][0]["source_id"] == "/vercel/next.js"
    assert ask(spark, "cite", '{"query":"q","resolved_sources":[],"evidence":[],"warnings":[],"pack_summary":"","token_budget":1}') == {"citations": []}


def test_help_has_no_write_verbs():
    text = parser().format_help()
    assert not any(w in text for w in ("upsert", "replace", "delete", "insert"))


class Service(BaseHTTPRequestHandler):
    """Pages on GET, embeddings on POST."""

    page = b"<article><p>About hooks and react.</p></article>"

    def _send(self, kind, body):
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._send("text/html", self.page)

    def do_POST(self):
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["content"]
        self._send("application/json", json.dumps({"embedding": [1.0, float("hooks" in text)]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_stages_one_by_one(spark, tmp_path, service, capsys):
    """Collect, normalize, validate, diff, apply and smoke a source, then ask for it in free text; then refresh it."""
    entry = {
        "source_id": "/react/docs", "kind": "docs", "enabled": True, "public_urls": [{"label": "a", "url": f"{service}/a"}], "discovery_urls": [], "normalization_profile": "p",
        "catalog_metadata": {"title": "React Docs", "aliases": ["react"], "domain": "code_docs", "trust": "official", "supported_versions": ["19"], "citations": [], "targets": [], "capabilities": [], "skill_kind": None, "retrieved_at": "x"},
        "memory_targets": {"staging_shard_ids": ["s"], "prod_shard_ids": ["p"]}, "cadence": "daily", "version_strategy": "v",
        "extraction_hints": {"content_roots": ["article"], "drop_selectors": [], "chunk_target_chars": 900}, "smoke_queries": {"resolve": "react", "query": "hooks", "pack": "react"},
    }
    registry, root = tmp_path / "registry.json", str(tmp_path / "root")
    registry.write_text(json.dumps([entry]))

    def stage(*argv):
        return ops.run(spark, ops.parser().parse_args(["--registry", str(registry), "--root", root, "--embedding-endpoint", service, *argv]))

    assert stage("collect") == {"status": "ok", "sources": ["/react/docs"]} == stage("normalize")
    assert stage("validate") == {"status": "ok", "errors": []}
    told = stage("diff", "--source", "/react/docs")
    assert [r.asDict() for r in spark.read.json(told["keys_path"]).collect()] == [{"change": "added", "record_key": f"{service}/a#0:0", "source_id": "/react/docs"}]
    assert told["results"][0]["status"] == "new" and json.load(open(f"{root}/reports/latest-diff.json"))["results"][0]["added_records"] == 1
    env = ["--source", "/react/docs", "--env", "prod"]
    assert stage("apply-memory", *env, "--dry-run")["status"] == "ok"
    assert stage("apply-memory", *env)["status"] == stage("apply-catalog", *env)["status"] == stage("smoke", *env)["status"] == "ok"
    assert stage("smoke", "--source", "/none", "--env", "prod") == {"status": "failed", "errors": ["source not found: /none"]}
    read = ["--catalog", f"{root}/catalog/prod", "--memory", f"{root}/memory/prod", "--embedding-endpoint", service]
    assert [x["snippet"] for x in ask(spark, *read, "query", "/react/docs", "about hooks")["snippets"]] == ["About hooks and react."]
    assert ask(spark, *read, "pack", "react")["evidence"][0]["citation"] == f"{service}/a"
    with pytest.raises(SystemExit, match="source not found: /none"):
        ask(spark, *read, "query", "/none", "x")
    with pytest.raises(SystemExit, match="a vector or an embedding endpoint is needed"):
        ask(spark, "pack", "react")
    assert stage("refresh")["sources"][0]["status"] == "applied"
    registry.write_text(json.dumps([{**entry, "cadence": "weekly"}, entry]))
    assert ops.main(["--registry", str(registry), "--root", root, "--vector", "1,0", "validate"]) == 1
    assert "duplicate source_id" in capsys.readouterr().out
    assert ops.main(["--registry", str(registry), "--root", root, "--vector", "1,0", "refresh"]) == 1
    assert "invalid_registry" in capsys.readouterr().err
