"""Read-only command line: resolve, query, pack, cite, list, filter and instances, over a published catalog and store."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="slateflow", description=__doc__)
    p.add_argument("--catalog", help="Parquet path of the catalog; the built-in sources if left out")
    p.add_argument("--memory", help="Parquet path of the memory records")
    p.add_argument("--vector", help="the query's vector, comma-separated")
    p.add_argument("--embedding-endpoint", help="a service that gives a text its vector, where no vector is given")
    p.add_argument("--pretty", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("resolve")
    r.add_argument("query")
    r.add_argument("--max-sources", type=int, default=5)
    r.add_argument("--include-skills", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("source_id")
    q.add_argument("query", nargs="?", default="", help="free text; needs an embedding endpoint unless a vector is given")
    q.add_argument("--version")
    q.add_argument("--top-k", type=int, default=5)
    k = sub.add_parser("pack")
    k.add_argument("query")
    k.add_argument("--max-sources", type=int, default=5)
    k.add_argument("--max-tokens", type=int, default=3000)
    k.add_argument("--include-skills", action="store_true")
    c = sub.add_parser("cite")
    c.add_argument("pack", help="a pack as JSON, or the path of a file")
    ls = sub.add_parser("list")
    ls.add_argument("--include-skills", action="store_true")
    f = sub.add_parser("filter")
    for o in ("domain", "trust", "version"):
        f.add_argument(f"--{o}")
    f.add_argument("--limit", type=int)
    f.add_argument("--include-skills", action="store_true")
    i = sub.add_parser("instances")
    i.add_argument("--path", help="JSON lines of deployed instances")
    return p


def embedded(df, vector: str | None, endpoint: str | None):
    """Rows of (query) with their vector: the given one, or the embedding service's."""
    from slateflow.operators.memory import FixedEmbedder, HttpEmbedder

    if vector:
        return FixedEmbedder([float(x) for x in vector.split(",")]).embed(df)
    if endpoint:
        return HttpEmbedder(endpoint).embed(df)
    raise SystemExit("a vector or an embedding endpoint is needed")


def run(spark, a: argparse.Namespace) -> dict:
    """The command's result, its shape alone telling which command it was."""
    from pyspark.sql import functions as F

    from slateflow import schemas
    from slateflow.operators import catalog, memory, pack, resolve
    from slateflow.settings import ReadSettings, load
    from slateflow.sources import tables

    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.command == "cite":
        text = pack.cite_json(spark, a.pack)
        return {"citations": [{k: v for k, v in r.items() if k not in ("position", "query")} for r in rows(text.orderBy("position"))]}
    s = load(ReadSettings, catalog=a.catalog, memory=a.memory, embedding_endpoint=a.embedding_endpoint, instances=getattr(a, "path", None))
    if a.command == "instances":
        if not s.instances:
            raise SystemExit("a path of instances is needed")
        return {"instances": rows(tables.list_instances(spark, s.instances))}
    sources = _catalog(spark, s.catalog) if s.catalog else tables.seed_catalog(spark)
    if a.command == "list":
        got = rows(catalog.list_sources(sources, a.include_skills))
        return {"count": len(got), "filters": None, "sources": got}
    if a.command == "filter":
        f = catalog.SourceFilters(a.domain, a.trust, a.version, a.limit)
        got = rows(catalog.filter_sources(sources, f, a.include_skills))
        return {"count": len(got), "filters": vars(f), "sources": got}
    if a.command == "resolve":
        q = spark.createDataFrame([(0, a.query)], "query_id int, query string")
        told = resolve.describe(q).first()
        found = rows(resolve.resolve(q, sources, a.max_sources, a.include_skills).orderBy("rank").drop("query_id", "rank"))
        return {"query": a.query, "intent": told["intent"], "entities": told["entities"], "candidates": found}
    records = _memory(spark, s.memory) if s.memory else spark.createDataFrame([], schemas.MEMORY)
    if a.command == "query" and catalog.get_source(sources, a.source_id).isEmpty():
        raise SystemExit(f"source not found: {a.source_id}")
    asked = embedded(spark.createDataFrame([(0, a.query)], "query_id int, query string"), a.vector, s.embedding_endpoint)
    if a.command == "pack":
        return pack.pack_one(asked, sources, records, max_sources=a.max_sources, max_tokens=a.max_tokens, include_skills=a.include_skills)
    ask = asked.select("query_id", F.lit(a.source_id).alias("source_id"), "vector", F.lit(a.version).cast("string").alias("version"), F.lit(a.top_k).alias("top_k"))
    found = memory.query(ask, sources, records).orderBy("hit_rank").drop("query_id", "src_rank", "hit_rank")
    return {"source_id": a.source_id, "snippets": rows(found)}


def _published(spark, path: str, what: str):
    """The version of a published catalog or memory that the newest commit of its root names, None for a table of another kind.

    A published folder is {root}/{what}/{environment}; {root} holds the commits.
    """
    from slateflow.sources.versions import Commits

    root, _, env = path.rstrip("/").rpartition("/")
    head = Commits(spark, f"{root.removesuffix('/' + what)}/state-commits").read()
    return (head.get(env) or {}).get(what)


def _catalog(spark, path: str):
    """A catalog that a refresh published, or a plain table."""
    from slateflow import schemas
    from slateflow.sources import tables
    from slateflow.sources.versions import BucketTable

    version = _published(spark, path, "catalog")
    return tables.migrate(spark.read.parquet(path)) if version is None else BucketTable(spark, path, schemas.SOURCE, "source_id").read(version)


def _memory(spark, path: str):
    """A memory that a refresh published, or a plain table."""
    from slateflow import schemas
    from slateflow.operators.memory import TableStore

    version = _published(spark, path, "memory")
    return spark.read.schema(schemas.MEMORY).parquet(path) if version is None else TableStore(spark, path, version).read()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("slateflow").getOrCreate()
    print(json.dumps(run(spark, a), indent=2 if a.pretty else None, ensure_ascii=False))


if __name__ == "__main__":
    main()
