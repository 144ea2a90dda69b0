"""Evidence packs: resolve, search, warn, drop repeats, rank, trim to a budget, summarize; and citations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slateflow import schemas
from slateflow.functions import text as X
from slateflow.operators.memory import search
from slateflow.operators.resolve import resolve

HITS_PER_SOURCE = 3
#: The token budget of a pack, unless another is given.
TOKENS = 3000


class NoSources(ValueError):
    """No source answered a query."""


def warnings_of(outcomes: DataFrame) -> DataFrame:
    """query_id, src_rank, kind, message for sources that failed or gave nothing."""
    stage = F.when(F.col("outcome") == "missing", "load source metadata").otherwise("query source canisters")
    kind = F.when(F.col("outcome") == "empty", "empty_source").otherwise("source_error")
    message = F.when(F.col("outcome") == "empty", F.concat(F.lit("No snippets matched for "), "source_id")).otherwise(F.concat(F.lit("Failed to "), stage, F.lit(" for "), "source_id"))
    return outcomes.where(F.col("outcome") != "ok").select("query_id", "src_rank", kind.alias("kind"), message.alias("message"))


def drop_repeats(snippets: DataFrame) -> DataFrame:
    """The first of snippets with one source, title and citation."""
    w = Window.partitionBy("query_id", "source_id", "title", "citation").orderBy("src_rank", "hit_rank")
    return snippets.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trim(snippets: DataFrame, max_tokens: int) -> DataFrame:
    """Best first, a snippet that doesn't fit what is left of the budget is skipped and the next one tried.

    A query's snippets are at most sources x HITS_PER_SOURCE, so they fold in one array.
    """
    cost = X.approximate_tokens(F.col("title"), F.col("snippet"), F.col("citation"))
    # Sorting by the negated score puts NaN first, as a descending order does.
    row = F.struct((F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score").cast("double"))).alias("o"), "src_rank", "hit_rank", cost.alias("cost"), *[F.col(c) for c in schemas.SNIPPET.names])
    packed = snippets.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    fold = f"""aggregate(rows, struct(0L AS used, slice(rows, 1, 0) AS kept),
        (s, x) -> CASE WHEN s.used + x.cost <= {int(max_tokens)} THEN struct(s.used + x.cost AS used, array_append(s.kept, x) AS kept) ELSE s END, s -> s.kept)"""
    kept = packed.select("query_id", F.posexplode(F.expr(fold)).alias("pos", "x"))
    return kept.select("query_id", (F.col("pos") + 1).alias("position"), "x.cost", *[f"x.{c}" for c in schemas.SNIPPET.names])


def summary(titles) -> F.Column:
    return F.when(F.size(titles) > 0, F.concat(F.lit("Top evidence came from: "), F.array_join(F.slice(titles, 1, 3), ", "))).otherwise(F.lit("No evidence found for the query."))


def evidence(queries: DataFrame, sources: DataFrame, memory: DataFrame, max_sources: int = 5, include_skills: bool = False, errors: DataFrame | None = None, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved sources, snippets without repeats, and outcomes, for (query_id, query, vector) rows.

    `metadata`: where a resolved source's shards and trust are looked up, if that is not the catalog it was
    resolved in; a source that isn't there has the outcome `missing`.
    """
    found = resolve(queries, sources, max_sources, include_skills).withColumnRenamed("rank", "src_rank")
    asked = found.select("query_id", "source_id", "src_rank").join(queries.select("query_id", "vector"), "query_id")
    asked = asked.withColumns({"version": F.lit(None).cast("string"), "top_k": F.lit(HITS_PER_SOURCE)})
    snippets, outcomes = search(asked, sources if metadata is None else metadata, memory, errors, HITS_PER_SOURCE)
    return found, drop_repeats(snippets), outcomes


def pack(queries: DataFrame, sources: DataFrame, memory: DataFrame, max_sources: int = 5, max_tokens: int = TOKENS, include_skills: bool = False, errors: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """One row for each query, as schemas.PACK with query_id and `failed`: no source answered and nothing was found."""
    found, snippets, outcomes = evidence(queries, sources, memory, max_sources, include_skills, errors, metadata)
    kept = trim(snippets, max_tokens)
    ev = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*schemas.SNIPPET.names).alias("s")))).alias("e"))
    ev = ev.select("query_id", F.transform("e", lambda x: x["s"]).alias("evidence"))
    warn = warnings_of(outcomes).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("src_rank", F.struct("kind", "message").alias("w")))).alias("w"))
    warn = warn.select("query_id", F.transform("w", lambda x: x["w"]).alias("warnings"))
    ids = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("src_rank", "source_id"))).alias("r")).select("query_id", F.transform("r", lambda x: x["source_id"]).alias("resolved_sources"))
    answered = outcomes.groupBy("query_id").agg(F.count_if(F.col("outcome").isin("ok", "empty")).alias("answered"))
    any_found = snippets.groupBy("query_id").agg(F.count("*").alias("found"))
    out = queries.select("query_id", "query")
    for part in (ids, ev, warn, answered, any_found):
        out = out.join(part, "query_id", "left")
    empty = F.array()
    out = out.withColumns({
        "resolved_sources": F.coalesce("resolved_sources", empty.cast("array<string>")),
        "evidence": F.coalesce("evidence", empty.cast(schemas.PACK["evidence"].dataType)),
        "warnings": F.coalesce("warnings", empty.cast(schemas.PACK["warnings"].dataType)),
        "failed": (F.coalesce("answered", F.lit(0)) == 0) & (F.coalesce("found", F.lit(0)) == 0),
    })
    return out.select(
        "query_id", "query", "resolved_sources", "evidence", "warnings",
        summary(F.transform("evidence", lambda e: e["title"])).alias("pack_summary"), F.lit(max_tokens).cast("long").alias("token_budget"), "failed",
    )


def pack_one(asked: DataFrame, sources: DataFrame, memory: DataFrame, **options) -> dict:
    """The pack of one (query_id, query, vector) row as a dictionary; raises NoSources if nothing answered."""
    row = pack(asked, sources, memory, **options).first().asDict(recursive=True)
    if row.pop("failed"):
        raise NoSources("all resolved sources failed")
    row.pop("query_id")
    return row


def cite(packs: DataFrame) -> DataFrame:
    """A row for each citation: evidence without its text and score."""
    return packs.select(*[c for c in ("query_id", "query") if c in packs.columns], F.posexplode("evidence").alias("position", "e")).select(
        *[c for c in ("query_id", "query") if c in packs.columns], "position", *[f"e.{c}" for c in schemas.SNIPPET.names if c not in ("snippet", "score")],
    )


def cite_json(spark: SparkSession, pack_text: str) -> DataFrame:
    """Citations of a pack given as JSON or as the path of a file."""
    text = Path(pack_text).read_text(encoding="utf-8") if len(pack_text) < 4096 and Path(pack_text).is_file() else pack_text
    try:
        json.loads(text)
    except ValueError as e:
        raise ValueError(f"failed to parse evidence pack JSON: {e}") from e
    rows = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schemas.PACK).alias("p")).select("p.*")
    return cite(rows)
