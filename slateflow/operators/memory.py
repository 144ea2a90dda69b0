"""Vector search over a source's shards, and payloads as snippets."""

from __future__ import annotations

import copy
import uuid
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slateflow import schemas
from slateflow.functions import text as X
from slateflow.sources.versions import BucketTable, delete, names


class Embedder(Protocol):
    """Gives each row of (query_id, query) its vector."""

    def embed(self, queries: DataFrame) -> DataFrame: ...


class MemoryStore(Protocol):
    """The records of shards, as schemas.MEMORY."""

    def read(self) -> DataFrame: ...


class FixedEmbedder:
    """The same vector for every query."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def embed(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("vector", F.array(*[F.lit(v).cast("float") for v in self.vector]))


class HttpEmbedder:
    """Vectors from an embedding service: POST {base}/embedding with {"content": text} gives {"embedding": [...]}.

    Calls go out from the executors, `at_once` at a time for each Arrow batch; equal texts of a batch are asked
    for once. A call that fails is made anew `tries` times in all, after longer and longer waits; what fails
    then fails its task, or becomes the text of column `error` if one is named: other rows keep their vectors.
    """

    def __init__(self, base: str, timeout: float = 30.0, at_once: int = 8, tries: int = 3, wait: float = 0.2):
        self.base, self.timeout, self.at_once, self.tries, self.wait = base.rstrip("/"), timeout, at_once, tries, wait

    def embed(self, queries: DataFrame, text: str = "query", out: str = "vector", error: str | None = None) -> DataFrame:
        url, timeout, at_once, tries, wait, strict = f"{self.base}/embedding", self.timeout, self.at_once, self.tries, self.wait, error is None

        def call(texts: pd.Series) -> pd.DataFrame:
            import json
            import time
            from concurrent.futures import ThreadPoolExecutor
            from urllib.request import Request, urlopen

            def one(t: str) -> tuple:
                for k in range(tries):
                    try:
                        with urlopen(Request(url, json.dumps({"content": t}).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:  # noqa: S310
                            return [float(x) for x in json.load(r)["embedding"]], None
                    except (OSError, ValueError, KeyError, TypeError) as e:  # URLError is an OSError; a bad answer is one of the others
                        if k + 1 < tries:
                            time.sleep(wait * 2**k)
                        elif strict:
                            raise
                        else:
                            return None, f"embedding failed: {e}"

            different = list(dict.fromkeys(texts))
            with ThreadPoolExecutor(at_once) as pool:
                found = dict(zip(different, pool.map(one, different)))
            return pd.DataFrame([found[t] for t in texts], columns=["v", "e"])

        got = queries.withColumn("_e", F.pandas_udf(call, "v array<float>, e string")(F.col(text)))
        got = got.withColumn(out, F.col("_e.v"))
        return (got if error is None else got.withColumn(error, F.col("_e.e"))).drop("_e")


#: What a store keeps of a record.
STORED = T.StructType([T.StructField("source_id", T.StringType()), *(f for f in schemas.MEMORY if f.name != "shard_id")])
RUNS = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("run", T.StringType())])


class TableStore:
    """Records in Parquet, a folder for each run and below it for each shard; a bucket table names the run in which each source was written last.

    add() and switch() leave what readers see as it was: a reader holds a version of the bucket table, the
    newest unless it is pinned by at(). So a source's records are replaced at once, whatever shards they were in.
    """

    def __init__(self, spark, path: str, version: int | None = None):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self.runs = BucketTable(spark, f"{self.path}/runs", RUNS, "source_id")

    def at(self, version: int | None) -> TableStore:
        out = copy.copy(self)
        out.version = version
        return out

    def read(self) -> DataFrame:
        """The records of each source's run; a join with the small table of runs, which prunes the other runs' folders."""
        if self.version is None and not self.runs.versions():
            return self.spark.createDataFrame([], schemas.MEMORY)
        schema = T.StructType([*STORED, T.StructField("run", T.StringType()), T.StructField("shard_id", T.StringType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/records")
        return rows.join(self.runs.read(self.version), ["source_id", "run"]).select(*schemas.MEMORY.names)

    def add(self, records: DataFrame, run: str) -> list[tuple[str, str]]:
        """Write records (source_id, MEMORY, error) as a run that counts for nobody yet; (source_id, error) of the sources with a failed record."""
        path = f"{self.path}/records/run={run}"
        records.select(*STORED.names, "shard_id", "error").write.partitionBy("shard_id").parquet(path)
        bad = self.spark.read.schema(T.StructType([*STORED, T.StructField("error", T.StringType())])).parquet(path).where("error is not null")
        return [(r["source_id"], r["error"]) for r in bad.groupBy("source_id").agg(F.min("error").alias("error")).orderBy("source_id").collect()]

    def switch(self, runs: dict[str, str], version: int | None = None) -> int:
        """The version in which the given sources' runs count, and for other sources what counted in `version`."""
        rows = self.spark.createDataFrame(sorted(runs.items()), RUNS)
        return self.runs.upsert(rows, version if version is not None else self.version)

    def reset(self, records: DataFrame) -> None:
        """Replace the records of the sources that `records` names, leave the others; an empty batch is an error, and so is a failed record."""
        run = uuid.uuid4().hex
        failed = self.add(records if "error" in records.columns else records.withColumn("error", F.lit(None).cast("string")), run)
        if failed:
            raise ValueError("; ".join(f"{s}: {e}" for s, e in failed))
        ids = [r["source_id"] for r in self.spark.read.schema(STORED).parquet(f"{self.path}/records/run={run}").select("source_id").distinct().collect()]
        if not ids:
            raise ValueError("no records to write")
        self.switch(dict.fromkeys(ids, run))

    def vacuum(self, keep: set[int]) -> None:
        """Drop the runs that none of the versions in `keep` names."""
        used = {r["run"] for n in keep for r in self.runs.read(n).select("run").distinct().collect()}
        for name in names(self.spark, f"{self.path}/records"):
            if name.startswith("run=") and name[4:] not in used:
                delete(self.spark, f"{self.path}/records/{name}")
        self.runs.vacuum(keep)


def _text(v: str, key: str) -> Column:
    """A string field of a variant column, null for other kinds."""
    value = F.try_variant_get(F.col(v), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.col(v), f"$.{key}", "string"))


def _payload_version(payload: Column) -> Column:
    """The version of a payload, if it is a string."""
    value = F.try_variant_get(F.try_parse_json(payload), "$.version", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(payload), "$.version", "string"))


def parse_payload(df: DataFrame, payload: str = "payload", source_id: str = "source_id") -> DataFrame:
    """df with p_title, p_snippet, p_citation, p_version from a JSON or plain payload; only string fields count."""
    raw = F.col(payload)
    df = df.withColumn("_v", F.try_parse_json(raw))
    df = df.withColumn("p_snippet", F.coalesce(_text("_v", "snippet"), _text("_v", "text"), _text("_v", "content"), raw))
    return df.withColumns({
        "p_title": F.coalesce(_text("_v", "title"), X.summarize_title(F.col("p_snippet"))),
        "p_citation": F.coalesce(_text("_v", "citation"), _text("_v", "url"), _text("_v", "source_url"), F.concat(F.lit("memory://"), F.col(source_id))),
        "p_version": _text("_v", "version"),
    }).drop("_v")


#: The most hits that one pair of query and source may ask for: a constant, by which Spark limits each task's rows before they are shuffled.
MOST_HITS = 1000
#: Lanes that a shard's records are dealt to, and queries that meet a lane together. No bound on either in total.
LANES, HELD = 4, 2048
#: What goes with a query through best_hits().
_ASK = ("query_id", "source_id", "src_rank", "top_k", "trust", "retrieved_at", "shard_pos", "version")


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q in double precision, added up in order of the components."""
    with np.errstate(all="ignore"):
        return 0.0 + np.add.accumulate(x * q, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def block_topk(x: np.ndarray, q: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
    """For each row of q the rows of x among which its k best surely are: by one matrix product, with room for its rounding."""
    with np.errstate(all="ignore"):
        s = x @ q.T
        room = 4 * x.shape[1] * np.finfo(np.float64).eps * (np.abs(x) @ np.abs(q).T)
    out = []
    for j in range(len(q)):
        if k[j] >= len(x):
            out.append(np.arange(len(x)))
            continue
        with np.errstate(all="ignore"):
            low, high = s[:, j] - room[:, j], s[:, j] + room[:, j]
        odd = ~np.isfinite(s[:, j]) | ~np.isfinite(room[:, j])
        low = np.where(odd, -np.inf, low)
        out.append(np.flatnonzero(odd | (high >= np.partition(low, len(x) - k[j])[len(x) - k[j]])))
    return out


def _order(score: float | None, shard_pos: int, hit_pos: int) -> tuple:
    """Best first: NaN above all numbers, none below them, as a descending order has it; then the earlier record."""
    kind = 2 if score is None else 0 if score != score else 1
    return kind, -score if kind == 1 else 0.0, shard_pos, hit_pos


def _best_hits(frames):
    """Of each lane the best hits of each query: queries come first and are held, records stream past in blocks."""
    lane, asks, vectors, best, block, out, names = None, [], [], [], [], [], None

    def meet():
        x_of: dict[int, list[int]] = {}
        for i, (_, e, _, _) in enumerate(block):
            x_of.setdefault(-1 if e is None else len(e), []).append(i)
        for dim in {len(v) for v in vectors if v is not None} & set(x_of):
            at = np.array(x_of[dim])
            x, mine = np.array([block[i][1] for i in at], dtype=np.float64).reshape(len(at), dim), [j for j, v in enumerate(vectors) if v is not None and len(v) == dim]
            for wanted in {asks[j]["version"] for j in mine}:
                same = [j for j in mine if asks[j]["version"] == wanted]
                rows = np.arange(len(at)) if wanted is None else np.array([r for r, i in enumerate(at) if block[i][3] == wanted], dtype=np.int64)
                if len(rows):
                    q = np.array([vectors[j] for j in same], dtype=np.float64).reshape(len(same), dim)
                    for j, near in zip(same, block_topk(x[rows], q, np.array([max(asks[j]["top_k"], 1) for j in same]))):
                        take = rows[near]
                        add(j, zip(exact_scores(x[take], vectors[j]).tolist(), at[take]))
        for j, v in enumerate(vectors):  # what can't be compared has no score and comes last
            lost = [i for d, some in x_of.items() if v is None or d != len(v) for i in some]
            add(j, [(None, i) for i in lost if asks[j]["version"] in (None, block[i][3])])

    def add(j: int, found):
        held = best[j] + [(_order(score, asks[j]["shard_pos"], block[i][0]), block[i][0], block[i][2], score) for score, i in found]
        held.sort(key=lambda h: h[0])
        best[j] = held[: max(asks[j]["top_k"], 1)]

    def close():
        if block:
            meet()
        # pandas would give NaN back as null, so it goes in a column of its own.
        out.extend((*(a[c] for c in names if c != "version"), *h[1:], h[3] != h[3]) for a, held in zip(asks, best) for h in held)

    for pdf in frames:
        names = [c for c in pdf.columns if c in _ASK]
        cols = {c: pdf[c].tolist() for c in pdf.columns if c != "vector"}
        for i, e in enumerate(pdf["vector"]):
            if cols["lane"][i] != lane:
                close()
                lane, asks, vectors, best, block = cols["lane"][i], [], [], [], []
            if cols["kind"][i] == 0:
                asks.append({c: cols[c][i] for c in names})
                vectors.append(e)
                best.append([])
            elif asks:
                block.append((cols["hit_pos"][i], e, cols["payload"][i], cols["version"][i]))
        if block:
            meet()
            block = []
        if out:
            yield pd.DataFrame(out, columns=[*(c for c in names if c != "version"), "hit_pos", "payload", "score", "nan"])
            out = []
    close()
    if out:
        yield pd.DataFrame(out, columns=[*(c for c in names if c != "version"), "hit_pos", "payload", "score", "nan"])


def best_hits(shards: DataFrame, memory: DataFrame) -> DataFrame:
    """(query_id, source_id, src_rank, top_k, trust, retrieved_at, shard_pos, hit_pos, payload, score): each query's best top_k records of each lane of its shards.

    shards: those columns of queries with shard_id, vector and version. Records of a shard are dealt
    to LANES lanes, a shard's queries to blocks of HELD; each lane meets each block in one place, where
    matrix products and a heap leave top_k records of a query: only those go on.
    """
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = shards.groupBy("shard_id").agg(F.expr(f"sequence(0, int((count(1) - 1) div {HELD}))").alias("_blocks"), F.max(F.col("version").isNotNull()).alias("_versions"))
    asks = shards.join(many, "shard_id")
    kinds = {c: dict(shards.dtypes)[c] for c in _ASK}
    key = "xxhash64(shard_id, _block, {}) as lane"
    asked = asks.selectExpr("*", "cast(pmod(xxhash64(query_id, source_id), size(_blocks)) as int) as _block", f"explode(sequence(0, {LANES - 1})) as _lane").selectExpr(
        key.format("_lane"), "0 as kind", *_ASK, "cast(vector as array<double>) as vector", "0L as hit_pos", "cast(null as string) as payload")
    version = F.when(F.col("_versions"), _payload_version(F.col("payload")))
    rows = memory.join(many, "shard_id").withColumn("version", version).selectExpr("*", "explode(_blocks) as _block").selectExpr(
        key.format(f"pmod(hash(hit_pos), {LANES})"), "1 as kind", *[f"cast('0' as {kinds[c]}) as {c}" if c != "version" else c for c in _ASK], "cast(embedding as array<double>) as vector", "hit_pos", "payload")
    out = ", ".join([*(f"{c} {kinds[c]}" for c in _ASK if c != "version"), "hit_pos long, payload string, score double, nan boolean"])
    found = asked.unionByName(rows).repartition(parts, "lane").sortWithinPartitions("lane", "kind").mapInPandas(_best_hits, out)
    return found.withColumn("score", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("score"))).drop("nan")


def pair_hits(shards: DataFrame, memory: DataFrame) -> DataFrame:
    """All hits, as best_hits() has them, of queries and records that meet on their shard."""
    hits = shards.join(memory, "shard_id").withColumn("score", X.dot(F.col("vector"), F.col("embedding")))
    return hits.where(F.col("version").isNull() | F.coalesce(_payload_version(F.col("payload")) == F.col("version"), F.lit(False)))


def search(asked: DataFrame, sources: DataFrame, memory: DataFrame, errors: DataFrame | None = None, most: int = MOST_HITS, blocks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Snippets and outcomes of (query_id, source_id, src_rank, vector, version, top_k) rows.

    Snippets have each pair's best top_k (`most` at most, more is an error), ranked; the smaller `most`, the less
    each task gives away. payloads are parsed once that is settled, and before it only
    where a version is asked for. An outcome is `ok`, `empty` (no snippet), `missing` (the source is not among
    `sources`) or `error`: the source has no shards, or no snippet is left and a shard failed (`errors`:
    shard_id, error). Records meet only the shards of resolved sources: a join on shard_id, which prunes
    partitions of the store. With `blocks` they meet by matrix products, in Python workers: better where each
    query has very many records to be compared with, and slower to begin; the rows are the same.
    """
    meta = sources.select("source_id", "trust", "retrieved_at", "shard_ids", F.lit(True).alias("_known"))
    pairs = asked.join(meta, "source_id", "left")
    top_k = F.when(F.col("top_k") > most, F.raise_error(F.lit(f"top_k is {most} at most"))).otherwise(F.col("top_k")).cast("int").alias("top_k")
    shards = pairs.select("query_id", "source_id", "src_rank", "vector", "version", top_k, "trust", "retrieved_at", F.posexplode(F.array_sort("shard_ids")).alias("shard_pos", "shard_id"))
    live = shards if errors is None else shards.join(errors.select("shard_id"), "shard_id", "left_anti")
    w = Window.partitionBy("query_id", "source_id").orderBy(F.desc("score"), "shard_pos", "hit_pos")
    hits = best_hits(live, memory) if blocks else pair_hits(live, memory)
    ranked = hits.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= most).where(F.col("hit_rank") <= F.greatest(F.col("top_k"), F.lit(1)))
    snippets = parse_payload(ranked).select(
        "query_id", "src_rank", "hit_rank", "source_id", F.col("p_title").alias("title"), F.col("p_snippet").alias("snippet"), F.col("p_citation").alias("citation"),
        "trust", "retrieved_at", F.col("p_version").alias("version"), F.lit(False).alias("stale"), F.col("score").cast("float").alias("score"),
    )
    got = ranked.groupBy("query_id", "source_id").agg(F.count("*").alias("n"))
    out = pairs.select("query_id", "source_id", "src_rank", F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce(F.size("shard_ids"), F.lit(0)).alias("shards")).join(got, ["query_id", "source_id"], "left")
    if errors is None:
        out = out.withColumn("failed", F.lit(False))
    else:
        failed = shards.join(errors.select("shard_id"), "shard_id", "left_semi").select("query_id", "source_id", F.lit(True).alias("failed")).distinct()
        out = out.join(failed, ["query_id", "source_id"], "left")
    status = (
        F.when(~F.col("known"), "missing").when(F.col("shards") <= 0, "error").when(F.coalesce("n", F.lit(0)) > 0, "ok")
        .when(F.coalesce("failed", F.lit(False)), "error").otherwise("empty")
    )
    return snippets, out.select("query_id", "source_id", "src_rank", status.alias("outcome"))


def query(asked: DataFrame, sources: DataFrame, memory: DataFrame, errors: DataFrame | None = None, most: int = MOST_HITS) -> DataFrame:
    """Ranked snippets of (query_id, source_id, vector, version, top_k) rows."""
    return search(asked.withColumn("src_rank", F.lit(1)), sources, memory, errors, most)[0]
