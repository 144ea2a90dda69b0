"""What was published of each source, as rows: record hashes, and digests of them by bucket, so that equal buckets are never compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateflow.sources.versions import delete, names

#: Hexadecimal digits of a record key's SHA-256 that name its bucket.
BUCKET_DIGITS = 4
#: A source of more records has a digest for each bucket; a smaller one has that of all its records alone.
WHOLE_RECORDS = 65_536
#: The bucket that stands for all records of a source.
WHOLE = ""

_S, _L = T.StringType(), T.LongType()
HASHES = T.StructType([T.StructField("source_id", _S), T.StructField("bucket", _S), T.StructField("record_key", _S), T.StructField("hash", _S)])
DIGESTS = T.StructType([T.StructField("source_id", _S), T.StructField("bucket", _S), T.StructField("n", _L), T.StructField("digest", _S)])


def bucketed(hashes: DataFrame) -> DataFrame:
    """HASHES of (source_id, record_key, hash)."""
    return hashes.select("source_id", F.substring(F.sha2("record_key", 256), 1, BUCKET_DIGITS).alias("bucket"), "record_key", "hash")


def digests(hashes: DataFrame) -> DataFrame:
    """DIGESTS of HASHES: of each source as a whole and, where it is large, of each bucket.

    A digest is the number of records and two sums of 60 bits of a hash over key and hash. Sums add up: that of
    a source comes from those of its buckets, records may come in any order, and no list of them is ever held.
    """
    mark = F.sha2(F.concat_ws("\n", "record_key", "hash"), 256)
    part = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(38,0)")
    total = lambda c: F.pmod(F.sum(c), F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias(c)
    each = hashes.select("source_id", "bucket", part(1).alias("a"), part(16).alias("b")).groupBy("source_id", "bucket").agg(F.count("*").alias("n"), total("a"), total("b"))
    wide = lambda c: F.col(c).cast("decimal(38,0)").alias(c)
    whole = each.select("source_id", "n", wide("a"), wide("b")).groupBy("source_id").agg(F.sum("n").alias("n"), total("a"), total("b")).withColumn("bucket", F.lit(WHOLE))
    large = whole.where(F.col("n") > WHOLE_RECORDS).select("source_id")
    text = F.concat_ws(":", "n", "a", "b").alias("digest")
    return whole.select("source_id", "bucket", "n", text).unionByName(each.join(large, "source_id", "left_semi").select("source_id", "bucket", "n", text))


def fingerprint(hashes: DataFrame) -> DataFrame:
    """(source_id, fingerprint): the digest of all records of each source, from (source_id, record_key, hash)."""
    return digests(bucketed(hashes)).where(F.col("bucket") == WHOLE).select("source_id", F.col("digest").alias("fingerprint"))


def differing(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From old and new DIGESTS: (source_id, n_old, n_new, equal) of each source, and (source_id, bucket) where they differ.

    Bucket WHOLE stands for a source that has digests by bucket on one side only, or on neither.
    """
    of = lambda x, name: x.select("source_id", "bucket", F.col("n").alias(f"n_{name}"), F.col("digest").alias(name))
    both = of(old, "old").join(of(new, "new"), ["source_id", "bucket"], "full_outer")
    sources = both.where(F.col("bucket") == WHOLE).select(
        "source_id", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"), F.col("old").eqNullSafe(F.col("new")).alias("equal"))
    deep = F.col("n_old").between(WHOLE_RECORDS + 1, (1 << 63) - 1) & (F.col("n_new") > WHOLE_RECORDS)
    apart = sources.where("not equal")
    whole = apart.where(~deep).select("source_id", F.lit(WHOLE).alias("bucket"))
    buckets = both.where((F.col("bucket") != WHOLE) & ~F.col("old").eqNullSafe(F.col("new"))).select("source_id", "bucket")
    return sources, whole.unionByName(buckets.join(apart.where(deep).select("source_id"), "source_id", "left_semi"))


def within(hashes: DataFrame, places: DataFrame) -> DataFrame:
    """The HASHES that lie in (source_id, bucket) places."""
    whole = hashes.join(places.where(F.col("bucket") == WHOLE).select("source_id"), "source_id", "left_semi")
    parts = hashes.join(places.where(F.col("bucket") != WHOLE), ["source_id", "bucket"], "left_semi")
    return whole.select(*HASHES.names).unionByName(parts.select(*HASHES.names))


class RecordStore:
    """HASHES and DIGESTS by run. A source's rows are those of the run that its state names; others count for nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, hashes: DataFrame, found: DataFrame, run: str) -> None:
        """HASHES and their DIGESTS as a run."""
        hashes.select(*HASHES.names).write.parquet(f"{self.path}/hashes/run={run}")
        found.select(*DIGESTS.names).write.parquet(f"{self.path}/digests/run={run}")

    def _read(self, kind: str, schema: T.StructType, named: DataFrame) -> DataFrame:
        if not names(self.spark, f"{self.path}/{kind}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField("run", _S)])).parquet(f"{self.path}/{kind}")
        return rows.join(named.select("source_id", F.col("hashes_run").alias("run")), ["source_id", "run"]).select(*schema.names)

    def hashes(self, named: DataFrame) -> DataFrame:
        """HASHES of the (source_id, hashes_run) that are named."""
        return self._read("hashes", HASHES, named)

    def digests(self, named: DataFrame) -> DataFrame:
        return self._read("digests", DIGESTS, named)

    def vacuum(self, keep: set[str]) -> None:
        for kind in ("hashes", "digests"):
            for name in names(self.spark, f"{self.path}/{kind}"):
                if name.removeprefix("run=") not in keep:
                    delete(self.spark, f"{self.path}/{kind}/{name}")
