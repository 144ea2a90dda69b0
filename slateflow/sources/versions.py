"""Tables that are replaced by versions, what belongs together in a commit, and small files, in any file system that Spark reaches.

Writers add beside what is there and never change it. What counts is named by a record that is written last:
a version by its job's success file, a bucket table by its manifest, several of them together by a commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(found: list[str], end: str = "") -> list[int]:
    return sorted(int(n[2 : len(n) - len(end)]) for n in found if n.startswith("v=") and n.endswith(end) and n[2 : len(n) - len(end)].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, in order."""
    return [n for n in _numbers(names(spark, path)) if exists(spark, f"{path}/v={n}/_SUCCESS")]


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A version of a table, the newest complete one unless it is named; an empty table where there is none."""
    if version is None:
        version = (versions(spark, path) or [None])[-1]
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{path}/v={version}")


def write_version(df: DataFrame, path: str, keep: int | None = 2) -> int:
    """Write a new version beside the others; `keep`: drop all but the last so many, None drops none.

    A version counts once its job has committed, so a reader sees the old table or the new one, and a crash
    leaves the old one. The new version may be computed from the one before. Of two writers that take one
    number at the same time the later fails. A reader that still holds a dropped version fails too: keep as
    many as readers may lag behind.
    """
    spark = df.sparkSession
    found = versions(spark, path)
    n = max(_numbers(names(spark, path)), default=-1) + 1  # past what a crash has left
    df.write.mode("errorifexists").parquet(f"{path}/v={n}")
    for old in found[: max(0, len(found) + 1 - keep)] if keep else []:
        delete(spark, f"{path}/v={old}")
    return n


# ---------------------------------------------------------------- bucket tables


class BucketTable:
    """A table with one row for each key, in hash buckets: an update writes the buckets that it touches.

    A version is a manifest that names each bucket's folder, so versions share what they have in common.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return _numbers(names(self.spark, f"{self.path}/manifests"), ".json")

    def _folders(self, version: int | None) -> dict[int, str]:
        if version is None:
            version = (self.versions() or [None])[-1]
        if version is None:
            return {}
        manifest = json.loads(read_text(self.spark, f"{self.path}/manifests/v={version}.json"))
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {manifest['buckets']} buckets, not {self.buckets}")
        return {int(b): folder for b, folder in manifest["folders"].items()}

    def _read(self, folders) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in sorted(set(folders))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, of the newest unless it is named."""
        return self._read(self._folders(version).values())

    def upsert(self, rows: DataFrame, version: int | None = None) -> int:
        """A new version: that of `version` (the newest unless it is named) with `rows` in place of the rows of their keys."""
        folders = self._folders(version)
        rows = rows.select(*self.schema.names).persist()
        try:
            touched = {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # one number a bucket
            old = self._read([folders[b] for b in touched if b in folders]).join(rows.select(self.key), self.key, "left_anti").select(*self.schema.names)
            return self._write(old.unionByName(rows), touched, {b: f for b, f in folders.items() if b not in touched})
        finally:
            rows.unpersist()

    def replace(self, rows: DataFrame) -> int:
        """A new version that has `rows` alone."""
        return self._write(rows.select(*self.schema.names), set(range(self.buckets)), {})

    def _write(self, rows: DataFrame, touched: set[int], folders: dict[int, str]) -> int:
        if touched:
            w = uuid.uuid4().hex
            rows.withColumn("bucket", self._bucket()).repartition(min(self.buckets, max(1, len(touched))), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{w}")
            written = names(self.spark, f"{self.path}/data/{w}")
            folders = folders | {b: f"{w}/bucket={b}" for b in touched if f"bucket={b}" in written}
        n = max(self.versions(), default=-1) + 1
        write_new(self.spark, f"{self.path}/manifests/v={n}.json", json.dumps({"buckets": self.buckets, "folders": folders}))
        return n

    def vacuum(self, keep: set[int]) -> None:
        """Drop all versions but `keep`, and folders that none of those names."""
        used = {f for n in keep for f in self._folders(n).values()}
        for n in self.versions():
            if n not in keep:
                delete(self.spark, f"{self.path}/manifests/v={n}.json")
        for w in names(self.spark, f"{self.path}/data"):
            buckets = [b for b in names(self.spark, f"{self.path}/data/{w}") if b.startswith("bucket=")]
            kept = [b for b in buckets if f"{w}/{b}" in used]
            for gone in [f"{w}/{b}" for b in buckets if b not in kept] if kept else [w]:
                delete(self.spark, f"{self.path}/data/{gone}")


class Commits:
    """Numbered records of which versions belong together. The newest is the truth: it is written last, whole, and once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        return _numbers(names(self.spark, self.path), ".json")

    def read(self, n: int | None = None) -> dict:
        """A commit, the newest unless it is named; an empty record where there is none."""
        if n is None:
            n = (self.numbers() or [None])[-1]
        return {} if n is None else json.loads(read_text(self.spark, f"{self.path}/v={n}.json"))

    def write(self, record: dict, after: int) -> int:
        """The commit after number `after` (-1: the first); fails if another writer has made it."""
        write_new(self.spark, f"{self.path}/v={after + 1}.json", json.dumps(record, sort_keys=True))
        return after + 1

    def last(self) -> int:
        return max(self.numbers(), default=-1)


# ---------------------------------------------------------------- small files


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole or not at all, and never in place of another: written aside and renamed."""
    p, fs = _fs(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, aside, text)
    if fs.exists(p) or not fs.rename(_fs(spark, aside)[0], p):
        delete(spark, aside)
        raise FileExistsError(f"another writer has made {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None where it doesn't exist."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def write_json(spark: SparkSession, path: str, value) -> None:
    """Indented, keys sorted, ASCII, a newline at the end."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=True, sort_keys=True) + "\n")
