"""Helpers shared by the training-data operators: shared storage, word splitting, hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Documents are long, so far fewer than Spark's default of 10,000.
BATCH_ROWS, BATCH_BYTES = 256, "16m"


#: Our own folder, set only where spark.checkpoint.dir is unset.
_OWN: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches, so that a Python worker holds a few MB of text at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not base:
        if spark.sparkContext.master.startswith(("local[", "local")) and not spark.sparkContext.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="slateflow-")
            atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_slateflow_work"
        _OWN["dir"] = base
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/slateflow/{name}-{uuid.uuid4().hex}"


#: Intermediate tables have small row groups and pages, also of few long rows, so that neither writing nor reading holds many of those.
_WRITING = {
    "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1000",
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1000",
}


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**_WRITING).option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._slateflow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and nothing needs any more."""
    path = getattr(df, "_slateflow_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are done: it does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def parts_of(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_totals(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `totals`, which has one row for each `key` and its number of rows in `count`. Nulls are a key.

    A key of more than a thousandth of all rows is one of a thousand at most: those are broadcast, so that no
    task gets a hot key's rows, and the others are joined by a shuffle. `totals` is a written table.
    """
    all_rows = totals.agg(F.sum(count).alias("n")).first()["n"] or 0
    totals = totals.withColumnRenamed(key, "_key")
    hot = totals.where(F.col(count) * 1000 > all_rows)
    same = rows[key].eqNullSafe(F.col("_key"))
    out = rows.join(F.broadcast(hot), same).drop("_key")
    rest = rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(totals.where(F.col(count) * 1000 <= all_rows), same).drop("_key")
    return out.unionByName(rest)


_WORKER: dict = {}


def worker_memory(key, make):
    """What a Python worker keeps from task to task: one thing only, so that operators run one after another don't add up."""
    if key not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # give free memory back to the system, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
        _WORKER[key] = make()
    return _WORKER[key]


class HashTable:
    """Numbers for up to `most` distinct hashes, in order of their coming: an open table in two arrays. 0 is no hash."""

    def __init__(self, most: int):
        self.most, self.bits = most, (4 * most).bit_length() - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.numbers = np.zeros(1 << self.bits, dtype=np.int32)
        self.count = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that aren't there."""
        out = np.full(len(h), -1, dtype=np.int64)
        left, slot, last = np.arange(len(h)), self._slots(h), (1 << self.bits) - 1
        while len(left):
            at = self.keys[slot]
            hit = at == h[left]
            out[left[hit]] = self.numbers[slot[hit]]
            go = ~hit & (at != 0)
            left, slot = left[go], (slot[go] + 1) & last
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct hashes that aren't there, from `count` on."""
        left, slot, last = np.arange(len(h)), self._slots(h), (1 << self.bits) - 1
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]  # of several that want a slot one gets it
            done = free & (self.keys[slot] == h[left])
            self.numbers[slot[done]] = self.count + left[done]
            left, slot = left[~done], (slot[~done] + 1) & last
        self.count += len(h)

    def unseen(self, h: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distinct hashes of h without a number, a place of each, and whether the table had to be emptied to make room: then all of h are."""
        new, where = np.unique(h[found < 0], return_index=True)
        if not len(new) or self.count + len(new) <= self.most:
            return new, np.flatnonzero(found < 0)[where], False
        self.clear()
        return *np.unique(h, return_index=True), True


# ---------------------------------------------------------------- words and hashes

#: Odd multipliers for combining the hashes of consecutive words: powers of one odd constant.
_STEP = 0x9E3779B97F4A7C15
MULTIPLIERS = np.array([pow(_STEP, 2 * i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8: bytes.split() cuts at exactly those six characters; bytes.lower() maps A-Z only."""
    raw = utf8(text) or b""
    return (raw.lower() if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


# ---------------------------------------------------------------- words of whole blocks of text

#: Bytes of text that are taken at once; a longer text is cut between words.
BLOCK_BYTES = 1 << 20
_SEGMENT = 1 << 16
SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int) -> np.ndarray:
    """base ** 0 to base ** _SEGMENT modulo 2 ** 64."""
    out = np.full(_SEGMENT + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, or of hashes, whatever its place: a polynomial modulo 2 ** 64, mixed. Ends don't decrease."""
    letters = (lambda x: _LETTER[x]) if buf.dtype == np.uint8 else (lambda x: x)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _SEGMENT, "right"))
        if j <= i:  # one span longer than a segment
            h, scale = 0, 1
            for at in range(lo, int(ends[i]), _SEGMENT):
                part = letters(buf[at : min(at + _SEGMENT, int(ends[i]))])
                h += int((part * _POWERS[: len(part)]).sum(dtype=np.uint64)) * scale
                scale = scale * int(_POWERS[_SEGMENT]) % (1 << 64)
            out[i] = h % (1 << 64)
            i += 1
            continue
        n = int(ends[j - 1]) - lo
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letters(buf[lo : lo + n]) * _POWERS[:n], out=total[1:])
        a = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[a]) * _INVERSES[a]
        i = j
    out = mix64(out + (ends - starts).astype(np.uint64) * MULTIPLIERS[1])
    out[out == 0] = 1  # 0 is for no hash
    return out


def byte_blocks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """(bytes with white space at both ends, which texts are in it, where each begins): whole short texts, or a part of a long one."""
    parts: list[bytes] = []
    who: list[int] = []
    size = 0

    def close():
        at = np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1].tolist()
        return np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", dtype=np.uint8), list(who), at

    for i, raw in enumerate(texts):
        raw = raw or b""
        lo = 0
        while True:
            hi = len(raw)
            if hi - lo > BLOCK_BYTES:
                hi = max(raw.rfind(bytes([c]), lo, lo + BLOCK_BYTES) for c in SPACES) + 1
                if hi <= lo:  # no white space in so many bytes
                    hi = min((k for k in (raw.find(bytes([c]), lo) for c in SPACES) if k >= 0), default=len(raw) - 1) + 1
            if parts and size + hi - lo > BLOCK_BYTES:
                yield close()
                parts, who, size = [], [], 0
            parts.append(raw[lo:hi])
            who.append(i)
            size += hi - lo
            lo = hi
            if lo >= len(raw):
                break
    if parts:
        yield close()


def utf8(text: str | None) -> bytes | None:
    return None if text is None else text.encode("utf-8", "surrogatepass")


def block_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words `[^\\x20\\x09-\\x0D]+` of a block begin and end."""
    space = _IS_SPACE[buf]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    return turn[0::2], turn[1::2]


def texts_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and how many words each text has."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    for buf, who, at in byte_blocks(texts):
        starts, ends = block_words(buf)
        hashes.append(span_hashes(buf, starts, ends))
        np.add.at(counts, who, np.diff(np.r_[np.searchsorted(starts, at), len(starts)]))
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), counts


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes, in order of place; empty for fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.full(n, seed, dtype=np.uint64)
    for i in range(k):
        acc += h[i : i + n] * MULTIPLIERS[i]
    return mix64(acc)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """For each text, lower-cased, the sorted distinct hashes of its k-word shingles; fewer words make one shingle; none make the empty set."""
    h, counts = texts_words([t and t.lower() for t in texts])  # bytes.lower() maps A-Z only
    grams = gram_hashes(h, k)
    out, at = [], 0
    for n in counts.tolist():
        out.append(distinct(grams[at : at + n - k + 1]) if n >= k else gram_hashes(h[at : at + n], max(n, 1), seed=n))
        at += n
    return out


# ---------------------------------------------------------------- connected components


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of edges (a, b) but the smallest of its component, with that smallest one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    to = np.arange(len(names))
    while True:
        low, high = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
        if (low == high).all():
            away = to != np.arange(len(names))
            return names[away], names[to[away]]
        np.minimum.at(to, high, low)
        while not (to[to] == to).all():
            to = to[to]


def _contract(frames):
    """Edges (u, v) of a partition, a bounded part of them at a time, as one edge for each node, to its smallest there."""
    held, n = [], 0

    def close():
        u, v = roots(*(np.concatenate(x) for x in zip(*held)))
        return pd.DataFrame({"u": u, "v": v})

    for pdf in frames:
        held.append((pdf["u"].to_numpy(), pdf["v"].to_numpy()))
        n += len(pdf)
        if n > 2_000_000:
            yield close()
            held, n = [], 0
    if n:
        yield close()


def components(edges: DataFrame, native: bool = False) -> DataFrame:
    """(node, component) for undirected edges (a, b): component is the smallest node reachable.

    Each partition first contracts its own edges of numbers, unless `native` asks for DataFrame operations
    alone; then alternating large-star and small-star rounds, joins
    and aggregates only, each written to the shared folder. Nulls and self-loops are dropped; nodes without
    another end don't appear. A hub's edges meet its minimum in a join, which AQE splits where the hub's
    partition is beyond its size, never in one collected group.
    """
    a, b = F.col("a"), F.col("b")
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialize(e.distinct() if native else e.mapInPandas(_contract, "u long, v long"), "cc")
    state = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == state:
            roots_ = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots_)
        state = (mark["n"], mark["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))), "cc")
        discard(e)
        e = new
