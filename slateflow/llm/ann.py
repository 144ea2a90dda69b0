"""Nearest neighbours by a block matrix join.

Rows and queries are dealt to tiles: a tile is a part of the rows against a group of queries, and Spark brings its
queries before its rows. A task keeps the queries and streams the rows: the float32 product of a block of unit vectors
with another gives every cosine up to a bound that follows from float32's rounding. Pairs that may reach a query's best
so far are computed again on the original vectors in double precision, and each query's best are kept.
Nothing is approximate in the result: a pair is left out only when the bound rules it out.

Equal vectors are one: of equal rows the smallest ids alone can be among the nearest, and equal queries are searched once.
Vectors are equal if two hashes of 64 bits are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A part has MOST_ROWS rows at most and, without need, not fewer than ROW_BLOCK; its rows are streamed. Queries are kept
#: in memory, so a group has QUERY_BLOCK of them and QUERY_VALUES components at most. A row is shuffled once for each
#: group, a query once for each part.
ROW_BLOCK, MOST_ROWS, QUERY_BLOCK, QUERY_VALUES = 4096, 524_288, 262_144, 1 << 24
#: Rows and queries of one product.
TILE_ROWS, TILE_QUERIES = 4096, 512
#: Pairs that are computed again at a time.
PAIRS = 1 << 16

_TILE = ["tile", "dim", "side", "h", "g", "vec_id", "embedding"]


def _sums(x: np.ndarray) -> np.ndarray:
    """Row sums in order of the components, so that a pair's cosine has the same last bit in every tile."""
    return np.add.accumulate(x, axis=1)[:, -1]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles by a power of two, which changes no cosine, so that squares stay in range. Floats stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if x.dtype == np.float64 else x


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and unit vectors as float32."""
    x = x.astype(np.float64)
    n = np.sqrt(_sums(x * x))
    return n, (x / n[:, None]).astype(np.float32)


def _places(hits: np.ndarray) -> np.ndarray:
    """Where a long array of few hits is true; eight at a time are ruled out."""
    whole = len(hits) // 8 * 8
    some = (np.flatnonzero(hits[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[some[hits[some]], whole + np.flatnonzero(hits[whole:])]


class _Tile:
    """Queries of one group and length, and the k best ids of each among the rows that were offered."""

    def __init__(self, dim: int, k: int, rows: int, queries: int):
        self.k, self.rows, self.queries, self.parts, self.ready = k, rows, queries, [], False
        #: Float32 products of unit vectors: the components' rounding and that of the sum, in whatever order it is taken.
        self.err = 1.01 * (dim + 8) * 2.0**-24

    def ask(self, h: np.ndarray, g: np.ndarray, x: np.ndarray) -> None:
        x = _scaled(x)
        self.parts.append((h, g, x, *_units(x)))

    def start(self) -> None:
        self.h, self.g, self.x, self.n, self.unit = (np.concatenate(p) for p in zip(*self.parts))
        self.parts, self.ready = [], True
        self.near, self.hits = np.empty(self.queries * self.rows, dtype=np.float32), np.empty(self.queries * self.rows, dtype=bool)
        self.best, self.who = np.full((len(self.h), self.k), -np.inf), np.zeros((len(self.h), self.k), dtype=np.int64)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.ready:
            if not self.parts:
                return
            self.start()
        new = np.r_[True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)]  # equal rows lie side by side
        ids, x = ids[new], _scaled(x[new])
        n, unit = _units(x)
        for lo in range(0, len(ids), self.rows):
            s = slice(lo, lo + self.rows)
            self._product(ids[s], x[s].astype(np.float64), n[s], unit[s])

    def _product(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray, unit: np.ndarray) -> None:
        least = np.nextafter((self.best[:, -1] - self.err).astype(np.float32), np.float32(-np.inf))
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        found, count = [], 0
        for lo in range(0, len(self.h), self.queries):
            asked = self.unit[lo : lo + self.queries]
            near = np.matmul(asked, unit.T, out=self.near[: len(asked) * len(unit)].reshape(len(asked), -1))
            floor = least[lo : lo + self.queries]
            if len(first) >= self.k and np.isneginf(floor).any():  # nothing is known yet: the k-th best id of this block
                by_id = near if len(first) == len(ids) else np.maximum.reduceat(near[:, order], first, axis=1)
                kth = np.partition(by_id, -self.k, axis=1)[:, -self.k].astype(np.float64) - 2 * self.err
                floor = np.maximum(floor, np.nextafter(kth.astype(np.float32), np.float32(-np.inf)))
            hit = _places(np.greater_equal(near, floor[:, None], out=self.hits[: near.size].reshape(near.shape)).ravel())
            if len(hit):
                found.append((lo + hit // len(ids), hit % len(ids)))
                count += len(hit)
            if count > PAIRS:
                self._keep(found, ids, x, n)
                found, count = [], 0
        if found:
            self._keep(found, ids, x, n)

    def _keep(self, found: list, ids: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
        """Pairs of query and row, again in double precision, among each query's best; an id counts with its best vector."""
        q, r = (np.concatenate(p) for p in zip(*found))
        for lo in range(0, len(q), PAIRS):
            i, j = q[lo : lo + PAIRS], r[lo : lo + PAIRS]
            score = _sums(x[j] * self.x[i].astype(np.float64)) / (n[j] * self.n[i])
            good = score >= self.best[i, -1]
            if not good.any():
                continue
            i, v, score = i[good], ids[j[good]], score[good]
            old = np.unique(i)
            has = ~np.isneginf(self.best[old])
            i = np.r_[np.broadcast_to(old[:, None], has.shape)[has], i]
            v, score = np.r_[self.who[old][has], v], np.r_[self.best[old][has], score]
            o = np.lexsort((-score, v, i))
            o = o[np.r_[True, (i[o][1:] != i[o][:-1]) | (v[o][1:] != v[o][:-1])]]
            i, v, score = i[o], v[o], score[o]
            o = np.lexsort((v, -score, i))
            i, v, score = i[o], v[o], score[o]
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            nth = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            top = nth < self.k
            self.best[i[top], nth[top]], self.who[i[top], nth[top]] = score[top], v[top]

    def result(self):
        if self.ready:
            q, nth = np.nonzero(~np.isneginf(self.best))
            for lo in range(0, len(q), PAIRS):
                i, m = q[lo : lo + PAIRS], nth[lo : lo + PAIRS]
                yield pa.RecordBatch.from_pydict({"h": self.h[i], "g": self.g[i], "vec_id": self.who[i, m], "score": self.best[i, m]})


def _scan(k: int):
    rows, queries = TILE_ROWS, TILE_QUERIES

    def run(batches):
        at, tile = None, None
        for batch in batches:
            key, dim, side, h, g, ids = (batch.column(c).to_numpy() for c in _TILE[:-1])
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (dim[1:] != dim[:-1]) | (side[1:] != side[:-1])]) if len(ids) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
                if at != (key[lo], dim[lo]):
                    if tile:
                        yield from tile.result()
                    at, tile = (key[lo], dim[lo]), _Tile(int(dim[lo]), k, rows, queries)
                x = batch.column("embedding").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, dim[lo])
                if side[lo]:
                    tile.offer(ids[lo:hi], x)
                else:
                    tile.ask(h[lo:hi], g[lo:hi], x)
        if tile:
            yield from tile.result()

    return run


def _grid(rows: tuple[int, int], asked: tuple[int, int], parts: int) -> tuple[int, int]:
    """Parts of the rows and groups of the queries, from the number and the components of each."""
    groups = max(1, -(-asked[0] // QUERY_BLOCK), -(-asked[1] // QUERY_VALUES))
    # As many parts as fill the partitions, as long as the queries' copies stay below half of the rows.
    fill = min(-(-rows[0] // ROW_BLOCK), -(-parts // groups), rows[1] // max(1, 2 * asked[1]))
    return max(1, -(-rows[0] // MOST_ROWS), fill), groups


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, ties to the smaller vec_id.

    Both frames have vec_id and embedding, and other columns are ignored. Null ids and vectors that are null,
    empty, zero or hold a null or non-finite component take no part; vectors of different lengths are not
    compared. Every other row counts: an id with several vectors, on either side, is as near as its nearest.
    Equal rows count once. Components may be of any finite size: vectors of doubles are scaled by a power of two
    before they are squared. A query whose id is the only one gets no row; an empty table gives none.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"

    def size(df: DataFrame) -> tuple[int, int]:
        n, values = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("embedding"), F.lit(0))), F.lit(0))).first()
        return n, values

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
        odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
        v = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", odd) & F.exists("embedding", lambda e: e != 0))
        return v.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))

    n_parts, n_groups = _grid(size(vectors), size(queries), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A query's own id may be among its k + 1 best, so k are left without it; of equal vectors, k + 1 ids can be among them.
    same = Window.partitionBy("h", "g").orderBy("vec_id")
    rows = clean(vectors).withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1)
    asked = clean(queries)

    def side(df: DataFrame, n: int, part: Column, group: Column) -> DataFrame:
        df = df.withColumn("part", part).withColumn("group", group)
        return df.select((F.col("group") * n_parts + F.col("part")).cast("int").alias("tile"), F.size("embedding").alias("dim"), F.lit(n).alias("side"), "h", "g", "vec_id", "embedding")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tiles = side(asked.dropDuplicates(["h", "g"]), 0, every(n_parts), F.pmod("h", F.lit(n_groups)))
    tiles = tiles.unionAll(side(rows, 1, F.pmod(F.xxhash64("vec_id", "h"), F.lit(n_parts)), every(n_groups)))
    tiles = tiles.repartitionById(n_parts * n_groups, F.col("tile")).sortWithinPartitions("tile", "dim", "side", "h", "g", "vec_id")
    best = tiles.mapInArrow(_scan(k + 1), "h long, g long, vec_id long, score double")
    best = best.groupBy("h", "g", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("h", "g").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1).drop("rank")
    members = asked.select("h", "g", F.col("vec_id").alias("query_id")).distinct()
    best = members.join(best, ["h", "g"]).where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_block_join(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 50 == 0), 5)
