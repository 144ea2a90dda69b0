"""Vectors as short codes: each part of a vector becomes the number of its nearest codebook entry, by Yinyang Lloyd rounds.

1. Vectors lie in blocks, as matrices of integers. A block keeps with it, for each part of each vector, the
   entry that it is assigned to, an upper bound of the distance to it, and a lower bound for each group of
   entries: no entry of the group but the assigned one is nearer than that.
2. The entries of a part's codebook are clustered into groups once. When entries have moved, upper bounds grow
   by the drift of their entry and lower bounds shrink by the largest drift of their group. Only groups whose
   bound fails then are scanned, with exact integer distances, which decide ties too. Bounds are rounded
   outwards, so none can hide an entry that is as near.
3. Each block sums its parts by entry; Spark adds the sums, and only those, one row for each component of the
   codebooks, reach the driver, which makes the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_totals, materialize, tune

#: Steps of a component's unit, parts of a vector, entries of a part's codebook, and Lloyd rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Groups of entries that share a lower bound.
GROUPS = 4
#: Vectors of a block.
BLOCK_ROWS = 1024

_BLOCK = "dim int, n int, ids array<long>, labels array<string>, ints binary, codes binary, upper binary, lower binary, sums array<long>, asked long"


def largest(dim: int) -> int:
    """The largest integer component of which a squared distance fits a long, whatever the other vector is."""
    return min(math.isqrt((2**63 - 1) // (4 * max(dim, 1))), 2**31 - 1)


def cuts(dim: int) -> list[int]:
    """Where the parts of a vector begin, and its end; if `dim` can't be divided, the last parts are shorter."""
    w = -(-dim // PARTS)
    return [min(i * w, dim) for i in range(PARTS + 1)]


def blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of integer vectors of one length each, from (vec_id, label, embedding), without vectors that are null or hold null or non-finite components."""
    tune(vectors.sparkSession)

    def run(frames):
        held: dict[int, list] = {}

        def close(dim):
            ids, labels, rows = zip(*held.pop(dim))
            ints = np.array(rows, dtype=np.int32).reshape(len(rows), dim)
            return pd.DataFrame([(dim, len(ids), list(ids), list(labels), ints.tobytes(), None, None, None, None, None)], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for pdf in frames:
            for i, label, e in zip(pdf["vec_id"], pdf["label"], pdf["embedding"]):
                if e is None:
                    continue
                e = np.asarray(e, dtype=np.float64)  # a null component is NaN
                with np.errstate(over="ignore", invalid="ignore"):
                    e = np.floor(e * SCALE)
                if not (np.abs(e) <= largest(len(e))).all():
                    continue
                held.setdefault(len(e), []).append((None if i is None else int(i), label, e))
                if len(held[len(e)]) == BLOCK_ROWS:
                    yield close(len(e))
        for dim in list(held):
            yield close(dim)

    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("string").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(run, _BLOCK)


# ---------------------------------------------------------------- bounds


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds from seeds that lie far from one another."""
    c = entries.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(GROUPS, len(c)):
        seeds.append(int(np.argmax(((c[:, None] - c[seeds]) ** 2).sum(axis=2).min(axis=1))))
    centres = c[seeds]
    for _ in range(5):
        group = ((c[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([c[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(len(centres))])
    return group


@dataclass
class Book:
    """A part's codebook, the groups of its entries, and how far each entry moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Book:
        """Each entry at the floor of its parts' mean; unused ones stay. `sums` and `counts` hold integers of any size."""
        new = self.entries.copy()
        for j, n in enumerate(counts):
            if n:
                new[j] = [int(s) // int(n) for s in sums[j]]
        far = np.sqrt(((new.astype(np.float64) - self.entries) ** 2).sum(axis=1)) * (1 + 1e-9)
        return Book(new, self.group, far)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from rows of c, as integers: by a matrix product of doubles where that is exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * max(x.shape[1], 1) * most * most < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for j in range(len(c)):
        out[:, j] = own(x, c[j])
    return out


def own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of x from its row of c."""
    d = x.astype(np.int64) - c
    return (d * d).sum(axis=1)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, book: Book, state: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper bound, lower bounds by group) of each row of x, and the number of distances that were computed.

    state: the same before the entries moved; None scans all groups. Of equally near entries the first is taken.
    """
    n, n_groups, c = len(x), int(book.group.max(initial=0)) + 1, book.entries
    members = [np.flatnonzero(book.group == g) for g in range(n_groups)]
    if state is None:
        entry, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, n_groups))
        left, best, asked = np.arange(n), own(x, c[np.zeros(n, dtype=np.int64)]), n
    else:
        entry = state[0].astype(np.int64)
        upper = state[1].astype(np.float64) + book.drift[entry]
        lower = np.maximum(state[2] - np.array([book.drift[m].max(initial=0) for m in members]), 0)
        left = np.flatnonzero(upper >= lower.min(axis=1))
        best = own(x[left], c[entry[left]])
        asked = len(left)
        upper[left] = _above(np.sqrt(best))
        still = upper[left] >= lower[left].min(axis=1)
        left, best = left[still], best[still]
    before, old = entry[left], best.copy()
    least = [None] * n_groups
    reach = np.full(len(left), np.inf) if state is None else upper[left]
    new = before.copy()
    for g, m in enumerate(members):
        near = np.flatnonzero(lower[left, g] <= reach)
        if not len(near) or not len(m):
            continue
        d = squared(x[left[near]], c[m])
        asked += d.size
        first = d.argmin(axis=1)
        low = d[np.arange(len(near)), first]
        d[np.arange(len(near)), first] = np.iinfo(np.int64).max
        least[g] = near, m[first], low, d.min(axis=1) if len(m) > 1 else np.full(len(near), -1)
        better = (low < best[near]) | ((low == best[near]) & (m[first] < new[near]))
        best[near[better]], new[near[better]] = low[better], m[first][better]
    # An unscanned group gets the entry that was left behind; a scanned one has its nearest entry, or the second if the nearest is assigned.
    gone = np.flatnonzero(new != before)
    g = book.group[before[gone]]
    lower[left[gone], g] = np.minimum(lower[left[gone], g], np.sqrt(old[gone]))
    for g, found in enumerate(least):
        if found is not None:
            near, first, low, second = found
            rest = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0)))
            lower[left[near], g] = np.where(first == new[near], rest, np.sqrt(low))
    entry[left], upper[left] = new, np.sqrt(best)
    return entry, _above(upper), _below(lower), asked


# ---------------------------------------------------------------- rounds


def _parts_of_block(dim: int, n: int, ints: bytes) -> list[np.ndarray]:
    x = np.frombuffer(ints, dtype=np.int32).reshape(n, dim).astype(np.int64)
    at = cuts(dim)
    return [x[:, lo:hi] for lo, hi in zip(at, at[1:])]


def _states(n: int, books: list[Book], codes: bytes | None, upper: bytes | None, lower: bytes | None) -> list[tuple | None]:
    if codes is None:
        return [None] * PARTS
    a, u = np.frombuffer(codes, dtype=np.uint8).reshape(PARTS, n), np.frombuffer(upper, dtype=np.float32).reshape(PARTS, n)
    widths = [n * (int(b.group.max(initial=0)) + 1) for b in books]
    flat, at = np.frombuffer(lower, dtype=np.float32), np.r_[0, np.cumsum(widths)]
    return [(a[p], u[p], flat[at[p] : at[p + 1]].reshape(n, -1)) for p in range(PARTS)]


def assigned(rows: DataFrame, books: list[Book]) -> DataFrame:
    """Blocks with entries, bounds, sums of parts and rows by entry, and the number of distances that were `asked` for."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                out, sums, counts = [], [], []
                parts = _parts_of_block(row.dim, row.n, row.ints)
                for x, book, state in zip(parts, books, _states(row.n, books, row.codes, row.upper, row.lower)):
                    out.append(assign(x, book, state))
                    entry = out[-1][0]
                    s = np.zeros((len(book.entries), x.shape[1]), dtype=np.int64)
                    np.add.at(s, entry, x)
                    sums.append(s.ravel())
                    counts.append(np.bincount(entry, minlength=len(book.entries)))
                told = row._asdict() | {
                    "codes": b"".join(a.astype(np.uint8).tobytes() for a, *_ in out), "upper": b"".join(u.tobytes() for _, u, *_ in out), "lower": b"".join(lo.tobytes() for _, _, lo, _ in out),
                    "sums": np.concatenate([*sums, *counts]), "asked": sum(o[3] for o in out),
                }
                yield pd.DataFrame([told])

    return rows.mapInPandas(run, _BLOCK)


def moved(rows: DataFrame, books: list[Book]) -> list[Book]:
    """The next codebooks: sums over all blocks, as many rows as the codebooks have components and entries."""
    total = rows.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    flat = np.array([int(r["s"]) for r in sorted(total.collect(), key=lambda r: r["i"])], dtype=object)
    out, at, count_at = [], 0, sum(b.entries.size for b in books)
    for b in books:
        k, d = b.entries.shape
        out.append(b.moved(flat[at : at + k * d].reshape(k, d), flat[count_at : count_at + k]))
        at, count_at = at + k * d, count_at + k
    return out


def coded(rows: DataFrame, books: list[Book]) -> DataFrame:
    """(vec_id, label, code, error) of every vector of assigned blocks."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                entry = np.frombuffer(row.codes, dtype=np.uint8).reshape(PARTS, row.n)
                error = sum(own(x, b.entries[a]) for x, b, a in zip(_parts_of_block(row.dim, row.n, row.ints), books, entry))
                yield pd.DataFrame({"vec_id": pd.array(list(row.ids), dtype="Int64"), "label": list(row.labels), "code": [bytes(c).hex() for c in entry.T.copy()], "error": error})

    return rows.select("dim", "n", "ids", "labels", "ints", "codes").mapInPandas(run, "vec_id long, label string, code string, error long")


def first_books(rows: DataFrame, dim: int) -> list[Book]:
    """Codebooks of the parts of the ENTRIES vectors with the smallest ids; of one id the smaller vector comes first, null ids last."""

    def unpack(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.ints, dtype=np.int32).reshape(row.n, row.dim)
                key = [(i is None, i or 0) for i in row.ids]
                last = sorted(key)[: ENTRIES][-1]
                at = sorted((i for i in range(row.n) if key[i] <= last), key=lambda i: (key[i], x[i].tolist()))[:ENTRIES]
                yield pd.DataFrame({"vec_id": pd.array([row.ids[i] for i in at], dtype="Int64"), "x": [x[i].tolist() for i in at]})

    least = rows.select("dim", "n", "ids", "ints").mapInPandas(unpack, "vec_id long, x array<int>")
    got = least.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    x = np.array([r["x"] for r in got], dtype=np.int64).reshape(len(got), dim)
    at = cuts(dim)
    return [Book(e, grouped(e), np.zeros(len(e))) for e in (x[:, lo:hi] for lo, hi in zip(at, at[1:]))]


def trained(vectors: DataFrame) -> tuple[DataFrame, list[Book]] | None:
    """Blocks assigned to the last codebooks, and those; None where no vector can be used."""
    rows = materialize(blocks(vectors), "blocks")
    kept = rows.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if kept is None:
        return None
    rows = rows.where(F.col("dim") == kept["dim"])
    books = first_books(rows, kept["dim"])
    before = None
    for k in range(ROUNDS + 1):
        new = materialize(assigned(rows, books), "assigned")
        if before is not None:
            discard(before)
        rows = before = new
        if k < ROUNDS:
            books = moved(rows, books)
    return rows, books


def books_digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector of (vec_id, label, embedding) that can be used.

    Vectors that are null or hold null or non-finite components are left out. So are those with a component
    beyond largest(), where a squared distance fits no long (for 64 components 46,340 after
    division by SCALE), and those of another length than most, the longer of equally many. Fewer than ENTRIES
    vectors make codebooks of as many entries; repeated rows count each; null ids come last among the first
    entries; null labels are one label. Of a length that PARTS doesn't divide the last parts are shorter, also
    empty. An empty table gives no rows; other columns are ignored.
    """
    found = trained(vectors)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = materialize(coded(*found), "codes")
    totals = materialize(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("rows")), "totals")
    out = join_totals(rows, totals, "label", "rows")
    return out.select("vec_id", "code", "error", F.expr("try_cast(label_error as bigint)").alias("label_error"), F.lit(books_digest(found[1])).alias("codebooks_sha256"))


def op12_yinyang(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return compress(vectors)
