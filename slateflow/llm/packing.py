"""Best-fit packing of tokenized documents by large-item matching.

Pieces above one third of the capacity pair at most twice per bin by greedy matching, the largest with
the largest that still fits; smaller pieces then go, largest first, to the smallest gap that holds them.
Both steps run over the histogram of lengths (at most `capacity` entries), so the plan's size doesn't
depend on the number of documents; every piece finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, HashTable, block_words, byte_blocks, materialize, span_hashes, tune, worker_memory

CAPACITY = 4096
END_ID = 1
#: Where the pieces of one length in one part begin is told to all tasks up to so many rows of it, and joined beyond.
TOLD_ROWS = 200_000


#: The steps before the merges that TextTokens takes by itself, as written in a tokenizer's file.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

# Kinds of bytes: white space, letters, digits, signs, and what only the tokenizer itself may read: apostrophes,
# which begin contractions, control characters, and letters beyond U+00FF.
_SPACE, _ALPHA, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[33:127] = _SIGN
_KIND[list(SPACES)] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _ALPHA
_KIND[39] = _OTHER
#: The second byte of U+00C0 to U+00FF but for the two signs among them; those below 0x9F are upper case.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def units(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block, where its units begin and end, and which units are whole chunks.

    White space is dropped and nothing joins across it. A chunk between white space whose normal form is
    itself and whose lower case is one letter for one falls into pre-tokens: runs of letters, single digits
    and runs of signs. Any other chunk is one unit, its bytes unchanged.
    """
    kind = _KIND[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    second = buf[lead + 1]
    latin = lead[_LATIN[second]]
    kind[latin] = kind[latin + 1] = _ALPHA
    kind[np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))] = _OTHER  # which special tokens begin with
    low = buf + 32 * ((buf >= 65) & (buf <= 90)).astype(np.uint8)
    low[latin + 1] += 32 * (buf[latin + 1] < 0x9F).astype(np.uint8)
    if (kind == _OTHER).any():
        a, b = block_words(buf)
        odd = np.add.reduceat(kind == _OTHER, np.c_[a, b].ravel())[::2] > 0
        edge = np.zeros(len(buf) + 1, dtype=np.int8)
        edge[a[odd]] = 1
        edge[b[odd]] = -1
        odd = np.cumsum(edge[:-1], dtype=np.int8) > 0
        kind[odd] = _OTHER
        low[odd] = buf[odd]
    turn = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
    of = kind[turn]
    ends = np.r_[turn[1:], len(buf)]
    keep = of != _SPACE
    return low, turn[keep], ends[keep], of[keep] == _OTHER


class TextTokens:
    """A tokenizer's ids of whole texts, with the ids of up to `most` units remembered in a table by hash.

    The units are those of one pair of normalizer and pre-tokenizer; for a tokenizer with other steps, each
    text goes through the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        steps = json.loads(self.tokenizer.to_str())
        self.known = {k: steps[k] for k in _STEPS} == _STEPS and steps["model"]["type"] == "BPE"
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.table = HashTable(most)
        self.clear()

    def clear(self) -> None:
        self.first, self.often = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat, self.used = np.zeros(4096, dtype="<u4"), 0

    def learn(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """Remember units with distinct hashes that are not in the table."""
        at, n, flat = self.table.count, len(h), np.fromiter(chain.from_iterable(ids), dtype="<u4")
        while at + n > len(self.first):
            self.first, self.often = (np.r_[x, np.zeros_like(x)] for x in (self.first, self.often))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=n)
        self.often[at : at + n] = sizes
        self.first[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.table.add(h)

    def unit(self, raw: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        shown = raw.decode() if raw.isascii() else "".join([self.letters[b] for b in raw])
        return [t.id for t in self.model.tokenize(shown)]

    def block(self, buf: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block, and how many of them belong to each text that begins at `at`."""
        low, starts, ends, whole = units(buf)
        hashes = span_hashes(low, starts, ends)
        out, sizes = [], np.zeros(len(starts) + 1, dtype=np.int64)
        step = self.most // 4
        for a in range(0, len(starts), step):
            h = hashes[a : a + step]
            found = self.table.find(h)
            new, where, emptied = self.table.unseen(h, found)
            if emptied:
                self.clear()
            if len(new):
                raw = low.tobytes()
                self.learn(new, [self.unit(raw[s:e], w) for s, e, w in zip(starts[a + where].tolist(), ends[a + where].tolist(), whole[a + where].tolist())])
                found = self.table.find(h)
            n = self.often[found]
            sizes[a + 1 : a + 1 + len(n)] = n
            total = np.cumsum(n)
            out.append(self.flat[np.repeat(self.first[found] - (total - n), n) + np.arange(total[-1] if len(n) else 0)])
        upto = np.cumsum(sizes)
        return (np.concatenate(out) if out else self.flat[:0]), np.diff(np.r_[upto[np.searchsorted(starts, at)], upto[-1]])

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        if not self.known:
            return [np.array(self.tokenizer.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4") for t in texts]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for buf, who, at in byte_blocks(texts):
            got, n = self.block(buf, at)
            ends = np.cumsum(n)
            for i, a, b in zip(who, (ends - n).tolist(), ends.tolist()):
                parts[i].append(got[a:b])
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, part, nth, and ids (little-endian bytes) on request.

    A document's ids end with END_ID; a null or empty text is that id alone. Only longer documents than
    `capacity` are cut, into pieces of `capacity`. nth counts the pieces of one length in a part, which is what
    one task wrote: to be written once, before it is read.
    """
    tune(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memory(("tokens", tokenizer), lambda: TextTokens(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in frames:
            who, nth, cut = [], [], []
            for i, ids in enumerate(memo.ids(batch.column(1).to_pylist())):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    who.append(i), nth.append(k), cut.append(ids[at : at + capacity])
            nth = np.array(nth, dtype=np.int32)
            sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
            cols = [batch.column(0).take(pa.array(who, type=pa.int32())), pa.array(nth), pa.array(nth.astype(np.int64) * capacity), pa.array(sizes)]
            cols.append(pa.array([zlib.crc32(c) for c in cut], type=pa.int64()))
            order = np.argsort(sizes, kind="stable")
            alike = sizes[order]
            first = np.searchsorted(alike, alike)
            rank = np.empty(len(cut), dtype=np.int64)
            rank[order] = np.arange(len(cut)) - first + seen[alike]
            seen += np.bincount(sizes, minlength=capacity + 1)
            cols += [pa.array(np.full(len(cut), part, dtype=np.int64)), pa.array(rank)]
            if keep_ids:
                cols.append(pa.array([c.tobytes() for c in cut], type=pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids binary" if keep_ids else "")
    names = [f.split()[0] for f in fields.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, fields)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, offset) in order of length and rank, and the number of sequences.

    A run gives pieces of one length, by rank, consecutive sequences at one offset, up to the next run's rank.
    """
    bins: list[list] = []  # [gap, how many alike, [(length, how often)]]
    left = {n: c for n, c in counts.items() if c > 0}
    big = sorted(n for n in left if 3 * n > capacity)
    while big:
        a = big[-1]
        fit = bisect_left(big, capacity - a + 1) - 1
        if fit < 0:
            bins.append([capacity - a, left[a], [(a, 1)]])
            left[a] = 0
        elif big[fit] == a and left[a] == 1:
            if fit == 0:
                bins.append([capacity - a, 1, [(a, 1)]])
                left[a] = 0
            else:
                b = big[fit - 1]
                bins.append([capacity - a - b, 1, [(a, 1), (b, 1)]])
                left[a] -= 1
                left[b] -= 1
        elif big[fit] == a:
            bins.append([capacity - 2 * a, left[a] // 2, [(a, 2)]])
            left[a] %= 2
        else:
            b = big[fit]
            m = min(left[a], left[b])
            bins.append([capacity - a - b, m, [(a, 1), (b, 1)]])
            left[a] -= m
            left[b] -= m
        big = [n for n in big if left[n]]
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []

    def offer(i: int) -> None:
        g = bins[i][0]
        if g > 0:
            if g not in by_gap:
                by_gap[g] = []
                insort(gaps, g)
            by_gap[g].append(i)

    for i in range(len(bins)):
        offer(i)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, s)
            if at == len(gaps):  # no gap holds it: open sequences
                k = min(capacity // s, n)
                bins.append([capacity - k * s, n // k, [(s, k)]])
                offer(len(bins) - 1)
                n -= (n // k) * k
                continue
            g = gaps[at]
            i = by_gap[g].pop()
            if not by_gap[g]:
                del by_gap[g]
                gaps.pop(at)
            gap, many, items = bins[i]
            k = min(gap // s, n)
            m = min(many, n // k)
            if m < many:
                bins[i][1] = many - m
                offer(i)
                bins.append([gap - k * s, m, [*items, (s, k)]])
                offer(len(bins) - 1)
            else:
                bins[i] = [gap - k * s, many, [*items, (s, k)]]
                offer(i)
            n -= m * k
    runs, rank, seq = [], dict.fromkeys(counts, 0), 0
    for _, many, items in bins:
        at = 0
        for s, k in items:
            for _ in range(k):
                runs.append((s, rank[s], seq, at))
                rank[s] += many
                at += s
        seq += many
    return sorted(runs), seq


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`parts` (pieces(), written once) with sequence_id and offset. Collected: a count for each length, `capacity` at most.

    A piece's rank among those of its length is its number in its part, after all of the parts before. So
    pieces, and ids that they carry, are shuffled only where the starts of parts are too many to tell.
    """
    ends = materialize(parts.groupBy("part", "length").agg((F.max("nth") + 1).alias("_n")), "ends")
    counts = {int(r["length"]): int(r["n"]) for r in ends.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    r = np.array(runs, dtype=np.int64).reshape(-1, 4)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if ends.count() <= TOLD_ROWS:
        base = F.broadcast(base)
    ranked = parts.join(base, ["part", "length"])

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy()
        at = np.empty(len(length), dtype=np.int64)
        for s, idx in length.groupby(length).indices.items():
            lo, hi = np.searchsorted(r[:, 0], [s, s + 1])
            at[idx] = lo + np.searchsorted(r[lo:hi, 1], rank[idx], side="right") - 1
        return pd.DataFrame({"sequence_id": r[at, 2] + rank - r[at, 1], "offset": r[at, 3]})

    found = F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("_base") + F.col("nth"))
    return ranked.withColumn("_at", found).select(*[c for c in parts.columns if c not in ("part", "nth")], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Sequences of at most `capacity` ids: a row for each piece with its sequence and its place there.

    Null and repeated doc_ids are rows like others; an empty table gives no rows; other columns are ignored.
    """
    return pack(materialize(pieces(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack_documents(docs, tokenizer or public_tokenizer())
