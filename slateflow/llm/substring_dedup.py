"""Repeated passages of WINDOW words, by prefix-partitioned suffix trees.

Words are symbols (64-bit hashes). Suffixes are taken where they begin with an anchor: the 8 words with the
smallest hash in some window, so that equal windows hold the same anchor at the same place. A suffix has the
words from its anchor on and, read backwards, those before it, as far as windows with that anchor reach.

Suffixes fall into groups by prefix. For most that is the anchor, 8 words; suffixes under an anchor that more
than `limit` share go by the whole prefix of WINDOW words, where a tree would have one leaf edge and counting
is enough: counts are combined before the shuffle and no such group meets in one task. In each other group,
suffixes are sorted word by word; the common prefixes of neighbours (lcp) give the tree's internal nodes as
intervals. A window that begins o words before the anchor repeats if another suffix below the same node of
depth WINDOW - o agrees with it in the o words on the left; neighbouring windows join to the maximal repeats.

Anchors that occur once in the corpus are left out before. In a pack of documents equal suffixes are one with
a mark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, gram_hashes, materialize, mix64, release, span_hashes, texts_words, tune

WINDOW, GRAM = 35, 8
#: Places an anchor can have in a window.
SPAN = WINDOW - GRAM + 1
#: Bytes of text and documents in a pack; suffixes that a group may hold.
PACK_BYTES, PACK_DOCS, GROUP_SUFFIXES = 1 << 20, 1024, 20_000

#: A suffix: its number in the pack, words before the anchor, the least place of the anchor in a window, words in all, whether the pack holds several.
HEAD = np.dtype([("place", "<u4"), ("left", "u1"), ("low", "u1"), ("n", "u1"), ("many", "u1")])


# ---------------------------------------------------------------- packs of documents


def pack_texts(docs: DataFrame) -> DataFrame:
    """(pack, ids, lens, body): neighbouring rows as one compressed text. Written once, so that packs keep their numbers."""
    schema = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        squeeze = zstandard.ZstdCompressor(level=3)
        ids, parts, size = [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({"pack": [base + n], "ids": [ids], "lens": [[len(p) for p in parts]], "body": [squeeze.compress(b"".join(parts))]}, schema)

        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = raw or b""
                if ids and (size + len(raw) > PACK_BYTES or len(ids) >= PACK_DOCS):
                    yield close()
                    n += 1
                    ids, parts, size = [], [], 0
                ids.append(d)
                parts.append(raw)
                size += len(raw)
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "pack long, ids array<long>, lens array<long>, body binary")


def unpack(lens: list[int], body: bytes) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(body) if sum(lens) else b"", [], 0
    for n in lens:
        out.append(raw[at : at + n])
        at += n
    return out


class Suffixes:
    """The suffixes of a pack: for each run of windows with one anchor its first and last window, the anchor's place and hash."""

    def __init__(self, texts: list[bytes]):
        self.h, self.counts = texts_words(texts)
        h, n = self.h, len(self.h)
        m = max(0, n - WINDOW + 1)
        g = gram_hashes(h, GRAM)
        best, width = np.arange(len(g)), 1
        while 2 * width <= SPAN and m:
            a, b = best[:-width], best[width:]
            best = np.where(g[a] <= g[b], a, b)
            width *= 2
        a, b = best[:m], best[SPAN - width :][:m]
        best = np.where(g[a] <= g[b], a, b)  # the leftmost smallest gram of each window
        stop = np.repeat(np.cumsum(self.counts), self.counts)[:m]
        start = np.flatnonzero(np.arange(m) + WINDOW <= stop)
        anchor = best[start]
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        self.first, self.anchor, self.key = start[new], anchor[new], g[anchor[new]]
        self.last = start[np.r_[new[1:], len(start)] - 1] if len(new) else start

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors and how many suffixes have each."""
        return np.unique(self.key, return_counts=True)

    def distinct(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes whose anchor is shared, the distinct one each of them is, and of the distinct ones an example and the number."""
        own = np.flatnonzero(_within(self.key, shared))
        digest = span_hashes(self.h, self.first[own], self.last[own] + WINDOW)
        digest = mix64(digest + (self.anchor[own] - self.first[own]).astype(np.uint64))
        _, example, which, often = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        return own, which, own[example], often

    def records(self, shared: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(cell, heads, words) of the distinct suffixes with a shared anchor, by the last bits of the anchor's hash: the first ones are small in a minimum."""
        _, _, one, often = self.distinct(shared)
        cell = (self.key[one] & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        one, cell = one[order], cell[order]
        head = np.empty(len(one), dtype=HEAD)
        head["place"], head["many"] = order, often[order] > 1
        head["left"], head["low"] = self.anchor[one] - self.first[one], self.anchor[one] - self.last[one]
        n = self.last[one] + WINDOW - self.first[one]
        head["n"] = n
        ends = np.cumsum(n)
        words = self.h[np.repeat(self.first[one] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]
        cut = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)) if len(cell) else []
        for a, b in zip(cut, cut[1:]):
            yield int(cell[a]), head[a:b].tobytes(), words[ends[a] - n[a] : ends[b - 1]].tobytes()

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows with these anchors, and two hashes of each window."""
        own = np.flatnonzero(_within(self.key, anchors))
        n = self.last[own] - self.first[own] + 1
        at = np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, (gram_hashes(self.h, WINDOW)[at] if len(at) else self.h[:0]), span_hashes(self.h, at, at + WINDOW)


def _within(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    i = np.searchsorted(values, x)
    i[i == len(values)] = 0
    return values[i] == x


def _hashes(values) -> np.ndarray:
    return np.sort(np.array(values or [], dtype=np.int64).view(np.uint64))


# ---------------------------------------------------------------- anchors


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys, often = Suffixes(unpack(row["lens"], row["body"])).anchors()
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["pack"])), pa.array(keys.view(np.int64)), pa.array(often.astype(np.int64))], names=["pack", "anchor", "n"])


# ---------------------------------------------------------------- trees


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, word by word, and how many words each sorted row has in common with the one before."""
    order = np.lexsort(rows.T[::-1])
    s = rows[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.r_[0, lcp][: len(rows)]


def nodes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the tree's node that it lies below and that is the first at least as deep: an interval of the sorted rows."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(lcp < depth) if depth else 0
    return out


def deep_repeats(head: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each suffix of a group a mask: bit o is set if the window that begins o words before the anchor occurs again."""
    n, left, low = (head[k].astype(np.int64) for k in ("n", "left", "low"))
    ends = np.cumsum(n)
    anchor = ends - n + left
    right = _side(words, anchor, np.minimum(ends - anchor, WINDOW), 1, WINDOW)
    before = _side(words, anchor - 1, left, -1, SPAN - 1)
    tree, back = suffix_order(right), suffix_order(before)
    weight, out = 1 + head["many"].astype(np.int64), np.zeros(len(head), dtype="<u4")
    for o in range(SPAN):
        ok = np.flatnonzero((low <= o) & (o <= left))
        if len(ok):
            pair = nodes(*tree, WINDOW - o)[ok] * (len(head) + 1) + nodes(*back, o)[ok]
            _, which = np.unique(pair, return_inverse=True)
            out[ok[np.bincount(which, weights=weight[ok])[which] > 1]] |= np.uint32(1 << o)
    return out


def _side(words: np.ndarray, at: np.ndarray, n: np.ndarray, step: int, width: int) -> np.ndarray:
    """Rows of `width` words from each place on, or back from it; 0 beyond n."""
    j = np.arange(width)
    inside = j < n[:, None]
    return np.where(inside, words[np.where(inside, at[:, None] + step * j, 0)], np.uint64(0))


def _tree(table: pa.Table) -> pa.Table:
    heads = [np.frombuffer(x, dtype=HEAD) for x in table["heads"].to_pylist()]
    found = deep_repeats(np.concatenate(heads), np.frombuffer(b"".join(table["words"].to_pylist()), dtype=np.uint64))
    packs, places, masks, at = [], [], [], 0
    for pack, head in zip(table["pack"].to_pylist(), heads):
        mask = found[at : at + len(head)]
        at += len(head)
        if mask.any():
            packs.append(pack), places.append(head["place"][mask > 0].tobytes()), masks.append(mask[mask > 0].tobytes())
    return pa.table({"pack": pa.array(packs, pa.int64()), "places": pa.array(places, pa.binary()), "masks": pa.array(masks, pa.binary())})


def _emit_suffixes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = [(c, row["pack"], a, b) for c, a, b in Suffixes(unpack(row["lens"], row["body"])).records(_hashes(row["shared"]), bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["cell", "pack", "heads", "words"])

    return run


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at, *h = Suffixes(unpack(row["lens"], row["body"])).windows(_hashes(row["crowded"]))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["pack"])), pa.array(at), *(pa.array(x.view(np.int64)) for x in h)], names=["pack", "start", "h", "k"])


# ---------------------------------------------------------------- removal


def _cover(keep_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = unpack(row["lens"], row["body"])
                starts = [np.array(row["starts"] or [], dtype=np.int64)]
                if row["places"]:
                    s = Suffixes(texts)
                    own, which, one, _ = s.distinct(_hashes(row["shared"]))
                    mask = np.zeros(len(one), dtype="<u4")
                    mask[np.frombuffer(b"".join(row["places"]), dtype="<u4")] = np.frombuffer(b"".join(row["masks"]), dtype="<u4")
                    mask = mask[which]
                    starts += [s.anchor[own[mask >> np.uint32(o) & np.uint32(1) > 0]] - o for o in range(SPAN)]
                start = np.concatenate(starts)
                words = [t.split() for t in texts]
                counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                gone = np.zeros(int(counts.sum()) + 1, dtype=np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + WINDOW, -1)
                keep = np.cumsum(gone[:-1]) == 0
                n_removed, digests, kept, at = [], [], [], 0
                for w, n in zip(words, counts.tolist()):
                    mine = keep[at : at + n]
                    at += n
                    left = int(mine.sum())
                    text = b" ".join(w if left == n else compress(w, mine.tolist()))
                    n_removed.append(n - left), digests.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        kept.append(text.decode("utf-8", "replace"))
                cols = [pa.array(row["ids"], pa.int64()), pa.array(counts), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, limit: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text left) for every row of docs (doc_id, text).

    A word goes if a window of WINDOW words over it starts anywhere else too. Null and blank texts have no
    words, and the digest of the empty string. Documents shorter than WINDOW keep all. Repeated rows count as
    separate documents, null ids as any other; an empty table gives no rows; other columns are ignored.
    Collected: two numbers.
    """
    spark = docs.sparkSession
    tune(spark)
    packs = materialize(pack_texts(docs), "packs", "uncompressed")  # the texts are compressed already
    anchors = materialize(packs.mapInArrow(_emit_anchors, "pack long, anchor long, n long"), "anchors")
    total = materialize(anchors.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1"), "totals")
    some = total.agg(F.sum(F.when(F.col("total") <= limit, F.col("total"))).alias("n"), F.max("total").alias("most")).first()
    told = anchors.join(total, "anchor").groupBy("pack").agg(
        F.collect_list(F.when(F.col("total") <= limit, F.col("anchor"))).alias("shared"), F.collect_list(F.when(F.col("total") > limit, F.col("anchor"))).alias("crowded")
    )
    told = materialize(told, "told")
    discard(anchors)
    discard(total)
    release(spark)
    bits = max(4, min(30, int(np.ceil(np.log2((some["n"] or 0) / GROUP_SUFFIXES + 1)))))
    both = packs.join(told, "pack")
    suffixes = both.select("pack", "lens", "body", "shared").mapInArrow(_emit_suffixes(bits), "cell long, pack long, heads binary, words binary")
    found = suffixes.groupBy("cell").applyInArrow(_tree, "pack long, places binary, masks binary")
    found = materialize(found.groupBy("pack").agg(F.collect_list("places").alias("places"), F.collect_list("masks").alias("masks")), "repeats")
    release(spark)
    if (some["most"] or 0) > limit:
        windows = materialize(both.where(F.size("crowded") > 0).select("pack", "lens", "body", "crowded").mapInArrow(_emit_windows, "pack long, start long, h long, k long"), "windows")
        again = windows.groupBy("h", "k").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        starts = windows.join(again, ["h", "k"]).groupBy("pack").agg(F.collect_list("start").alias("starts"))
        found = found.join(materialize(starts, "starts"), "pack", "full")
    else:
        found = found.withColumn("starts", F.lit(None).cast("array<long>"))
    found = found.join(told.select("pack", "shared"), "pack")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return packs.join(found, "pack", "left").select("ids", "lens", "body", "shared", "places", "masks", "starts").mapInArrow(_cover(keep_text), schema)


def op4_suffix_trees(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
