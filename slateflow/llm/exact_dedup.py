"""Exact duplicates by two passes over fingerprints: a Bloom filter that counts to two, then a shuffle of what may repeat.

1. Each text becomes its SHA-256, after A-Z are lower-cased; only fingerprints go on. In the first pass every
   task counts the filter positions of its rows, and the counts of all tasks are added, up to two, segment by
   segment. All positions of a row lie in one segment, so a segment is merged by one task, one partial at a time.
2. A fingerprint that occurs twice has a count of two at each of its positions. In the second pass rows with a
   smaller count somewhere pass straight through: nothing else has their text. The others, true repeats and a
   few false alarms, are grouped by the whole fingerprint, which decides.

The filter grows with the rows, 8 to 16 positions a row. What is broadcast doesn't: beyond ROUND_BYTES the
segments are taken in rounds, each of which tests the fingerprints of its own segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_totals, materialize, parts_of

#: Filter positions of a row, all in one segment.
HASHES = 3
#: Least positions of the filter for each row; the number of segments is the next power of two.
POSITIONS_A_ROW = 8
#: Positions of a segment are 2 ** SEGMENT_BITS at most: a byte each while a task merges it, a bit each after that.
SEGMENT_BITS, LEAST_SEGMENTS = 24, 16
#: Rows whose positions a task holds before it gives them away.
FLUSH_ROWS = 1_000_000
#: Most of the filter that the driver and a Python worker hold at once.
ROUND_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 with A-Z lower-cased, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), 256))


class Layout:
    """Where the filter for n rows keeps a fingerprint: its segment, and its positions there."""

    def __init__(self, n: int):
        bits = max(LEAST_SEGMENTS.bit_length() + 5, (POSITIONS_A_ROW * max(n, 1) - 1).bit_length())
        self.bits = min(SEGMENT_BITS, bits - LEAST_SEGMENTS.bit_length() + 1)
        self.segments = 1 << (bits - self.bits)

    @property
    def rounds(self) -> int:
        return -(-(self.segments << self.bits) // (8 * ROUND_BYTES))

    def round_of(self, segment: int) -> int:
        return segment * self.rounds // self.segments

    def places(self, digests: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Segment of each 32-byte fingerprint, and its HASHES positions, a row for each."""
        words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
        return (words[:, 3] & np.uint64(self.segments - 1)).astype(np.int64), (words[:, :HASHES] & np.uint64((1 << self.bits) - 1)).astype(np.int64)


def partial_counts(segment: np.ndarray, positions: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(segment, positions counted once, positions counted more often) of some rows. A row counts once at each of its positions."""
    at = np.sort(positions, axis=1)
    own = np.c_[np.ones(len(at), dtype=bool), at[:, 1:] != at[:, :-1]]
    key, often = np.unique(((segment[:, None] << bits) | at)[own], return_counts=True)
    of = key >> bits
    cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(key) else []
    for lo, hi in zip(cut, [*cut[1:], len(key)]):
        low = (key[lo:hi] & ((1 << bits) - 1)).astype(np.uint32)
        yield int(of[lo]), low[often[lo:hi] == 1], low[often[lo:hi] > 1]


def twice_filter(fingerprints: DataFrame, layout: Layout) -> DataFrame:
    """(segment, bits): which positions of each segment have a count of two or more over all rows."""
    bits = layout.bits

    def count(frames):
        held, n = [], 0

        def close():
            rows = partial_counts(np.concatenate([s for s, _ in held]), np.concatenate([p for _, p in held]), bits)
            return pd.DataFrame([(s, a.tobytes(), b.tobytes()) for s, a, b in rows], columns=["segment", "once", "twice"])

        for pdf in frames:
            if len(pdf):
                held.append(layout.places(pdf["digest"]))
                n += len(pdf)
            if n >= FLUSH_ROWS:
                yield close()
                held, n = [], 0
        if n:
            yield close()

    def merge(frames):
        at, counts = None, None

        def close():
            return pd.DataFrame({"segment": [at], "bits": [np.packbits(counts > 1, bitorder="little").tobytes()]})

        for pdf in frames:
            for segment, once, twice in zip(pdf["segment"].tolist(), pdf["once"], pdf["twice"]):
                if segment != at:
                    if at is not None:
                        yield close()
                    at, counts = segment, np.zeros(1 << bits, dtype=np.uint8)
                once = np.frombuffer(once, dtype=np.uint32)
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[np.frombuffer(twice, dtype=np.uint32)] = 2
        if at is not None:
            yield close()

    part = fingerprints.select("digest").mapInPandas(count, "segment long, once binary, twice binary")
    parts = parts_of(fingerprints.sparkSession)
    return part.repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(merge, "segment long, bits binary")


def maybe_repeated(fingerprints: DataFrame, layout: Layout) -> list[DataFrame]:
    """`fingerprints` with `maybe`, false only where nothing else has the digest: a written table for each round of segments."""
    spark = fingerprints.sparkSession
    twice = materialize(twice_filter(fingerprints, layout), "twice")
    out = []
    for k in range(layout.rounds):
        lo, hi = (-(-r * layout.segments // layout.rounds) for r in (k, k + 1))
        held = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in twice.where(F.col("segment").between(lo, hi - 1)).collect()})

        def test(frames, lo=lo, hi=hi, held=held):
            bits = np.zeros((hi - lo, 1 << max(layout.bits - 3, 0)), dtype=np.uint8)
            for segment, x in held.value.items():
                bits[segment - lo] = np.frombuffer(x, dtype=np.uint8)
            for pdf in frames:
                if not len(pdf):
                    continue
                segment, at = layout.places(pdf["digest"])
                ours = (segment >= lo) & (segment < hi)
                pdf, segment, at = pdf[ours], segment[ours] - lo, at[ours]
                yield pdf.assign(maybe=((bits[segment[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))

        out.append(materialize(fingerprints.mapInPandas(test, "doc_id long, digest binary, maybe boolean"), "tested"))
        held.destroy()
    discard(twice)
    return out


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Null text counts as empty, and texts of any length are read whole. Of equal texts the largest doc_id
    stays; rows that repeat it stay together, as they are one document. A null doc_id counts in its group and
    stays only where no row of the group has an id: keep_id is then null. An empty table gives no rows; other
    columns are ignored.
    """
    fingerprints = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("digest")), "fingerprints")
    tested = maybe_repeated(fingerprints, Layout(fingerprints.count()))
    rows = tested[0]
    for x in tested[1:]:
        rows = rows.unionByName(x)
    alone = rows.where("not maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = rows.where("maybe").drop("maybe")
    groups = materialize(again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = alone.unionByName(join_totals(again, groups, "digest", "group_size").select("doc_id", "digest", "keep_id", "group_size"))
    discard(fingerprints)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose text a row of larger doc_id has; rows without doc_id stay."""
    gone = exact_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_digest"))
    return docs.join(gone.distinct(), (docs["doc_id"] == gone["_gone"]) & (fingerprint(docs["text"]) == gone["_digest"]), "left_anti")


def op13_two_pass_bloom(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)
