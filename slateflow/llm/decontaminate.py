"""Benchmark decontamination by pigeonhole edit matching.

An item with a budget of e edits is split into e + 1 pieces: a passage within e edits holds one of them
unchanged. An automaton finds the pieces in every document, and Myers' bit-parallel distance verifies the
passage around each hit. Case and runs of white space are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tune

#: Edits allowed per character of an item, and half the least length of an item that is matched with edits.
ERROR_RATE, LEAST_PIECE = 0.05, 16
#: Items of fewer characters than this are matched whole, without edits, between non-word characters.
LEAST_ITEM = 2 * LEAST_PIECE
#: Characters of items that are searched at once; a larger benchmark is searched block by block.
BLOCK_CHARS = 4_000_000

HITS = "doc_id long, item_id long, edits int, budget int"


def normalize(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, rate: float = ERROR_RATE) -> int:
    """The whole share of edits for an item of n characters, however short its pieces become."""
    return max(0, min(int(n * rate), n - 1)) if n >= LEAST_ITEM else 0


def split_item(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of near-equal length."""
    n, k = len(item), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> int | None:
    """Least edit distance of `pattern` to any passage of `text`, None if above `most`: one word of len(pattern) bits a step."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best if best <= most else None


class Matcher:
    """Finds items within their budgets in one normalized text."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, e) in enumerate(self.items):
            for at, piece in split_item(t, e):
                where.setdefault(piece, []).append((n, at))
        self.machine = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.machine.add_word(piece, (len(piece), hits))
        if where:
            self.machine.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item_id -> (fewest edits, budget) of items found."""
        if not self.items or not text:
            return {}
        starts: dict[int, set[int]] = {}
        for end, (size, hits) in self.machine.iter(text):
            for n, at in hits:
                starts.setdefault(n, set()).add(end - size + 1 - at)
        found: dict[int, tuple[int, int]] = {}
        for n, places in starts.items():
            item_id, item, e = self.items[n]
            best = None
            if e == 0:
                if any(len(item) >= LEAST_ITEM or _apart(text, s, s + len(item)) for s in places):
                    best = 0
            elif any(s >= 0 and text.startswith(item, s) for s in places):
                best = 0
            else:
                for lo, hi in _merged(sorted(places), len(item), e):
                    d = myers(item, text[max(0, lo) : hi], e)
                    best = d if best is None else best if d is None else min(best, d)
            if best is not None and (item_id not in found or best < found[item_id][0]):
                found[item_id] = (best, e)
        return found


def _apart(text: str, a: int, b: int) -> bool:
    return (a == 0 or not text[a - 1].isalnum()) and (b >= len(text) or not text[b].isalnum())


def _merged(starts: list[int], n: int, e: int) -> list[tuple[int, int]]:
    """Passages to verify, joined where they overlap by most of an item."""
    out: list[tuple[int, int]] = []
    for s in starts:
        lo, hi = s - e, s + n + e
        if out and lo <= out[-1][0] + n:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, edits, budget for every document that holds an item within its budget; nothing for clean documents.

    Items (item_id, text) are read in blocks of BLOCK_CHARS at most, whatever the benchmark's size; items
    with null id or null or blank text take no part. Null and empty texts hold nothing. A doc_id of
    several rows appears once for each item, with the fewest edits; rows without doc_id are left out.
    """
    tune(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = docs.sparkSession.createDataFrame([], HITS)
    for block in _blocks(items):

        def run(frames, block=block):
            finder = Matcher(block, rate)
            for pdf in frames:
                rows = [(d, i, e, k) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, (e, k) in finder.find(normalize(t)).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "budget"])

        out = out.unionByName(src.mapInPandas(run, HITS))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("budget").alias("budget"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items as (item_id, normalized text), in blocks of about BLOCK_CHARS."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted({(r["item_id"], normalize(r["text"])) for r in part.collect()})


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of `docs` whose text holds no item, with all their columns.

    Each row is judged by its own text, whatever its doc_id, so null and repeated ids make no difference. Null
    and empty texts stay, and so do all rows where there are no items. Nothing is shuffled.
    """
    tune(docs.sparkSession)
    for n, block in enumerate(_blocks(items)):
        if n:  # written between blocks, so that a task has one Python worker at a time
            docs = materialize(docs, "clean")
        docs = docs.where(F.pandas_udf(_free_of(block, rate), "boolean")(F.col("text").cast("string")))
    return docs


def _free_of(block: list[tuple[int, str]], rate: float):
    def free(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Matcher(block, rate)
        for x in texts:
            yield pd.Series([not finder.find(normalize(t)) for t in x], dtype=bool)

    return free


def op8_pigeonhole(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items)
