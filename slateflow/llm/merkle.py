"""A Merkle manifest of a dataset: a tree of documents for each source, a tree of sources above them, a proof for each document.

1. Every document is a leaf. Leaves are sorted over all machines by source and doc_id, so each part of them
   holds leaves that stand side by side; a count for each part and source gives every leaf its index.
2. A fragment holds the nodes of a forest that aren't resolved yet, keyed by tree, level and run. Putting in a
   node that completes its run, whose arity follows from the size of its tree, replaces the run by its parent,
   and so on upwards; a tree's root is a leaf of the tree above. So fragments join in any grouping to the same
   fragment, whatever each holds: parts make fragments of at most a few runs at both of their ends, which are
   merged FAN at a time in a tree of jobs until the root is left. Each completed run is written once.
3. Proofs go downwards: a run has the siblings of its parent and those above it, found by a join with the run
   of its parent, level by level. Leaves take theirs from their own run.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, parts_of
from .exact_dedup import LOWER, UPPER

#: Children of a node.
ARITY = 16
#: Leaves of a part, about, and fragments that a task merges.
PART_ROWS, FAN = 500_000, 16
#: The tree of sources; those of documents are numbered from 0 in order of source. `level` of a tree that is a single leaf.
TOP, LONE = -1, -1

_FOREST = "open boolean, part long, tree long, size long, level int, place long, hash string, doc_id long, used string, hashes array<string>, docs array<struct<doc_id:long,used:string>>, up_tree long, up_run long, up_pos int"


def field(x: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """A document's leaf, with `text` as its text."""
    return F.sha2(F.concat(field(F.col("doc_id").cast("long")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars").cast("long")), field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, used): `used` is the leaf of the tampered text, null where a document isn't tampered with."""
    text = F.col("text").cast("string")
    chosen = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")) % 5 == 0
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(text).alias("leaf"),
        F.when(chosen, leaf_hash(F.translate(text, UPPER, LOWER))).alias("used"),
    )


def indexed(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(part, pos, kind, ...) in order of source, doc_id and leaf: each leaf, after a row that says where a source begins or goes on in the part; the number of sources.

    To the driver comes one number for each part.
    """
    spark = rows.sparkSession
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    parts = max(parts_of(spark), -(-n // PART_ROWS))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumns({"part": F.spark_partition_id().cast("long"), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    by_source = Window.partitionBy("source").orderBy("part")
    spans = rows.groupBy("part", "source").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).withColumns({
        "offset": F.coalesce(F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "size": F.sum("n").over(Window.partitionBy("source")), "first": F.row_number().over(by_source) == 1,
    })
    spans = materialize(spans, "spans")
    before, total = [], 0
    for r in sorted(spans.where("first").groupBy("part").count().collect(), key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["count"]
    at = spark.createDataFrame(before, "part long, before long").coalesce(1)
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())) - 1
    trees = spans.where("first").withColumn("_own", own).join(F.broadcast(at), "part").select("source", (F.col("before") + F.col("_own")).alias("tree"))
    spans = spans.join(trees, spans["source"].eqNullSafe(trees["source"])).select("part", "pos", F.lit(0).alias("kind"), "tree", "offset", "size", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("used"))
    none = F.lit(None).cast("long")
    each = rows.select("part", "pos", F.lit(1).alias("kind"), none.alias("tree"), none.alias("offset"), none.alias("size"), "doc_id", "leaf", "used")
    return spans.unionByName(each), total


class Fragment:
    """Unresolved nodes of a forest with `trees` trees of documents, and what was completed since done() was last called."""

    def __init__(self, trees: int):
        self.trees, self.open, self.runs = trees, {}, []

    def _up(self, tree: int, size: int, level: int, place: int) -> tuple:
        """Tree, run and place in it of a node's own run; nothing for the root."""
        if -(-size // ARITY**level) == 1:
            if tree == TOP or self.trees == 1:
                return None, None, None
            tree, place = TOP, tree
        return tree, place // ARITY, place % ARITY

    def put(self, tree: int, size: int, level: int, place: int, value: str, doc: tuple | None) -> None:
        while True:
            width = -(-size // ARITY**level)
            if width == 1:
                if tree == TOP:
                    self.runs.append((tree, size, level, place, value, None, None, None, None, None))
                    return
                if level == 0:
                    self.runs.append((tree, size, LONE, 0, None, [value], [doc], *self._up(tree, size, 0, 0)))
                tree, size, level, place, doc = TOP, self.trees, 0, tree, None
                continue
            run = place // ARITY
            held = self.open.setdefault((tree, size, level, run), {})
            held[place] = (value, doc)
            if len(held) < min(ARITY, width - ARITY * run):
                return
            del self.open[tree, size, level, run]
            nodes = [held[k] for k in sorted(held)]
            hashes = [h for h, _ in nodes]
            docs = [d for _, d in nodes] if tree != TOP and level == 0 else None
            self.runs.append((tree, size, level, run, None, hashes, docs, *self._up(tree, size, level + 1, run)))
            value, level, place, doc = hashlib.sha256("".join(hashes).encode()).hexdigest(), level + 1, run, None

    def done(self) -> pd.DataFrame:
        rows = [(False, None, t, s, lv, p, h, None, None, hashes, docs and [{"doc_id": d, "used": u} for d, u in docs], *up) for t, s, lv, p, h, hashes, docs, *up in self.runs]
        self.runs = []
        return _table(rows)

    def rest(self, part: int) -> pd.DataFrame:
        """All that is left to tell of a part: what is completed, and what stays open."""
        rows = [(True, part, t, s, lv, p, h, *(doc or (None, None)), None, None, None, None, None) for (t, s, lv, _), held in self.open.items() for p, (h, doc) in held.items()]
        return pd.concat([self.done(), _table(rows)])


def _table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOREST.split(", ")], dtype=object)
    for c in ("part", "tree", "size", "place", "doc_id", "up_tree", "up_run"):
        out[c] = out[c].astype("Int64")
    for c in ("level", "up_pos"):
        out[c] = out[c].astype("Int32")
    return out.astype({"open": "boolean"})


def _numbers(*names: str) -> list[Column]:
    """Numbers that may be null as text, which pandas doesn't turn to floats."""
    return [F.col(c).cast("string").alias(c) for c in names]


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


def part_fragments(rows: DataFrame, trees: int) -> DataFrame:
    """The completed runs of each part and, `open`, the nodes that it leaves unresolved; from rows of indexed()."""

    def run(frames):
        at, fragment, tree, shift, size = None, None, 0, 0, 0
        for pdf in frames:
            for part, pos, kind, t, offset, n, doc_id, leaf, used in pdf.itertuples(index=False):
                if part != at:
                    if fragment is not None:
                        yield fragment.rest(at)
                    at, fragment = part, Fragment(trees)
                if kind == 0:
                    tree, shift, size = int(t), int(offset) - pos, int(n)
                else:
                    fragment.put(tree, size, 0, pos + shift, leaf, (_int(doc_id), used))
            if fragment is not None and fragment.runs:
                yield fragment.done()
        if fragment is not None:
            yield fragment.rest(at)

    rows = rows.select("part", "pos", "kind", *_numbers("tree", "offset", "size", "doc_id"), "leaf", "used")
    return rows.repartition(parts_of(rows.sparkSession), "part").sortWithinPartitions("part", "pos", "kind").mapInPandas(run, _FOREST)


def merged(rows: DataFrame, trees: int) -> DataFrame:
    """The fragments of FAN parts as one: the runs that are complete now, and what is still open."""

    def run(frames):
        at, fragment = None, None
        for pdf in frames:
            for group, tree, size, level, place, value, doc_id, used in pdf.itertuples(index=False):
                if group != at:
                    if fragment is not None:
                        yield fragment.rest(at)
                    at, fragment = group, Fragment(trees)
                fragment.put(tree, size, level, place, value, (_int(doc_id), used) if tree != TOP and level == 0 else None)
            if fragment is not None and fragment.runs:
                yield fragment.done()
        if fragment is not None:
            yield fragment.rest(at)

    group = F.floor(F.col("part") / FAN).alias("group")
    rows = rows.where("open").select(group, "tree", "size", "level", "place", "hash", *_numbers("doc_id"), "used")
    return rows.repartition(parts_of(rows.sparkSession), "group").sortWithinPartitions("group", "tree", "level", "place").mapInPandas(run, _FOREST)


def forest(rows: DataFrame, n: int) -> tuple[DataFrame, str, int]:
    """Completed runs of all trees, the root, and the number of sources, of n leaves."""
    numbered, trees = indexed(rows, n)
    tables = [materialize(part_fragments(numbered, trees), "forest")]
    while True:
        left = tables[-1].where("open").agg(F.max("part").alias("last")).first()["last"]
        if left is None:
            break
        tables.append(materialize(merged(tables[-1], trees), "forest"))
    runs = reduce(DataFrame.unionByName, [t.where("not open") for t in tables])
    root = runs.where("hash is not null").first()["hash"]
    return runs.where("hash is null").drop("open", "part", "hash", "doc_id", "used"), root, trees


def _siblings(hashes: Column, i: Column) -> Column:
    """What stands left and right of the i-th (from 0) of a run's hashes."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("l"), F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("r"))


def paths(runs: DataFrame, root: str, trees: int) -> DataFrame:
    """(level, hashes, docs, path, subroot) of every run of documents: siblings from that of the run's parent up to the root."""
    steps = F.array().cast("array<struct<l:string,r:string>>")
    highest = {r["top"]: r["level"] for r in runs.groupBy((F.col("tree") == TOP).alias("top")).agg(F.max("level").alias("level")).collect()}

    def below(level_runs: DataFrame, parents: DataFrame | None) -> DataFrame:
        cols = ["tree", F.col("place").alias("run"), "level", "hashes", "docs"]
        at_root = level_runs.where("up_tree is null").select(*cols, steps.alias("path"), F.lit(root).alias("subroot"))
        if parents is None:
            return at_root
        p = parents.select(F.col("tree").alias("up_tree"), F.col("run").alias("up_run"), F.col("hashes").alias("up_hashes"), F.col("path").alias("up_path"), F.col("subroot").alias("up_subroot"))
        path = F.concat(F.array(_siblings(F.col("up_hashes"), F.col("up_pos"))), "up_path")
        subroot = F.when(F.col("up_tree") == TOP, F.element_at("up_hashes", F.col("up_pos") + 1)).otherwise(F.col("up_subroot"))
        return at_root.unionByName(level_runs.join(p, ["up_tree", "up_run"]).select(*cols, path.alias("path"), subroot.alias("subroot")))

    top = None
    for level in range(highest.get(True, -1), -1, -1):
        top = materialize(below(runs.where((F.col("tree") == TOP) & (F.col("level") == level)), top), "paths")
    out, found = None, top
    for level in range(highest[False], LONE - 1, -1):
        got = materialize(below(runs.where((F.col("tree") != TOP) & (F.col("level") == level)), found), "paths")
        found = got if top is None else got.unionByName(top)
        if level <= 0:
            out = got if out is None else out.unionByName(got)
        if level == 0:
            found = top
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars, text).

    Null fields count as `-`, empty ones as `0:`; a null source is a source of its own, before the others. Rows
    of one source with equal doc_id stand in order of their leaves, null ids first; a row without doc_id isn't
    tampered with. A source of one document has its leaf as its subroot, and a table of one document as its
    root. Texts of any length are hashed whole. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(leaves(docs), "leaves")
    n = rows.count()
    if n == 0:
        return rows.select("doc_id", "leaf", *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))
    runs, root, trees = forest(rows, n)
    discard(rows)
    each = paths(runs, root, trees).select("level", "hashes", "path", "subroot", F.posexplode("docs").alias("i", "d"))
    leaf = F.element_at("hashes", F.col("i") + 1)
    steps = F.when(F.col("level") == LONE, F.col("path")).otherwise(F.concat(F.array(_siblings(F.col("hashes"), F.col("i"))), "path"))
    each = each.select(F.col("d.doc_id").alias("doc_id"), leaf.alias("leaf"), "subroot", F.coalesce("d.used", leaf).alias("used"), steps.alias("steps"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    folded = F.aggregate("steps", F.col("used"), lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))
    out = each.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_sparse_forest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return manifest(docs)
