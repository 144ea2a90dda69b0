"""Near-duplicates by MinHash: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Every document gives one permutation's minima over BINS bins; empty bins borrow from bins that a hash of
   (bin, attempt) names. Documents with equal shingle sets fold into one class, so copies never pair up.
2. BANDS bands of ROWS bins are buckets. Few shingles leave most bins to be borrowed, so a set of at most SHORT
   shingles is also in the buckets of pairs of its smallest shingles, which short sets near enough always share.
   In a bucket, each member has one edge, to the member with the smallest id: as many edges as members, never
   all pairs. Edges whose sizes, or whose signatures where sets are not small, rule out 0.75 go; the others of one centre meet in groups of bounded size, where all overlaps of full shingle
   sets are counted. Their links give components.
3. What a star can lose is a pair that shares a bucket but no near centre. So in every bucket that still has
   several components, all members outside its largest one meet all its members by size and signature, and
   where those allow a link the full sets are compared: in bounded tasks that give a row for each link that joins two
   components, never one for each pair.

Pairs of at most SHORT shingles lose no link. Beyond that, a pair of similarity 0.75 shares no bucket with
probability (1 - 0.75^4)^32, about 5 in a million. Where the larger set has FEW shingles or more, signatures may
also agree in fewer than LEAST_ESTIMATE of the bins, six standard errors below. No other link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULTIPLIERS, components, discard, materialize, mix64, shingle_sets, tune, utf8

BINS, BANDS, ROWS = 128, 32, 4
#: Least estimated similarity of two documents whose full sets are compared: five standard errors of BINS minima below 0.75.
LEAST_ESTIMATE = 0.55
#: Sets of at most so many shingles have buckets of their own, and smaller ones than FEW are compared whatever their signatures.
SHORT, FEW = 32, 64
#: Documents of a group that is compared exactly in memory.
GROUP_DOCS = 256
#: Strays that a task holds, and members that it lets stream past them. No bound on either in total.
HELD, STREAMED = 4096, 65_536

_rng = np.random.default_rng(20)
#: Bins that an empty bin asks, attempt by attempt.
DONORS = _rng.integers(0, BINS, (64, BINS))

#: Whether so many equal marks of BINS make the least estimate.
ENOUGH = (np.arange(BINS + 1) / BINS - 1 / 256) / (1 - 1 / 256) >= LEAST_ESTIMATE

SIGNATURES = "n_shingles long, set_key binary, bands array<long>, marks binary"


def signature(s: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty sorted set of hashes: the top bits name the bin, so a bin's minimum is its first."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    own = (s >> shift).astype(np.int64)
    first = np.r_[True, own[1:] != own[:-1]]
    out = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    out[own[first]] = s[first]
    full[own[first]] = True
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        donor = DONORS[attempt % len(DONORS), empty] if attempt < len(DONORS) else (empty + attempt) % BINS
        ok = full[donor]
        out[empty[ok]] = out[donor[ok]]
        empty = empty[~ok]
        attempt += 1
    return out


def short_keys(s: np.ndarray) -> np.ndarray:
    """Buckets of a sorted set of at most SHORT hashes: pairs of its smallest ones, none for a larger set.

    Of n hashes, a set near enough holds all but n // 4, so two of the n // 4 + 2 smallest are the two smallest
    that both have; as the same holds for the other set, they share that pair.
    """
    if not 2 <= len(s) <= SHORT:
        return s[:0]
    i, j = np.triu_indices(len(s) // 4 + 2, 1)
    return mix64(s[i] * MULTIPLIERS[ROWS] + s[j] * MULTIPLIERS[ROWS + 1])


def may_link(same: np.ndarray, n: np.ndarray, other: int | np.ndarray) -> np.ndarray:
    """Whether sets of n and other shingles whose signatures agree in `same` bins are compared in full."""
    low, high = np.minimum(n, other), np.maximum(n, other)
    return (4 * low >= 3 * high) & ((high < FEW) | ENOUGH[same])


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each row of docs. Documents without words have the empty set: no bands, no key."""
    tune(docs.sparkSession)
    seeds = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in texts:
            n, keys, bands, marks = [], [], [], []
            for s in shingle_sets([utf8(t) for t in x]):
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append([]), marks.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = mix64(signature(s))
                b = mix64((m.reshape(BANDS, ROWS) * MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64) + seeds)
                bands.append(np.r_[b, short_keys(s)].view(np.int64))
                marks.append((m >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"n_shingles": n, "set_key": keys, "bands": bands, "marks": marks})

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, SIGNATURES)(F.col("text").cast("string")).alias("s"))
    return got.select("doc_id", "s.*")


def _parts(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- stars


def stars(reps: DataFrame) -> DataFrame:
    """(key, x, c): each member of a bucket with its smallest member, itself left out. Buckets of one have no row."""
    buckets = reps.select("doc_id", F.explode("bands").alias("key"))
    centre = buckets.groupBy("key").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("_last")).where("c < _last").drop("_last")
    return buckets.join(centre, "key").where("doc_id <> c").select("key", F.col("doc_id").alias("x"), "c")


def near_stars(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct edges (x, c) whose sizes and signatures allow a link. `marks`: (doc_id, n_shingles, marks)."""

    def run(frames):
        for pdf in frames:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["mx"]), dtype=np.uint8).reshape(-1, BINS)
                b = np.frombuffer(b"".join(pdf["mc"]), dtype=np.uint8).reshape(-1, BINS)
                yield pdf.loc[may_link((a == b).sum(axis=1), pdf["nx"].to_numpy(), pdf["nc"].to_numpy()), ["x", "c"]]

    pairs = edges.select("x", "c").distinct()
    side = lambda k: marks.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("marks").alias(f"m{k}"))
    both = pairs.join(side("x"), "x").join(side("c"), "c").where("4 * least(nx, nc) >= 3 * greatest(nx, nc)")
    return both.select("x", "c", "nx", "nc", "mx", "mc").mapInPandas(run, "x long, c long").distinct()


def link_group(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(id, root, links) by exact overlaps of full sets: root is the best-linked member of the id's component in the group."""
    n = len(ids)
    if n == 1:
        return [(ids[0], ids[0], 0)]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, term, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    name = np.cumsum(shared) - 1
    keep = shared[term]
    who, term = who[keep], name[term[keep]]
    order = np.argsort(term, kind="stable")
    who, term = who[order], term[order]
    both = np.zeros((n, n))
    n_terms, step = int(shared.sum()), 8192
    cut = np.searchsorted(term, np.arange(0, n_terms + step, step))
    for k, (lo, hi) in enumerate(zip(cut, cut[1:])):
        m = np.zeros((n, min(step, n_terms - k * step)), dtype=np.float32)
        m[who[lo:hi], term[lo:hi] - k * step] = 1
        both += m @ m.T
    union = size[:, None] + size - both
    linked = 100 * both >= 75 * union
    np.fill_diagonal(linked, False)
    degree = linked.sum(axis=1)
    root = np.full(n, -1)
    for i in np.lexsort((ids, -degree)):
        if root[i] >= 0:
            continue
        front = np.array([i])
        root[i] = i
        while len(front):
            near = linked[front].any(axis=0) & (root < 0)
            root[near] = i
            front = np.flatnonzero(near)
    return [(ids[i], ids[root[i]], int(degree[i])) for i in range(n)]


def link_groups(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y) for members (group, doc_id): each linked document of a group with the root of its component there.

    Groups of bounded size stream through, one in memory at a time.
    """

    def run(frames):
        at, ids, held = None, [], []

        def close():
            sets = shingle_sets(held)
            return [r[:2] for r in link_group(ids, sets) if r[0] != r[1]]

        for pdf in frames:
            done = []
            for g, d, t in zip(pdf["group"], pdf["doc_id"], pdf["text"]):
                if g != at:
                    if len(held) > 1:
                        done += close()
                    at, ids, held = g, [], []
                ids.append(d), held.append(utf8(t))
            if done:
                yield pd.DataFrame(done, columns=["x", "y"])
        if len(held) > 1 and (done := close()):
            yield pd.DataFrame(done, columns=["x", "y"])

    rows = members.join(texts, "doc_id").select("group", "doc_id", "text")
    return rows.repartition(_parts(members.sparkSession), "group").sortWithinPartitions("group", "doc_id").mapInPandas(run, "x long, y long")


def star_groups(near: DataFrame) -> DataFrame:
    """(group, doc_id): each centre c with its x, in groups of bounded size, however many they are."""
    many = near.groupBy("c").agg(F.ceil(F.count("*") / (GROUP_DOCS - 1)).cast("long").alias("n"))
    sided = near.join(many, "c").withColumn("group", F.xxhash64("c", F.pmod(F.xxhash64("x", F.lit(9)), F.col("n")), F.lit(11)))
    return sided.select("group", F.col("x").alias("doc_id")).unionByName(sided.select("group", F.col("c").alias("doc_id")).distinct())


# ---------------------------------------------------------------- what stars lose


def strays(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(block, doc_id, k, stray) for buckets whose members lie in several components k: whether k is not the bucket's largest."""
    members = edges.select(F.col("key").alias("block"), F.col("x").alias("doc_id")).unionByName(edges.groupBy(F.col("key").alias("block")).agg(F.min("c").alias("doc_id")))
    rows = members.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("block", "doc_id", F.coalesce("component", "doc_id").alias("k"))
    main = rows.groupBy("block", "k").count().groupBy("block").agg(F.max_by("k", F.struct("count", -F.col("k"))).alias("main"), F.count("*").alias("n")).where("n > 1")
    return rows.join(main.drop("n"), "block").withColumn("stray", F.col("k") != F.col("main")).drop("main")


def _faced(rows: DataFrame) -> DataFrame:
    """(task, side, part, doc_id, k, n_shingles, marks) from (block, part, doc_id, k, n_shingles, marks, stray): every stray of a block meets every member in one task.

    A task has some strays (side 0) first, then the members of some of the block's parts (side 1), part by part.
    """
    size = rows.groupBy("block").agg(
        F.ceil(F.sum(F.col("stray").cast("long")) / HELD).cast("long").alias("n_held"), F.ceil(F.count("*") / STREAMED).cast("long").alias("n_streamed")
    )
    rows = rows.join(size.where("n_held > 0"), "block")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = rows.where("stray").withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.col("n_held"))).withColumn("j", every("n_streamed"))
    sent = rows.withColumn("i", every("n_held")).withColumn("j", F.pmod(F.xxhash64("part", F.lit(17)), F.col("n_streamed")))
    cols = [F.xxhash64("block", "i", "j", F.lit(19)).alias("task"), "side", "part", "doc_id", "k", "n_shingles", "marks"]
    both = held.withColumn("side", F.lit(0)).select(*cols).unionByName(sent.withColumn("side", F.lit(1)).select(*cols))
    return both.repartition(_parts(rows.sparkSession), "task").sortWithinPartitions("task", "side", "part", "doc_id")


def near_groups(rows: DataFrame) -> DataFrame:
    """(x, group) from (block, part = group, doc_id, k, n_shingles, marks, stray): strays and the groups where a member of another component may be linked."""

    def run(frames):
        task, part, ids, ks, sizes, marks, held, hit = None, None, [], [], [], [], None, None
        out = []

        def close():
            if hit is not None:
                out.extend((ids[i], part) for i in np.flatnonzero(hit))

        for pdf in frames:
            for t, side, p, d, k, n, m in pdf[["task", "side", "part", "doc_id", "k", "n_shingles", "marks"]].itertuples(index=False):
                if t != task:
                    close()
                    task, part, ids, ks, sizes, marks, held, hit = t, None, [], [], [], [], None, None
                if side == 0:
                    ids.append(d), ks.append(k), sizes.append(n), marks.append(m)
                    continue
                if held is None:
                    held, ks = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(-1, BINS).T.copy(), np.array(ks)
                    sizes = np.array(sizes)
                if p != part:
                    close()
                    part, hit = p, np.zeros(len(ids), dtype=bool)
                open_ = np.flatnonzero(~hit & (ks != k) & (4 * np.minimum(sizes, n) >= 3 * np.maximum(sizes, n)))
                if len(open_):
                    same = (held[:, open_] == np.frombuffer(m, dtype=np.uint8)[:, None]).sum(axis=0, dtype=np.uint8)
                    hit[open_] = may_link(same, sizes[open_], n)
            if out:
                yield pd.DataFrame(out, columns=["x", "group"])
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=["x", "group"])

    return _faced(rows).mapInPandas(run, "x long, group long")


def _known_as(names: dict, k: int) -> int:
    """The component that k has been joined to in a task."""
    at = k
    while at in names:
        at = names[at]
    if at != k:
        names[k] = at
    return at


def stray_links(pairs: DataFrame, named: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (x, y) that join components, by exact overlaps of x with all members of the group, for pairs (x, group).

    `named`: (group, doc_id, k). A task holds a group and lets some of its strays stream past.
    """

    def run(frames):
        task, ids, ks, held, terms, who, size, names = None, [], [], [], None, None, None, {}
        for pdf in frames:
            out = []
            sets = shingle_sets([utf8(t) for t in pdf["text"]])
            for t, side, d, k, s in zip(pdf["task"].tolist(), pdf["side"].tolist(), pdf["doc_id"].tolist(), pdf["k"].tolist(), sets):
                if t != task:
                    task, ids, ks, held, terms, names = t, [], [], [], None, {}
                if side == 0:
                    ids.append(d), ks.append(k), held.append(s)
                    continue
                if terms is None:
                    ks, size = np.array(ks), np.array([len(x) for x in held])
                    terms = np.concatenate(held)
                    order = np.argsort(terms, kind="stable")
                    terms, who = terms[order], np.repeat(np.arange(len(ids)), size)[order]
                    held = []
                k = _known_as(names, k)
                if (ks == k).all():
                    continue
                lo, hi = np.searchsorted(terms, s, "left"), np.searchsorted(terms, s, "right")
                n = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(who[at], minlength=len(ids))
                linked = 100 * both >= 75 * (size + len(s) - both)
                for other in np.unique(ks[linked]).tolist():
                    if other != k:
                        out.append((d, ids[int(np.flatnonzero(linked & (ks == other))[0])]))
                        ks[ks == other] = k
                        names[other] = k
            if out:
                yield pd.DataFrame(out, columns=["x", "y"])

    many = pairs.groupBy("group").agg(F.ceil(F.count("*") / HELD).cast("long").alias("n"))
    cols = [F.xxhash64("group", "i", F.lit(23)).alias("task"), "side", "doc_id", "k"]
    held = named.join(many, "group").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("side", F.lit(0)).select(*cols)
    sent = pairs.join(many, "group").withColumnRenamed("x", "doc_id").join(named.select("doc_id", "k"), "doc_id")
    sent = sent.withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.col("n"))).withColumn("side", F.lit(1)).select(*cols)
    rows = held.unionByName(sent).join(texts, "doc_id").select("task", "side", "doc_id", "k", "text")
    return rows.repartition(_parts(texts.sparkSession), "task").sortWithinPartitions("task", "side", "doc_id").mapInPandas(run, "x long, y long")


def meetings(edges: DataFrame, comp: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (x, group) and members (group, doc_id, k), where x may be linked with a member of another component that it shares a bucket with.

    None if no bucket has several components.
    """
    apart = materialize(strays(edges, comp), "strays")
    if apart.isEmpty():
        return None
    # Members that have a centre in common come together in groups; which ones do matters for speed only.
    first = edges.groupBy("x").agg(F.min("c").alias("c")).select(F.col("x").alias("doc_id"), "c")
    ends = apart.groupBy("doc_id").agg(F.min("k").alias("k")).join(first, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    size = ends.groupBy("c").agg(F.ceil(F.count("*") / GROUP_DOCS).cast("long").alias("n"))
    ends = ends.join(size, "c").select(F.xxhash64("c", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("n")), F.lit(5)).alias("group"), "doc_id", "k")
    named = materialize(ends.join(marks, "doc_id"), "named")
    faced = apart.select("block", "doc_id", "stray").join(named.withColumnRenamed("group", "part"), "doc_id")
    return materialize(near_groups(faced).distinct(), "pairs"), named.select("group", "doc_id", "k").distinct()


def representatives(sig: DataFrame) -> DataFrame:
    """(set_key, doc_id, n_shingles, bands, marks): of each class of equal sets the smallest id."""
    told = F.min_by(F.struct("n_shingles", "bands", "marks"), "doc_id")
    got = sig.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), told.alias("s"))
    return got.select("set_key", "doc_id", "s.*")


def same_documents(sig: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, y): ids that occur with several different texts, each with the representatives of those texts."""
    several = sig.where("set_key is not null and doc_id is not null").groupBy("doc_id").agg((F.min("set_key") < F.max("set_key")).alias("several")).where("several").drop("several")
    rows = sig.join(several, "doc_id").select("doc_id", "set_key").distinct()
    return rows.join(reps.select("set_key", F.col("doc_id").alias("y")), "set_key").select(F.col("doc_id").alias("x"), "y").where("x <> y")


def links(sig: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) for representatives that are linked with others."""
    marks = reps.select("doc_id", "n_shingles", "marks")
    edges = materialize(stars(reps), "stars")
    near = materialize(near_stars(edges, marks), "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    who = edges.select(F.col("x").alias("doc_id")).unionByName(edges.select(F.col("c").alias("doc_id"))).distinct()
    rows = rows.join(who, "doc_id", "left_semi")
    texts = materialize(rows.groupBy("doc_id", F.xxhash64("text").alias("_t")).agg(F.first("text").alias("text")).drop("_t"), "texts")
    # Written before components() reads it: one Python worker for each running task, not two.
    found = materialize(link_groups(star_groups(near), texts).unionByName(same_documents(sig, reps)), "links")
    comp = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    met = meetings(edges, comp, marks)
    if met is not None:
        more = materialize(stray_links(*met, texts), "links")
        joined = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
        comp = components(joined)
    for x in (edges, near, texts):
        discard(x)
    return comp


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null or blank text: empty set, a component of its own. Rows that repeat a doc_id are one document: their
    texts all count, and a row has the component of its text. A null doc_id takes no part: null component_id,
    kept. An empty table gives no rows; other columns are ignored.
    """
    sig = materialize(signatures(docs), "signatures")
    reps = materialize(representatives(sig), "reps")
    comp = links(sig, reps, docs)
    told = reps.join(comp, F.col("doc_id") == F.col("node"), "left").select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    rows = sig.select("doc_id", "n_shingles", "set_key")
    alone = rows.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("set_key is not null and doc_id is not null").join(told, "set_key").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; rows without doc_id stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op9_star_minhash(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
