"""Merkle manifest, vector codes and exact duplicates against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("slateflow.llm")
from slateflow.llm import exact_dedup, merkle, vector_codes  # noqa: E402

LEAST = lambda r: tuple((x is not None, x) for x in r)  # noqa: E731  nulls sort first


def same(got, want):
    return sorted(map(tuple, got), key=LEAST) == sorted(want, key=LEAST)


def low(t):
    return t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


# ---------------------------------------------------------------- op11


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for i, source, lang, n, t in rows:
        leaf = lambda x: digest(*map(show, (i, source, lang, n, x)))  # noqa: B023, E731
        by[source].append((i, leaf(t), leaf(t and low(t))))

    def climb(nodes, at):
        path = []
        while len(nodes) > 1:
            path.append((nodes[at // 16 * 16 : at // 16 * 16 + 16], at % 16))
            nodes, at = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], at // 16
        return nodes[0], path

    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subroots = [climb([r[1] for r in by[x]], 0)[0] for x in names]
    out = []
    for k, x in enumerate(names):
        root, upper = climb(subroots, k)
        for at, (i, leaf, tampered) in enumerate(by[x]):
            path = climb([r[1] for r in by[x]], at)[1] + upper
            acc = tampered if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
            for run, j in path:
                acc = digest(*run[:j], acc, *run[j + 1 :])
            out.append((i, leaf, subroots[k], root, digest(*[h for run, j in path for q, h in enumerate(run) if q != j]), acc, acc == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, level int, tree long, hash string, part long"


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (17, 1), (40, 40), (700, 3), (60, 20)])
def test_manifest(spark, n, sources):
    rng = random.Random(n)
    rows = [(rng.choice([i, i, i, i // 9, None]), None if i % sources == 0 else f"S{i % sources}ä", rng.choice([None, "", "en"]), rng.choice([None, i]), rng.choice([None, "", "Abc É", "x" * 9, "WORD " * 40_000 if i == 7 else "W"])) for i in range(n)]
    rows += rows[:2] if n > 17 else []  # repeated rows
    df = spark.createDataFrame([(*r, 1, 2, "h", 3) for r in rows], DOCS).repartition(3)
    got = merkle.op11_sparse_forest(spark, df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert same(got.collect(), brute_manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle.op11_sparse_forest(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_fragments_join_in_any_grouping(monkeypatch):
    """The monoid: whatever leaves a fragment holds, and however fragments are merged, the same runs and root come out."""
    sizes = [1, 300, 16, 17, 5, 1, 1, 40, 2, 256, *[1] * 20]
    nodes = [(t, n, 0, p, digest(str(t), str(p)), (p, None)) for t, n in enumerate(sizes) for p in range(n)]

    def told(seed):
        rng, found = random.Random(seed), []

        def fragment(some):
            f = merkle.Fragment(len(sizes))
            for x in some:
                f.put(*x)
            found.extend(map(repr, f.runs))
            return [(t, s, lv, p, *v) for (t, s, lv, _), held in f.open.items() for p, v in held.items()]

        rng.shuffle(nodes)
        cuts = sorted(rng.sample(range(len(nodes)), rng.randrange(1, 9)))
        parts = [fragment(nodes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(nodes)])]
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            parts.append(fragment(a + b))
        assert parts == [[]]
        return sorted(found)

    assert told(1) == told(2) == told(3)


def test_parts_keep_only_their_ends(spark):
    """What goes from part to part is bounded by the tree's height, not by the leaves."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as source", "'en' as lang", "id as n_chars", "cast(id as string) as text")
    rows, trees = merkle.indexed(merkle.leaves(docs), 20_000)
    assert trees == 51
    left = merkle.part_fragments(rows, trees).where("open").groupBy("part").count().collect()
    assert left and max(r["count"] for r in left) <= 3 * 4 * 30


# ---------------------------------------------------------------- op12


def brute_codes(rows):
    rows = [(i, label, [math.floor(4096 * x) for x in e]) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = -(-len(rows[0][2]) // 8)
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[part(x, p) for _, _, x in rows[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(p):
        return [min((far(part(x, p), c), j) for j, c in enumerate(books[p])) for _, _, x in rows]

    for _ in range(6):
        for p, found in [(p, nearest(p)) for p in range(8)]:
            for j in range(len(books[p])):
                mine = [part(x, p) for (_, _, x), (_, k) in zip(rows, found) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [nearest(p) for p in range(8)]
    errors = [sum(f[k][0] for f in found) for k in range(len(rows))]
    by = defaultdict(int)
    for (_, label, _), e in zip(rows, errors):
        by[label] += e
    key = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(i, "".join(f"{f[k][1]:02x}" for f in found), errors[k], by[label], key) for k, (i, label, _) in enumerate(rows)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, n int, ids string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, label, "c", 1, "x") for i, e, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize(("n", "dim", "scale"), [(400, 16, 1.0), (150, 20, 0.001), (9, 8, 1.0), (300, 8, 20_000.0)])
def test_codes(spark, monkeypatch, n, dim, scale):
    """Ties (few different values), repeated ids and vectors, fewer vectors than entries, parts of unequal length, components past a double's exact products."""
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 64)
    rng = random.Random(dim)
    f32 = lambda x: float(np.float32(x))
    rows = [(rng.choice([k, k, k // 2]), [f32(rng.choice([rng.gauss(0, 1), rng.randrange(-2, 3)]) * scale) for _ in range(dim)], rng.choice([None, 1, 1, 1, 2])) for k in range(n)]
    rows += [(rows[0][0], rows[0][1], 1)] * (n // 3)
    odd = [(1, None, 1), (2, [math.nan] * dim, 1), (3, [0.5] * (dim - 1) + [math.inf], 2), (4, [None] + [0.5] * (dim - 1), 2), (5, [0.5] * (dim + 8), 1), (6, [], 1), (7, [3e30] * dim, 1)]
    if n > 16:
        rows.append((None, [f32(0.25 * scale)] * dim, None))
    got = vector_codes.op12_yinyang(spark, vectors_of(spark, rows + odd))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert same(got.collect(), brute_codes([(i, e, label) for i, e, label in rows]))


def test_codes_of_nothing(spark):
    assert vector_codes.op12_yinyang(spark, vectors_of(spark, [])).count() == 0
    assert vector_codes.op12_yinyang(spark, vectors_of(spark, [(1, None, 1)])).count() == 0


def test_bounds_spare_distances_and_hide_nothing():
    """After each round the bounds hold, the entries are the first of the nearest, and far fewer distances are asked for than there are."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 30, (500, 4)) for m in (0, 500, 900, 1500)] + [np.tile([[5, 5, 5, 5]], (200, 1))]).astype(np.int64)
    book = vector_codes.Book(x[::140][:16].copy(), vector_codes.grouped(x[::140][:16]), np.zeros(16))
    state, asked = None, []
    for _ in range(8):
        *state, n = vector_codes.assign(x, book, state)
        asked.append(n)
        d = ((x[:, None] - book.entries) ** 2).sum(axis=2)
        entry, upper, lower = state
        assert (entry == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), entry])).all()
        away = np.where(np.arange(16) == entry[:, None], np.inf, np.sqrt(d))
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= away[:, book.group == g].min(axis=1)).all()
        sums = np.array([x[entry == j].sum(axis=0) for j in range(16)])
        book = book.moved(sums, np.bincount(entry, minlength=16))
    assert asked[0] >= 16 * len(x) and asked[-1] < 4 * len(x)


# ---------------------------------------------------------------- op13


def brute_copies(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[low(t or "")].append(i)
    told = {t: (max((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items()}
    return [(i, best, n, i == best, h) for i, t in rows for best, n, h in [told[low(t or "")]]]


TEXTS = "doc_id long, text string, digest string, segment long, maybe boolean, keep_id string"


@pytest.mark.parametrize("small", [False, True])
def test_copies(spark, monkeypatch, small):
    """Also with a filter in several rounds, segments of a few positions, and partial counts given away every few rows."""
    if small:
        monkeypatch.setattr(exact_dedup, "ROUND_BYTES", 256)
        monkeypatch.setattr(exact_dedup, "FLUSH_ROWS", 50)
        monkeypatch.setattr(exact_dedup, "SEGMENT_BITS", 7)
    rng = random.Random(5)
    texts = [None, "", " ", "É", "é", "straße", "STRASSE", "K", "K", "a" * 300_000, "A" * 300_000]
    rows = [(i, rng.choice([f"Text {i}", f"text {i // 2}", rng.choice(texts), "HOT copy" if i % 2 else "hot COPY"])) for i in range(1500)]
    rows += [(None, "hot copy"), (None, "only without id"), (None, "only without id"), *rows[:5], *rows[:5], (-3, "below zero")]
    df = spark.createDataFrame([(i, t, "d", 1, True, "k") for i, t in rows], TEXTS).repartition(5)
    assert exact_dedup.Layout(len(rows)).rounds == (8 if small else 1)
    got = exact_dedup.op13_two_pass_bloom(spark, df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = brute_copies(rows)
    assert same(got.collect(), want)
    if not small:
        stays = {(i, low(t or "")) for (i, t), w in zip(rows, want) if i is None or w[3]}
        assert {(r["doc_id"], low(r["text"] or "")) for r in exact_dedup.drop_exact_duplicates(df).collect()} == stays


def test_copies_of_nothing(spark):
    assert exact_dedup.op13_two_pass_bloom(spark, spark.createDataFrame([], TEXTS)).count() == 0


def test_only_what_may_repeat_is_shuffled(spark):
    """With 8.7 positions a row, (1 - exp(-3 / 8.7)) ** 3 = 0.024 of all different texts are held for a repeat by mistake; every repeat is held."""
    df = spark.range(30_000).selectExpr("id as doc_id", "unhex(sha2(cast(if(id < 200, 0, id) as string), 256)) as digest")
    (tested,) = exact_dedup.maybe_repeated(df, exact_dedup.Layout(30_000))
    held = {r["doc_id"] for r in tested.where("maybe").collect()}
    assert held >= set(range(200)) and len(held) < 200 + 0.03 * 29_800 and tested.count() == 30_000
