"""Each operator against a brute-force version on small rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import html
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("slateflow.llm")
from slateflow.llm import ann, common, decontaminate, html_wrapper, langid, near_dedup, packing, pii, queries, sharding, substring_dedup, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, p string, _text string, `group` long, score double"


def docs_of(spark, texts, langs=None):
    """(id, text) rows with columns whose names operators use themselves."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", None, "r", "q", "z", 1, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n))


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# ---------------------------------------------------------------- op1

PAGES = "page_id long, url string, html string, host string, verdict string"


def test_urls(spark):
    link = '<LINK rel="canonical" href="{}">'
    rows = [
        (1, "https://A.Example.com/en/x?q#f", None), (2, "http://www.example.com/en/", ""), (3, "http://shop.net/fr/a", None), (4, None, None), (5, "no scheme", None),
        (6, "http://a.org/1", link.format("http://shop.net/fr/a")), (7, "http://b.org/2", '<meta http-equiv="refresh" content="0; url=http://a.org/1">'), (8, "http://c.org", None),
        (9, "http://d.org/d/e", link.format("/f")), (10, "http://d.org/f", link.format("//good.com/x")), (11, "http://a.org/1#frag", None), (11, "http://a.org/1#frag", None),
        (12, "http://xnet/es/", None), (13, "http://net/es/", None), (14, "http://e.org/a", link.format("http://e.org/a")), (15, "http://f.org/a?x=1&y", link.format("b?x=1&amp;y")), (16, "http://f.org/b?x=1&y", link.format("http://z.net/es/1")),
        (17, "http://g.org/loop", link.format("http://h.org/loop")), (18, "http://h.org/loop", link.format("http://g.org/loop")), (19, "x" * 50_000 + "://n.net/fr/" + "y/" * 20_000, None), (20, "a://b://c.com/", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.op1_redirect_classes(spark, df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("shop.net", "/fr/a", "net/fr/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("a.org", "/1", None, "block") and got[7][3] == "block" and got[11][3] == "block"
    assert got[8] == ("c.org", "", None, "allow")
    assert got[9][3] == got[10][3] == "allow"
    assert got[12] == ("xnet", "/es/", None, "allow") and got[13] == ("net", "/es/", "net/es/", "block")
    assert got[15][3] == got[16][3] == "block" and got[17][3] == got[18][3] == "allow"
    assert got[19][0] == "n.net" and got[19][3] == "block" and got[20][:2] == ("b:", "//c.com/")
    assert url_filter.op1_redirect_classes(spark, df).count() == len(rows)
    assert url_filter.op1_redirect_classes(spark, df.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "http://a.org/1", link.format("http://b.net/fr/")), (2, "http://a.org/2", link.format("http://a.org/1")), (3, "http://c.com/", link.format("http://a.org/2"))], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(both).collect()} == {1: "allow", 2: "allow", 3: "allow"}  # an explicit allow goes before a block


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500, 500 + i) for i in range(1, 80)] + [(600 + i, 601 + i) for i in range(40)] + [(None, 1), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_rules_and_classes(spark, monkeypatch):
    """Rules by joins decide as rules by expression do, over generated chains, hubs and loops of redirects; against brute force."""
    rng = random.Random(21)
    hosts = [f"{a}{b}{c}.{d}" for a in ("", "www.", "m.x.") for b in "abc" for c in "xyz" for d in ("com", "net", "co.uk")]
    paths = ["/", "/en/", "/en/news/", "/fr/a", ""]
    rules = list({(v, h, p): 1 for v, h, p in [(rng.choice(["allow", "block"]), rng.choice([*hosts, "co.uk"]), rng.choice(["/", "/en/", "/e", "/en/news/", "/fr/a"])) for _ in range(25)] + [("block", "hub.org", "/en/")]})
    rules = [r for r in rules if sum(r[1:] == x[1:] for x in rules) == 1]
    def split(u):
        host, _, rest = u.split("://", 1)[1].partition("/")
        return host, "/" + rest if _ else ""

    def rule(u):
        h, p = split(u)
        fits = [(len(r[1] + r[2]), *r) for r in rules if (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
        return max(fits) if fits else None

    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    key = lambda u: (split(u)[0], split(u)[1] or "/")
    rng.shuffle(urls)
    to = {u: [] for u in urls}
    for a, b in zip(urls[:40], urls[1:41]):  # a chain
        to[a].append(b)
    for i in range(30):  # a hub that was not crawled
        urls.append(f"http://n{i}.org/{i}")
        to[urls[-1]] = ["http://hub.org/en/"]
    for a, b in ((urls[100], urls[101]), (urls[101], urls[100]), (urls[102], urls[102])):
        to[a].append(b)
    rows = [(i, u, "".join(f'<link rel=canonical href="{t}">' if i % 2 else f'<meta http-equiv="refresh" content="1;url={t}">' for t in to[u])) for i, u in enumerate(urls)]

    near = defaultdict(set)
    for a, ts in to.items():
        for t in ts:
            near[key(a)].add(key(t)), near[key(t)].add(key(a))
    want = {}
    for i, u in enumerate(urls):
        seen, todo = {key(u)}, [key(u)]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        votes = {(rule(f"http://{h}{p}") or (0, None))[1] for h, p in seen} if near[key(u)] else set()
        own = rule(u)
        want[i] = (own[2] + own[3] if own else None, own[1] if own else "allow" if "allow" in votes else "block" if "block" in votes else "allow")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for listed in (100, 0):
        monkeypatch.setattr(url_filter, "LISTED_RULES", listed)
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()} == want
    by_class = sum(r is None and v == "block" for r, v in want.values())
    assert by_class >= 30 and len({v for r, v in want.values() if r is None}) == 2


# ---------------------------------------------------------------- op2


def cosine_top(rows, k=5):
    ok = {}
    for i, e in rows:
        if i is None or e is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        ok[i] = np.array(e, dtype=np.float32).astype(float)
    out = {}
    for q, a in ok.items():
        if q % 50 == 0:
            c = [(-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), v) for v, b in ok.items() if v != q and len(b) == len(a)]
            out[q] = [(v, -s) for s, v in sorted((round(s, 12), v) for s, v in c)[:k]]
    return {q: v for q, v in out.items() if v}


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)]  # ties go to the smaller id
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (2200, []), (None, [1.0] * 8), (2250, [float("inf")] + [1.0] * 7), (2300, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, 0, "x") for i, e in rows], "vec_id long, embedding array<float>, rank int, dim string")
    got = defaultdict(list)
    for r in ann.op2_block_join(spark, df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = cosine_top(rows)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert ann.op2_block_join(spark, df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.op2_block_join(spark, few).collect()] == [(0, 1)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_every_vector_of_a_repeated_id_counts(spark, monkeypatch, kind):
    """Unusable vectors of an id take nothing from its others, doubles keep their last bits, and an id is as near as its nearest vector."""
    for name, value in (("ROW_BLOCK", 30), ("MOST_ROWS", 40), ("QUERY_BLOCK", 3), ("TILE_ROWS", 7), ("TILE_QUERIES", 2)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    rows = [(i % 90, (base + 1e-7 * rng.normal(size=6) if i % 3 else rng.normal(size=6)).tolist()) for i in range(200)]
    rows += [(i, [0.0] * 6) for i in range(0, 90, 7)] + [(i, [float("nan")] * 6) for i in range(0, 90, 5)] + [(50, rows[0][1]), (50, rows[0][1])]
    cast = np.float32 if kind == "float" else np.float64
    usable = [(i, np.array(e, dtype=cast).astype(float)) for i, e in rows if all(map(np.isfinite, e)) and any(e)]
    want = {}
    for q in (0, 50):
        best = {}
        for a in (e for i, e in usable if i == q):
            for i, b in usable:
                if i != q:
                    best[i] = max(best.get(i, -9), np.add.accumulate(a * b)[-1] / (np.sqrt(np.add.accumulate(a * a)[-1]) * np.sqrt(np.add.accumulate(b * b)[-1])))
        want[q] = sorted(best, key=lambda i: (-best[i], i))[:5]
    got = defaultdict(list)
    for r in ann.op2_block_join(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == want


def shuffled(plan) -> int:
    """Bytes that a plan's exchanges have written."""
    own = plan.metrics().get("dataSize").get().value() if plan.nodeName() == "Exchange" else 0
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    below += [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else []
    return own + sum(map(shuffled, below))


def test_search_shuffles_rows_once_for_many_queries(spark):
    """8,192 queries against as many rows: what is shuffled is a few times the vectors, and the nearest are those of brute force."""
    x = np.random.default_rng(6).normal(size=(8192, 64)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    out = ann.nearest(df, df, 5)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in out.collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in range(0, 8192, 97):
        score = y @ y[q]
        score[q] = -9
        assert [got[q, rank] for rank in range(1, 6)] == np.argsort(-score)[:5].tolist()
    assert len(got) == 5 * 8192 and 0 < shuffled(out._jdf.queryExecution().executedPlan()) < 8 * x.nbytes, shuffled(out._jdf.queryExecution().executedPlan()) / x.nbytes


# ---------------------------------------------------------------- op3


@pytest.mark.parametrize("size", [1e-310, 1e-200, 1.0, 1e200, 1e307])
def test_doubles_of_any_size(spark, size):
    """Scores are those of the vectors at ordinary size, whatever the scale of each."""
    rng = np.random.default_rng(5)
    x = np.rint(rng.normal(size=(150, 6)) * 8) / 8
    scaled = [(i, np.ldexp(v, int(np.log2(size))).tolist() if i % 3 else v.tolist()) for i, v in enumerate(x)]
    kind = "vec_id long, embedding array<double>"
    want = ann.op2_block_join(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], kind)).orderBy("query_id", "rank").collect()
    got = ann.op2_block_join(spark, spark.createDataFrame(scaled, kind)).orderBy("query_id", "rank").collect()
    assert got == want and len(got) == 15


def test_sharding(spark):
    rng = random.Random(2)
    texts = [(i, prose(rng, rng.randrange(1, 200))) for i in range(600)] + [(i, "same text") for i in range(600, 900)] + [(900, None), (901, ""), (None, "no id"), (None, "no id"), (902, "é" * 5000), (5, "twice"), (5, "twice")]
    rows = sharding.op3_virtual_slots(spark, docs_of(spark, texts)).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values()) + 50
    assert sharding.op3_virtual_slots(spark, docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [(7, "the same"), (None, "the same"), (7, None)])
def test_a_key_of_a_third_of_all_rows(spark, hot):
    rng = random.Random(5)
    rows = [(100 + i, prose(rng, rng.randrange(1, 40))) for i in range(4000)] + [hot] * 2000
    got = sharding.op3_virtual_slots(spark, docs_of(spark, rows)).collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 6000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.01 * max(load.values())
    assert len({r["shard"] for r in got if r["doc_id"] == hot[0]}) == 8


def test_slot_map_is_reopened(spark, tmp_path):
    path, docs = str(tmp_path / "map"), docs_of(spark, [(i, "x" * (i % 50)) for i in range(500)])
    _, first = sharding.shard(docs, 4, 64, sharding.SlotMap(spark, path))
    again = sharding.SlotMap(spark, path)
    assert (again.version, again.shards) == (first.version, first.shards)
    out, grown = sharding.shard(docs, 5, 64, again)
    assert grown.version == first.version + 1 and {r["shard"] for r in out.collect()} == set(range(5))
    kept = sum(a == b for a, b in zip(first.shards, grown.shards))
    assert kept > 40 and sharding.SlotMap(spark, path).shards == grown.shards


def test_slot_map_versions(spark):
    m = sharding.SlotMap(spark)
    m.save([s % 4 for s in range(64)])
    weight = [random.Random(s).randrange(1, 100) for s in range(64)]
    before = list(m.shards)
    m.rebalance(weight, 5)
    assert m.version == 1 and m.load(0).where("shard = 4").count() == 0
    moved = [s for s in range(64) if m.shards[s] != before[s]]
    load = Counter()
    for s, d in enumerate(m.shards):
        load[d] += weight[s]
    assert len(moved) < 32 and max(load.values()) - min(load.values()) <= 5


# ---------------------------------------------------------------- op4


def repeats(texts):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [600_000, 40])
def test_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "PACK_BYTES", 4000)
    rng = random.Random(limit)
    passage = prose(rng, 60)
    texts = [(i, prose(rng, rng.randrange(0, 300))) for i in range(60)]
    texts += [(100 + i, f"{prose(rng, 20)}\n{passage}\t{prose(rng, 50)}") for i in range(40)]  # many share a passage
    texts += [(200 + i, texts[3][1]) for i in range(5)] + [(300, None), (301, ""), (302, " \t\n"), (None, "a b"), (303, "x " * 200), (304, prose(rng, 34)), (305, texts[70][1][:400]), (306, passage.replace(" ", "\x0b")), (307, passage.replace(" ", " "))]
    texts += [(3, texts[3][1]), (308, prose(rng, 20_000, 5000))]
    got = substring_dedup.remove_repeats(docs_of(spark, texts), limit=limit).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(repeats(texts))
    if limit == 40:
        assert substring_dedup.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_trees_of_words():
    """Order, common prefixes and nodes at every depth, against plain comparison of words."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        rows = rng.integers(0, 3, (int(rng.integers(1, 60)), 9)).astype(np.uint64)
        order, lcp = substring_dedup.suffix_order(rows)
        s = [tuple(r) for r in rows[order].tolist()]
        assert s == sorted(s) and lcp[0] == 0
        for a, b, n in zip(s, s[1:], lcp[1:].tolist()):
            assert a[:n] == b[:n] and (n == 9 or a[n] != b[n])
        for depth in range(10):
            node = substring_dedup.nodes(order, lcp, depth)
            for i in range(len(rows)):
                for j in range(i):
                    assert (node[i] == node[j]) == (rows[i, :depth] == rows[j, :depth]).all()


def test_repeats_below_deep_nodes(monkeypatch):
    """Windows around an anchor, of which any part may differ on either side, against plain counting."""
    rng = np.random.default_rng(4)
    anchor = rng.integers(1, 2**60, 8).astype(np.uint64)
    heads, words, windows = [], [], []
    for k in range(60):
        left, right = int(rng.integers(0, 28)), int(rng.integers(0, 28))
        if left + right < 27:
            right = 27 - left
        text = np.r_[rng.choice([5, 6], left, p=[0.97, 0.03]), anchor, rng.choice([7, 8], right, p=[0.97, 0.03])].astype(np.uint64)
        low = max(0, 27 - right)
        heads.append((k, left, low, len(text), rng.random() < 0.05))
        words.append(text)
        windows.append({o: tuple(text[left - o : left - o + 35].tolist()) for o in range(low, left + 1)})
    seen = Counter()
    for h, w in zip(heads, windows):
        for o, x in w.items():
            seen[(o, x)] += 1 + h[4]
    got = substring_dedup.deep_repeats(np.array(heads, dtype=substring_dedup.HEAD), np.concatenate(words))
    assert [int(m) for m in got] == [sum(1 << o for o, x in w.items() if seen[(o, x)] > 1) for w in windows]


# ---------------------------------------------------------------- op5

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def base_spans(t):
    out = []
    for k, p in KINDS:
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "a.b+c@d-e.f.g", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.0255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (523) 555-7040", "+12", "+49 30 1234567 8.8.8.8", "é", "😀", "12", "-", "\n", " ", "word", "00000000000000", "1-2-3"]
    texts = [(i, rng.choice(["", " ", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(250)]
    texts += [(300, None), (301, ""), (302, "a@b.cd " * 1500), (303, "9" * 20_000), (304, "a" * 50_000), (305, "1-" * 5000), (306, "a@" + "b." * 3000 + "c"), (None, "x@y.zz"), (5, texts[5][1]), (307, "+" + "1 " * 4000)]
    got = pii.op5_bootstrap(spark, docs_of(spark, texts)).collect()
    want = Counter()
    for i, t in texts:
        b = base_spans(t)
        want[(i, hashlib.sha256(",".join(b).encode()).hexdigest(), *[sum(x.startswith(k) for x in b) for k, _ in KINDS])] += 1
    assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    assert pii.op5_bootstrap(spark, docs_of(spark, texts).limit(0)).count() == 0


def test_bootstrap_finds_unseen_identifiers(spark):
    known = [(i, f"please mail to user{i}@host{i}.org today") for i in range(40)]
    cards = [(100 + i, f"the number is +1 555 010 {1000 + i} now") for i in range(3)]
    unseen = [(200, "please mail to user77(at)host.org-9124 today"), (201, "nothing to 12345 here")]
    got = {r["doc_id"]: r["spans"] for r in pii.op5_bootstrap(spark, docs_of(spark, known + cards + unseen)).collect()}
    t = unseen[0][1]
    assert got[200] == f"context:{t.index('user77')}:{t.index(' today')}"
    assert got[201] == "" and got[0] == "email:15:30"
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs_of(spark, [*known, *unseen, (300, None), (301, "a é b@c.de +1 555 010 1000")])).collect()}
    assert masked[0] == "please mail to <EMAIL> today" and masked[200] == "please mail to <CONTEXT> today" and masked[201] == unseen[1][1] and masked[300] is None
    assert masked[301] == "a é <EMAIL> <PHONE>"


def test_context_is_the_text_before_a_whole_span(spark):
    """Phones of several words seed a pattern; earlier identifiers and long gaps are part of the text before a token."""
    rng = random.Random(8)
    long = "x" * 6000
    rows = [(i, f"you may call me at +1 (0{i:02d}) 555-{7000 + i} now") for i in range(30)]
    rows += [(100 + i, f"reach ids 12345 and user{i}@a.org or") for i in range(30)]
    rows += [(200 + i, f"{long} key" + " " * 5000 + f"u{i}@b.org") for i in range(30)]
    new = [(300, "please call me at ext-5550199 soon"), (301, "ids 12345 and acct-99812"), (302, f"{long} key acct-77123"), (303, f"y{long[1:]} key acct-77124"), (304, "pad " * 2000 + "é me at ref-4410 end")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["spans"] for r in pii.op5_bootstrap(spark, docs_of(spark, rows + new)).collect()}
    for (i, t), token in zip(new, ("ext-5550199", "acct-99812", "acct-77123", None, "ref-4410")):
        assert got[i] == (f"context:{t.index(token)}:{t.index(token) + len(token)}" if token else ""), i
    assert got[0] == "phone:19:36"


def test_texts_of_long_words(spark):
    """Work grows with the text's length: 5 M characters of long words, and a token of very many spans; long contexts are found like others."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdef", k=n))
    far = [word(5000), word(6000), word(430)]
    texts = [(i, f"{word(9000)} {far[0]} {far[1]} u{i}@b.org {far[2]} {far[2]} 10.0.0.{i} end") for i in range(30)]
    texts += [(100, f"x {far[0]}  {far[1]} acct-5519 {far[2]} {far[2]} id-77120 {far[1]} {far[1]} id-77121"), (101, f"{far[0]} acct-5519"), (102, f"{far[0][1:]} {far[1]} acct-5519")]
    texts += [(103, f"{far[0]} {far[1]} " + "(a@b.c)" * 300 + " " + "a@b.c," * 300)]
    texts += [(104, " ".join(word(430) + f"{i:04d}" for i in range(11_600))), (105, word(3000) + " " + word(3000) + " " + "a@b.c," * 20_000)]
    want = discovered(texts[:-2])
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("context:")] for r in pii.op5_bootstrap(spark, docs_of(spark, texts)).collect()}
    assert [got[i] for i, _ in texts[:-2]] == want and len(got) == len(texts)
    assert len(want[30]) == 2 and not want[31] and not want[32]


def discovered(texts):
    """The bootstrap by plain loops: each text's discovered spans."""
    rows = []
    for _, t in texts:
        t = t or ""
        base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in base_spans(t))]
        items = [(a, a, b, True) for a, b in base]
        for m in re.finditer(r"(?<!\S)(?=\S*?(?:[0-9]{3}|@))\S+", t, re.ASCII):
            core = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", m[0])
            a = m.start() + len(m[0]) - len(re.sub(r"^[^A-Za-z0-9]+", "", m[0]))
            if len(core) >= 4 and not any(x < a + len(core) and y > a for x, y in base):
                items.append((m.start(), a, a + len(core), False))
        out = []
        for at, a, b, seed in items:
            two = re.search(r"(?<!\S)(\S+\s+\S+)\s+\S*$", t[:at], re.ASCII)
            if two:
                out.append((re.sub(r"\s+", " ", two[1].lower()), t[a:b], seed, a, b))
        rows.append(out)
    seed_score = defaultdict(float)
    edges = set()
    for p, i, seed, *_ in (x for r in rows for x in r):
        seed_score[i] = max(seed_score[i], float(seed))
        edges.add((p, i))
    known = dict(seed_score)
    for _ in range(pii.ROUNDS):
        by = defaultdict(list)
        for p, i in edges:
            by[p].append(i)
        conf = {p: sum(known[i] for i in x) / (len(x) + 1) for p, x in by.items() if sum(seed_score[i] for i in x) >= pii.LEAST_SEEDS}
        told = defaultdict(float)
        for p, i in edges:
            if conf.get(p, 0) >= pii.LEAST_CONFIDENCE:
                told[i] = max(told[i], conf[p])
        known = {i: max(s, told[i]) for i, s in seed_score.items()}
    good = {p for p, c in conf.items() if c >= pii.LEAST_CONFIDENCE}
    return [sorted({(a, b) for p, _, seed, a, b in r if not seed and p in good}) for r in rows]


def test_discovered_spans_are_brute_force(spark):
    """Many generated contexts, some of which always, mostly, seldom or never stand before personal data."""
    rng = random.Random(31)
    seeds = [lambda: f"u{rng.randrange(500)}@h{rng.randrange(90)}.org", lambda: f"10.{rng.randrange(200)}.3.{rng.randrange(200)}", lambda: f"+1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"]
    others = [lambda: f"id-{rng.randrange(1000, 9999)}", lambda: f"[ref{rng.randrange(100, 999)}x]", lambda: str(rng.randrange(10**5)), lambda: f"({rng.randrange(100, 999)})", lambda: "q" * 200 + str(rng.randrange(100, 999))]
    contexts = [(f"{rng.choice(['call', 'Mail', 'see', 'at', 'to'])} w{i}", rng.choice([0.0, 0.3, 0.85, 0.97, 1.0])) for i in range(40)]
    texts = []
    for d in range(400):
        out = []
        for _ in range(rng.randrange(0, 12)):
            words, share = rng.choice(contexts)
            out.append(f"{words}{rng.choice([' ', '  ', chr(10)])}{(rng.choice(seeds) if rng.random() < share else rng.choice(others))()}{rng.choice(['', ',', '.', ' ok'])}")
        texts.append((d, " ".join(out)))
    texts += [(500, " ".join(f"mail w1 id-{i:05d}" for i in range(1500)) + " a@b.org" * 300), (501, None), (502, "")]
    want = discovered(texts)
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("context:")] for r in pii.op5_bootstrap(spark, docs_of(spark, texts)).collect()}
    assert [got[i] for i, _ in texts] == want
    assert sum(map(len, want)) > 15


# ---------------------------------------------------------------- op6


def test_plan_is_tight():
    rng = random.Random(1)
    for _ in range(30):
        counts = Counter(min(4096, int(rng.paretovariate(0.9) * 40)) for _ in range(rng.randrange(1, 3000)))
        runs, n = packing.plan(dict(counts))
        fill, given = Counter(), Counter()
        nxt = {}
        for i, (s, rank, seq, at) in enumerate(runs):
            end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == s else counts[s]
            for k in range(end - rank):
                nxt.setdefault(seq + k, []).append((at, s))
            given[s] += end - rank
        assert given == counts and len(nxt) == n
        for spans in nxt.values():
            at = 0
            for o, s in sorted(spans):
                assert o == at
                at += s
            assert at <= 4096
            fill[at] += 1
        least = max(-(-sum(s * c for s, c in counts.items()) // 4096), sum(c for s, c in counts.items() if s > 2048))
        assert n <= least * 1.03 + 1


def test_packing(spark, monkeypatch):
    tok = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rng = random.Random(4)
    odd = ["It's we'll I'd", "x'll'S ÀÉ éa ﬁ İI ß ½ x² ａ", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd\x85e", "日本語テキスト 😀👍🏽 !!??", "_a_b__ 12a34 v1.2-x", "퟿�", "a" * 3000, "--- ''' \"q\"", "Ñandú, straße; École!", "́start"]
    texts = [(i, t) for i, t in enumerate(odd)] + [(50, None), (51, ""), (52, "  "), (None, "no id"), (53, " ".join(str(rng.random()) for _ in range(3000))), (54, "same"), (54, "same")]
    texts += [(100 + i, prose(rng, rng.randrange(1, 900))) for i in range(120)]
    t = Tokenizer.from_file(tok)
    want = Counter()
    for i, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            want[(i, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))] += 1
    rows = packing.op6_best_fit(spark, docs_of(spark, texts), tok).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.op6_best_fit(spark, docs_of(spark, texts).limit(0), tok).count() == 0
    monkeypatch.setattr(packing, "TOLD_ROWS", 3)  # the starts of parts by a join
    again = packing.op6_best_fit(spark, docs_of(spark, texts), tok).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in again) == want and len({(r["sequence_id"], r["offset"]) for r in again}) == len(again)
    assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in again) == sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    kept = packing.pack_documents(docs_of(spark, [(1, "one two")]), tok, keep_ids=True).first()
    assert np.frombuffer(kept["ids"], dtype="<u4").tolist() == [*t.encode("one two", add_special_tokens=False).ids, 1]


# ---------------------------------------------------------------- op7


def page(main, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>{main}{extra}<footer>&copy; x</footer></body></html>'


def test_wrapper(spark):
    art = lambda *p: "<article><h1>Head &amp; more</h1>" + "".join(f"<p>{x}</p>" for x in p) + "</article>"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, "http://h.org/a", page(art(*[f"par {i}  {j}\n<b>x</b>" for j in range(i % 4 + 1)]))) for i in range(12)]
    rows += [
        (20, "http://h.org/b", page(art("text"), '<section class="comments"><p>First!</p></section>')), (21, "http://h.org/c", page("<article><p>a<br>b<p>c<div class='share-box'>share</div><form><p>mail</p></form></article>")),
        (22, None, page(art("null url"))), (23, "http://h.org/d", None), (24, "http://h.org/e", ""), (25, "http://x.net/", "<p>bare &lt;b&gt; text</p><aside>side</aside><p>two"), (26, "http://h.org/f", page(art(long))),
        (27, "http://h.org/g", page("<div>outside</div><main><article><p>in</p></article></main><div class='cookie-notice'>ok?</div>")), (27, "http://h.org/g", page("<div>outside</div><main><article><p>in</p></article></main><div class='cookie-notice'>ok?</div>")), (None, "http://h.org/", page(art("no id"))),
        (28, "http://h.org/h", "<body><article><p>cut <scr"), (29, "http://h.org/i", "<article><p>x</p><script>never ends"),
    ]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, text string")
    got = defaultdict(list)
    for r in html_wrapper.op7_wrapper(spark, df).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for i in range(12):
        assert got[i] == ["\n".join(["Head & more", *[f"par {i} {j} x" for j in range(i % 4 + 1)]])]
    assert got[20] == ["Head & more\ntext"] and got[21] == ["a b\nc"] and got[22] == ["Head & more\nnull url"] and got[23] == got[24] == [""]
    assert got[25] == ["bare <b> text\ntwo"] and got[26] == ["Head & more\n" + long] and got[27] == ["in", "in"] and got[None] == ["Head & more\nno id"]
    assert got[28] == ["cut"] and got[29] == ["x"]
    assert html_wrapper.op7_wrapper(spark, df.limit(0)).count() == 0


def test_wrapper_alignment():
    W = html_wrapper
    forms = [W.form(W.Page(page("<article>" + "<p>x</p>" * n + extra + "</article>"))) for n, extra in ((1, ""), (3, ""), (2, "<table></table>"))]
    w = W.infer([(f, facts, 5) for f, facts in forms])
    assert "( ( p # )+ )?" not in w.expression() and "( p # )+" in w.expression() and "( table # )?" in w.expression()
    lost = W.Page("<body><nav><p>menu<article><p>lost end tags")
    assert json.loads(w.dump()) and len(lost.tags) == len(lost.slots) == len(lost.links)
    assert len(W.Chooser.load(w.chooser().dump()).decide(lost)) == len(lost.tags) and w.n == 15
    assert not W.whole(("/div", "div")) and W.whole(("div.a", "p", "/div")) and W.whole(("li",)) and not W.whole(("div", "/p"))


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 40])
def test_align_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_wrapper, "ALIGN_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(400):
        a, b = (rng.choices("abcde", k=rng.randrange(0, 28)) for _ in range(2))
        got = html_wrapper.align(a, b)
        assert [i for i, _ in got if i is not None] == list(range(len(a))) and [j for _, j in got if j is not None] == list(range(len(b)))
        pairs = [(i, j) for i, j in got if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)


def test_pages_of_very_many_or_deep_tags():
    import time

    rng = random.Random(3)
    t = time.process_time()
    one, two = ("".join(f"<{x}>t</{x}>" if rng.random() < 0.9 else f"<{x}>" for x in rng.choices(["div", "ul", "table", "section", "h2", "p"], k=50_000)) for _ in range(2))
    w = html_wrapper.infer([(*html_wrapper.form(html_wrapper.Page(one)), 3)])
    second = html_wrapper.Page(two)
    assert len(w.chooser().decide(second)) == len(second.tags) > 80_000
    deep = html_wrapper.Page("<div>" * 60_000 + "x" + "</b></i></td>" * 60_000)
    assert deep.slots[60_000] == ["x"] and time.process_time() - t < 60


def plain(rng, host, i, n_items, odd):
    """A page without names or article tags, and its main text."""
    words = lambda n: " ".join(f"{host}{rng.randrange(10**6)}" for _ in range(n))
    head, paras = words(6), [words(rng.randrange(15, 60)) for _ in range(rng.randrange(1, 7))]
    body = [f"<p>{x}</p>" for x in paras]
    if odd:
        body.insert(1, f"<table><tr><td>{(cell := words(9))}</td></tr></table>")
        paras.insert(1, cell)
    links = "".join(f'<li><a href="/{k}">{words(2)}</a></li>' for k in range(n_items))
    html_text = f"""<body><div><div>Site {host}</div><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></div>
      <div><div>Sign up for our letter</div><div><h1>{head}</h1><div>Share this story</div>{''.join(body)}<ul>{links}</ul></div><div>Today: {words(3)}</div></div>
      <div>All rights reserved {host} 2024</div></body>"""
    return html_text, "\n".join([head, *paras])


def test_hosts_without_any_marks(spark):
    """Aligned text alone tells the article; a page alone on its host keeps all its text."""
    rng = random.Random(8)
    rows, want = [], {}
    for h in ("ant", "bee", "cat"):
        for i in range(25):
            x, text = plain(rng, h, i, rng.randrange(2, 9), i % 5 == 0)
            want[len(rows)] = text
            rows.append((len(rows), f"http://{h}.org/{i}", x))
    copy, text = plain(rng, "ant", 99, 3, False)
    for _ in range(40):  # copies count once: they make nothing constant
        want[len(rows)] = text
        rows.append((len(rows), "http://ant.org/same", copy))
    alone = len(rows)
    rows.append((alone, "http://dog.org/", plain(rng, "dog", 0, 3, False)[0]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.op7_wrapper(spark, df).collect()}
    assert {i: got[i] for i in want} == want
    own = {i: html_wrapper.Page(h) for i, _, h in rows}
    changed = sum("\n".join(t for ok, slot in zip(p.own(), p.slots) if ok for t in slot) != got[i] for i, p in own.items())
    assert changed == len(want) and "All rights reserved" in got[alone]


def test_marks_that_the_text_does_not_bear_out(spark):
    """A <main> that holds only a teaser loses against the element with the data."""
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(12):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
        rows.append((i, "http://h.org/x", f"<body><main><p>Teaser {rng.randrange(10**6)}</p></main><div><h1>Head {i}</h1><p>{text}</p></div></body>"))
        want[i] = f"Head {i}\n{text}"
    got = {r["page_id"]: r["text"] for r in html_wrapper.op7_wrapper(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_every_form_votes(spark, monkeypatch):
    """Forms of one page each outvote the commonest ones together, over several parts and levels."""
    for name, value in (("WRAPPER_FORMS", 4), ("MERGED", 3)):
        monkeypatch.setattr(html_wrapper, name, value, raising=False)
    tail = lambda i: f"<div class='{chr(97 + i // 26)}{chr(97 + i % 26)}'></div>"
    rows = [(i, f"<article></article><section class='x'>own {i}</section>{tail(i // 2)}") for i in range(8)]
    rows += [(100 + i, f"<article><section class='x'>in {i}</section></article>{tail(30 + i)}") for i in range(60)]
    df = spark.createDataFrame([(i, "http://h.org/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.op7_wrapper(spark, df).collect()}
    assert [got[i] for i in range(8)] == [f"own {i}" for i in range(8)] and got[100] == "in 0"
    found = html_wrapper.wrappers(df.withColumn("host", F.lit("h.org"))).collect()
    assert len(found) == 1
    wrapper = html_wrapper.Wrapper.load(found[0]["wrapper"])
    assert wrapper.n == 68 and not wrapper.optional[0]
    assert sum(isinstance(x, str) and x.startswith("div.") for x in wrapper.items) == 64


# ---------------------------------------------------------------- op8


def edit_in(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        prev, row = row, [0]
        for i, x in enumerate(p):
            row.append(min(prev[i] + (x != c), prev[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def test_myers():
    rng = random.Random(7)
    for _ in range(300):
        p = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.myers(p, t, 10**6) == edit_in(p, t)


def test_decontaminate(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"term{rng.randrange(500)}" for _ in range(rng.randrange(8, 40)))) for i in range(25)] + [(50, None), (51, " "), (52, "tiny"), (None, "no id at all in this one"), (3, "second text of item three, which is also searched")]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k] = rng.choice(["", "q", t[k] + "z"])
        return "".join(t)

    texts = [(i, prose(rng, 120)) for i in range(60)]
    for i in range(25):
        e = decontaminate.budget(len(items[i][1]))
        texts.append((100 + i, f"{prose(rng, 20)} {edited(items[i][1], e)} {prose(rng, 20)}"))
        texts.append((200 + i, f"{prose(rng, 10)}\n{items[i][1].upper().replace(' ', '  ')}"))
        texts.append((300 + i, edited(items[i][1], 3 * e + 6)))
    texts += [(400, None), (401, ""), (402, "tiny"), (403, "destiny's"), (None, items[0][1]), (404, prose(rng, 40_000) + items[1][1]), (405, items[3][1]), (405, items[3][1]), (406, items[-1][1])]
    d, b = docs_of(spark, texts), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, edits int")
    want = {}
    for i, t in texts:
        for j, x in items:
            n, k = decontaminate.normalize(t), decontaminate.normalize(x)
            if i is None or j is None or not k:
                continue
            e = decontaminate.budget(len(k))
            if len(k) < decontaminate.LEAST_ITEM:
                ok, dist = bool(re.search(rf"(?<![^\W_]){re.escape(k)}(?![^\W_])", n)), 0
            elif len(n) > 5000:
                ok, dist = k in n, 0
            else:
                dist = edit_in(k, n)
                ok = dist <= e
            if ok:
                want[(i, j)] = min(dist, want.get((i, j), 99))
    for chars in (4_000_000, 1500):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        assert {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.op8_pigeonhole(spark, d, b).collect()} == want
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    documents, benchmark = d.select("doc_id", "text").where("length(text) < 20000 or text is null").toPandas(), b.select("item_id", "text").toPandas()
    c.register("documents", documents), c.register("benchmark", benchmark)
    told = c.execute(queries.oracle_sql()["op8_pigeonhole"]).fetchall()
    assert {(int(i), int(j)): e for i, j, e, _ in told} == {k: v for k, v in want.items() if k[0] != 404}
    left = decontaminate.clean(d, b)
    # Rows are judged one by one, also those without an id.
    held = {t for i, t in texts if any((i, j) in want for j, _ in items)} | {items[0][1]}
    assert left.columns == d.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, t) for i, t in texts if t not in held)
    assert decontaminate.clean(d, b.limit(0)).count() == len(texts)
    assert decontaminate.op8_pigeonhole(spark, d.limit(0), b).count() == 0 and decontaminate.op8_pigeonhole(spark, d, b.limit(0)).count() == 0


def test_budget_is_the_stated_share_at_every_length():
    rng = random.Random(2)
    for n in range(decontaminate.LEAST_ITEM, 130):
        e = n * 5 // 100
        item = "".join(rng.choice("abcdefghij") for _ in range(n))
        ends = [(k + 1) * n // (e + 1) - 1 for k in range(e)]  # one edit in each piece but the last
        text = "".join("z" if i in ends else c for i, c in enumerate(item))
        assert decontaminate.Matcher([(1, item)]).find(f"some {text} other") == {1: (e, e)}, n


# ---------------------------------------------------------------- op9


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 5 else [b" ".join(w[j : j + 5]) for j in range(len(w) - 4)])


def linked(texts):
    sets = {i: shingles(t) for i, t in texts if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("size", [256, 8])
def test_near_duplicates(spark, monkeypatch, size):
    """Groups of 8 make most clusters span groups, as hot ones do at scale."""
    monkeypatch.setattr(near_dedup, "GROUP_DOCS", size)
    rng = random.Random(9)

    def near(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        return " ".join(w)

    bases = [prose(rng, 150, 5000) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(bases)]
    texts += [(100 + 10 * i + k, near(b, rng.randrange(1, 7))) for i, b in enumerate(bases) for k in range(8)]
    texts += [(300 + k, near(bases[0], rng.randrange(0, 4))) for k in range(60)]  # a hot group
    texts += [(400 + k, bases[1].upper()) for k in range(20)] + [(500, None), (501, ""), (502, " \n"), (503, "a b"), (504, "A  b"), (505, "a b c"), (506, prose(rng, 20_000, 9000)), (None, bases[0]), (507, bases[2]), (507, bases[2])]
    d = docs_of(spark, texts)
    rows = near_dedup.op9_star_minhash(spark, d).collect()
    assert len(rows) == len(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    assert got == linked(texts)
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    if size == 8:
        left = near_dedup.drop_near_duplicates(d)
        assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {i for i, x in linked(texts).items() if x[2]} | {None}
        assert near_dedup.op9_star_minhash(spark, d.limit(0)).count() == 0


def versions(rng, n, words, step, at):
    """Independent versions of a text, each with `step` other words: pairs lie about the threshold, and all buckets of a pair are the family's."""
    base, out = prose(rng, words, 5000).split(), []
    for i in range(n):
        w = list(base)
        for j in rng.sample(range(words), step):
            w[j] = f"new{rng.randrange(10**6)}"
        out.append((at + i, " ".join(w)))
    return out


def test_links_between_members_of_different_groups(spark, monkeypatch):
    """Families over many groups, whose links hang on pairs that are neither roots nor centres."""
    for name, value in (("GROUP_DOCS", 8), ("HELD", 5), ("STREAMED", 20)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(4)
    texts = versions(rng, 150, 200, 4, 0) + versions(rng, 120, 150, 3, 1000)
    want = linked(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op9_star_minhash(spark, docs_of(spark, texts)).collect()}
    assert sum(got[i] != x for i, x in want.items()) == 0 and len(got) == len(want)


def test_members_of_a_bucket_that_agree_meet(spark, monkeypatch):
    """Every pair that shares a bucket and agrees enough, whatever the bucket's centre, is handed to the exact comparison unless it is joined already."""
    for name, value in (("HELD", 5), ("STREAMED", 20), ("GROUP_DOCS", 8)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = np.random.default_rng(6)
    reps = []
    for i in range(160):  # a row differs from its family's in 20 to 80 of 128 marks; bands are few, so buckets are crowded
        if i % 40 == 0:
            base = rng.integers(0, 256, near_dedup.BINS)
        m = np.where(rng.permutation(near_dedup.BINS) < rng.integers(20, 80), rng.integers(0, 256, near_dedup.BINS), base)
        reps.append((1 + (i * 37) % 160, 100, [int(rng.integers(0, 12)) + 1000 * b if b < 3 else 10**6 * (i + 1) + b for b in range(near_dedup.BANDS)], m.astype(np.uint8)))
    df = spark.createDataFrame([(*r[:3], bytearray(r[3].tobytes())) for r in reps], "doc_id long, n_shingles long, bands array<long>, marks binary")
    for joined in (0, 20):  # none, or so many of each family in one component
        comp = spark.createDataFrame([(r[0], 1 + 40 * (i // 40)) for i, r in enumerate(reps) if i % 40 < joined], "node long, component long")
        k = {r[0]: r[0] for r in reps} | {r["node"]: r["component"] for r in comp.collect()}
        pairs, named = near_dedup.meetings(near_dedup.stars(df), comp, df.select("doc_id", "n_shingles", "marks"))
        group = {r["doc_id"]: r["group"] for r in named.collect()}
        got = {(r["x"], r["group"]) for r in pairs.collect()}
        want = 0
        for a in reps:
            for b in reps:
                if a[0] < b[0] and k[a[0]] != k[b[0]] and set(a[2]) & set(b[2]) and ((a[3] == b[3]).mean() - 1 / 256) / (1 - 1 / 256) >= near_dedup.LEAST_ESTIMATE:
                    want += 1
                    assert (a[0], group[b[0]]) in got or (b[0], group[a[0]]) in got
        assert want > 20 and Counter(group.values()).most_common(1)[0][1] < 40


def test_short_sets_near_enough_share_a_bucket():
    """100,000 pairs of sets of 3 to 32 shingles, as unlike as a link allows."""
    rng = np.random.default_rng(12)
    for i in range(100_000):
        both = 3 + i % 28
        rest = rng.integers(0, min(both // 3, 32 - both) + 1)
        mine = rng.integers(0, rest + 1)
        x = rng.integers(0, 1 << 63, both + rest).astype(np.uint64)
        a, b = np.sort(x[: both + mine]), np.sort(np.r_[x[:both], x[both + mine :]])
        assert 100 * both >= 75 * (both + rest) and max(len(a), len(b)) <= near_dedup.SHORT
        assert len(np.intersect1d(near_dedup.short_keys(a), near_dedup.short_keys(b)))
        assert near_dedup.may_link(np.array([0]), np.array([len(a)]), len(b))[0]
    assert not len(near_dedup.short_keys(np.arange(33, dtype=np.uint64))) and not len(near_dedup.short_keys(x[:1])) and not len(near_dedup.short_keys(x[:0]))


def test_short_documents(spark, monkeypatch):
    """Pairs of 3 to 36 shingles about the threshold, and short documents that share a line and are otherwise unlike."""
    for name, value in (("HELD", 50), ("STREAMED", 200), ("GROUP_DOCS", 16)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(14)
    texts = []
    for i in range(600):
        n = rng.randrange(3, 37)
        w = prose(rng, n + 4, 10**6).split()
        more = [f"t{rng.randrange(10**9)}" for _ in range(max(1, n // 3) + rng.randrange(-1, 2))]
        texts += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w + more))]
    line = prose(rng, 14, 10**6)
    texts += [(10**4 + i, f"{line} " + prose(rng, rng.randrange(1, 20), 10**6)) for i in range(300)]
    want = linked(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op9_star_minhash(spark, docs_of(spark, texts)).collect()}
    assert sum(got[i] != x for i, x in want.items()) == 0 and len(got) == len(want)
    assert 200 < sum(not x[2] for i, x in want.items() if i < 10**4) < 500


def test_long_chain_and_hot_family(spark):
    """3,000 documents of which only neighbours are linked, at 0.75 exactly, and 3,000 versions of one text about the threshold."""
    words = [f"c{i}" for i in range(10 * 3000 + 74)]
    chain = [(i, " ".join(words[10 * i : 10 * i + 74])) for i in range(3000)]
    assert [100 * len(a & b) == 75 * len(a | b) for a, b in [(shingles(chain[7][1]), shingles(chain[8][1]))]] == [True]
    rng = random.Random(12)
    base = prose(rng, 150, 5000).split()
    family = []
    for i in range(3000):
        w = list(base)
        for j in rng.sample(range(150), rng.randrange(0, 14)):
            w[j] = f"n{rng.randrange(10**7)}"
        family.append((10_000 + i, " ".join(w)))
    rng.shuffle(family)
    sets = [shingles(t) for _, t in family]
    name = {}
    at = [np.array([name.setdefault(x, len(name)) for x in s]) for s in sets]
    size, both = np.array([len(s) for s in sets]), np.zeros((3000, 3000), dtype=np.float32)
    for lo in range(0, len(name), 4096):
        m = np.zeros((3000, 4096), dtype=np.float32)
        for i, x in enumerate(at):
            m[i, x[(x >= lo) & (x < lo + 4096)] - lo] = 1
        both += m @ m.T
    near = 100 * both >= 75 * (size[:, None] + size - both)
    label = np.array([i for i, _ in family])
    while True:
        low = np.where(near, label, 10**9).min(axis=1)
        if (low == label).all():
            break
        label = low
    want = {i: 0 for i, _ in chain} | {i: int(x) for (i, _), x in zip(family, label)}
    got = by_id(near_dedup.near_duplicates(docs_of(spark, chain + family)), "component_id")
    assert sum(got[i] != (x,) for i, x in want.items()) == 0
    assert len(set(label.tolist())) > 20


def test_one_id_with_several_texts(spark):
    """Rows of one id are one document: all its texts count, in whatever order they come."""
    rng = random.Random(13)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    texts = [(5, a), (5, b), (5, a), (7, b + " tail"), (8, a + " end"), (3, c), (9, c), (9, b + " other"), (2, None), (2, "")]
    rng.shuffle(texts)
    rows = near_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {5: 3, 7: 3, 8: 3, 3: 3, 9: 3, 2: 2} and len(rows) == len(texts)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.9):
        got = []
        for _ in range(60):
            n = int(rng.integers(6, 900))
            x = common.mix64(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            both = int(round(n * share))
            only = (n - both) // 2
            a, b = np.unique(x[: both + only]), np.unique(np.r_[x[:both], x[both + only : both + 2 * only]])
            true = both / (both + 2 * only)
            got.append((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true)
        assert abs(np.mean(got)) < 0.03


# ---------------------------------------------------------------- op10


def test_backpropagation():
    net = langid.ByteNetwork(["a", "b", "c"], hidden=4, seed=1)
    for p in (net.fwd, net.bwd):
        p.w, p.u, p.b = (x.astype(np.float64) for x in (p.w, p.u, p.b))
    net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
    x = np.frombuffer(b"hellocoolzzzzz!", dtype=np.uint8).reshape(3, 5)
    y = np.array([0, 2, 1])
    _, grads = net.gradients(x, y)
    for p, g in zip(net.params(), grads):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            keep = p[at]
            p[at] = keep + 1e-3
            up = net.gradients(x, y)[0]
            p[at] = keep - 1e-3
            down = net.gradients(x, y)[0]
            p[at] = keep
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_language(spark):
    rng = random.Random(6)
    syl = {"en": ["th", "ing", "er", "wh", "and"], "fr": ["eau", "ç", "é", "que", "oi"], "es": ["ción", "ñ", "ar", "ll", "dor"]}
    word = lambda g: "".join(rng.choice(syl[g]) for _ in range(rng.randrange(1, 4)))
    texts, langs = [], {}
    for i in range(240):
        g = ["en", "fr", "es"][i % 3]
        texts.append((i, " ".join(word(g) for _ in range(rng.randrange(3, 120)))))
        langs[i] = g
    langs |= {500: None, 503: "fr"}
    texts += [(500, None), (501, ""), (502, "12 345 !?"), (503, "eau" * 20_000), (None, "the thing"), (7, texts[7][1]), (504, "²³")]
    d = docs_of(spark, texts, langs)
    rows = langid.op10_byte_gru(spark, d).collect()
    assert len(rows) == len(texts)
    got = {r["doc_id"]: r for r in rows}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    for i in (500, 501, 502, 504):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[503]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.op10_byte_gru(spark, d.limit(0)).count() == 0
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.op10_byte_gru(spark, none).collect()} == {"und"}
    net = langid.fit(d)
    left = langid.keep_known(d, net, 0.3)
    assert left.columns == d.columns and left.schema == d.schema and {500, 501, 502, 504}.isdisjoint({r["doc_id"] for r in left.collect()})
    mixed = [t for _, t in texts[:3]]
    whole = langid.predict(langid.WordScores(net), [" ".join(mixed)])[0]
    assert 0 < whole[1] <= 1


def test_a_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 3)
    rows = [(7, f"aaa bbb {i % 2}", "x") for i in range(50)] + [(i, f"ccc{i}", "x") for i in range(20, 60)] + [(i, f"ddd{i}", "y") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid.ByteNetwork, "train", lambda self, words, labels, **k: seen.append(set(words)))
    langid.fit(df)
    assert len({w for w in seen[0] if w[:3] in (b"ccc", b"ddd")}) + (b"aaa" in seen[0]) == 6 and not (b"0" in seen[0] and b"1" in seen[0])


def test_language_is_the_mean_over_all_positions(spark):
    """The whole query against the network run on each word by itself, all bytes of all words."""
    rng = random.Random(16)
    texts = [(i, prose(rng, rng.randrange(0, 60))) for i in range(80)] + [(90, "mot été ñandú"), (91, "x" * 500 + " tail"), (92, "日本語" * 90), (93, None), (94, "12"), (95, ".,.")]
    d = docs_of(spark, texts, {i: "abc"[i % 3] for i in range(80)})
    net = langid.fit(d)
    got = by_id(langid.identify(d, net), "lang_pred", "score")
    for i, t in texts:
        total, n = np.zeros(len(net.langs)), 0
        for w in (t or "").encode().split():
            for piece, a, b in langid.cut(w):
                total += net.positions(np.frombuffer(piece, dtype=np.uint8)[None])[0, a:b].sum(axis=0)
                n += b - a
            assert sum(b - a for _, a, b in langid.cut(w)) == len(w) and b"".join(p[a:b] for p, a, b in langid.cut(w)) == w
        if not n or not re.search(r"[^\W\d_]", t):
            assert got[i] == ("und", 0.0)
            continue
        lang, score = got[i]
        assert abs(score - total.max() / n) < 1e-5 and total[net.langs.index(lang)] >= total.max() - 1e-5 * n
    for piece, a, b in langid.cut(("日本語" * 90).encode()):
        piece[a:b].decode()
