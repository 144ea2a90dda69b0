"""Main text of pages by wrappers: union-free regular expressions over the block tags of a host's pages.

A page is a stream of block tags; every tag has a text slot behind it. Runs of equal groups fold into
repeated groups. A host's wrapper starts with its commonest stream; others are aligned with it one by one,
and what only one side has becomes an optional group, what one side repeats a repeated group.

The aligned slots then tell data from template: a slot whose text is the same on all pages is template, one
whose text differs is data. The article is the element that holds the host's data: from the whole page
down, as long as one element has most of what is left, to the one with a headline or without such a part.
Within it template slots and lists of links go. Where pages mark their article (`<article>`, `<main>`), the
marked slots are taken if they hold half of the data. A host of fewer than LEAST_PAGES different pages can't
be compared: there a page's own marks and the names of its elements decide.

Distinct streams meet in parts of about WRAPPER_FORMS, and the wrappers of a host's parts are aligned and
summed MERGED at a time until one is left, so that every page counts and every form is in the expression.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tune
from .url_filter import split_url

#: Distinct folded streams that meet in one task, and the longest group that can repeat.
WRAPPER_FORMS, LONGEST_GROUP = 64, 12
#: Wrappers of a host that are merged in one task.
MERGED = 16
#: Different pages that it takes to tell template from data, and the share of pages on which a template slot stands.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.5
#: An element with this share of an element's data is looked into; a slot with this share of its text in links is no text.
MOST_DATA, MOST_LINKS = 0.6, 0.8
#: Cells of an alignment that is traced back at once; a larger one is halved first.
ALIGN_CELLS = 1 << 28

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|noscript|template|svg|iframe|select|title)\b.*?(?:</\1\s*+>|\Z)"
    r"|<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link input q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Their end tags are often left out, so they are no part of a stream.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside form head menu dialog button".split())
#: Words in a class, id or role that name what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies "
    "consent gdpr notice alert popup modal newsletter subscribe share sharing social comment comments disqus reply replies related recommended widget toolbar footer complementary search pagination".split()
)
_WORD = re.compile(r"[a-z]+")


class Page:
    """A page's block tags in order; for each whether its slot lies in the marked article, and whether in what is named as no article; its blocks of text; and its text in links."""

    def __init__(self, page: str | None):
        page = page or ""
        self.tags, self.main, self.aside = [""], [0], [0]
        self.slots: list[list[str]] = [[]]
        self.links = [0]
        stack: list[tuple[str, bool, bool]] = []  # name, main, aside
        opened: Counter[str] = Counter()
        mains = asides = anchors = 0
        texts: list[str] = []

        def close_block() -> None:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                self.slots[-1].append(text)
            texts.clear()

        def pop(i: int) -> None:
            nonlocal mains, asides
            for name, main, aside in stack[i:]:
                opened[name] -= 1
                mains -= main
                asides -= aside
            del stack[i:]

        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                texts.append(page[at : m.start()])
                if anchors:
                    self.links[-1] += len(texts[-1].strip())
            at = m.end()
            tok = m[0]
            name = _NAME.match(tok)
            if m[1] or not name:
                continue
            name = name[1].lower()
            end = tok.startswith("</")
            if name == "br":
                texts.append(" ")
                continue
            if name == "a":
                anchors = 0 if end else 1
            if name in INLINE and not (not end and name in ("span", "a") and _aside_words(tok)):
                continue
            close_block()
            if end:
                if opened[name]:
                    pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                if name in OPEN_ENDED:
                    continue
                self.tags.append("/" + name)
            else:
                if name in OPEN_ENDED and opened[name]:  # a new one ends its unfinished like
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            pop(i)
                            break
                        if stack[i][0] not in OPEN_ENDED and stack[i][0] not in INLINE:
                            break
                aside = name in ASIDE or (name == "header" and not mains) or _aside_words(tok)
                if name not in VOID and not tok.endswith("/>"):
                    stack.append((name, name in MAIN, aside))
                    opened[name] += 1
                    mains += name in MAIN
                    asides += aside
                self.tags.append(name + _marks(tok))
            self.main.append(int(mains > 0))
            self.aside.append(int(asides > 0))
            self.slots.append([])
            self.links.append(0)
        if at < len(page):
            texts.append(page[at:])
        close_block()

    def own(self) -> list[int]:
        """1 or 0 for each slot as the page by itself has it in the article: marked, or on pages without marks any, and not named otherwise."""
        marked = any(self.main)
        return [int(not a and (m or not marked)) for m, a in zip(self.main, self.aside)]


def _marks(tok: str) -> str:
    found = {w for k, a, b, c in _MARK.findall(tok) for w in (a or b or c).lower().split() if not any(ch.isdigit() for ch in w)}
    return "".join("." + w for w in sorted(found))


def _aside_words(tok: str) -> bool:
    return any(w in ASIDE_WORDS for _, a, b, c in _MARK.findall(tok) for w in _WORD.findall((a or b or c).lower()))


# A stream's item is a tag, or a tuple of items: a group that repeats. An item's facts are a list for each tag
# (place) in it: pages on which its slot is in the marked article, outside of it, and named as no article;
# pages on which it has text; characters of text, and of text in links; smallest and largest hash of its text.
MARKED, OUTSIDE, NAMED, TEXTS, CHARS, LINKS, LOW, HIGH = range(8)
NOTHING = [0, 0, 0, 0, 0, 0, (1 << 63) - 1, -1]


def added(x: list[int], y: list[int]) -> list[int]:
    return [a + b for a, b in zip(x[:LOW], y)] + [min(x[LOW], y[LOW]), max(x[HIGH], y[HIGH])]


def width(item) -> int:
    return 1 if isinstance(item, str) else sum(map(width, item))


def whole(unit: tuple) -> bool:
    """Whether a group of items is made of whole elements: only such groups repeat."""
    opened: list[str] = []
    for t in unit:
        if isinstance(t, tuple):
            continue
        name = t.split(".")[0]
        if name.startswith("/"):
            if not opened or opened.pop() != name[1:]:
                return False
        elif name not in OPEN_ENDED and name not in VOID:
            opened.append(name)
    return not opened


def fold(items: list, owners: list[list[int]]) -> tuple[list, list[list[int]]]:
    """Fold adjacent equal groups of whole elements, short ones first. `owners[i]`: source tags that item i stands for, by place in the item.

    The places of a folded group keep every source tag: owners are lists over places of lists of tags.
    """
    for size in range(1, LONGEST_GROUP + 1):
        i = 0
        while i + size < len(items):
            if size == 1 and isinstance(items[i], tuple):
                unit = items[i]
                j = i + 1
                while j < len(items) and items[j] == unit:
                    j += 1
            else:
                j = i + size
                if items[i] != items[j]:
                    i += 1
                    continue
                unit = tuple(items[i:j])
                if tuple(items[j : j + size]) != unit or not whole(unit):
                    i += 1
                    continue
                while tuple(items[j : j + size]) == unit:
                    j += size
            if j > i + size:
                _merge(items, owners, i, j, size, unit)
            i += 1
    return items, owners


def _merge(items: list, owners: list, i: int, j: int, size: int, unit: tuple) -> None:
    places = [list(p) for k in range(i, i + size) for p in owners[k]]
    for a in range(i + size, j, size):
        more = [p for k in range(a, a + size) for p in owners[k]]
        for mine, theirs in zip(places, more):
            mine += theirs
    items[i:j] = [unit]
    owners[i:j] = [places]


def wrap(items: list, owners: list, units: set) -> tuple[list, list]:
    """Turn single occurrences of groups that the other side repeats into groups, the longest that fits at each place."""
    by_first: dict = {}
    for unit in sorted(units, key=lambda u: (-len(u), str(u))):
        by_first.setdefault(unit[0], []).append(unit)
    out_i, out_o, i = [], [], 0
    while i < len(items):
        unit = next((u for u in by_first.get(items[i], ()) if tuple(items[i : i + len(u)]) == u), None)
        if unit is None:
            out_i.append(items[i])
            out_o.append(owners[i])
            i += 1
        else:
            out_i.append(unit)
            out_o.append([p for k in range(i, i + len(unit)) for p in owners[k]])
            i += len(unit)
    return out_i, out_o


def _rows(a: list[int], b: list[int]):
    """For each prefix of a, the bits of b where the longest common subsequence with b's prefixes doesn't grow."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every prefix of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(bits == 0)]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: bit rows for small tables, halves of `a` for large ones, in memory that grows with a + b."""
    if not a or not b:
        return []
    if len(a) * len(b) <= ALIGN_CELLS or len(a) == 1:
        rows = list(_rows(a, b))
        out, i, j = [], len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    out.append((i, j))
        return out[::-1]
    half = len(a) // 2
    k = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return _common(a[:half], b[:k]) + [(i + half, j + k) for i, j in _common(a[half:], b[k:])]


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """A longest common subsequence of two item lists as pairs; None where one side has nothing."""
    names: dict = {}
    x, y = ([names.setdefault(t, len(names)) for t in side] for side in (a, b))
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    pairs = [(i, i) for i in range(lo)]
    pairs += [(i + lo, j + lo) for i, j in _common(x[lo : len(x) - hi], y[lo : len(y) - hi])]
    pairs += [(len(x) - hi + k, len(y) - hi + k) for k in range(hi)]
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [(k, None) for k in range(i, p)]
        out += [(None, k) for k in range(j, q)]
        out.append((p, q))
        i, j = p + 1, q + 1
    return out[:-1]


def units(items: list) -> set:
    return {x for x in items if isinstance(x, tuple)}


def _wrapped(items: list, facts: list, optional: list[bool], repeated: set) -> tuple[list, list, list[bool]]:
    """wrap() for items with facts; a new group is optional where all its items are."""
    items, tagged = wrap(items, [[(p, o) for p in v] for v, o in zip(facts, optional)], repeated)
    return items, [[p for p, _ in v] for v in tagged], [all(o for _, o in v) for v in tagged]


def places(items: list) -> list[str]:
    """The tags of items, groups opened up."""
    return [t for x in items for t in ([x] if isinstance(x, str) else places(x))]


class Wrapper:
    """items, the facts of each item's places, which items are optional, and the number of different pages."""

    def __init__(self, items: list, facts: list, optional: list[bool], n: int):
        self.items, self.facts, self.optional, self.n = items, facts, optional, n

    def add(self, other: Wrapper) -> None:
        items, facts, theirs = _wrapped(other.items, other.facts, other.optional, units(self.items))
        if units(items) - units(self.items):
            self.items, self.facts, self.optional = _wrapped(self.items, self.facts, self.optional, units(items))
        out_i, out_f, out_o = [], [], []
        for i, j in align(self.items, items):
            if i is not None and j is not None:
                out_i.append(self.items[i])
                out_f.append([added(x, y) for x, y in zip(self.facts[i], facts[j])])
                out_o.append(self.optional[i] or theirs[j])
            elif i is not None:
                out_i.append(self.items[i]), out_f.append(self.facts[i]), out_o.append(True)
            else:
                out_i.append(items[j]), out_f.append(facts[j]), out_o.append(True)
        self.items, self.facts, self.optional = out_i, out_f, out_o
        self.n += other.n

    def expression(self) -> str:
        """The wrapper as a regular expression over tags, # for a text slot."""
        one = lambda x: f"{x or '^'} #" if isinstance(x, str) else "( " + " ".join(map(one, x)) + " )+"
        return " ".join(f"( {one(x)} )?" if o else one(x) for x, o in zip(self.items, self.optional))

    def dump(self) -> str:
        return json.dumps([self.items, self.facts, self.optional, self.n], ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Wrapper:
        items, facts, optional, n = json.loads(text)
        return cls([_frozen(x) for x in items], facts, optional, n)

    def choose(self) -> list[int | None]:
        """For each place whether its slot is part of the article: 1 or 0, None where that is left to the page."""
        tags, facts = places(self.items), [p for f in self.facts for p in f]
        varies = [f[LOW] < f[HIGH] for f in facts]
        data = [f[CHARS] if v and not 2 * f[NAMED] > self.n else 0 for f, v in zip(facts, varies)]
        if self.n < LEAST_PAGES or not sum(data):
            return [None] * len(tags)
        marked = [f[MARKED] > f[OUTSIDE] + f[NAMED] for f in facts]
        if 2 * sum(d for d, m in zip(data, marked) if m) >= sum(data):
            told = [f[MARKED] + f[OUTSIDE] + f[NAMED] for f in facts]
            return [int(m) if 2 * f[MARKED] != t else None for f, m, t in zip(facts, marked, told)]
        inside = region(tags, data)
        template = [not v and f[TEXTS] >= LEAST_PAGES and f[TEXTS] >= TEMPLATE_SHARE * self.n for f, v in zip(facts, varies)]
        listed = [f[LINKS] > MOST_LINKS * f[CHARS] for f in facts]
        return [int(k in inside and not template[k] and not listed[k] and not 2 * f[NAMED] > max(f[TEXTS], 1)) for k, f in enumerate(facts)]

    def chooser(self) -> Chooser:
        return Chooser(self.items, self.choose())


def region(tags: list[str], data: list[int]) -> set[int]:
    """Places of the element that holds the data: down from the whole page to the last element with most of its parent's."""
    parent, inner, stack = [0] * len(tags), {0: []}, [0]
    for k, tag in enumerate(tags):
        if not k:
            continue
        name = tag.split(".")[0]
        if name.startswith("/"):
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]].split(".")[0] == name[1:]:
                    del stack[i:]
                    break
            parent[k] = stack[-1]
        elif name in OPEN_ENDED or name in VOID:
            parent[k] = stack[-1]
        else:
            inner.setdefault(stack[-1], []).append(k)
            parent[k] = k
            stack.append(k)
    own = Counter()
    for k, d in enumerate(data):
        own[parent[k]] += d
    of = {}

    def total(top: int) -> int:
        """Data of an element and all in it, each element once."""
        order, todo = [], [top]
        while todo:
            k = todo.pop()
            order.append(k)
            todo += inner.get(k, ())
        for k in reversed(order):
            of[k] = own[k] + sum(of[c] for c in inner.get(k, ()))
        return of[top]

    total(0)
    at = 0
    while inner.get(at) and not any(tags[c].split(".")[0] == "h1" and data[c] for c in inner[at]):
        best = max(inner[at], key=lambda c: of[c])
        if of[best] < MOST_DATA * of[at] or tags[best].split(".")[0] in HEADINGS:
            break
        at = best
    inside, todo = set(), [at]
    while todo:
        k = todo.pop()
        inside.add(k)
        todo += inner.get(k, ())
    return {k for k in range(len(tags)) if parent[k] in inside}


class Chooser:
    """What a host's pages need of their wrapper: its items, and for each place whether its slot is part of the article."""

    def __init__(self, items: list, chosen: list[int | None]):
        self.items, self.units, self.chosen = items, units(items), []
        at = 0
        for x in items:
            n = width(x)
            self.chosen.append(chosen[at : at + n])
            at += n

    def dump(self) -> str:
        return json.dumps([self.items, [p for f in self.chosen for p in f]], ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Chooser:
        items, chosen = json.loads(text)
        return cls([_frozen(x) for x in items], chosen)

    def decide(self, page: Page) -> list[int]:
        """1 or 0 for each slot of a page: the wrapper's choice where the page aligns with it, else the page's own."""
        items, owners = fold(list(page.tags), [[[i]] for i in range(len(page.tags))])
        items, owners = wrap(items, owners, self.units)
        out = page.own()
        for i, j in align(self.items, items):
            if i is None or j is None:
                continue
            for yes, own in zip(self.chosen[i], owners[j]):
                if yes is not None:
                    for k in own:
                        # What a page itself names as no article stays out.
                        out[k] = int(yes and not page.aside[k])
        return out


def _frozen(x):
    return x if isinstance(x, str) else tuple(map(_frozen, x))


def form(page: Page) -> tuple[str, list[list[int]]]:
    """A page's folded stream as text, and the facts of its places in order."""
    items, owners = fold(list(page.tags), [[[i]] for i in range(len(page.tags))])
    marked, facts = any(page.main), []
    for own in (p for o in owners for p in o):
        half = len(own) / 2
        named = sum(page.aside[k] for k in own) > half
        main = sum(page.main[k] for k in own) > half
        text = "\n".join(t for k in own for t in page.slots[k])
        h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 2 if text else None
        facts.append([int(marked and main and not named), int(marked and not main and not named), int(named), int(h is not None), len(text), sum(page.links[k] for k in own), *([NOTHING[LOW], NOTHING[HIGH]] if h is None else [h, h])])
    return json.dumps(items, ensure_ascii=False), facts


def infer(forms: list[tuple[str, list[list[int]], int]]) -> Wrapper:
    """The wrapper of (form, facts, different pages), the first one first."""
    wrapper = None
    for text, facts, n in forms:
        items, own, at = [_frozen(x) for x in json.loads(text)], [], 0
        for x in items:
            own.append([list(p) for p in facts[at : at + width(x)]])
            at += width(x)
        more = Wrapper(items, own, [False] * len(items), n)
        if wrapper is None:
            wrapper = more
        else:
            wrapper.add(more)
    return wrapper


#: A form, its page's hash, and the facts of its places one after another.
FORM = "form string, key long, facts array<long>"


def _forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for x in pages:
            text, facts = form(Page(x))
            rows.append((text, xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "surrogatepass")) >> 1, np.array(facts, dtype=np.int64).ravel()))
        yield pd.DataFrame(rows, columns=["form", "key", "facts"])


PARTS = "host string, part long, n long, wrapper string"


def _infer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "form"], ascending=[False, True])
    wrapper = infer([(f, [list(map(int, p)) for p in x], int(n)) for f, x, n in zip(pdf["form"], pdf["facts"], pdf["n"])])
    return pd.DataFrame({"host": [key[0]], "part": [key[1]], "n": [wrapper.n], "wrapper": [wrapper.dump()]})


def _sum(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "wrapper"], ascending=[False, True])
    first, *others = map(Wrapper.load, pdf["wrapper"])
    for x in others:
        first.add(x)
    return pd.DataFrame({"host": [key[0]], "part": [key[1]], "n": [first.n], "wrapper": [first.dump()]})


def _chooser(dumps: pd.Series) -> pd.Series:
    return pd.Series([Wrapper.load(x).chooser().dump() for x in dumps], dtype=object)


def facts_of(pages: DataFrame) -> DataFrame:
    """(host, form, n, facts) of all pages (host, html): each distinct form with the facts of its places over its n different pages."""
    seen = pages.select("host", F.pandas_udf(_forms, FORM)("html").alias("f")).select("host", "f.*")
    seen = seen.groupBy("host", "key").agg(F.min_by(F.struct("form", "facts"), "form").alias("f")).select("host", "f.*").withColumn("id", F.xxhash64("form"))
    seen = materialize(seen, "forms")
    n = len(NOTHING)
    each = F.transform(F.sequence(F.lit(0), (F.size("facts") / n).cast("int") - 1), lambda i: F.slice("facts", i * n + 1, n))
    each = seen.select("host", "id", F.posexplode(each).alias("place", "x"))
    total = each.groupBy("host", "id", "place").agg(*[(F.sum if k < LOW else F.min if k == LOW else F.max)(F.col("x")[k]).alias(f"x{k}") for k in range(n)])
    listed = F.array_sort(F.collect_list(F.struct("place", F.array(*[f"x{k}" for k in range(n)]).alias("x"))))
    facts = total.groupBy("host", "id").agg(F.transform(listed, lambda p: p["x"]).alias("facts"))
    forms = seen.groupBy("host", "id").agg(F.min("form").alias("form"), F.count("*").alias("n"))
    same = forms["host"].eqNullSafe(facts["host"]) & (forms["id"] == facts["id"])
    return forms.join(facts, same).select(forms["host"], "form", "n", "facts")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of all pages (host, html)."""
    seen = materialize(facts_of(pages), "facts")
    size = seen.groupBy("host").agg(F.ceil(F.count("*") / WRAPPER_FORMS).cast("long").alias("n_parts"))
    part = F.pmod(F.xxhash64("form", F.lit(31)), F.coalesce("n_parts", F.lit(1))).cast("long").alias("part")
    level = seen.join(size, "host", "left").select("host", part, "form", "n", "facts").groupBy("host", "part").applyInPandas(_infer, PARTS)
    level = materialize(level, "parts")
    parts = size.agg(F.max("n_parts")).first()[0] or 1
    while parts > 1:
        parts = -(-parts // MERGED)
        up = level.withColumn("part", F.floor(F.col("part") / MERGED).cast("long"))
        level = materialize(up.groupBy("host", "part").applyInPandas(_sum, PARTS), "parts")
    return level.select("host", "wrapper")


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    cache: dict[str, Chooser] = {}
    for pages, dumps in batches:
        out = []
        for text, dump in zip(pages, dumps):
            page = Page(text)
            if isinstance(dump, str):
                if dump not in cache:
                    if len(cache) >= 1000:
                        cache.clear()
                    cache[dump] = Chooser.load(dump)
                inside = cache[dump].decide(page)
            else:
                inside = page.own()
            out.append("\n".join(b for ok, slot in zip(inside, page.slots) if ok for b in slot))
        yield pd.Series(out, dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Null or empty html, and pages without text in the article, give the empty string. Pages whose url is null or
    has no host share one wrapper. Repeated rows are extracted alike; other columns are ignored. A line break
    tag counts as white space. Pages meet their wrapper in a join that Spark may broadcast, by the wrappers'
    size, or split where a host is hot.
    """
    tune(pages.sparkSession)
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    src = src.withColumn("host", split_url(F.col("url"))[0])
    found = wrappers(src).select("host", F.pandas_udf(_chooser, "string")("wrapper").alias("wrapper"))
    rows = src.join(found, "host", "left").select("page_id", "url", F.pandas_udf(_extract, "string")("html", "wrapper").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op7_wrapper(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
