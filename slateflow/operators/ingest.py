"""From collected pages to stored chunks: sections, paragraphs, payloads, checks."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateflow import schemas
from slateflow.functions import text as X

# Default hints, limits, and what the guard calls suspicious.
CONTENT_ROOTS = ["main", "article"]
DROP_SELECTORS = ["nav", "header", "footer", "aside"]
CHUNK_CHARS = 900
GUARD_BODY, GUARD_TEXT, GUARD_RATIO = 2000, 160, 0.02
REQUIRED = ["source_id", "title", "snippet", "citation"]
VERSIONED = ["/vercel/next.js", "/supabase/docs", "/react/docs"]

HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
BODIES = frozenset(("p", "li", "pre", "code"))
#: End tags that undo one level of skipping, whichever start tag began it.
UNSKIP = frozenset(("script", "style", "nav", "header", "footer", "aside"))


def _clean(x: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split())


class Selector:
    """Tag names, .classes and #ids to match start tags against."""

    def __init__(self, selectors: list[str]):
        self.tags = {s for s in selectors if s[:1] not in (".", "#")}
        self.classes = {s[1:] for s in selectors if s.startswith(".")}
        self.ids = {s[1:] for s in selectors if s.startswith("#")}

    def hits(self, tag: str, attrs: dict[str, str]) -> bool:
        return tag in self.tags or attrs.get("id") in self.ids or not self.classes.isdisjoint(attrs.get("class", "").split())


OPEN, CLOSE, TEXT = "open", "close", "text"
#: What a tag does to the outline of a page; others do nothing.
ROLES = {"title": "title"} | dict.fromkeys(HEADINGS, "heading") | dict.fromkeys(BODIES, "body")
#: The label of text inside a title element, which is no section.
TITLE = ("__title__", None)


class Events(HTMLParser):
    """A page as (kind, name or text, attributes) events."""

    def __init__(self):
        super().__init__()
        self.seen: list[tuple[str, str, dict[str, str]]] = []
        self.handle_endtag = lambda tag: self.seen.append((CLOSE, tag, {}))
        self.handle_data = lambda data: self.seen.append((TEXT, data, {}))

    def handle_starttag(self, tag, attrs):
        self.seen.append((OPEN, tag, {k: v or "" for k, v in attrs}))


class Extract(NamedTuple):
    title: str | None
    raw_text: str
    roots: int
    sections: list[tuple[str, str, str]]


def shown(events: list, roots: Selector, drops: Selector) -> tuple[list, int]:
    """Events that are neither dropped nor, once a root was met, between roots; and how many start tags matched a root.

    Text before the first root is shown. Roots count also where they are dropped. A dropped element ends at
    the next end tag of a kind that is dropped by default, whichever started it, and only roots given by tag
    name ever end.
    """
    out, dropped, depth, met = [], 0, 0, 0
    bounded = bool(roots.tags or roots.classes or roots.ids)
    for event in events:
        kind, name, attrs = event
        if kind == OPEN and (name in ("script", "style") or drops.hits(name, attrs)):
            dropped += 1
        elif kind == CLOSE and name in UNSKIP:
            dropped -= dropped > 0
        else:
            begins = kind == OPEN and roots.hits(name, attrs)
            met += begins
            depth += begins
            if not dropped:
                depth -= kind == CLOSE and depth > 0 and name in roots.tags
                between = bounded and met > 0 and depth == 0
                if kind == CLOSE or not between or (kind, name) == (OPEN, "title"):
                    out.append(event)
    return out, met


def outline(events: list) -> tuple[str | None, str, list[tuple[str, str, str]]]:
    """Title, all text, and sections (id, heading, text) of a page's shown events."""
    # Cut the events at the tags that count, so that each piece is a run of texts and the tag after it.
    pieces, texts, everything = [], [], []
    for kind, name, attrs in events:
        if kind == TEXT:
            texts += filter(None, [_clean(name)])
        elif name in ROLES:
            pieces.append((texts, (kind, ROLES[name]), name, attrs))
            texts = []
    pieces.append((texts, (CLOSE, "page"), "", {}))
    title, label, sections, run = None, None, [], []
    for texts, step, name, attrs in pieces:
        everything += texts
        run = run + texts
        said = _clean(" ".join(run))
        if said and label is not TITLE and step not in ((OPEN, "title"), (CLOSE, "title"), (CLOSE, "heading")):
            ident, heading = label or ("", "")
            sections.append((ident, _clean(heading), said))
        run = []
        match step:
            case (kind, "title") if kind == OPEN:
                label = TITLE
            case (_, "title"):
                title, label = said or title, None
            case (kind, "heading"):
                label = (attrs.get("id", ""), name) if kind == OPEN else (label[0] if label else "", said or name)
            case (kind, "body") if kind == OPEN:
                label = label or ("", "p")
    return title, " ".join(everything), sections


def read_sections(body: str, roots: list[str], drops: list[str]) -> Extract:
    """Fed but never closed, so that an unfinished reference at the end takes its run of text with it."""
    events = Events()
    events.feed(body)
    kept, met = shown(events.seen, Selector(roots), Selector(drops))
    title, text, sections = outline(kept)
    return Extract(title, _clean(text), met, sections)


_EXTRACTED = "title string, raw_text string, roots int, sections array<struct<heading_id:string,heading:string,text:string>>"


def extract_sections(pages: DataFrame, body: str = "body", roots: list[str] | None = None, drops: list[str] | None = None) -> DataFrame:
    """`pages` with title, raw_text, roots (matches) and sections of its body; per-row hints in columns
    content_roots and drop_selectors take the place of `roots` and `drops`. Null bodies are empty ones."""
    roots, drops = CONTENT_ROOTS if roots is None else roots, DROP_SELECTORS if drops is None else drops
    own = [c for c in ("content_roots", "drop_selectors") if c in pages.columns]

    @F.pandas_udf(_EXTRACTED)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            mine = getattr(r, "content_roots", None)
            less = getattr(r, "drop_selectors", None)
            s = read_sections(r.body or "", roots if mine is None else list(mine), drops if less is None else list(less))
            out.append((s.title, s.raw_text, s.roots, [{"heading_id": a, "heading": b, "text": c} for a, b, c in s.sections]))
        return pd.DataFrame(out, columns=["title", "raw_text", "roots", "sections"])

    args = F.struct(F.col(body).alias("body"), *[F.col(c) for c in own])
    return pages.withColumn("_x", run(args)).select(*[F.col(f"`{c}`") for c in pages.columns], "_x.*")


_MARK = "\x01"


def split_paragraph(paragraph: Column, limit: Column | int = CHUNK_CHARS) -> Column:
    """Chunks of whole sentences of at most `limit` characters; a longer sentence stays whole."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    sentences = F.split(paragraph, f"(?<=[.!?]){X.SPACE}+", -1)
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        joined = F.when(s["cur"] == "", x).otherwise(X.strip(F.concat(s["cur"], F.lit(" "), x)))
        fits = F.length(joined) <= limit
        return F.when(fits, F.struct(joined.alias("cur"), s["out"].alias("out"))).otherwise(
            F.struct(x.alias("cur"), F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])).alias("out"))
        )

    packed = F.aggregate(sentences, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"])))
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(packed)


def extraction_checks(items: DataFrame) -> DataFrame:
    """Extracted items (body, content_type, title, raw_text, roots, sections, content_roots) with all_text, suspicious and warnings."""
    text = F.when(F.col("raw_text") == "", X.clean_text(F.col("body"))).otherwise(F.col("raw_text"))
    out = items.withColumn("all_text", text)
    is_html = F.coalesce(F.startswith("content_type", F.lit("text/html")), F.lit(False))
    size = F.length("body")
    small = (F.length("all_text") < GUARD_TEXT) | (F.length("all_text") / F.greatest(size, F.lit(1)) < GUARD_RATIO)
    warn = F.array(
        F.when((F.size("content_roots") > 0) & (F.col("roots") == 0), "content_roots_unmatched"), F.when(F.col("raw_text") == "", "body_fallback_used"),
        F.when(~is_html, "non_html_content_type"), F.when(F.size("sections") == 0, "section_fallback_used"),
    )
    return out.withColumns({"suspicious": is_html & (size >= GUARD_BODY) & small, "warnings": F.array_sort(F.array_distinct(F.array_compact(warn)))})


def normalize(raw: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads in schemas.PAYLOAD, with item_pos, and a row for each item: url, warnings, suspicious.

    `raw` is schemas.RAW; only public URLs become payloads. A source with a suspicious item is left to the
    caller to fail.
    """
    hints = registry.select(
        "source_id", F.col("catalog_metadata.title").alias("source_title"), F.col("catalog_metadata.aliases").alias("source_aliases"),
        F.col("catalog_metadata.supported_versions").alias("versions"),
        F.coalesce("extraction_hints.content_roots", F.array().cast("array<string>")).alias("content_roots"),
        F.coalesce("extraction_hints.drop_selectors", F.array().cast("array<string>")).alias("drop_selectors"),
        F.coalesce("extraction_hints.chunk_target_chars", F.lit(CHUNK_CHARS)).alias("chunk_chars"),
    )
    items = raw.select("source_id", "collected_at", F.posexplode("items").alias("item_pos", "i")).where(F.coalesce(F.col("i.role") == "public_urls", F.lit(False)))
    items = items.select("source_id", "collected_at", "item_pos", "i.url", F.coalesce(F.when(F.col("i.final_url") != "", F.col("i.final_url")), F.col("i.url")).alias("base"), "i.content_type", "i.body", "i.label")
    items = extraction_checks(extract_sections(items.join(hints, "source_id")))
    meta = items.select("source_id", F.col("base").alias("url"), "item_pos", "warnings", "suspicious")
    one = F.array(F.struct(F.lit("").alias("heading_id"), F.col("label").alias("heading"), F.col("all_text").alias("text")))
    rows = items.withColumn("fallback", F.coalesce("title", X.page_title(F.col("body"), F.col("source_title"))))
    rows = rows.select("*", F.posexplode(F.when(F.size("sections") > 0, F.col("sections")).otherwise(one)).alias("section_index", "s"))
    heading = X.clean_text(F.coalesce("s.heading", F.lit("")))
    rows = rows.withColumn("heading", F.when(heading == "", F.col("fallback")).otherwise(heading))
    rows = rows.select("*", F.posexplode(split_paragraph(F.col("s.text"), F.col("chunk_chars"))).alias("chunk_index", "chunk"))
    named = F.when(F.length("chunk") < F.length("s.text"), F.concat("heading", F.lit(" ("), (F.col("chunk_index") + 1).cast("string"), F.lit(")"))).otherwise(F.col("heading"))
    payloads = rows.select(
        "source_id", X.summarize_text(named, 120).alias("title"), X.summarize_text(F.col("chunk")).alias("snippet"),
        X.with_fragment(F.col("base"), F.col("s.heading_id")).alias("citation"), X.latest_version(F.col("versions")).alias("version"), F.col("chunk").alias("content"),
        X.section_slug(F.col("heading")).alias("section"), F.slice("source_aliases", 1, 3).alias("tags"), F.col("collected_at").alias("retrieved_at"),
        "chunk_index", "section_index", "item_pos",
    )
    return payloads, meta


def ordered(payloads: DataFrame) -> DataFrame:
    return payloads.orderBy("source_id", "citation", "section_index", "chunk_index", "item_pos")


# ---------------------------------------------------------------- checks


def validate_payloads(payloads: DataFrame, expected: Column, position: Column, strict: bool = False) -> DataFrame:
    """(source_id, position, message) of payload rows that break a rule.

    `expected` is the source a row should belong to. A JSON null passes the checks for a value, as text does;
    with `strict` null is missing.
    """
    missing = (lambda c: F.coalesce(X.strip(F.col(c)) == "", F.lit(True))) if strict else (lambda c: F.coalesce(X.strip(F.col(c)) == "", F.lit(False)))
    head = F.concat(expected, F.lit("["), position.cast("string"), F.lit("]: "))
    rules = [(missing(f), f"missing `{f}`") for f in REQUIRED]
    rules += [
        (~F.col("source_id").eqNullSafe(expected), "payload source_id mismatch"),
        (~X.is_absolute(F.col("citation")), "citation must be absolute"),
        (expected.isin(VERSIONED) & missing("version"), "version is required"),
        (F.coalesce((F.length("content") > 280) & (F.col("content") == F.col("snippet")), F.lit(False)), "snippet should not duplicate long content"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.concat(head, F.lit(m))) for c, m in rules]))
    return payloads.select(expected.alias("expected_id"), position.alias("position"), F.explode(found).alias("message"))


REGISTRY_KEYS = [
    ("", ["source_id", "kind", "enabled", "public_urls", "discovery_urls", "normalization_profile", "catalog_metadata", "memory_targets", "cadence", "version_strategy", "extraction_hints", "smoke_queries"]),
    ("catalog_metadata", ["title", "aliases", "domain", "trust", "supported_versions", "citations"]),
    ("memory_targets", ["staging_shard_ids", "prod_shard_ids"]),
    ("smoke_queries", ["resolve", "query", "pack"]),
    ("extraction_hints", ["content_roots", "drop_selectors", "chunk_target_chars"]),
]


def validate_registry(entries: DataFrame) -> DataFrame:
    """(position, message) from entries (position, entry): the entry as JSON text, so that a missing key differs from a null."""
    rows = entries.withColumn("_id", F.coalesce(F.get_json_object("entry", "$.source_id"), F.lit("<missing>")))
    checks = []
    for parent, keys in REGISTRY_KEYS:
        where = "$" if not parent else f"$.{parent}"
        have = F.coalesce(F.json_object_keys(F.get_json_object("entry", where)), F.array().cast("array<string>"))
        for k in keys:
            text = F.concat("_id", F.lit(f": {parent} missing `{k}`" if parent else f": missing `{k}`"))
            checks.append(F.when(~F.array_contains(have, k), text))
    missing = rows.select("position", F.explode(F.array_compact(F.array(*checks))).alias("message"))
    return missing.unionByName(duplicate_ids(rows.select("position", F.get_json_object("entry", "$.source_id").alias("source_id"))).select("position", F.concat("source_id", F.lit(": duplicate source_id")).alias("message")))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Rows (position, source_id) whose id stands at an earlier position."""
    first = rows.where("source_id is not null").groupBy("source_id").agg(F.min("position").alias("_first"))
    return rows.join(first, "source_id").where(F.col("position") > F.col("_first")).drop("_first")
