"""Scalar functions as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain of skills, hints in their order of precedence, words of intents and entities.
SKILL_DOMAIN = "skill_knowledge"
SKILL_HINTS = ["migration", "upgrade", "debug", "checklist", "playbook", "workflow"]
TOPIC_HINTS = ["auth", "middleware", "routing", "cookies", "server", "hooks", "deploy"]
CODE_WORDS = ["next", "nextjs", "next.js", "react", "supabase", "hook"]
TRAVEL_WORDS = ["travel", "trip", "hotel"]
ENTITIES = ["next.js", "supabase", "react", "middleware", "auth"]
SKILL_ENTITIES = [("next", "nextjs"), ("supabase", "supabase"), ("react", "react")]

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as str.split() knows it; \s of the JVM is ASCII only.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UP, _LOW)


def normalize_catalog(x: Column) -> Column:
    """Letters, digits, dot and slash lower-cased; any other character is one blank."""
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9./]", " "))


def normalize_engine(x: Column) -> Column:
    """Letters and digits lower-cased, runs of anything else one blank, trimmed."""
    return F.trim(F.regexp_replace(ascii_lower(x), "[^a-z0-9]+", " "))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def alias_points(alias: Column, query: Column, toks: Column) -> Column:
    """1 if every token is in the alias (so also for no token), a half if the alias is in the query, else 0; both normalized."""
    return F.when(F.forall(toks, lambda t: F.contains(alias, t)), F.lit(1.0)).when(F.contains(query, alias), F.lit(0.5)).otherwise(F.lit(0.0)).cast("float")


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def intent(query: Column) -> Column:
    q = ascii_lower(query)
    return F.when(_any(q, CODE_WORDS), "Code").when(_any(q, TRAVEL_WORDS), "Travel").otherwise("General")


def entities(query: Column) -> Column:
    q = ascii_lower(query)
    return F.array_compact(F.array(*[F.when(F.contains(q, F.lit(e)) | F.contains(q, F.lit(e.replace(".", ""))), F.lit(e)) for e in ENTITIES]))


def _hits(normalized: Column, hints: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(normalized, F.lit(h)), F.lit(h)) for h in hints]))


def task_kind(normalized: Column) -> Column:
    """First hint in list order that the engine-normalized query contains, else null."""
    return F.try_element_at(_hits(normalized, SKILL_HINTS), F.lit(1))


def skill_topics(normalized: Column) -> Column:
    return _hits(normalized, TOPIC_HINTS)


def skill_entities(normalized: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(normalized, F.lit(a)), F.lit(b)) for a, b in SKILL_ENTITIES]))


def approximate_tokens(title: Column, snippet: Column, citation: Column) -> Column:
    return F.floor((F.length(title) + F.length(snippet) + F.length(citation) + 3) / 4).cast("long")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def summarize_title(x: Column) -> Column:
    """Trimmed, cut to 80 characters with an ellipsis; a fixed title for blank text."""
    t = strip(x)
    return F.when(t == "", "Untitled memory result").when(F.length(t) > 80, F.concat(F.substring(t, 1, 80), F.lit("..."))).otherwise(t)


def _unescape(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def unescape(x: Column) -> Column:
    """HTML character references decoded, by the standard table; in Arrow batches, as Spark has no function for it."""
    return F.pandas_udf(_unescape, "string")(x)


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, f"{SPACE}+", " "))


def clean_text(x: Column) -> Column:
    """Tags to blanks, then references decoded, white space collapsed and trimmed."""
    return collapse(unescape(F.regexp_replace(x, "<[^>]+>", " ")))


def shorten(cleaned: Column, limit: int = 240) -> Column:
    """A clean text of at most `limit` characters, an ellipsis in place of the rest."""
    head = F.regexp_replace(F.substring(cleaned, 1, limit - 3), f"{SPACE}+$", "")
    return F.when(F.length(cleaned) > limit, F.concat(head, F.lit("..."))).otherwise(cleaned)


def summarize_text(x: Column, limit: int = 240) -> Column:
    return shorten(clean_text(x), limit)


def slug(source_id: Column) -> Column:
    s = F.regexp_replace(source_id, "^/+|/+$", "")
    s = F.replace(F.replace(s, F.lit("/"), F.lit("__")), F.lit("."), F.lit("_"))
    return F.when(s == "", "root").otherwise(s)


def file_safe(timestamp: Column) -> Column:
    return F.replace(timestamp, F.lit(":"), F.lit("-"))


def latest_version(versions: Column) -> Column:
    """The last element, not the largest; null for none."""
    return F.try_element_at(versions, F.lit(-1))


def is_absolute(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit("^(http|https|file)://")), F.lit(False))


def with_fragment(citation: Column, heading_id: Column) -> Column:
    h = strip(F.coalesce(heading_id, F.lit("")))
    return F.when((h != "") & ~F.contains(citation, F.lit("#")), F.concat(citation, F.lit("#"), h)).otherwise(citation)


def section_slug(heading: Column) -> Column:
    return F.substring(F.replace(F.lower(heading), F.lit(" "), F.lit("-")), 1, 80)


def record_key(citation: Column, section_index: Column, chunk_index: Column) -> Column:
    zero = F.lit(0)
    return F.concat(citation, F.lit("#"), F.coalesce(section_index, zero).cast("string"), F.lit(":"), F.coalesce(chunk_index, zero).cast("string"))


def embedding_text(title: Column, snippet: Column, content: Column) -> Column:
    parts = F.array(*[strip(F.coalesce(x, F.lit(""))) for x in (title, snippet, content)])
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def memory_tag(source_id: Column, versions: Column) -> Column:
    return F.concat(F.lit("source:"), source_id, F.lit(":"), F.coalesce(latest_version(versions), F.lit("unversioned")))


def page_title(body: Column, fallback: Column) -> Column:
    """The first <title>, cleaned, or the fallback when it is blank; without one, the first line cut to 80 characters."""
    has = F.rlike(body, F.lit("(?is)<title>.*?</title>"))
    t = clean_text(F.regexp_extract(body, "(?is)<title>(.*?)</title>", 1))
    line = F.split(strip(body), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", 2)[0]
    first = summarize_text(line, 80)
    return F.when(has, F.when(t == "", fallback).otherwise(t)).otherwise(F.when(first == "", fallback).otherwise(first))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def canonical_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the name-sorted fields as ASCII JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}), 256)
