"""URL filters by rules and redirect equivalence, in DataFrame operations only.

A rule is a host and a path prefix. Pages whose redirect (meta refresh) or canonical link leads to one
another form classes: connected components over those edges, found by joins and aggregates. A URL that no
rule fits takes its class's decision: allow if any member is explicitly allowed, else block if any member
is blocked, else allow. A URL's own rule always holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Up to so many rules are one expression; more are joined by the suffixes of hosts.
LISTED_RULES = 100

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL; empty strings for null or a URL without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.substring(u, F.instr(u, F.lit("://")) + 3, F.length(u))).otherwise(F.lit(""))
    part = lambda p: F.regexp_extract(rest, p, 1)
    return F.translate(part(r"^([^/?#]*)"), UPPER, LOWER), part(r"^[^/?#]*([^?#]*)"), part(r"^[^/?#]*[^?#]*(\?[^#]*)?")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. `rules` is a driver-side list of (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (with host and path) with a column r: rule_of() for rules (verdict, host, path) of any number, by joins on the suffixes of hosts."""
    parts = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    told = rules.select("verdict", F.col("host").alias("_rh"), F.col("path").alias("_rp")).distinct()
    places = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("_rh"))
    order = F.struct(F.length("_rh") + F.length("_rp"), "verdict", "_rh", "_rp")
    one = F.max_by(F.struct(F.concat("_rh", "_rp").alias("rule"), "verdict"), order).alias("r")
    fits = places.join(told, "_rh").where(F.startswith("path", F.col("_rp"))).groupBy("host", "path").agg(one)
    return urls.join(fits, ["host", "path"], "left")


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`urls` with a column r, the longest rule that fits."""
    if len(rules) <= LISTED_RULES:
        return urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return match_rules(urls, urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string"))


def _key(host: Column, path: Column, query: Column) -> Column:
    """What names a resource: scheme and fragment don't count, nor does an empty path differ from /."""
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.coalesce(query, F.lit(""))))


def links(html: Column) -> Column:
    """Array of canonical and refresh targets as written in the page."""
    head = F.coalesce(html, F.lit(""))
    tags = F.filter(F.regexp_extract_all(head, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1)), lambda t: F.rlike(t, F.lit(r"(?i)\bcanonical\b|\brefresh\b")))
    canonical = F.transform(
        F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)^<link\b[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))),
        lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"))),
        lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]*)", 1),
    )
    return F.transform(F.filter(F.concat(canonical, refresh), lambda x: x != ""), lambda x: F.regexp_replace(x, "(?i)&amp;", "&"))


def resolve(target: Column, url: Column, host: Column, path: Column) -> Column:
    """The target as an absolute URL."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(F.when(scheme == "", F.lit("http")).otherwise(scheme), F.lit("://"))
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), r"(?s)^(.*/)", 1)
    return (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(root, F.substring(target, 3, 1 << 30)))
        .when(F.startswith(target, F.lit("/")), F.concat(root, host, target))
        .when(F.startswith(target, F.lit("?")), F.concat(root, host, path, target))
        .otherwise(F.concat(root, host, folder, target))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, class_key for every row of `pages` (page_id, url, html).

    A null url or one without :// has empty host and path, fits no rule, belongs to no class and gets the
    default. Null html has no links. Repeated rows are judged alike. Extra columns are ignored.
    """
    rules = RULES if rules is None else rules
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path, query = split_url(url)
    base = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"), query.alias("query"))
    base = base.select("*", _key(F.col("host"), F.col("path"), F.col("query")).alias("key"))
    out = F.explode(links(F.col("html")))
    found = base.where(F.col("key").isNotNull() & F.rlike(F.coalesce("html", F.lit("")), F.lit("(?i)canonical|refresh"))).select("key", "url", "host", "path", out.alias("to"))
    # Exploding an array of one keeps the target a column, in place of copies of its expression in all that follows.
    to = found.select("key", F.explode(F.array(resolve(F.col("to"), F.col("url"), F.col("host"), F.col("path")))).alias("to"))
    edges = materialize(to.select(F.col("key").alias("a"), _key(*split_url(F.col("to"))).alias("b")).where("b is not null and a <> b").distinct(), "redirects")
    classes = components(edges, native=True)
    # A member's own rule follows from its key, whether or not its page was crawled.
    member = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path")
    judged = with_rule(classes.select("node", "component", *member), rules).select("node", "component", F.col("r.verdict").alias("v"))
    decided = judged.groupBy("component").agg(F.max(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocked"))
    spread = judged.join(decided, "component").select("node", "component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("class_verdict"))
    own = with_rule(base.select("page_id", "host", "path", "key"), rules)
    return own.join(spread, own["key"] == spread["node"], "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), "class_verdict", F.lit(default)).alias("verdict"), F.col("component").alias("class_key"),
    )


def op1_redirect_classes(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages)
