"""Resolve free-text queries to catalogued sources, many queries in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slateflow.functions import text as X
from slateflow.operators.catalog import is_skill

#: A catalog of up to so many sources meets each query whole.
SMALL_CATALOG = 4096
#: Characters of text of which a task builds an automaton, about.
AUTOMATON_CHARS = 4_000_000
_MEET = "query string, text string, inside boolean, covers boolean"


def _texts(sources: DataFrame) -> DataFrame:
    """(text, source_id, aliases, titles, ids): each normalized text of each source, and how often it is there as what."""
    none = F.array().cast("array<string>")
    one = lambda x, kind: F.struct(x.alias("text"), F.lit(kind).alias("kind"))
    each = F.concat(F.transform(F.coalesce("aliases", none), lambda a: one(X.normalize_catalog(a), "alias")), F.array(one(X.normalize_catalog(F.col("title")), "title"), one(X.normalize_catalog(F.col("source_id")), "id")))
    rows = sources.select("source_id", F.explode(each).alias("t")).where("t.text is not null")
    n = lambda kind: F.count_if(F.col("t.kind") == kind)
    return rows.groupBy(F.col("t.text").alias("text"), "source_id").agg(n("alias").alias("aliases"), n("title").alias("titles"), n("id").alias("ids"))


def _meetings(frames):
    """(query, text, inside, covers) of a part's texts (kind 0) with the queries (kind 1) that stream past.

    One automaton finds the texts inside a query. For the mirror, queries are held in blocks: an automaton of
    their longest tokens finds, text by text, those that a text may cover, and the other tokens are looked up.
    """
    import ahocorasick

    part, texts, inside, block, size = None, [], None, [], 0

    def built(words):
        out = ahocorasick.Automaton()
        for w in words:
            out.add_word(w, w)
        out.make_automaton()
        return out

    def meet():
        found = {}
        if len(inside):
            for q in block:
                for _, w in inside.iter(q):
                    found[q, w] = (True, False)
        by_token: dict[str, list] = {}
        for q in block:
            toks = [t for t in q.split(" ") if t]
            by_token.setdefault(max(toks, key=len, default=""), []).append((q, toks))
        longest = built([t for t in by_token if t])
        for text, is_alias in texts:
            if not is_alias:
                continue
            hit = {w for _, w in longest.iter(text)} if len(longest) else set()
            for token in [*hit, ""] if "" in by_token else hit:
                for q, toks in by_token[token]:
                    if all(t in text for t in toks):
                        found[q, text] = (found.get((q, text), (False,))[0], True)
        if "" in held:
            for q in block:
                found[q, ""] = (True, found.get((q, ""), (False, False))[1])
        return pd.DataFrame([(q, w, i, c) for (q, w), (i, c) in found.items()], columns=["query", "text", "inside", "covers"])

    held: set = set()
    for pdf in frames:
        for now, kind, text, is_alias in pdf.itertuples(index=False):
            if now != part:
                if block:
                    yield meet()
                part, texts, inside, block, size, held = now, [], None, [], 0, set()
            if kind == 0:
                texts.append((text, is_alias))
                held.add(text)
                continue
            if inside is None:
                inside = built([t for t, _ in texts if t])
            if not texts:
                continue
            block.append(text)
            size += len(text)
            if size > AUTOMATON_CHARS // 4:
                yield meet()
                block, size = [], 0
    if block:
        yield meet()


def meetings(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, text, inside, covers) of all different normalized queries and texts of which the text is in the query, or, of an alias, all tokens of the query are in it.

    Texts are dealt to parts of about AUTOMATON_CHARS, and each part meets all queries.
    """
    spark = queries.sparkSession
    words = texts.groupBy("text").agg((F.max("aliases") > 0).alias("alias"))
    # Few parts would leave machines idle: queries are dealt to lanes, and each lane has all parts.
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.greatest(F.ceil(F.sum(F.length("text") + 1) / AUTOMATON_CHARS), F.lit(1)).cast("int")
    size = words.agg(n.alias("_n"), F.greatest(F.ceil(F.lit(lanes) / n), F.lit(1)).cast("int").alias("_l"), F.lit(0).alias("_all"))
    with_size = lambda df: df.withColumn("_all", F.lit(0)).join(F.broadcast(size), "_all")  # noqa: E731  one row
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    held = with_size(words).select(dealt("_n").alias("p"), every("_l").alias("l"), F.lit(0).alias("kind"), "text", "alias")
    asked = with_size(queries.select(F.col("_q").alias("text")).distinct()).select(every("_n").alias("p"), dealt("_l").alias("l"), F.lit(1).alias("kind"), "text", F.lit(False).alias("alias"))
    both = held.unionByName(asked).select(F.struct("p", "l").cast("string").alias("part"), "kind", "text", "alias")
    return both.repartition(lanes, "part").sortWithinPartitions("part", "kind", "text").mapInPandas(_meetings, _MEET)


def _score(points: Column, title: Column, source_id: Column) -> Column:
    add = lambda has, x: F.when(has, F.lit(x)).otherwise(F.lit(0.0)).cast("float")
    return points.cast("float") + add(title, 0.7) + add(source_id, 0.8)


def _reasons(q: Column, points: Column) -> Column:
    """What a source of these points scored by, from its raw aliases, title and id; q is the normalized query."""
    said = F.zip_with(
        "aliases", points,
        lambda a, p: F.when(p == 1.0, F.concat(F.lit("matched alias `"), a, F.lit("`"))).when(p == 0.5, F.concat(F.lit("partially matched alias `"), a, F.lit("`"))),
    )
    inside = lambda c: F.contains(q, X.normalize_catalog(F.col(c)))
    return F.array_compact(F.concat(said, F.array(F.when(inside("title"), F.lit("matched title")), F.when(inside("source_id"), F.lit("matched source_id")))))


_FOUND = ("query_id", "query", "source_id", "title", "score", "reasons", "domain", "skill_kind", "targets", "capabilities", "aliases")


def _all_pairs(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """score_sources() of a small catalog, which meets each query whole."""
    held = sources.select(
        "source_id", "title", "domain", "skill_kind", "targets", "capabilities", "aliases", F.lit(0).alias("_all"),
        F.transform("aliases", X.normalize_catalog).alias("_aliases"), X.normalize_catalog(F.col("title")).alias("_title"), X.normalize_catalog(F.col("source_id")).alias("_id"),
    )
    q = queries.select("query_id", "query", X.normalize_catalog(F.col("query")).alias("_q"), F.lit(0).alias("_all")).where("_q is not null")
    both = q.withColumn("_toks", X.tokens(F.col("_q"))).join(F.broadcast(held), "_all")
    both = both.withColumn("_points", F.transform("_aliases", lambda a: X.alias_points(a, F.col("_q"), F.col("_toks"))))
    total = F.aggregate("_points", F.lit(0.0).cast("float"), lambda s, p: s + p)
    both = both.withColumn("score", _score(total, F.contains("_q", F.col("_title")), F.contains("_q", F.col("_id")))).where("score > 0")
    return both.withColumn("reasons", _reasons(F.col("_q"), F.col("_points"))).select(*_FOUND)


def _scores(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source_id, score) of every query and source of positive score: texts and queries find each other by meetings()."""
    q = queries.select("query_id", X.normalize_catalog(F.col("query")).alias("_q")).where("_q is not null")
    texts = _texts(sources)
    met = meetings(q, texts).join(texts, "text")
    points = F.when(F.col("covers"), 1.0).when(F.col("inside"), 0.5).otherwise(0.0) * F.col("aliases")
    has = lambda c: F.max(F.col("inside") & (F.col(c) > 0)).alias(f"_{c}")
    found = met.groupBy(F.col("query").alias("_q"), "source_id").agg(F.sum(points).alias("_points"), has("titles"), has("ids"))
    return found.select("_q", "source_id", _score(F.col("_points"), F.col("_titles"), F.col("_ids")).alias("score")).where("score > 0").join(q, "_q").select("query_id", "source_id", "score")


def _described(found: DataFrame, queries: DataFrame, sources: DataFrame) -> DataFrame:
    """`found` (query_id, source_id, score, ...) with the query, what is needed of the source, and the reasons of the score."""
    q = queries.select("query_id", "query", X.normalize_catalog(F.col("query")).alias("_q"))
    both = found.join(q, "query_id").join(sources.select("source_id", "title", "domain", "skill_kind", "targets", "capabilities", "aliases"), "source_id")
    points = F.transform("aliases", lambda a: X.alias_points(X.normalize_catalog(a), F.col("_q"), X.tokens(F.col("_q"))))
    return both.withColumn("reasons", _reasons(F.col("_q"), points)).drop("_q")


def _is_small(sources: DataFrame, whole: bool | None) -> bool:
    return sources.limit(SMALL_CATALOG + 1).count() <= SMALL_CATALOG if whole is None else whole


def score_sources(queries: DataFrame, sources: DataFrame, whole: bool | None = None) -> DataFrame:
    """Every (query, source) of positive score: score (float) and reasons. Ids are keys of their tables.

    `whole`: whether each query meets the whole catalog, which is broadcast. Unless it is given, a job counts
    up to SMALL_CATALOG sources while the plan is made.
    """
    if _is_small(sources, whole):
        return _all_pairs(queries, sources)
    return _described(_scores(queries, sources), queries, sources).select(*_FOUND)


def _top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def catalog_resolve(queries: DataFrame, sources: DataFrame, limit: int, whole: bool | None = None) -> DataFrame:
    """The best `limit` (1 at least) sources of each query; ties in order of id. `whole`: see score_sources()."""
    best = lambda df: _top(df, max(limit, 1), F.desc("score"), F.col("source_id"))
    if _is_small(sources, whole):
        return best(_all_pairs(queries, sources))
    return _described(best(_scores(queries, sources)), queries, sources)  # what goes with a source is joined to the best alone


def _bonus(q: Column) -> tuple[Column, Column]:
    """Score and reasons that a skill gains; q is the engine-normalized query."""
    kind, ents, topics = X.task_kind(q), X.skill_entities(q), X.skill_topics(q)
    by_kind = is_skill() & kind.isNotNull() & F.col("skill_kind").eqNullSafe(kind)
    target = by_kind & F.exists("targets", lambda t: F.array_contains(ents, X.normalize_engine(t)))
    capability = by_kind & F.exists("capabilities", lambda c: F.array_contains(topics, X.normalize_engine(c)))
    alias = is_skill() & F.exists("aliases", lambda a: X.normalize_engine(a) == q)
    parts = [(by_kind, 0.7, "skill kind matched query"), (target, 0.8, "skill target matched query entity"), (capability, 0.45, "skill capability matched query topic"), (alias, 0.45, "skill alias exactly matched query")]
    score = F.col("score")
    for cond, points, _ in parts:
        score = score + F.when(cond, F.lit(points)).otherwise(F.lit(0.0)).cast("float")
    return score, F.concat("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in parts])))


def resolve(queries: DataFrame, sources: DataFrame, max_sources: int = 5, include_skills: bool = False) -> DataFrame:
    """query_id, rank, source_id, title, score, reasons.

    Twice max_sources candidates come from the catalog; then skills are ranked anew or left out, and only
    then the list is cut: skills among the candidates can leave fewer than max_sources.
    """
    found = catalog_resolve(queries, sources, max(2 * max_sources, 1))
    if include_skills:
        score, reasons = _bonus(F.col("_eq"))
        found = found.withColumn("_eq", X.normalize_engine(F.col("query")))
        found = found.withColumns({"score": score, "reasons": reasons, "_first": F.col("rank")})
        out = _top(found, max_sources, F.desc("score"), F.col("_first"))
    else:
        out = _top(found.where(~is_skill()).withColumn("_first", F.col("rank")), max_sources, F.col("_first"))
    return out.select("query_id", "rank", "source_id", "title", "score", "reasons")


def describe(queries: DataFrame) -> DataFrame:
    """Intent and entities of each query."""
    return queries.select("query_id", "query", X.intent(F.col("query")).alias("intent"), X.entities(F.col("query")).alias("entities"))
