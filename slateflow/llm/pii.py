"""Personal data by patterns and by bootstrapped context, in DataFrame operations only.

Base spans (email, ip, card, phone) follow fixed patterns. They seed a graph of lexical patterns (the two
words before a base span or another identifier-like token, earlier ones included: one word is too little to
tell) and instances (base spans as a whole, and tokens outside them): a pattern's confidence is the mean score
of its distinct instances, an unseen instance's score the best confidence it stands under, and Spark repeats
the two aggregates ROUNDS times. Patterns of high confidence with enough distinct seeds then mark
the unseen identifiers that follow them, under the kind `context`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "context"
ROUNDS, LEAST_CONFIDENCE, LEAST_SEEDS = 3, 0.8, 5

# Equal in matches to the plain forms of the contract; possessive, and anchored at a run's start or the last
# match's end, so that long runs of one class cost linear time and no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with three digits in a row or an @, or rather what of it starts and ends with a letter or digit.
IDENTIFIER = r"(?<!\S)(?=\S*?(?:[0-9]{3}|@))\S++"

OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_CHUNK = 256
#: Code points of a piece of text, and those first looked at for the two words before an instance.
_PIECE, _NEAR = 4096, 400
_SPAN = "struct<kind:string,start:int,end:int>"


def _matches(df: DataFrame, name: str, pattern: str, needed: Column) -> DataFrame:
    """Column `name`: array of (start, match) for every match, starts in code points.

    The text between matches, from split(), and the matches themselves have the starts as running sums;
    sums run in chunks, so that texts with very many matches cost little more than others.
    """
    m, p, adv, sums = f"_m_{name}", f"_p_{name}", f"_a_{name}", f"_s_{name}"
    empty = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(needed, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split("_text", pattern, -1)).otherwise(empty))
    df = df.withColumn(adv, F.expr(f"transform({m}, (x, i) -> struct(length({p}[i]) AS gap, length({p}[i]) + length(x) AS adv, x AS match))"))
    df = df.withColumn(
        sums,
        F.expr(f"transform(sequence(0, greatest(cast(ceil(size({adv}) / {_CHUNK}D) AS int) - 1, 0)), c -> slice({adv}, c * {_CHUNK} + 1, {_CHUNK}))"),
    )
    df = df.withColumn(adv, F.expr(f"transform({sums}, c -> aggregate(c, 0, (s, v) -> s + v.adv))"))
    out = f"""flatten(transform({sums}, (c, k) -> aggregate(c,
        struct(aggregate(slice({adv}, 1, k), 0, (s, v) -> s + v) AS at, cast(array() AS array<struct<start:int,match:string>>) AS found),
        (s, v) -> struct(s.at + v.adv AS at, array_append(s.found, struct(s.at + v.gap AS start, v.match AS match)) AS found),
        s -> s.found)))"""
    return df.withColumn(name, F.expr(out)).drop(m, p, adv, sums)


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """SQL: whether the digits in x have 13 to 19 places and pass Luhn's check."""
    d = f"reverse({_digits(x)})"
    total = f"aggregate(sequence(1, 19), 0, (s, i) -> s + CASE WHEN i > length({d}) THEN 0 WHEN i % 2 = 1 THEN cast(substring({d}, i, 1) AS int) ELSE cast(substring({d}, i, 1) AS int) * 2 - CASE WHEN substring({d}, i, 1) > '4' THEN 9 ELSE 0 END END)"
    return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def base_spans(df: DataFrame) -> DataFrame:
    """df (with _text) and a column for each kind: its spans in order of start. Column _seeds: all of them, (start, match)."""
    digit = F.rlike("_text", F.lit("[0-9]"))
    df = df.withColumn("_digit", digit)
    df = _matches(df, "_email", EMAIL, F.contains("_text", F.lit("@")))
    df = _matches(df, "_ip", IP, F.col("_digit") & F.contains("_text", F.lit(".")))
    df = _matches(df, "_card", CARD, F.col("_digit"))
    df = _matches(df, "_phone", PHONE, F.col("_digit") & F.contains("_text", F.lit("+")))
    checks = {"email": "true", "ip": f"rlike(x.match, r'{OCTETS}')", "card": f"length(x.match) >= 13 AND {_luhn('x.match')}", "phone": f"length({_digits('x.match')}) BETWEEN 9 AND 15"}
    for kind, check in checks.items():
        df = df.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, x -> {check})"))
        span = f"transform(_{kind}, x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.start + length(x.match)))"
        df = df.withColumn(kind, F.expr(span).cast(f"array<{_SPAN}>"))
    return df.withColumn("_seeds", F.concat(*[f"_{k}" for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def _one_gap(words: str) -> str:
    return rf"regexp_replace(lower({words}), r'\s+', ' ')"


def _short(x: str) -> str:
    """SQL: a long string by its digest."""
    return f"CASE WHEN length({x}) > 64 THEN sha2({x}, 256) ELSE {x} END"


def _near_words(start: str) -> str:
    """SQL: the pattern before the blank-separated token that holds code point `start`, from _pieces; null where the nearest text doesn't hold two words."""
    k, words = f"cast({start} div {_PIECE} AS int)", r"r'(?<!\S)(\S++\s++\S++)\s++\S*+$'"
    near = f"right(concat(CASE WHEN {k} > 0 THEN _pieces[{k} - 1] ELSE '' END, left(_pieces[{k}], {start} % {_PIECE})), {_NEAR})"
    # Text that starts in the middle of a word or of a gap is cut before its first blank, so that no part of a word is taken for a word.
    inner = f"regexp_extract(CASE WHEN {start} > {_NEAR} THEN regexp_replace({near}, r'^\\S++', '') ELSE {near} END, {words}, 1)"
    return _one_gap(f"CASE WHEN {inner} <> '' OR {start} <= {_NEAR} THEN {inner} END")


def _far_words(df: DataFrame) -> DataFrame:
    """df, with the patterns that _near_words() left null in _tokens filled in.

    Of a text that has any, all words are listed once, each with the pattern before it; a token finds its word
    by the number of words that begin before it: in earlier pieces, and in its own. So the work for a token is
    that of a piece, however long words and text are.
    """
    df = df.withColumn("_far", F.expr("exists(_tokens, x -> x.two IS NULL)"))
    some = lambda sql, kind: F.expr(f"CASE WHEN _far THEN {sql} ELSE cast(array() AS array<{kind}>) END")
    df = df.withColumn("_words", some(r"regexp_extract_all(_text, r'\S++', 0)", "string"))
    plain = _one_gap("concat(_words[i - 2], ' ', _words[i - 1])")
    df = df.withColumn("_before", some(f"transform(transform(_words, (w, i) -> CASE WHEN i < 2 THEN '' ELSE {plain} END), p -> {_short('p')})", "string"))
    last = "CASE WHEN i = 0 THEN ' ' ELSE right(_pieces[i - 1], 1) END"
    df = df.withColumn("_starts", some(rf"transform(_pieces, (p, i) -> size(regexp_extract_all(concat({last}, p), r'\s\S', 0)))", "int"))
    df = df.withColumn("_sums", some("transform(_starts, (n, i) -> aggregate(slice(_starts, 1, i), 0, (s, v) -> s + v))", "int"))
    k = f"cast(x.at div {_PIECE} AS int)"
    own = rf"size(regexp_extract_all(concat(CASE WHEN {k} = 0 THEN ' ' ELSE right(g.pieces[{k} - 1], 1) END, left(g.pieces[{k}], x.at % {_PIECE} + 1)), r'\s\S', 0))"
    # One struct holds what a token looks up: a column named inside the function could be computed anew for each token.
    held = "array(named_struct('tokens', _tokens, 'before', _before, 'sums', _sums, 'pieces', _pieces))"
    told = f"x -> named_struct('start', x.start, 'end', x.end, 'token', x.token, 'two', CASE WHEN x.two IS NULL THEN g.before[g.sums[{k}] + {own} - 1] ELSE x.two END, 'seed', x.seed)"
    df = df.withColumn("_tokens", F.expr(f"transform({held}, g -> transform(g.tokens, {told}))[0]"))
    return df.drop("_far", "_words", "_before", "_starts", "_sums")


def _identifiers(df: DataFrame) -> DataFrame:
    """Column _tokens: base spans, and identifier-like tokens that none overlaps, with place and the two words before them."""
    some = F.col("_digit") | F.contains("_text", F.lit("@"))
    df = _matches(df, "_id", IDENTIFIER, some)
    df = df.withColumn("_pieces", F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    head = "length(x.match) - length(regexp_replace(x.match, r'^[^A-Za-z0-9]+', ''))"
    core = r"regexp_replace(x.match, r'^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '')"
    df = df.withColumn("_found", F.expr(f"transform(_id, x -> named_struct('at', x.start, 'start', x.start + {head}, 'token', {core}))"))
    # Both lists are in order of start but for base spans of different kinds; a chunk of tokens meets the spans near it only.
    chunk = f"slice(_found, c * {_CHUNK} + 1, {_CHUNK})"
    near = f"filter(_seeds, b -> b.start < element_at({chunk}, -1).start + length(element_at({chunk}, -1).token) AND b.start + length(b.match) > element_at({chunk}, 1).start)"
    apart = "x -> length(x.token) >= 4 AND NOT exists(g.near, b -> b.start < x.start + length(x.token) AND b.start + length(b.match) > x.start)"
    groups = f"transform(sequence(0, cast(ceil(size(_found) / {_CHUNK}D) AS int) - 1), c -> named_struct('some', {chunk}, 'near', {near}))"
    df = df.withColumn("_found", F.expr(f"CASE WHEN size(_found) = 0 THEN _found ELSE flatten(transform({groups}, g -> filter(g.some, {apart}))) END"))
    df = df.withColumn("_found", F.expr(
        "concat(transform(_seeds, x -> named_struct('at', x.start, 'start', x.start, 'token', x.match, 'seed', true)), transform(_found, x -> named_struct('at', x.at, 'start', x.start, 'token', x.token, 'seed', false)))"
    ))
    tokens = f"transform(_found, x -> named_struct('at', x.at, 'start', x.start, 'end', x.start + length(x.token), 'token', x.token, 'two', {_near_words('x.at')}, 'seed', x.seed))"
    return _far_words(df.withColumn("_tokens", F.expr(tokens))).drop("_id", "_found", "_pieces", "_seeds")


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, least: float = LEAST_CONFIDENCE, seeds: int = LEAST_SEEDS) -> DataFrame:
    """Patterns of high confidence, from edges (pattern, instance, seed): distinct, so copies of a text count once."""
    score = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    edges = edges.select("pattern", "instance").distinct()
    known = materialize(score, "scores")
    seed = known.select("instance", F.col("score").alias("seed_score"))
    for _ in range(rounds):
        graded = edges.join(known, "instance").join(seed, "instance")
        pattern = graded.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum("seed_score").alias("seeds"))
        pattern = materialize(pattern.where((F.col("seeds") >= seeds)), "patterns")
        told = edges.join(pattern.where(F.col("confidence") >= least), "pattern").groupBy("instance").agg(F.max("confidence").alias("c"))
        known = materialize(seed.join(told, "instance", "left").select("instance", F.greatest("seed_score", F.coalesce("c", F.lit(0.0))).alias("score")), "scores")
    return pattern.where(F.col("confidence") >= least).select("pattern", "confidence")


def find(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: the columns `carry`, the spans of each base kind, and `context`, those discovered.

    Null text is the empty text and has no spans; an empty table gives no rows. Repeated rows are found alike,
    each by itself, while a pattern counts an instance once however often it stands there. Rows need no key: a
    number given when the spans are first written joins them. Other columns may have any name. Discovered
    identifiers have 4 code points at least. Work grows with a text's length, whatever the length of its words.
    """
    carry = carry or []
    df = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carry)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = _identifiers(base_spans(df)).drop("_digit", "_text").withColumn("_row", F.monotonically_increasing_id())
    df = materialize(df, "spans")
    token = df.select("_row", F.explode("_tokens").alias("t")).select("_row", "t.*")
    marked = token.select("_row", "start", "end", "seed", F.expr(_short("token")).alias("instance"), F.expr(_short("two")).alias("pattern")).where("pattern <> ''")
    good = confident_patterns(marked.select("pattern", "instance", "seed"))
    hits = marked.where("not seed").join(good, "pattern").select("_row", F.struct(F.lit(DISCOVERED).alias("kind"), "start", "end").alias("span"))
    extra = materialize(hits.groupBy("_row").agg(F.sort_array(F.collect_set("span")).alias(DISCOVERED)), "discovered")
    out = df.join(extra, "_row", "left").withColumn(DISCOVERED, F.coalesce(DISCOVERED, F.array().cast(f"array<{_SPAN}>")))
    return out.select(*[F.col(f"c_{i}") for i in range(len(carry))], *KINDS, DISCOVERED)


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: list[Column]) -> DataFrame:
    base = F.concat(*KINDS)
    return found.select(
        *key, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_join(base), 256).alias("base_sha256"), _join(F.concat(base, DISCOVERED)).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """`docs`, row by row and with all its columns, every span in the text, discovered ones too, replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the kind of the first. Other texts, and null, stay as they are; an
    empty table stays empty.
    """
    cols = docs.columns
    found = find(docs, cols)
    at = {c: f"c_{i}" for i, c in enumerate(cols)}
    text = at["text"]
    spans = F.array_sort(F.transform(F.concat(*KINDS, DISCOVERED), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    apart = """aggregate(_spans, slice(_spans, 1, 0), (s, x) -> CASE WHEN size(s) > 0 AND x.start < element_at(s, -1).end
        THEN array_append(slice(s, 1, size(s) - 1), named_struct('start', element_at(s, -1).start, 'end', greatest(element_at(s, -1).end, x.end), 'kind', element_at(s, -1).kind))
        ELSE array_append(s, x) END)"""
    # Text is put together piece by piece, so that a span costs a step in its piece and not in the whole text.
    at_piece = f"i * {_PIECE}"
    near = f"filter(_spans, x -> x.start < {at_piece} + length(p) AND x.end > {at_piece})"
    piece = f"""aggregate({near}, named_struct('at', {at_piece}, 'parts', cast(array() AS array<string>)),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'parts', concat(s.parts, array(substring(p, s.at - {at_piece} + 1, greatest(x.start - s.at, 0)), CASE WHEN x.start >= {at_piece} THEN concat('<', upper(x.kind), '>') ELSE '' END))),
        s -> concat(array_join(s.parts, ''), substring(p, s.at - {at_piece} + 1, greatest(length(p) + {at_piece} - s.at, 0))))"""
    found = found.withColumn("_spans", spans).withColumn("_spans", F.expr(apart))
    found = found.withColumn("_pieces", F.when(F.size("_spans") > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    masked = F.when(F.size("_spans") > 0, F.expr(f"array_join(transform(_pieces, (p, i) -> {piece}), '')")).otherwise(F.col(text))
    return found.select(*[(masked if c == "text" else F.col(at[c])).alias(c) for c in cols])


def op5_bootstrap(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find(rows.select("doc_id", "text"), ["doc_id"])
    return digest(found, [F.col("c_0").alias("doc_id")])
