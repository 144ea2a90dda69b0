"""The operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, exact_dedup, html_wrapper, langid, merkle, near_dedup, packing, pii, sharding, substring_dedup, url_filter, vector_codes
from .common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_redirect_classes": lambda s, d: url_filter.op1_redirect_classes(s, read(s, d, "pages")),
        "op2_block_join": lambda s, d: ann.op2_block_join(s, read(s, d, "embeddings")),
        "op3_virtual_slots": lambda s, d: sharding.op3_virtual_slots(s, read(s, d, "documents")),
        "op4_suffix_trees": lambda s, d: substring_dedup.op4_suffix_trees(s, read(s, d, "documents")),
        "op5_bootstrap": lambda s, d: pii.op5_bootstrap(s, read(s, d, "documents")),
        "op6_best_fit": lambda s, d: packing.op6_best_fit(s, read(s, d, "documents")),
        "op7_wrapper": lambda s, d: html_wrapper.op7_wrapper(s, read(s, d, "pages")),
        "op8_pigeonhole": lambda s, d: decontaminate.op8_pigeonhole(s, read(s, d, "documents"), read(s, d, "benchmark")),
        "op9_star_minhash": lambda s, d: near_dedup.op9_star_minhash(s, read(s, d, "documents")),
        "op10_byte_gru": lambda s, d: langid.op10_byte_gru(s, read(s, d, "documents")),
        "op11_sparse_forest": lambda s, d: merkle.op11_sparse_forest(s, read(s, d, "documents")),
        "op12_yinyang": lambda s, d: vector_codes.op12_yinyang(s, read(s, d, "embeddings")),
        "op13_two_pass_bloom": lambda s, d: exact_dedup.op13_two_pass_bloom(s, read(s, d, "documents")),
    }


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: op1: links as written, then as keys; a key is host, path (at least /) and query.
_OP1 = r"""WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CASE WHEN contains(coalesce(url, ''), '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*[^?#]*(\?[^#]*)?', 1) AS query FROM u),
p AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS key, regexp_extract_all(html, '(?i)(<(?:link|meta)\b[^>]*>)', 1) AS tags FROM h),
t AS (SELECT p.*, unnest(list_filter(list_concat(
    list_transform(list_filter(tags, lambda x: regexp_matches(x, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)),
    list_transform(list_filter(tags, lambda x: regexp_matches(x, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>;]*)', 1))), lambda x: x <> '')) AS to_raw FROM p WHERE key IS NOT NULL),
a AS (SELECT key, regexp_replace(to_raw, '(?i)&amp;', '&', 'g') AS t, coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'http') || '://' AS root, host, path, regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '(?s)^(.*/)', 1) AS folder FROM t),
b AS (SELECT key, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN root || substring(t, 3) WHEN starts_with(t, '/') THEN root || host || t WHEN starts_with(t, '?') THEN root || host || path || t ELSE root || host || folder || t END AS target FROM a),
c AS (SELECT key, substring(target, instr(target, '://') + 3) AS rest FROM b),
d AS (SELECT key AS x, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END || regexp_extract(rest, '^[^/?#]*[^?#]*(\?[^#]*)?', 1) AS y FROM c WHERE regexp_extract(rest, '^([^/?#]*)', 1) <> ''),
e AS (SELECT x, y FROM d WHERE x <> y UNION SELECT y, x FROM d WHERE x <> y),
r(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
cl AS (SELECT node, min(root) AS class_key FROM r GROUP BY 1),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
nd AS (SELECT cl.*, regexp_extract(node, '^([^/?#]*)', 1) AS nh, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS np FROM cl),
nv AS (SELECT class_key, verdict FROM nd LEFT JOIN rules ON (nh = rh OR ends_with(nh, '.' || rh)) AND starts_with(np, rp) QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rh || rp) DESC) = 1),
cv AS (SELECT class_key, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS v FROM nv GROUP BY 1),
n AS (SELECT *, row_number() OVER () AS i FROM p),
own AS (SELECT n.i, n.page_id, n.host, n.path, n.key, rh || rp AS rule, verdict FROM n LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY n.i ORDER BY length(rh || rp) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, v, 'allow') AS verdict, cl.class_key FROM own LEFT JOIN cl ON cl.node = own.key LEFT JOIN cv USING (class_key)"""

_OP2 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_OP4 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM win),
r AS (SELECT doc_id, i FROM k SEMI JOIN (SELECT h FROM k GROUP BY h HAVING count(*) > 1) t USING (h)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

#: op8: piece hits, then the least edit distance of an item to any passage about its length around a hit.
_OP8 = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), 'SPACES', ' ', 'g'), ' ') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, x, length(x) AS n FROM (SELECT item_id, trim(regexp_replace(lower(text), 'SPACES', ' ', 'g'), ' ') AS x FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE x <> ''),
i AS (SELECT *, CASE WHEN n >= 32 THEN n * 5 // 100 ELSE 0 END AS e FROM b),
p AS (SELECT item_id, x, n, e, unnest(list_transform(range(0, e + 1), lambda k: struct_pack(a := k * n // (e + 1), s := substring(x, k * n // (e + 1) + 1, (k + 1) * n // (e + 1) - k * n // (e + 1)))), recursive := true) FROM i),
h AS (SELECT DISTINCT d.doc_id, d.t, p.item_id, p.x, p.n, p.e, p.a, p.s FROM d JOIN p ON contains(d.t, p.s)),
w AS (SELECT DISTINCT doc_id, t, item_id, x, n, e FROM h WHERE n >= 32 AND contains(t, x)),
short AS (SELECT doc_id, item_id FROM h WHERE n < 32 AND len(list_filter(range(1, length(t) - n + 2), lambda q: substring(t, q, n) = x AND NOT regexp_matches(substring(t, q - 1, 1), '^[\p{L}\p{N}]$') AND NOT regexp_matches(substring(t, q + n, 1), '^[\p{L}\p{N}]$'))) > 0),
o AS (SELECT h.*, unnest(list_filter(range(1, length(h.t) - length(h.s) + 2), lambda q: substring(h.t, q, length(h.s)) = h.s)) - a AS q FROM h ANTI JOIN w USING (doc_id, item_id) WHERE n >= 32 AND e > 0),
m AS (SELECT doc_id, item_id, e, list_min(flatten(list_transform(range(q - e, q + e + 1), lambda f: list_transform(range(n - e, n + e + 1), lambda l: levenshtein(x, substring(t, greatest(f, 1), l - greatest(1 - f, 0))))))) AS edits FROM (SELECT DISTINCT doc_id, t, item_id, x, n, e, q FROM o)),
r AS (SELECT doc_id, item_id, 0 AS edits, e AS budget FROM w UNION ALL SELECT doc_id, item_id, 0, 0 FROM short UNION ALL SELECT doc_id, item_id, edits, e FROM m WHERE edits <= e)
SELECT doc_id, item_id, min(edits)::INT AS edits, max(budget)::INT AS budget FROM r GROUP BY doc_id, item_id""".replace("SPACES", r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

_OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS h, g FROM s),
rep AS (SELECT h, min(doc_id) AS rep FROM u WHERE n > 0 GROUP BY h),
x AS (SELECT u.doc_id, u.n, unnest(u.g) AS sh FROM u JOIN rep ON u.doc_id = rep.rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(node, root) AS (SELECT rep, rep FROM rep UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(root) AS component FROM c GROUP BY 1)
SELECT u.doc_id, u.n::BIGINT AS n_shingles, coalesce(m.component, u.doc_id) AS component_id, u.doc_id = coalesce(m.component, u.doc_id) AS kept FROM u LEFT JOIN rep ON rep.h = u.h AND u.n > 0 LEFT JOIN m ON m.node = rep.rep"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str, key: str) -> str:
    """Nodes (key, level, place, hash, n) of the trees over leaves (key, place, hash, n)."""
    return f"""{name}({key}, level, place, hash, n) AS (SELECT {key}, 0::BIGINT, place::BIGINT, hash, n::BIGINT FROM {leaves}
  UNION ALL SELECT {key}, level + 1, place // 16, sha256(string_agg(hash, '' ORDER BY place)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY {key}, level, n, place // 16)"""


def _runs(tree: str, key: str) -> str:
    return f"SELECT {key}, level, place // 16 AS run, list(hash ORDER BY place) AS h FROM {tree} WHERE n > 1 GROUP BY {key}, level, place // 16"


#: op11: trees level by level, then a walk from each leaf up its runs. DuckDB has no crc32: `crc` is its table of bytes, `cr` goes through the digits.
_OP11 = f"""WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
ct AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, *, {_leaf("text")} AS leaf, {_leaf(_LOWER.format("text"))} AS low FROM documents),
cr(r, s, k, c) AS (SELECT r, doc_id::VARCHAR, 1::BIGINT, 4294967295::BIGINT FROM d WHERE doc_id IS NOT NULL UNION ALL SELECT r, s, k + 1, xor(t[(xor(c, ascii(s[k])) & 255) + 1], c >> 8) FROM cr, ct WHERE k <= length(s)),
hit AS (SELECT r FROM cr WHERE k = length(s) + 1 AND xor(c, 4294967295) % 5 = 0),
l AS (SELECT d.r, doc_id, leaf, CASE WHEN hit.r IS NULL THEN leaf ELSE low END AS used, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS hash, count(*) OVER (PARTITION BY source) AS n FROM d LEFT JOIN hit ON hit.r = d.r),
{_tree("nodes", "l", "src")},
subs AS (SELECT 0 AS one, src AS place, hash, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree("top", "subs", "one")},
runs AS ({_runs("nodes", "src")}),
tops AS ({_runs("top", "one")}),
lv AS (SELECT src, max(level) AS levels FROM nodes GROUP BY src),
steps AS (SELECT r, x.level AS step, h, (l.place // (16 ** x.level)::BIGINT) % 16 AS i FROM l JOIN runs x ON x.src = l.src AND x.run = l.place // (16 ** (x.level + 1))::BIGINT
  UNION ALL SELECT r, lv.levels + x.level, h, (l.src // (16 ** x.level)::BIGINT) % 16 FROM l JOIN lv ON lv.src = l.src JOIN tops x ON x.run = l.src // (16 ** (x.level + 1))::BIGINT),
walk(r, step, acc) AS (SELECT r, 0::BIGINT, used FROM l UNION ALL SELECT w.r, w.step + 1, sha256(array_to_string(s.h[:s.i::BIGINT], '') || acc || array_to_string(s.h[s.i::BIGINT + 2:], '')) FROM walk w JOIN steps s ON s.r = w.r AND s.step = w.step),
fold AS (SELECT r, arg_max(acc, step) AS folded FROM walk GROUP BY r),
sib AS (SELECT r, string_agg(array_to_string(h[:i::BIGINT], '') || array_to_string(h[i::BIGINT + 2:], ''), '' ORDER BY step) AS p FROM steps GROUP BY r)
SELECT doc_id, leaf, subs.hash AS subroot, rt.hash AS root, sha256(coalesce(p, '')) AS proof_sha256, folded AS folded_root, folded = rt.hash AS verified
FROM l JOIN subs ON subs.place = l.src JOIN fold ON fold.r = l.r LEFT JOIN sib ON sib.r = l.r CROSS JOIN (SELECT hash FROM top WHERE n = 1) rt"""


def _op12(rounds: int = vector_codes.ROUNDS) -> str:
    """Lloyd rounds one after another, each with its assignment and its codebooks."""
    out = ["""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT r, p, x[p * (len(x) // 8) + 1:(p + 1) * (len(x) // 8)] AS x FROM v, range(8) t(p))",
        "b0 AS (SELECT p, r - 1 AS j, x FROM parts WHERE r <= 16)"]
    near = "SELECT r, p, x, min(struct_pack(d := d, j := j)) AS m FROM (SELECT s.r, s.p, s.x, b.j, list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts s JOIN {} b USING (p)) GROUP BY r, p, x"
    for k in range(rounds):
        out += [
            f"a{k} AS MATERIALIZED ({near.format(f'b{k}')})",
            f"s{k} AS (SELECT p, j, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, m.j AS j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, j, i)",
            f"u{k} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM s{k} GROUP BY p, j)",
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(u.x, b.x) AS x FROM b{k} b LEFT JOIN u{k} u ON u.p = b.p AND u.j = b.j)",
        ]
    out.append(f"z AS MATERIALIZED ({near.format(f'b{rounds}')})")
    out.append(f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{rounds})")
    out.append("e AS (SELECT r, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY r)")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (r) CROSS JOIN digest"


_OP13 = f"""WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    """Of the others, op3 needs a balance, op5 and op10 a fit, op6 a tokenizer, op7 a parser: tests compare them with brute force."""
    return {"op1_redirect_classes": _OP1, "op2_block_join": _OP2, "op4_suffix_trees": _OP4, "op8_pigeonhole": _OP8, "op9_star_minhash": _OP9, "op11_sparse_forest": _OP11, "op12_yinyang": _op12(), "op13_two_pass_bloom": _OP13}
