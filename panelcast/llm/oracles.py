"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .license_scan import templates
from .line_dedup import MAX_RATIO, MIN_PAGES
from .mixing import BUDGET_PERCENT, DOMAINS, LEAF, MAX_EPOCHS, SEED, WEIGHTS
from .quality import RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"


def _range(name: str, least: float | None, most: float | None) -> str:
    return " AND ".join([f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP7 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM base WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         len(regexp_extract_all(body, '!!')) AS n_shouts, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stops
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), q AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
         coalesce(n_shouts / nullif(n_words, 0), 0) AS shouts_per_word, coalesce(n_stops / nullif(n_words, 0), 0) AS stop_word_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_range(*r) for r in RULES)} AS kept
FROM q
"""

OP4 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM n WINDOW g AS (PARTITION BY body)
"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, i, l, trim(l, {_SPACE}) AS bare
  FROM (SELECT doc_id, source, ls, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), bad AS (
  SELECT c.host, c.bare
  FROM (SELECT host, bare, count(DISTINCT doc_id) AS pages FROM lines WHERE bare <> '' GROUP BY host, bare) c
  JOIN (SELECT coalesce(source, '') AS host, count(*) AS n FROM documents GROUP BY 1) t ON c.host = t.host
  WHERE c.pages >= {MIN_PAGES} AND c.pages > {MAX_RATIO} * t.n
), marked AS (SELECT l.*, b.bare IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.bare = b.bare),
cut AS (
  SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""


def _case(table: dict, column: str, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other} END"


def _level(depth: int) -> str:
    """One level of the tree: capacities summed to it, then its parents' budgets shared out."""
    path, level = ", ".join(LEAF[: depth + 1]), LEAF[depth]
    over = "PARTITION BY " + (", ".join(LEAF[:depth]) or "0")
    join = f"JOIN s{depth - 1} p USING ({', '.join(LEAF[:depth])})" if depth else ""
    budget = "p.share" if depth else f"(SELECT (CAST(sum(tokens) AS BIGINT) * {BUDGET_PERCENT}) // 100 FROM leaves)"
    return f"""
n{depth} AS (
  SELECT c.*, {budget} AS budget, {_case(WEIGHTS[level], level, "1")} AS weight
  FROM (SELECT {path}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY {path}) c {join}
), f{depth} AS (
  SELECT *, capacity * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= weight * greatest(budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS is_full
  FROM n{depth} WINDOW o AS ({over} ORDER BY capacity / weight, {level})
), g{depth} AS (
  SELECT *, greatest(budget - coalesce(sum(capacity) FILTER (WHERE is_full) OVER (p), 0), 0) AS rest_, sum(weight) FILTER (WHERE NOT is_full) OVER (p) AS open_
  FROM f{depth} WINDOW p AS ({over})
), h{depth} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE (weight * rest_) // open_ END AS part FROM g{depth}),
s{depth} AS (
  SELECT {path}, CAST(part + CASE WHEN NOT is_full AND row_number() OVER ({over} ORDER BY is_full, {level}) <= rest_ - sum(part) FILTER (WHERE NOT is_full) OVER ({over}) THEN 1 ELSE 0 END AS BIGINT) AS share
  FROM h{depth}
)"""


OP1 = f"""
WITH units AS (
  SELECT *, {_case(DOMAINS, "source", "'other'")} AS domain FROM (
    SELECT min(doc_id) AS doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS uid, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
           CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS BIGINT) AS n
    FROM documents GROUP BY 2, 3, 4) WHERE n > 0
), leaves AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) * {MAX_EPOCHS} AS BIGINT) AS capacity FROM units GROUP BY 1, 2, 3),
{_level(0)}, {_level(1)}, {_level(2)},
plan AS (SELECT l.*, coalesce(s2.share, 0) // tokens AS whole, coalesce(s2.share, 0) % tokens AS rest FROM leaves l LEFT JOIN s2 USING (domain, lang, source)),
placed AS (
  SELECT u.*, whole, rest, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || uid), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM units u JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, n AS n_tokens, n AS take_tokens
FROM (SELECT *, unnest(generate_series(0, whole - 1)) AS epoch FROM placed)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), n, CAST(least(n, rest - before) AS BIGINT) FROM placed WHERE before < rest
"""

def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"('{t['label']}', {str(t['exact']).lower()}, {t['need']}, {t['step']}, {_list(t['kinds'])}, {_list(t['body'])})" for t in templates())

#: Every block against every template.
OP8 = rf"""
WITH t(label, exact, need, step, kinds, body) AS (VALUES {_TEMPLATES}),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spots AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1)) AS i FROM w WHERE len(w) > 0),
places AS (SELECT doc_id, i, label FROM spots, t WHERE exact AND w[i + 1] = body[1] AND w[i + 1 : i + len(body)] = body),
blocks AS (SELECT doc_id, step, w[i + 1 : i + 2 * step] AS b FROM spots, (SELECT DISTINCT step FROM t) WHERE i % step = 0),
near AS (
  SELECT doc_id, label, len(list_intersect(kinds, b)) AS shared, len(kinds) AS size
  FROM blocks JOIN t USING (step) WHERE NOT exact AND list_has_any(kinds, b) AND len(list_intersect(kinds, b)) >= need
), base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT doc_id, label, 1.0 AS score FROM places UNION ALL SELECT doc_id, label, shared / size FROM near) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN every ON w.doc_id = every.doc_id
"""

#: The CRC-32 table by its rule, as one list t.
_CRC = """tab AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k) AS v FROM (SELECT unnest(range(256)) AS k)))"""


def _crc32(hexes: str) -> str:
    """CRC-32 of bytes given as capital hex digits; needs tab.t."""
    byte = f"16 * (strpos('0123456789ABCDEF', substr({hexes}, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr({hexes}, CAST(2 * i + 2 AS BIGINT), 1)) - 1"
    return f"xor(list_reduce(list_transform(range(length({hexes}) // 2), lambda i: CAST({byte} AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


OP12 = rf"""
WITH {_CRC},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY doc_id, word),
kinds AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM b)),
codes AS (SELECT word, {_crc32("h")} % 10000 AS bucket FROM kinds, tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN codes USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN codes USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
gains AS (
  SELECT bucket, floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (sizes.s + 10000) AS DOUBLE) / CAST((s.n + 1) * (sizes.t + 10000) AS DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket), sizes
), weighed AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(x.weight, 0) AS BIGINT) AS weight,
         list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT)), lambda a, c: 16 * a + c) AS h
  FROM d LEFT JOIN (SELECT doc_id, sum(n * gain) AS weight FROM dw JOIN codes USING (word) JOIN gains USING (bucket) GROUP BY doc_id) x ON d.doc_id = x.doc_id
), scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

OP11 = rf"""
WITH {_CRC},
turns AS (
  SELECT conv_id, turn, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS k, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS own, hex(encode(CAST(conv_id AS VARCHAR))) AS name FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, own, {_crc32("name")} % 4 AS h FROM convs, tab),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1 : h], c.own[h + 1 :]) AS s FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (SELECT conv_id, len(s) AS size, d, array_to_string(list_transform(s[1 : d], lambda x: x.k), ',') AS p, CASE WHEN d = 0 THEN 0 ELSE s[d].w END AS w FROM (SELECT conv_id, s, unnest(generate_series(0, len(s))) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, count(*) FILTER (WHERE size = d) AS n_ends,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
  FROM paths GROUP BY p, d
), above AS (SELECT substr(p, 1, CAST(greatest(33 * a - 1, 0) AS BIGINT)) AS up, a, n, w, n_ends FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM nodes)),
sums AS (SELECT up, a, count(*) FILTER (WHERE n = n_ends) AS n_leaves, CAST(sum((n - 1) * w) AS BIGINT) AS saved_tokens FROM above GROUP BY up, a),
kids AS (SELECT substr(p, 1, CAST(greatest(33 * (d - 1) - 1, 0) AS BIGINT)) AS up, d - 1 AS a, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums s ON s.up = x.p AND s.a = x.d LEFT JOIN kids k ON k.up = x.p AND k.a = x.d
LEFT JOIN nodes y ON y.d = x.d - 1 AND y.p = substr(x.p, 1, CAST(greatest(33 * (x.d - 1) - 1, 0) AS BIGINT))
"""

ORACLES = {"op8_license_scan": OP8, "op1_source_mix": OP1, "op3_line_dedup": OP3, "op4_exact_dedup": OP4, "op7_quality_rules": OP7, "op11_prefix_trie": OP11, "op12_importance": OP12}
