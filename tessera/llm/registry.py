"""Queries of the training-data problems and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import leaks, mixing, neardup, pairs, quality, reading, scans, spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": scans.p1_found,
    "p1_repaired": scans.p1_repaired,
    "p2_found": quality.p2_found,
    "p2_statistics": quality.p2_statistics,
    "p2_counts": quality.p2_counts,
    "p3_found": spans.p3_found,
    "p3_shared": spans.p3_shared,
    "p4_found": neardup.p4_found,
    "p4_groups": neardup.p4_groups,
    "p5_found": pairs.p5_found,
    "p5_defects": pairs.p5_defects,
    "p5_patterns": pairs.p5_patterns,
    "p6_found": leaks.p6_found,
    "p6_runs": leaks.p6_runs,
    "p6_leaks": leaks.p6_leaks,
    "p7_found": mixing.p7_found,
    "p7_reach": mixing.p7_reach,
    "p7_mixture": mixing.p7_mixture,
    "p7_shares": mixing.p7_shares,
    "p8_found": reading.p8_found,
    "p8_levels": reading.p8_levels,
}

_TEXTS = "t AS (SELECT DISTINCT id, doc_id, content.text AS text FROM chunks WHERE content.text IS NOT NULL AND id IS NOT NULL AND doc_id IS NOT NULL)"
_SPANS = f"""{_TEXTS},
w AS (SELECT id, doc_id, unnest(range(0, length(text) - 199)) AS s, text FROM t WHERE length(text) >= 200),
h AS (SELECT id, doc_id, s, md5_number(substring(text, s + 1, 200)) AS h FROM w),
g AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT id, s, lead(s) OVER (PARTITION BY id ORDER BY s) AS next, lag(s) OVER (PARTITION BY id ORDER BY s) AS last FROM (SELECT DISTINCT id, s FROM h WHERE h IN (SELECT h FROM g)))"""
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_RUNS = "list_transform(range(1, len({0}) - {1} + 2), lambda k: array_to_string({0}[k:k + {1} - 1], ' '))"

_PAIRS = f"""{_TEXTS},
w AS (SELECT DISTINCT id, {_WORDS.format("text")} AS w FROM t),
r AS (SELECT id, unnest(list_distinct({_RUNS.format("w", 3)})) AS r FROM w WHERE len(w) >= 40),
n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
f AS (SELECT r, count(*) AS df FROM r GROUP BY r),
o AS (SELECT r.id, r.r, n.n, row_number() OVER (PARTITION BY r.id ORDER BY f.df, r.r) AS place FROM r JOIN f ON f.r = r.r JOIN n ON n.id = r.id),
p AS (SELECT id, r FROM o WHERE place <= n - CAST(ceil(0.6 * n - 0.000001) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM p a JOIN p b ON a.r = b.r AND a.id < b.id),
i AS (SELECT id_a, id_b, count(*) AS common FROM c JOIN r a ON a.id = c.id_a JOIN r b ON b.id = c.id_b AND b.r = a.r GROUP BY id_a, id_b),
pairs AS (SELECT id_a, id_b FROM i JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE common >= 0.6 * (a.n + b.n - common))"""

#: SQL twins, where SQL can say the whole result on the whole tables.
ORACLE: dict[str, str] = {
    "p2_counts": rf"""WITH {_TEXTS},
u AS (SELECT DISTINCT id, text FROM t),
w AS (SELECT id, unnest({_WORDS.format("text")}) AS word FROM u),
c AS (SELECT DISTINCT unnest({_WORDS.format("word")}) AS word FROM common_words WHERE word IS NOT NULL),
n AS (SELECT w.id, count(*) AS n_words, count(c.word) AS n_common FROM w LEFT JOIN c ON c.word = w.word GROUP BY w.id)
SELECT u.id, CAST(length(text) AS BIGINT) AS n_chars, coalesce(n_words, 0) AS n_words, coalesce(n_common, 0) AS n_common,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x0B\x{{A0}}\x{{2003}}\x{{2009}}\x{{202F}}\x{{3000}}]'))) AS BIGINT) AS n_lines
FROM u LEFT JOIN n ON n.id = u.id""",
    "p3_found": f"WITH {_SPANS} SELECT DISTINCT id FROM m",
    "p3_shared": f"""WITH {_SPANS},
c AS (SELECT id, CAST(sum(least(200, coalesce(next - s, 200))) AS BIGINT) AS shared_chars, CAST(count(*) FILTER (last IS NULL OR s - last > 200) AS BIGINT) AS n_spans FROM m GROUP BY id)
SELECT x.id, CAST(x.n_chars AS BIGINT) AS n_chars, coalesce(c.shared_chars, 0) AS shared_chars, coalesce(round(c.shared_chars / x.n_chars, 6), 0.0) AS share, coalesce(c.n_spans, 0) AS n_spans
FROM (SELECT id, max(length(content.text)) AS n_chars FROM chunks WHERE content.text IS NOT NULL AND id IS NOT NULL GROUP BY id) x LEFT JOIN c ON c.id = x.id""",
    "p4_found": f"WITH {_PAIRS} SELECT id_a, id_b FROM pairs",
    "p4_groups": f"""WITH RECURSIVE {_PAIRS},
e AS (SELECT id_a AS x, id_b AS y FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
g AS (SELECT x, least(x, min(y)) AS group_id FROM reach GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT n.id, coalesce(g.group_id, n.id) AS group_id, coalesce(l.n_links, 0) AS n_links FROM n LEFT JOIN g ON g.x = n.id LEFT JOIN l ON l.x = n.id""",
    "p6_found": f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT item_id, unnest({_RUNS.format("w", 14)}) AS r FROM i WHERE len(w) >= 14),
y AS (SELECT doc_id, unnest({_RUNS.format("w", 14)}) AS r FROM d WHERE len(w) >= 14)
SELECT DISTINCT y.doc_id, x.item_id FROM y JOIN x ON x.r = y.r""",
    "p6_runs": f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT item_id, unnest({_RUNS.format("w", 14)}) AS r, generate_subscripts({_RUNS.format("w", 14)}, 1) AS q FROM i WHERE len(w) >= 14),
y AS (SELECT doc_id, unnest({_RUNS.format("w", 14)}) AS r, generate_subscripts({_RUNS.format("w", 14)}, 1) AS p FROM d WHERE len(w) >= 14),
m AS (SELECT doc_id, item_id, p - q AS diagonal, p, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM (SELECT DISTINCT y.doc_id, x.item_id, y.p, x.q FROM y JOIN x ON x.r = y.r)),
l AS (SELECT doc_id, item_id, count(*) + 13 AS n FROM m GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS exact_run FROM l GROUP BY doc_id, item_id""",
    "p7_found": r"""WITH s AS (SELECT lower(regexp_replace(trim(source), '[^\p{L}\p{N}]+', '_', 'g')) AS source, sum(length(text)) AS size FROM documents GROUP BY 1),
a AS (SELECT sum(size) AS whole FROM s)
SELECT w.source FROM source_weights w CROSS JOIN a LEFT JOIN s ON s.source = w.source WHERE coalesce(s.size, 0) * w.max_uses < w.target_share * a.whole""",
    "p7_reach": r"""WITH s AS (SELECT lower(regexp_replace(trim(source), '[^\p{L}\p{N}]+', '_', 'g')) AS source, count(*) AS documents, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY 1),
a AS (SELECT sum(size) AS whole FROM s),
x AS (SELECT w.source, coalesce(s.documents, 0) AS documents, coalesce(s.size, 0) AS size, w.target_share * a.whole AS target, w.max_uses FROM source_weights w CROSS JOIN a LEFT JOIN s ON s.source = w.source)
SELECT source, documents, CAST(size AS BIGINT) AS available_chars, CAST(round(target, 2) AS DOUBLE) AS target_chars, CAST(round(least(target, size * max_uses), 2) AS DOUBLE) AS raked_chars, size * max_uses >= target AS reachable FROM x""",
}
