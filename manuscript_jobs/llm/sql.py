"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .url_filter import RULES, SOFT, SOFT_LIMIT, STRICT


def _op1() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for c, (_, h, p) in zip(fits, ordered)) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, (a, _, _) in zip(fits, ordered)) + " END"
    bounded = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    soft = " + ".join(f"{w} * regexp_matches(low, '{bounded.format(t)}')::INT" for t, w in SOFT)
    softs = " + ".join(f"regexp_matches(low, '{bounded.format(t)}')::INT" for t, _ in SOFT)
    strict = " + ".join(f"regexp_matches(low, '{bounded.format(t)}')::INT" for t in STRICT)
    return f"""
    WITH a AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
                      CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM a),
    c AS (SELECT *, {lower.format("raw_host")} AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT *, {rule} AS rule, {action} AS action, ({strict})::INT AS strict_hits, ({softs})::INT AS soft_hits, ({soft})::INT AS soft_weight FROM c)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN strict_hits >= 1 OR (soft_hits >= 2 AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
           strict_hits, soft_hits, soft_weight FROM d"""


#: Targets by the closed form of the water level; a document's place by sums in its source's seeded order.
_OP6 = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      md5('mix-1|' || doc_id::VARCHAR) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
    o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS r FROM w),
    l AS (SELECT r, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / (sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level, cap / weight AS full_at FROM o),
    v AS (SELECT level FROM l WHERE level <= full_at ORDER BY r LIMIT 1),
    t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM v)) AS target FROM o),
    p AS (SELECT doc_id, size, source_size, target, floor(round(target)::BIGINT / source_size)::BIGINT AS whole,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(k, 1, 8))::BIGINT % 1024, k, doc_id, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - begins)))::BIGINT AS taken FROM p"""

_OP9 = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12 = rf"""
    WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
    d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, p)) AS term FROM documents, pattern),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
    i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, p)) AS term FROM benchmark, pattern),
    q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
    s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), total GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20"""

_OP11 = rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
    k AS (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 30),
    v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
    n AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
    t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
    p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * terms) AS p
          FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (max(whole) + 5 * max(terms)) AS q
          FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS whole FROM t GROUP BY lang) USING (lang) GROUP BY ALL),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
    SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

ORACLES = {"op1_url_filter": _op1(), "op6_mixing": _OP6, "op9_topk": _OP9, "op11_divergence": _OP11, "op12_lexical": _OP12}
