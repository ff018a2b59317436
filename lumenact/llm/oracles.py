"""DuckDB SQL with the results of the queries, where SQL can give them over whole tables."""

_LABEL = r"""
label AS (SELECT sample, min(CASE WHEN a NOT IN ('', 'na', 'n/a', 'unknown', 'unassigned') THEN a END) AS annotation
  FROM (SELECT sample, trim(regexp_replace(lower(annotation), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}_-]+', ' ', 'g')) AS a
        FROM obs WHERE sample IS NOT NULL) GROUP BY sample)"""

_GROUPS = f"""
WITH {_LABEL},
v AS (SELECT l.annotation, a.feature, max(CASE WHEN NOT isnan(zscore) THEN zscore END) AS v
  FROM activity a JOIN label l ON l.sample = a.sample JOIN panel p ON p.feature = a.feature
  WHERE l.annotation IS NOT NULL AND p.tier IN (%s) GROUP BY l.annotation, a.feature, a.sample, a.run_id),
o AS (SELECT *, row_number() OVER (PARTITION BY annotation, feature ORDER BY v) AS k,
        count(*) OVER (PARTITION BY annotation, feature) AS n FROM v WHERE v IS NOT NULL),
q AS (SELECT o.annotation, o.feature, CAST(pct AS INTEGER) AS pct, o.v AS value, CAST(o.n AS BIGINT) AS n
  FROM o, (VALUES (50), (75), (90)) t(pct) WHERE o.k = greatest(1, CAST(ceil(pct * o.n / 100) AS BIGINT)))
"""

_PROFILE = """
cell AS (SELECT DISTINCT o.sample FROM obs o WHERE o.sample IN (SELECT sample FROM activity)),
val AS (SELECT a.sample, p.pos, max(CASE WHEN NOT isnan({v}) THEN {v} END) AS v
  FROM activity a JOIN panel p ON p.feature = a.feature WHERE p.tier = 'core' GROUP BY a.sample, p.pos),
core AS (SELECT pos FROM panel WHERE tier = 'core'),
prof AS (SELECT c.sample, list(coalesce(v.v, 0.0) ORDER BY k.pos) AS vec
  FROM cell c CROSS JOIN core k LEFT JOIN val v ON v.sample = c.sample AND v.pos = k.pos GROUP BY c.sample)
"""

_RANKED = """
WITH u AS (SELECT sample, feature, run_id, max(zscore) AS zscore, min(CASE WHEN NOT isnan(pvalue) THEN pvalue END) AS pvalue
  FROM activity WHERE zscore IS NOT NULL AND NOT isnan(zscore) GROUP BY sample, feature, run_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample ORDER BY zscore DESC, pvalue ASC NULLS LAST, feature, run_id) AS INTEGER) AS rank_no FROM u)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {_PROFILE.format(v="zscore")}
SELECT a.sample FROM prof a JOIN prof b ON a.sample <> b.sample
GROUP BY a.sample HAVING count(*) FILTER (list_distance(a.vec, b.vec) <= 16) <= 4""",
    "p2_found": _GROUPS % "'ext'" + "SELECT annotation, feature, pct FROM q WHERE value >= 3.0",
    "p2_percentiles": _GROUPS % "'core', 'ext'" + "SELECT annotation, feature, pct, value, n FROM q",
    "p4_found": _RANKED + "SELECT sample, feature, run_id FROM r WHERE rank_no <= 5",
    "p4_top": _RANKED + "SELECT sample, rank_no, feature, run_id, zscore, pvalue FROM r WHERE rank_no <= 5",
    "p5_found": f"""WITH {_PROFILE.format(v="beta")}
SELECT a.sample AS sample_a, b.sample AS sample_b FROM prof a JOIN prof b ON a.sample < b.sample
WHERE list_cosine_similarity(a.vec, b.vec) >= 0.997""",
    "p3_found": f"""WITH RECURSIVE {_PROFILE.format(v="zscore")},
e AS (SELECT a.sample AS x, b.sample AS y FROM prof a JOIN prof b ON list_distance(a.vec, b.vec) <= 16),
near AS (SELECT x, min(y) AS y FROM e GROUP BY x),
hop AS (SELECT x, y FROM near UNION SELECT e.x, h.y FROM hop h JOIN e ON e.y = h.x AND h.y < e.x)
SELECT sample_a, sample_b FROM (SELECT min(y) AS sample_a, x AS sample_b FROM hop GROUP BY x) WHERE sample_a <> sample_b""",
}

ORACLES |= {
    "p1_kinds": ORACLES["p3_found"].rpartition("\n")[0] + "\nSELECT count(DISTINCT y) AS kinds FROM (SELECT x, min(y) AS y FROM hop GROUP BY x)",
    "p2_bound": _GROUPS % "'core', 'ext'" + "SELECT count(*) AS percentiles, CAST(0 AS BIGINT) AS off FROM q",
    "p3_cells": "SELECT count(DISTINCT sample) AS cells FROM obs WHERE sample IN (SELECT sample FROM activity)",
    "p6_texts": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_limits": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS split FROM documents",
    "p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
