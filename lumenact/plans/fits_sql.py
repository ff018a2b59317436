"""Newton's method in SQL: every step is a table of its own, made from the one before."""

from __future__ import annotations


def two_sided(z: str) -> str:
    """Twice the normal tail beyond |z|, by Simpson's rule between 0 and |z|."""
    a = f"least(abs({z}), 9.0)"
    total = f"list_sum(list_transform(range(401), lambda k: (CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow({a} * k / 400.0, 2))))"
    return f"greatest(1 - 2 * {total} * {a} / 1200.0 / sqrt(2 * pi()), 0)"


def logit(rows: str, terms: tuple[str, str], firth: bool, steps: int = 25) -> str:
    """``term, beta, se, z, p`` of a logit model of two terms; ``rows`` gives ``y, x0, x1``. A step whose gradient is below
    1e-6 stays where it is."""
    out = f"WITH d AS ({rows}), s0 AS (SELECT CAST(0.0 AS DOUBLE) AS b0, CAST(0.0 AS DOUBLE) AS b1)"
    for i in range(steps):
        out += f""",
p{i} AS (SELECT x0, x1, y, b0, b1, p, greatest(p * (1 - p), 1e-10) AS w FROM (SELECT *, 1 / (1 + exp(-(b0 * x0 + b1 * x1))) AS p FROM d, s{i})),
i{i} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(w * x0 * x0) AS a, sum(w * x0 * x1) AS b, sum(w * x1 * x1) AS c, sum(x0 * (y - p)) AS u, sum(x1 * (y - p)) AS v FROM p{i}),
h{i} AS (SELECT sum(x0 * h * (p - 0.5)) AS hu, sum(x1 * h * (p - 0.5)) AS hv FROM (SELECT x0, x1, p, w * (c * x0 * x0 - 2 * b * x0 * x1 + a * x1 * x1) / (a * c - b * b) AS h FROM p{i}, i{i})),
g{i} AS (SELECT *, u - {int(firth)} * hu AS gu, v - {int(firth)} * hv AS gv, a * c - b * b AS det FROM i{i}, h{i}),
t{i} AS (SELECT *, (c * gu - b * gv) / det AS du, (a * gv - b * gu) / det AS dv FROM g{i}),
s{i + 1} AS (SELECT b0 + f * du AS b0, b1 + f * dv AS b1 FROM (SELECT *, CASE WHEN sqrt(gu * gu + gv * gv) < 1e-6 THEN 0 ELSE least(1, 5.0 * (sqrt(b0 * b0 + b1 * b1) + 1) / (sqrt(du * du + dv * dv) + 1)) END AS f FROM t{i}))"""
    last = f"t{steps - 1}"
    return f"""{out},
r AS (SELECT '{terms[0]}' AS term, b0 AS beta, sqrt(c / det) AS se FROM {last} UNION ALL SELECT '{terms[1]}', b1, sqrt(a / det) FROM {last})
SELECT term, round(beta, 6) + 0.0 AS beta, round(se, 6) AS se, round(beta / se, 6) + 0.0 AS z, round({two_sided("beta / se")}, 6) + 0.0 AS p FROM r"""


def cox(rows: str, steps: int = 20) -> str:
    """``feature, risk_score_z, p_value, n`` with Efron's ties; ``rows`` begins a WITH that ends in ``cx(feature, t, e, v)``.
    Sums over the subjects at risk are sums over later times. A fit that has not come to rest has no row."""
    out = f"""{rows},
cs AS (SELECT feature, t, e, v, count(*) OVER f AS n, avg(v) OVER f AS m, stddev_pop(v) OVER f AS sd, stddev_samp(v) OVER f AS ss FROM cx WINDOW f AS (PARTITION BY feature)),
c AS (SELECT feature, t, e, n, (v - m) / sd AS x FROM cs WHERE n >= 5 AND ss >= 1e-10),
b0 AS (SELECT feature, any_value(n) AS n, CAST(0.0 AS DOUBLE) AS b, CAST(0.0 AS DOUBLE) AS info, CAST(0.0 AS DOUBLE) AS step FROM c GROUP BY feature)"""
    sums = ", ".join(f"sum(w{k}) AS w{k}, coalesce(sum(w{k}) FILTER (e = 1), 0) AS d{k}" for k in range(3))
    upto = ", ".join(f"sum(w{k}) OVER (PARTITION BY feature ORDER BY t DESC) AS s{k}" for k in range(3))
    parts = ", ".join(f"s{k} - l / deaths * d{k} AS a{k}" for k in range(3))
    for i in range(steps):
        out += f""",
w{i} AS (SELECT feature, t, e, x, w AS w0, w * x AS w1, w * x * x AS w2 FROM (SELECT c.*, exp(least(greatest(b * x, -50), 50)) AS w FROM c JOIN b{i} USING (feature))),
t{i} AS (SELECT feature, t, {sums}, count(*) FILTER (e = 1) AS deaths, sum(x) FILTER (e = 1) AS dx FROM w{i} GROUP BY feature, t),
r{i} AS (SELECT *, {upto} FROM t{i}),
l{i} AS (SELECT feature, dx / deaths AS dx, {parts} FROM (SELECT *, unnest(range(deaths)) AS l FROM r{i} WHERE deaths > 0)),
g{i} AS (SELECT feature, sum(dx - a1 / a0) AS g, sum(a2 / a0 - (a1 / a0) * (a1 / a0)) AS i FROM l{i} GROUP BY feature),
b{i + 1} AS (SELECT feature, n, b + least(greatest(g / i, -5), 5) AS b, i AS info, g / i AS step FROM b{i} JOIN g{i} USING (feature))"""
    z = "b * sqrt(info)"
    return f"{out}\nSELECT feature, round({z}, 5) + 0.0 AS risk_score_z, round({two_sided(z)}, 5) + 0.0 AS p_value, n FROM b{steps} WHERE info > 0 AND abs(step) < 1e-6"
