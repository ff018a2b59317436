"""Permutation tables of each generator in recursive SQL, from the generators' published recurrences: 4 permutations of 25
positions with seed 0. They share nothing with ``operators.rng``, which they check."""

from __future__ import annotations

#: Two places of a list change over.
_SWAP = "list_transform(line, lambda x, z: CASE WHEN z = {a} THEN line[CAST({b} AS INT)] WHEN z = {b} THEN line[CAST({a} AS INT)] ELSE x END)"

#: Additive feedback over 31 words; the first 310 are skipped.
_FEEDBACK = """lcg(i, v) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, 16807 * v % 2147483647 FROM lcg WHERE i < 30),
start AS (SELECT list(v ORDER BY i) AS l FROM lcg),
ring(l) AS (SELECT l || l[1:3] FROM start UNION ALL SELECT list_append(l, (l[len(l) - 2] + l[len(l) - 30]) & 4294967295) FROM ring WHERE len(l) < 440),
word AS (SELECT list_transform(l[345:], lambda x: x >> 1) AS w FROM ring WHERE len(l) = 440)"""

#: A Mersenne twister: its first state, and the words of the next one that need no word of their own state.
_TWISTER = """init(l) AS (SELECT [CAST({seed} AS BIGINT)] UNION ALL SELECT list_append(l, (1812433253 * xor(l[len(l)], l[len(l)] >> 30) + len(l)) & 4294967295) FROM init WHERE len(l) < 624),
mt AS (SELECT l FROM init WHERE len(l) = 624),
fresh AS (SELECT k, xor(xor(l[k + 398], y >> 1), (y & 1) * 2567483615) AS y FROM (SELECT k, l, (l[k + 1] & 2147483648) | (l[k + 2] & 2147483647) AS y FROM mt, range(227) g(k))),
t1 AS (SELECT k, xor(y, y >> 11) AS y FROM fresh), t2 AS (SELECT k, xor(y, (y << 7) & 2636928640) AS y FROM t1), t3 AS (SELECT k, xor(y, (y << 15) & 4022730752) AS y FROM t2),
word AS (SELECT list(xor(y, y >> 18) ORDER BY k) AS w FROM t3)"""

#: Position i changes over with i + word // (most // (n - i) + 1); a permutation goes on from the one before.
_CHAIN = (
    "perm(t, line) AS (SELECT 0, range(25) UNION ALL SELECT t + 1, "
    + _SWAP.format(a="(t % 24 + 1)", b="(t % 24 + w[t + 1] // ({most} // (25 - t % 24) + 1) + 1)")
    + """ FROM perm, word WHERE t < 96)
SELECT CAST(t // 24 - 1 AS INTEGER) AS perm_id, CAST(i AS INTEGER) AS pos, CAST(line[i + 1] AS INTEGER) AS src FROM perm, range(25) r(i) WHERE t > 0 AND t % 24 = 0"""
)

#: From the last position down, each changes over with a masked word that does not exceed it; every permutation starts anew.
_DRAW = (
    """perm(t, p, i, line, made) AS (SELECT 0, 0, 24, range(25), CAST(NULL AS BIGINT[]) UNION ALL
SELECT t + 1, CASE WHEN hit AND i = 1 THEN p + 1 ELSE p END, CASE WHEN NOT hit THEN i WHEN i = 1 THEN 24 ELSE i - 1 END,
  CASE WHEN NOT hit THEN line WHEN i = 1 THEN range(25) ELSE moved END, CASE WHEN hit AND i = 1 THEN moved END
FROM (SELECT *, """
    + _SWAP.format(a="(i + 1)", b="(v + 1)")
    + """ AS moved FROM (SELECT t, p, i, line, v, v <= i AS hit FROM
  (SELECT t, p, i, line, w[t + 1] & (CASE WHEN i > 15 THEN 31 WHEN i > 7 THEN 15 WHEN i > 3 THEN 7 WHEN i > 1 THEN 3 ELSE 1 END) AS v FROM perm, word WHERE p < 4))))
SELECT CAST(p - 1 AS INTEGER) AS perm_id, CAST(i AS INTEGER) AS pos, CAST(made[i + 1] AS INTEGER) AS src FROM (SELECT p, made FROM perm WHERE made IS NOT NULL), range(25) r(i)"""
)

TABLES = {
    "srand": f"WITH RECURSIVE {_FEEDBACK}, {_CHAIN.format(most=2**31 - 1)}",
    "gsl": f"WITH RECURSIVE {_TWISTER.format(seed=4357)}, {_CHAIN.format(most=2**32 - 1)}",
    "numpy": f"WITH RECURSIVE {_TWISTER.format(seed=0)}, {_DRAW}",
}
