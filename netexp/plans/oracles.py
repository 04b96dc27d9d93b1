"""DuckDB SQL of the network queries, from shared pieces."""

from __future__ import annotations

import math

from netexp.functions.scalar import Z975

SIMS, SIZE = 4, 20

NET = """b AS (SELECT DISTINCT o_custkey AS n, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 45),
e AS (SELECT DISTINCT x.n AS s, y.n AS d FROM b x JOIN b y ON x.p = y.p AND x.n < y.n),
adj AS (SELECT s AS src, d AS dst FROM e UNION ALL SELECT d, s FROM e),
deg AS (SELECT src AS node, count(*)::BIGINT AS degree FROM adj GROUP BY src)"""
ALL_LINES = NET.replace(" WHERE l_quantity >= 45", "")
#: Neighbours as words of 60 bits: common ones are counted without paths.
WORDS = """bs AS (SELECT src AS node, dst // 60 AS chunk, bit_or(1::BIGINT << (dst % 60)) AS b FROM adj GROUP BY ALL),
tn AS (SELECT x.node, sum(bit_count(x.b & y.b)) // 2 AS t FROM adj JOIN bs x ON x.node = adj.src JOIN bs y ON y.node = adj.dst AND y.chunk = x.chunk GROUP BY x.node),
cc AS (SELECT deg.node, CASE WHEN degree >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0::DOUBLE END AS cluster_coef FROM deg LEFT JOIN tn ON deg.node = tn.node),
nb AS (SELECT adj.src AS node, avg(degree) AS nb_degree FROM adj JOIN deg ON deg.node = adj.dst GROUP BY adj.src),
attrs AS (SELECT deg.node, degree, cluster_coef, nb_degree FROM deg JOIN cc ON deg.node = cc.node JOIN nb ON nb.node = deg.node)"""
COBUY = """e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'),
adj AS (SELECT s AS src, d AS dst FROM e UNION ALL SELECT d, s FROM e),
deg AS (SELECT src AS node, count(*)::BIGINT AS degree FROM adj GROUP BY src)"""
CC = """tri AS (SELECT x.s AS a, x.d AS b, y.d AS c FROM e x JOIN e y ON x.d = y.s JOIN e z ON z.s = x.s AND z.d = y.d),
tn AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY node),
cc AS (SELECT deg.node, CASE WHEN degree >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0::DOUBLE END AS cluster_coef FROM deg LEFT JOIN tn ON deg.node = tn.node),
nb AS (SELECT adj.src AS node, avg(degree) AS nb_degree FROM adj JOIN deg ON deg.node = adj.dst GROUP BY adj.src),
attrs AS (SELECT deg.node, degree, cluster_coef, nb_degree FROM deg JOIN cc ON deg.node = cc.node JOIN nb ON nb.node = deg.node)"""
SAMPLE = f"""sims AS (SELECT unnest(range(1, {SIMS + 1}))::INTEGER AS sim),
ranked AS (SELECT sim, node, row_number() OVER (PARTITION BY sim ORDER BY md5(node::VARCHAR || '-' || sim::VARCHAR), node) AS rn FROM deg, sims),
samp AS (SELECT sim, node, CASE WHEN rn <= {SIZE} THEN 1 ELSE 2 END AS arm FROM ranked WHERE rn <= {2 * SIZE}),
nd AS (SELECT samp.sim, adj.src AS node, count(*)::BIGINT AS nd FROM samp JOIN adj ON adj.dst = samp.node GROUP BY samp.sim, adj.src),
clean AS (SELECT samp.* FROM samp LEFT JOIN nd ON samp.sim = nd.sim AND samp.node = nd.node WHERE nd.nd IS NULL),
alters AS (SELECT nd.sim, nd.node FROM nd LEFT JOIN samp ON samp.sim = nd.sim AND samp.node = nd.node WHERE nd.nd = 1 AND samp.node IS NULL),
armalt AS (SELECT DISTINCT samp.sim, samp.arm, adj.dst AS node FROM samp JOIN adj ON adj.src = samp.node JOIN alters ON alters.sim = samp.sim AND alters.node = adj.dst)"""


def sweep(sizes: list[int], sims: int = SIMS) -> str:
    """par, ranked, samp, nd and clean of a sweep with an order for each simulation and size; sizes beyond two arms are left out."""
    return f"""par AS (SELECT s.sim, z.nsample FROM (SELECT unnest(range(1, {sims + 1}))::INTEGER AS sim) s, (SELECT unnest({list(sizes)})::INTEGER AS nsample) z WHERE 2 * z.nsample <= (SELECT count(*) FROM deg)),
ranked AS (SELECT sim, nsample, node, row_number() OVER (PARTITION BY sim, nsample ORDER BY md5(node::VARCHAR || '-' || sim::VARCHAR || '-' || nsample::VARCHAR), node) AS rn FROM deg, par),
samp AS (SELECT sim, nsample, node, CASE WHEN rn <= nsample THEN 1 ELSE 2 END AS arm FROM ranked WHERE rn <= 2 * nsample),
nd AS (SELECT samp.sim, samp.nsample, adj.src AS node, count(*) AS nd FROM samp JOIN adj ON adj.dst = samp.node GROUP BY ALL),
clean AS (SELECT samp.* FROM samp LEFT JOIN nd ON samp.sim = nd.sim AND samp.nsample = nd.nsample AND samp.node = nd.node WHERE nd.nd IS NULL)"""


def nested(sizes: list[int], sims: int = SIMS) -> str:
    """par, ranked, samp, nd and clean of ``sweep``, with the samples of a simulation as prefixes of one order; sizes beyond two arms are left out."""
    return f"""par AS (SELECT s.sim, z.nsample FROM (SELECT unnest(range(1, {sims + 1}))::INTEGER AS sim) s, (SELECT unnest({list(sizes)})::INTEGER AS nsample) z WHERE 2 * z.nsample <= (SELECT count(*) FROM deg)),
ranked AS (SELECT sim, node, row_number() OVER (PARTITION BY sim ORDER BY md5(node::VARCHAR || '-' || sim::VARCHAR), node) AS rn FROM deg, (SELECT DISTINCT sim FROM par)),
samp AS (SELECT ranked.sim, nsample, node, CASE WHEN rn <= nsample THEN 1 ELSE 2 END AS arm, rn FROM ranked JOIN par ON par.sim = ranked.sim AND rn <= 2 * nsample),
nd AS (SELECT samp.sim, samp.nsample, adj.src AS node, count(*) AS nd FROM samp JOIN adj ON adj.dst = samp.node GROUP BY ALL),
clean AS (SELECT samp.* FROM samp LEFT JOIN nd ON samp.sim = nd.sim AND samp.nsample = nd.nsample AND samp.node = nd.node WHERE nd.nd IS NULL)"""


def near_pairs(name: str, source: str) -> str:
    """(sim, nsample, node) of ``source`` with a mate at distance exactly 2 in it, from all such pairs of the network."""
    return f"""{name}h AS (SELECT DISTINCT p.src, q.dst FROM adj p JOIN adj q ON q.src = p.dst AND q.dst <> p.src ANTI JOIN adj r ON r.src = p.src AND r.dst = q.dst),
{name} AS (SELECT DISTINCT x.sim, x.nsample, x.node FROM {source} x JOIN {name}h h ON h.src = x.node JOIN {source} y ON y.sim = x.sim AND y.nsample = x.nsample AND y.node = h.dst)"""


def ks_windows(name: str, sample: str, population: str, value: str, keys: list[str]) -> str:
    """(keys, ks) as ``ks``, with running counts at every population value."""
    k = ", ".join(keys)
    on = " AND ".join(f"g.{x} = s.{x}" for x in keys)
    return f"""{name}p AS (SELECT {value} AS v, sum(count(*)) OVER (ORDER BY {value}) / sum(count(*)) OVER ()::DOUBLE AS fp FROM {population} GROUP BY {value}),
{name}s AS (SELECT {k}, {value} AS v, count(*) AS c FROM {sample} GROUP BY ALL),
{name}g AS (SELECT g.*, v, fp FROM (SELECT DISTINCT {k} FROM {name}s) g, {name}p),
{name} AS (SELECT {k}, max(abs(fp - fs)) AS ks FROM (SELECT {', '.join('g.' + x for x in keys)}, fp, sum(coalesce(c, 0)) OVER (PARTITION BY {', '.join('g.' + x for x in keys)} ORDER BY g.v) / sum(coalesce(c, 0)) OVER (PARTITION BY {', '.join('g.' + x for x in keys)})::DOUBLE AS fs FROM {name}g g LEFT JOIN {name}s s ON {on} AND g.v = s.v) GROUP BY {k})"""


def pairs(name: str, source: str, keys: list[str]) -> str:
    """(keys, node) of ``source`` with a mate at distance exactly 2 in it; treated: with a treated one."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    ks = ", ".join(f"x.{k}" for k in keys)
    return f"""{name} AS (SELECT DISTINCT {ks}, x.node, y.node AS mate, y.arm AS mate_arm FROM {source} x JOIN adj p ON p.src = x.node JOIN adj q ON q.src = p.dst JOIN {source} y ON {on('x', 'y')} AND y.node = q.dst AND y.node <> x.node
LEFT JOIN adj r ON r.src = x.node AND r.dst = y.node WHERE r.src IS NULL)"""


def ks(name: str, sample: str, population: str, value: str, keys: list[str]) -> str:
    """(keys, ks): by the distribution functions at every pooled value."""
    ks_, on = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "TRUE"
    return f"""{name}v AS (SELECT DISTINCT {value} AS v FROM {population}),
{name}p AS (SELECT v, (SELECT count(*) FROM {population} q WHERE q.{value} <= v) / (SELECT count(*) FROM {population})::DOUBLE AS fp FROM {name}v),
{name}t AS (SELECT {ks_}, count(*) AS total FROM {sample} GROUP BY {ks_}),
{name} AS (SELECT {', '.join('t.' + k for k in keys)}, max(abs(fp - (SELECT count(*) FROM {sample} s WHERE {on('s', 't')} AND s.{value} <= v) / total::DOUBLE)) AS ks FROM {name}t t, {name}p GROUP BY {', '.join('t.' + k for k in keys)})"""


def normal(node: str, name: str) -> str:
    u = lambda k: f"((('0x' || substr(md5({node}::VARCHAR || '-{name}-{k}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u('u')})) * cos({2 * math.pi!r} * {u('v')}))"


def t975(df: str) -> str:
    z = Z975
    c = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join([f"{z!r}::DOUBLE", *(f"{x!r}::DOUBLE / pow({df}, {i})" for i, x in enumerate(c, 1))]) + ")"


COV = f"""zd AS (SELECT node, degree, (degree - avg(degree) OVER ()) / stddev_pop(degree) OVER () AS z FROM deg),
zm AS (SELECT node, degree, -0.7 * z + {(1 - 0.49) ** 0.5!r} * {normal('node', 'z1')} AS a, 0.3 * z + {(1 - 0.3 * 0.3) ** 0.5!r} * {normal('node', 'z2')} AS c,
  (('0x' || substr(md5(node::VARCHAR || '-z3'), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM zd),
cov AS (SELECT node, degree, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 10 AS z1, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) * 10 AS z2, CASE WHEN u < 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS z3 FROM zm),
base AS (SELECT node, degree, 1.0 + 0.5 * ln(degree) - 0.5 * ln(z1 + 1) + 0.5 * ln(z2 + 1) - 0.5 * z3 + {normal('node', 'noise')} AS y00, {normal('node', 'ego')} AS eff FROM cov)"""
OUT = """tt AS (SELECT sim, samp.node, arm, CASE WHEN arm = 1 THEN 0.05 * degree ELSE 0 END AS tt, eff FROM samp JOIN base ON base.node = samp.node),
ad AS (SELECT sim, node, sum(v) AS v FROM (SELECT sim, node, tt + eff AS v FROM tt UNION ALL SELECT tt.sim, adj.src, 0.5 * tt.tt + tt.eff FROM tt JOIN adj ON adj.dst = tt.node) GROUP BY sim, node),
y AS (SELECT s.sim, base.node, y00 + coalesce(v, 0) AS y FROM base CROSS JOIN (SELECT DISTINCT sim FROM samp) s LEFT JOIN ad ON ad.sim = s.sim AND ad.node = base.node),
oe AS (SELECT c.sim, c.arm, c.node, nullif(y, 0) AS y FROM clean c JOIN y ON y.sim = c.sim AND y.node = c.node),
oa AS (SELECT c.sim, c.arm, c.node, nullif(y, 0) AS y FROM armalt c JOIN y ON y.sim = c.sim AND y.node = c.node)"""
EXPO = f"""k AS (SELECT DISTINCT degree, (SELECT count(*) FROM deg)::DOUBLE AS n, {2 * SIZE}.0::DOUBLE AS m FROM deg),
f AS (SELECT k.*, j::DOUBLE AS j FROM k, LATERAL (SELECT unnest(range(0, degree)) AS j) u),
g AS (SELECT degree, n, m, exp(sum(CASE WHEN n - m - j > 0 THEN ln((n - m - j) / (n - 1 - j)) END)) * CASE WHEN min(n - m - j) > 0 THEN 1 ELSE 0 END AS p10,
  exp(sum(CASE WHEN n - 1 - m - j > 0 THEN ln((n - 1 - m - j) / (n - 1 - j)) END)) * CASE WHEN min(n - 1 - m - j) > 0 THEN 1 ELSE 0 END AS p00,
  coalesce(exp(sum(CASE WHEN j < degree - 1 AND n - 1 - m - j > 0 THEN ln((n - 1 - m - j) / (n - 2 - j)) END)), 1) * CASE WHEN min(CASE WHEN j < degree - 1 THEN n - 1 - m - j ELSE 1 END) > 0 THEN 1 ELSE 0 END AS p01 FROM f GROUP BY degree, n, m),
xd AS (SELECT degree, m / n * p10 AS d10, (n - m) / n * p00 AS d00, (n - m) / n * degree * m / (n - 1) * p01 AS d01, n, m FROM g),
expo AS (SELECT node, m / n - d10 AS d11, d10, (n - m) / n - d00 - d01 AS d0n, d01, d00 FROM deg JOIN xd ON xd.degree = deg.degree)"""
WEIGHTED = """he AS (SELECT sim, arm, oe.node, y / nullif(d10 / 2, 0) AS y, CASE WHEN y IS NOT NULL THEN 1 / nullif(d10 / 2, 0) END AS w FROM oe JOIN expo ON expo.node = oe.node),
ha AS (SELECT sim, arm, oa.node, y / nullif(d01 / 2, 0) AS y, CASE WHEN y IS NOT NULL THEN 1 / nullif(d01 / 2, 0) END AS w FROM oa JOIN expo ON expo.node = oa.node)"""


def filled(name: str, source: str) -> str:
    return f"""{name} AS (SELECT s.sim, a.arm, deg.node, coalesce(v.y, 0) AS y FROM deg CROSS JOIN (SELECT DISTINCT sim FROM {source}) s CROSS JOIN (SELECT unnest([1, 2]) AS arm) a LEFT JOIN {source} v ON v.sim = s.sim AND v.arm = a.arm AND v.node = deg.node)"""


def test(source: str, true_value: str) -> str:
    df = "(n1 + n2 - 2)"
    return f"""m AS (SELECT sim, count(y) FILTER (arm = 1) AS n1, count(y) FILTER (arm = 2) AS n2, avg(y) FILTER (arm = 1) AS m1, avg(y) FILTER (arm = 2) AS m2, var_samp(y) FILTER (arm = 1) AS v1, var_samp(y) FILTER (arm = 2) AS v2 FROM {source} WHERE y IS NOT NULL GROUP BY sim),
q AS (SELECT sim, m1 - m2 AS est, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / {df} * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS se, {t975(df)} AS tq FROM m),
tst AS (SELECT sim, est, se, est / nullif(se, 0) AS t, est - tq * se AS lo, est + tq * se AS hi, est - tq * se > 0 AS power, (est - tq * se < {true_value}) AND ({true_value} < est + tq * se) AS coverage FROM q)"""


SHOW_TEST = "SELECT sim, round(est, 6) AS est, round(se, 6) AS se, round(t, 6) AS t, round(lo, 6) AS lo, round(hi, 6) AS hi, power, coverage FROM tst"
TRUE_D = "((SELECT avg(degree) FROM deg) * 0.05)"
TRUE_I = "((SELECT avg(degree) FROM deg) * 0.05 * 0.5)"


def w(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts[:-1]) + "\n" + parts[-1]
