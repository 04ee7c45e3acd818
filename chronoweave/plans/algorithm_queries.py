"""Iterative graph algorithms: orders, betweenness, spectra, orbits, neighbourhood kernels, projections; each beside its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, kernels, orbits, ordering, paths, projection, spectrum, structure
from chronoweave.plans.queries import _PAIRS, _SOCIAL, _WIN, query
from chronoweave.plans.sample_queries import _u
from chronoweave.plans.structure_queries import _CHAMBERS, _DEG, _EMD, _FIT, _chambers, _fits, _r, _win
from chronoweave.session import stored, table
from chronoweave.sources.tables import social_edges

_NEAR = _PAIRS + ", near AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), deg AS (SELECT a AS node, count(*) AS k FROM near GROUP BY a)"


# Reverse Cuthill-McKee

_HOPS = 12  #: levels that the SQL below unrolls; the graphs of the test tables have fewer
_RCM = f"""{_NEAR}, comp AS (SELECT node, min(c) AS c FROM (WITH RECURSIVE r AS (SELECT node, node AS c FROM deg UNION SELECT near.b, r.c FROM r JOIN near ON near.a = r.node) SELECT * FROM r) GROUP BY node),
  first AS (SELECT node FROM (SELECT deg.node, row_number() OVER (PARTITION BY c ORDER BY k, deg.node) AS r FROM deg JOIN comp USING (node)) WHERE r = 1),
  l0 AS (SELECT node, 0 AS level, row_number() OVER (ORDER BY k, node) - 1 AS place, row_number() OVER (ORDER BY k, node) - 1 AS root FROM first JOIN deg USING (node))""" + "".join(
    f""", s{h} AS (SELECT * FROM {'l0' if not h else f's{h - 1} UNION ALL SELECT * FROM l{h}'}), l{h + 1} AS (SELECT node, {h + 1} AS level, row_number() OVER (ORDER BY parent, k, node) - 1 AS place, root
    FROM (SELECT near.b AS node, min(l.place) AS parent, arg_min(l.root, l.place) AS root FROM l{h} l JOIN near ON near.a = l.node WHERE near.b NOT IN (SELECT node FROM s{h}) GROUP BY near.b) JOIN deg USING (node))"""
    for h in range(_HOPS)
) + f", placed AS (SELECT * FROM s{_HOPS - 1} UNION ALL SELECT * FROM l{_HOPS}), rcm AS (SELECT node, (SELECT count(*) FROM placed) - row_number() OVER (ORDER BY root, level, place) AS number FROM placed)"


@query("gr37_reverse_cuthill_mckee", f"WITH {_RCM} SELECT node, number FROM rcm")
def _(spark, d):
    """The place of every node in the reverse Cuthill-McKee order of the social graph."""
    return ordering.cuthill_mckee(social_edges(spark, d))


_GAPS = "max(gap) AS most, round(avg(gap), 6) AS mean, quantile_cont(gap, 0.9) AS p90"


@query("gr37_bandwidth", f"WITH {_RCM}, g AS (SELECT abs(a.number - b.number) AS gap FROM social JOIN rcm a ON a.node = src JOIN rcm b ON b.node = dst) SELECT 'after' AS ordered, {_GAPS} FROM g UNION ALL SELECT 'before', {_GAPS} FROM (SELECT abs(src - dst) AS gap FROM social)")
def _(spark, d):
    """How far apart edges' ends are, before and after the order."""
    e = social_edges(spark, d)
    after = ordering.bandwidth(e, ordering.cuthill_mckee(e)).select("gap")
    before = e.select(F.abs(F.col("src") - F.col("dst")).alias("gap"))

    def row(name, g):
        return g.agg(F.max("gap").alias("most"), _r(F.avg("gap")).alias("mean")).join(F.broadcast(dist.quantiles(g, "gap", {"p90": 0.9}))).select(F.lit(name).alias("ordered"), "most", "mean", "p90")

    return row("after", stored(after)).union(row("before", before))


# Ranks

_ROUNDS = 10
_RANKS = f"WITH {_SOCIAL}, e AS (SELECT DISTINCT src, dst FROM social), o AS (SELECT src, count(*) AS n FROM e GROUP BY src), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, n)" + "".join(
    f""", r{k + 1} AS MATERIALIZED (SELECT v.node, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + coalesce((SELECT sum(rank) FROM r{k} WHERE node NOT IN (SELECT src FROM o)), 0) / n.n) AS rank
    FROM v LEFT JOIN (SELECT e.dst AS node, sum(r.rank / o.n) AS got FROM e JOIN r{k} r ON r.node = e.src JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.node = v.node, n)"""
    for k in range(_ROUNDS)
)


@query("gr9_pagerank_ten_rounds", f"{_RANKS} SELECT node, round(rank, 9) AS rank FROM r{_ROUNDS}")
def _(spark, d):
    """Ranks after ten rounds, which the SQL unrolls."""
    return graph.pagerank(social_edges(spark, d), rounds=_ROUNDS).select("node", _r(F.col("rank"), 9).alias("rank"))


@query("l5_pagerank_top_ten_rounds", f"{_RANKS} SELECT node, round(rank, 9) AS rank FROM r{_ROUNDS} ORDER BY round(rank, 9) DESC, node LIMIT 100")
def _(spark, d):
    return graph.pagerank(social_edges(spark, d), rounds=_ROUNDS).select("node", _r(F.col("rank"), 9).alias("rank")).orderBy(F.desc("rank"), "node").limit(100)


_TOPS = f"WITH {_WIN}, a AS (SELECT src FROM win WHERE w < 15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 100), b AS (SELECT src FROM win WHERE w >= 15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 100), h AS (SELECT count(*) AS h FROM a JOIN b USING (src)) SELECT h / (SELECT count(*) FROM b) AS precision, h / (SELECT count(*) FROM a) AS recall, 2 * h / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) AS f1 FROM h"


@query(
    "gr32_macro_bundle_ten_rounds",
    f"""SELECT h.*, f.*, c.*, r.* FROM ({_TOPS}) h, (WITH {_WIN}, {_FIT} SELECT round(avg(alpha), 6) AS alpha, round(avg(D), 6) AS D FROM s) f,
    (WITH {_CHAMBERS} SELECT count(*) FILTER (linked / "similar" > 0.01) AS chambers FROM c) c, (SELECT round(avg(rank), 9) AS top_rank FROM ({_RANKS} SELECT rank FROM r{_ROUNDS} ORDER BY rank DESC, node LIMIT 100)) r""",
)
def _(spark, d):
    """Hub agreement, exponent, distance, chambers and mean rank of the top nodes in one row."""
    e = _win(spark, d)
    hubs = structure.hub_scores(e.where("w < 15"), e.where("w >= 15"), 100)
    fit = _fits(spark, d).agg(_r(F.avg("alpha")).alias("alpha"), _r(F.avg("D")).alias("D"))
    chambers = _chambers(spark, d, social_edges(spark, d)).agg(F.count_if("chamber").alias("chambers"))
    top = graph.pagerank(social_edges(spark, d), rounds=_ROUNDS).orderBy(F.desc("rank"), "node").limit(100).agg(_r(F.avg("rank"), 9).alias("top_rank"))
    return hubs.join(F.broadcast(fit)).join(F.broadcast(chambers)).join(F.broadcast(top))


# Betweenness

_LEVELS = 4  #: hops that the SQL below unrolls
_FORWARD = f"{_NEAR}, f0 AS (SELECT node AS s, node AS v, 1.0::DOUBLE AS n FROM deg WHERE node % 20 = 0), k0 AS (SELECT s, v FROM f0)" + "".join(
    f", f{h} AS (SELECT f.s, near.b AS v, sum(f.n) AS n FROM f{h - 1} f JOIN near ON near.a = f.v WHERE (f.s, near.b) NOT IN (SELECT (s, v) FROM k{h - 1}) GROUP BY ALL), k{h} AS (SELECT * FROM k{h - 1} UNION ALL SELECT s, v FROM f{h})"
    for h in range(1, _LEVELS + 1)
)
_BACKWARD = f", d{_LEVELS} AS (SELECT s, v, n, 0.0::DOUBLE AS d FROM f{_LEVELS})" + "".join(
    f", d{h} AS (SELECT f.s, f.v, f.n, f.n * coalesce(sum((1 + x.d) / x.n), 0) AS d FROM f{h} f LEFT JOIN (SELECT near.b AS v, t.s, t.d, t.n FROM d{h + 1} t JOIN near ON near.a = t.v) x ON x.s = f.s AND x.v = f.v GROUP BY f.s, f.v, f.n)"
    for h in range(_LEVELS - 1, 0, -1)
)
_SUMMED = ", b AS (SELECT v, sum(d) AS d FROM (" + " UNION ALL ".join(f"SELECT v, d FROM d{h}" for h in range(1, _LEVELS + 1)) + ") GROUP BY v)"


@query("gr27_betweenness", f"WITH {_FORWARD}{_BACKWARD}{_SUMMED} SELECT node, round(coalesce(d, 0), 6) AS dependency FROM deg LEFT JOIN b ON b.v = node")
def _(spark, d):
    """Betweenness from a stated set of sources, ids divisible by 20, to all nodes."""
    e = social_edges(spark, d)
    sources = graph.both_ways(e).select("node").distinct().where("node % 20 = 0")
    return paths.betweenness(e, sources).select("node", _r(F.col("dependency")).alias("dependency"))


# Spectra

_MOMENTS, _PROBES = 8, 3
_WNEAR = f"{_WIN}, wp AS (SELECT DISTINCT w, least(src, dst) AS a, greatest(src, dst) AS b FROM win WHERE src <> dst), wnear AS (SELECT w, a, b FROM wp UNION ALL SELECT w, b, a FROM wp), wdeg AS (SELECT w, a, count(*) AS k FROM wnear GROUP BY w, a)"
_T = (
    f"{_WNEAR}, m AS (SELECT n.w, n.a, n.b, -1 / sqrt(x.k * y.k) AS m FROM wnear n JOIN wdeg x ON x.w = n.w AND x.a = n.a JOIN wdeg y ON y.w = n.w AND y.a = n.b), "
    f"t0 AS (SELECT w, a, r, CASE WHEN {_u(17, 'CAST(a AS VARCHAR)', 'CAST(r AS VARCHAR)')} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE AS x FROM wdeg, (SELECT unnest(range(1, {_PROBES + 1})) AS r)), "
    "t1 AS (SELECT m.w, m.a, r, sum(m * x) AS x FROM m JOIN t0 ON t0.w = m.w AND t0.a = m.b GROUP BY ALL)"
    + "".join(f", t{k} AS (SELECT p.w, p.a, p.r, 2 * y - p.x AS x FROM t{k - 2} p JOIN (SELECT m.w, m.a, r, sum(m * x) AS y FROM m JOIN t{k - 1} t ON t.w = m.w AND t.a = m.b GROUP BY ALL) q ON q.w = p.w AND q.a = p.a AND q.r = p.r)" for k in range(2, _MOMENTS))
)


@query("gr17_moments", f"WITH {_T} " + " UNION ALL ".join(f"SELECT t0.w, {k} AS k, round(sum(t0.x * t{k}.x) / count(*), 6) AS moment FROM t0 JOIN t{k} ON t{k}.w = t0.w AND t{k}.a = t0.a AND t{k}.r = t0.r GROUP BY t0.w" for k in range(1, _MOMENTS)))
def _(spark, d):
    """Chebyshev moments of each window's normalised Laplacian, by three probes; the SQL multiplies each vector with the first one."""
    m = spectrum.moments(_win(spark, d), "w", _MOMENTS, _PROBES)
    return m.select("w", F.posexplode("moments").alias("k", "moment")).where("k > 0").select("w", "k", _r(F.col("moment")).alias("moment"))


@query("gr17_spectra")
def _(spark, d):
    """Shares of each window's normalised-Laplacian eigenvalues in 20 bins of [0, 2]."""
    return spectrum.spectra(_win(spark, d), "w", 20)


# Orbits

_COMMON = f"{_NEAR}, cn AS (SELECT x.a AS a, y.b AS b, count(*) AS c FROM near x JOIN near y ON x.b = y.a AND x.a <> y.b GROUP BY ALL), tri AS (SELECT near.a, near.b, coalesce(c, 0) AS c FROM near LEFT JOIN cn ON cn.a = near.a AND cn.b = near.b)"
_K4 = "q4 AS (SELECT unnest([ab.a, ab.b, ac.b, ad.b]) AS x FROM p ab JOIN p ac ON ac.a = ab.a AND ac.b > ab.b JOIN p bc ON bc.a = ab.b AND bc.b = ac.b JOIN p ad ON ad.a = ab.a AND ad.b > ac.b JOIN p bd ON bd.a = ab.b AND bd.b = ad.b JOIN p cd ON cd.a = ac.b AND cd.b = ad.b), k4 AS (SELECT x, count(*) AS k4 FROM q4 GROUP BY x)"
_ORBITS = f"""{_COMMON}, {_K4}, own AS (SELECT a AS x, count(*) AS d, sum(c) / 2 AS t FROM tri GROUP BY a), e AS (SELECT tri.a AS x, tri.b AS y, tri.c, o.d AS dy, o.t AS ty FROM tri JOIN own o ON o.x = tri.b),
  s AS (SELECT x, sum(dy - 1) AS ends, sum((dy - 1) * (dy - 2) / 2) AS leaf, sum(ty - c) AS tail, sum(c * (dy - 2)) AS plain, sum(c * (c - 1) / 2) AS chord FROM e GROUP BY x),
  s2 AS (SELECT near.a AS x, sum(ends) AS second FROM near JOIN s ON s.x = near.b GROUP BY near.a), far AS (SELECT n1.a AS x, sum(tri.c - 1) / 2 AS far FROM near n1 JOIN near n2 ON n2.a = n1.a JOIN tri ON tri.a = n1.b AND tri.b = n2.b GROUP BY n1.a),
  cyc AS (SELECT a AS x, sum(c * (c - 1) / 2) AS cycles FROM cn GROUP BY a),
  r AS (SELECT own.x AS node, d, t, ends, leaf, tail, plain, chord, second, coalesce(far, 0) AS far, coalesce(k4, 0) AS k4, coalesce(cycles, 0) AS cycles FROM own JOIN s USING (x) JOIN s2 USING (x) LEFT JOIN far USING (x) LEFT JOIN k4 USING (x) LEFT JOIN cyc USING (x)),
  r1 AS (SELECT *, far - 3 * k4 AS o12, chord - 3 * k4 AS o13 FROM r), r2 AS (SELECT *, cycles - o12 - o13 - 3 * k4 AS o8, tail - 2 * o12 - 3 * k4 AS o9, plain - 2 * o12 - 2 * o13 - 6 * k4 AS o10, t * (d - 2) - 2 * o13 - 3 * k4 AS o11 FROM r1)"""
_FIFTEEN = """d AS o0, ends - 2 * t AS o1, d * (d - 1) / 2 - t AS o2, t AS o3, second - d * (d - 1) - 2 * t - 2 * o8 - 2 * o9 - o10 - 4 * o12 - 2 * o13 - 6 * k4 AS o4, (d - 1) * ends - 2 * t - 2 * o8 - o10 - 2 * o11 - 2 * o12 - 4 * o13 - 6 * k4 AS o5,
  leaf - o9 - o10 - 2 * o12 - o13 - 3 * k4 AS o6, d * (d - 1) * (d - 2) / 6 - o11 - o13 - k4 AS o7, o8, o9, o10, o11, o12, o13, k4 AS o14"""


@query("gr18_orbits", f"WITH {_ORBITS}, o AS (SELECT node, {_FIFTEEN} FROM r2) SELECT node, " + ", ".join(f"CAST(o{k} AS BIGINT) AS o{k}" for k in range(15)) + " FROM o")
def _(spark, d):
    """The 15 orbit counts of each node; the SQL counts cycles and triangles by all pairs with a common neighbour."""
    return orbits.orbit_counts(social_edges(spark, d)).select("node", *[F.col("orbits")[k].alias(f"o{k}") for k in range(15)])


# Distances between sets of snapshots


@query(
    "gr22_cluster_mmd",
    f"""WITH {_WNEAR}, t AS (SELECT x.w, x.a, count(*) / 2 AS t FROM wnear x JOIN wnear y ON y.w = x.w AND y.a = x.a JOIN wnear z ON z.w = x.w AND z.a = x.b AND z.b = y.b GROUP BY x.w, x.a),
    c AS (SELECT d.w, d.a, CASE WHEN k < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (k * (k - 1)) END AS c FROM wdeg d LEFT JOIN t ON t.w = d.w AND t.a = d.a),
    hb AS (SELECT w, CAST(least(floor(c / 0.01), 99) AS INT) AS b, count(*) AS n FROM c GROUP BY ALL), hh AS (SELECT w, b, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY w) AS p FROM (SELECT * FROM (SELECT DISTINCT w FROM c), (SELECT unnest(range(0, 100)) AS b)) LEFT JOIN hb USING (w, b)),
    d AS (SELECT a.w AS x, b.w AS y, sum(abs(a.p - b.p)) / 2 AS d FROM hh a JOIN hh b USING (b) GROUP BY ALL), kk AS (SELECT x, y, exp(-d * d / (2 * 0.01)) AS k FROM d)
    SELECT round(sqrt(greatest((SELECT avg(k) FROM kk WHERE x < 15 AND y < 15) + (SELECT avg(k) FROM kk WHERE x >= 15 AND y >= 15) - 2 * (SELECT avg(k) FROM kk WHERE x < 15 AND y >= 15), 0)), 6) AS mmd""",
)
def _(spark, d):
    """Clustering coefficients of the nodes of each window, in 100 bins."""
    h = structure.shares(structure.by_snapshot(graph.local_clustering, _win(spark, d), "w"), "w", "clustering", 100, 0.01)
    return structure.mmd(h.where("w < 15"), h.where("w >= 15"), "tv", 0.1, root=True).select(_r(F.col("mmd")).alias("mmd"))


@query("gr22_snapshot_bundle")
def _(spark, d):
    """Degrees, clustering, spectra and mean orbit counts of two sets of snapshots in one row; spectra have no SQL."""
    e = stored(_win(spark, d).select("w", "src", "dst"))
    side = lambda h: (h.where("w < 15"), h.where("w >= 15"))
    degree = structure.shares(e.groupBy("w", "src").agg(F.count("*").alias("k")), "w", "k", 32, 1.0)
    counts = stored(structure.by_snapshot(orbits.orbit_counts, e, "w"))
    k, triangles = F.col("orbits")[0], F.col("orbits")[3]  # of these, clustering as in graph.local_clustering
    cluster = structure.shares(counts.select("w", F.when(k < 2, 0.0).otherwise(2.0 * triangles / (k * (k - 1))).alias("clustering")), "w", "clustering", 100, 0.01)
    mean = counts.groupBy("w").agg(F.array(*[F.avg(F.col("orbits")[k]) for k in range(15)]).alias("h"))
    spectra = spectrum.spectra(e, "w", 200)
    rows = [("degree", degree, "tv", 1.0), ("cluster", cluster, "tv", 0.1), ("spectra", spectra, "tv", 1.0), ("orbit", mean, "emd", 30.0)]
    out = None
    for name, h, distance, sigma in rows:
        one = structure.mmd(*side(stored(h.select("w", "h"))), distance, sigma, root=True).select(F.lit(name).alias("kind"), _r(F.col("mmd")).alias("mmd"))
        out = one if out is None else out.union(one)
    return out


_SIGMAS = [0.01, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


@query(
    "gr25_largest_mmd",
    f"""WITH {_WIN}, {_DEG}, d AS ({_EMD}), z AS (SELECT unnest({_SIGMAS}) AS s), g AS (SELECT sqrt(avg(d * d)) AS g FROM d WHERE x < 15 AND y >= 15),
    km AS (SELECT s, avg(exp(-d * d / (2 * s * s * g * g))) FILTER (x < 15 AND y < 15) + avg(exp(-d * d / (2 * s * s * g * g))) FILTER (x >= 15 AND y >= 15) - 2 * avg(exp(-d * d / (2 * s * s * g * g))) FILTER (x < 15 AND y >= 15) AS m FROM d, z, g GROUP BY s)
    SELECT round(greatest(max(m), 0), 6) AS mmd FROM km""",
)
def _(spark, d):
    """The largest over ten widths of the kernel, each scaled by the mean distance between the two sets."""
    h = structure.shares(_win(spark, d).groupBy("w", "src").agg(F.count("*").alias("k")), "w", "k", 32, 1.0)
    return structure.largest_mmd(h.where("w < 15"), h.where("w >= 15"), "emd", _SIGMAS, scaled=True).select(_r(F.col("mmd")).alias("mmd"))


@query(
    "gr25_neighbourhood_kernel",
    f"""WITH {_WNEAR}, n0 AS (SELECT w, a, CAST(k AS VARCHAR) AS h FROM wdeg), n1 AS (SELECT n.w, n.a, any_value(o.h) || '(' || string_agg(x.h, ',' ORDER BY x.h) || ')' AS h FROM wnear n JOIN n0 x ON x.w = n.w AND x.a = n.b JOIN n0 o ON o.w = n.w AND o.a = n.a GROUP BY n.w, n.a),
    n2 AS (SELECT n.w, n.a, any_value(o.h) || '(' || string_agg(x.h, ',' ORDER BY x.h) || ')' AS h FROM wnear n JOIN n1 x ON x.w = n.w AND x.a = n.b JOIN n1 o ON o.w = n.w AND o.a = n.a GROUP BY n.w, n.a),
    h AS (SELECT w, a, 0 AS r, h FROM n0 UNION ALL SELECT w, a, 1, h FROM n1 UNION ALL SELECT w, a, 2, h FROM n2), two AS (SELECT w, a, a AS b, 0 AS hops FROM wdeg UNION ALL SELECT w, a, b, 1 FROM wp),
    c AS (SELECT two.w, x.r, hops, least(x.h, y.h) AS lo, greatest(x.h, y.h) AS hi, count(*) AS n FROM two JOIN h x ON x.w = two.w AND x.a = two.a JOIN h y ON y.w = two.w AND y.a = two.b AND y.r = x.r GROUP BY ALL),
    l AS (SELECT w, r, hops, sqrt(sum(n * n)) AS l FROM c GROUP BY ALL), q AS (SELECT w, sqrt(count(*)) AS q FROM l GROUP BY w), f AS (SELECT c.w, c.r, c.hops, lo, hi, n / l / q AS v FROM c JOIN l ON l.w = c.w AND l.r = c.r AND l.hops = c.hops JOIN q ON q.w = c.w),
    g AS (SELECT coalesce(sum(v) FILTER (w < 15), 0) / (SELECT count(DISTINCT w) FROM f WHERE w < 15) - coalesce(sum(v) FILTER (w >= 15), 0) / (SELECT count(DISTINCT w) FROM f WHERE w >= 15) AS m FROM f GROUP BY r, hops, lo, hi)
    SELECT round(sum(m * m), 9) AS mmd FROM g""",
)
def _(spark, d):
    """Pairs of neighbourhoods up to radius 2, one hop apart; the SQL spells neighbourhoods out."""
    f = stored(kernels.neighbourhood_pairs(_win(spark, d), "w", radius=2, distance=1))
    return kernels.kernel_mmd(f.where("w < 15"), f.where("w >= 15"), "w").select(_r(F.col("mmd"), 9).alias("mmd"))


# Projections

_ND, _GD = 8, 4


def _normal(seed, key, at):
    """SQL of one of the four normal numbers of a block; ``at``: SQL of the number's place."""
    digest = f"md5('{seed}:' || {key} || ':' || CAST(({at}) // 4 AS VARCHAR))"
    part = lambda i: f"((CAST('0x' || substring({digest}, {8 * i + 1}, 8) AS UBIGINT) + 0.5) / 4294967296.0)"
    one = lambda f, i: f"{f}(2 * pi() * {part(i + 1)}) * sqrt(-2 * ln({part(i)}))"
    return f"CASE ({at}) % 4 WHEN 0 THEN {one('cos', 0)} WHEN 1 THEN {one('sin', 0)} WHEN 2 THEN {one('cos', 2)} ELSE {one('sin', 2)} END"


def _projected(half, features):
    """CTEs of one half's matrix (i, c, x)."""
    n = half
    lone = f"SELECT e.*, 0 AS role, src AS node, dst AS other FROM e{n} e UNION ALL SELECT e.*, 1, dst, src FROM e{n} e"
    width = 67 if features else 3
    event = "[(v - (SELECT min(v) FROM e{0})) / ((SELECT max(v) - min(v) FROM e{0}) + 1e-6), (t - (SELECT min(t) FROM e{0})) / ((SELECT max(t) - min(t) FROM e{0}) + 1e-6), role]".format(n)
    x = f"list_concat(coalesce(f.f, [0.0 FOR i IN range(64)]), {event})" if features else event
    join = f"LEFT JOIN feat f ON f.node = b{n}.other" if features else ""
    own = f" UNION ALL SELECT k.node, (max(k) * {width})::BIGINT, coalesce(any_value(f.f), [0.0 FOR i IN range(64)]) FROM k{n} k LEFT JOIN feat f ON f.node = k.node GROUP BY k.node" if features else ""
    return f""", e{n} AS (SELECT edge_id, src, dst, CAST(t AS DOUBLE) AS t, CAST(value AS DOUBLE) AS v FROM social JOIN events ON event_id = edge_id WHERE {'edge_id % 2 = 0' if n == 'a' else 'edge_id % 2 = 1'}),
  b{n} AS ({lone}), k{n} AS (SELECT b{n}.node, row_number() OVER (PARTITION BY b{n}.node ORDER BY t, edge_id, other) AS k, {x} AS x FROM b{n} {join}),
  r{n} AS (SELECT node, (k - 1) * {width} AS pos, x FROM k{n}{own}), i{n} AS (SELECT node, pos + i - 1 AS pos, x[i] AS v FROM r{n}, (SELECT unnest(range(1, {width + 1})) AS i) WHERE i <= len(x)),
  z{n} AS (SELECT node, c, sum(v * ({_normal(7, 'CAST(pos AS VARCHAR)', 'c')})) / sqrt(100000) AS z FROM i{n}, (SELECT unnest(range(0, {_ND})) AS c) WHERE pos < 100000 GROUP BY node, c),
  g{n} AS (SELECT z.c AS i, g.c AS c, sum(z * ({_normal(8, 'CAST(node AS VARCHAR)', 'g.c')})) / sqrt((SELECT count(DISTINCT node) FROM b{n})) AS x FROM z{n} z, (SELECT unnest(range(0, {_GD})) AS c) g GROUP BY z.c, g.c)"""


_SIMILAR = f" SELECT round(sum(s) / {_GD}, 6) AS similarity FROM (SELECT a.c, sum(a.x * b.x) / ((sqrt(sum(a.x * a.x)) + 1e-8) * (sqrt(sum(b.x * b.x)) + 1e-8)) AS s FROM ga a JOIN gb b ON b.i = a.i AND b.c = a.c GROUP BY a.c)"
_FEATURES = ", span AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings), feat AS (SELECT vec_id AS node, [(CAST(v AS DOUBLE) - lo) / (hi - lo + 1e-6) FOR v IN embedding] AS f FROM embeddings, span)"


def _compared(spark, d, features):
    e = social_edges(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("edge_id"), "value"), "edge_id")
    made = [projection.projection(e.where(F.col("edge_id") % 2 == k), ["value"], _ND, _GD, 7, features=features) for k in (0, 1)]
    return projection.similarity(*made, _GD).select(_r(F.col("similarity")).alias("similarity"))


@query("gr35_projected_graphs", f"WITH {_SOCIAL}{_projected('a', False)}{_projected('b', False)}{_SIMILAR}")
def _(spark, d):
    """Edges of even and of odd ids as two graphs: how alike their projections are."""
    return _compared(spark, d, None)


@query("gr36_projected_graphs_with_features", f"WITH {_SOCIAL}{_FEATURES}{_projected('a', True)}{_projected('b', True)}{_SIMILAR}")
def _(spark, d):
    """The same with the nodes' vectors beside their events."""
    return _compared(spark, d, table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("x")))
