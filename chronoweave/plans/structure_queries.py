"""Structure of snapshots, neighbours over several hops, negatives, bundles and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import vectors as vec
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, paths, reports, retrieval, sampling, structure
from chronoweave.operators.components import connected_components
from chronoweave.plans.queries import _BOTH, _PAIRS, _REPORT, _SOCIAL, _TRADE, _WIN, query
from chronoweave.plans.sample_queries import _LEVELS, _levels, _u
from chronoweave.session import stored, table
from chronoweave.sources.tables import DAY, report_rows, social_edges, trade_edges


def _r(c, n=6):
    return F.round(c, n)


def _win(spark, d):
    return graph.windowed(social_edges(spark, d), DAY)


# Graph statistics


@query("gr1_mean_degree", f"WITH {_TRADE}, k AS (SELECT dst, count(*) AS k FROM trade GROUP BY dst), n AS (SELECT max(v) + 1 AS n FROM (SELECT max(src) AS v FROM trade UNION ALL SELECT max(dst) FROM trade)) SELECT max(k) AS most, min(k) AS least, round(sum(k) / (SELECT n FROM n), 6) AS mean FROM k")
def _(spark, d):
    """Degrees by in-edges, their mean over all ids from 0."""
    t = trade_edges(spark, d)
    ids = t.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n"))
    k = t.groupBy("dst").agg(F.count("*").alias("k")).agg(F.max("k").alias("most"), F.min("k").alias("least"), F.sum("k").alias("s"))
    return k.join(F.broadcast(ids)).select("most", "least", _r(F.col("s") / F.col("n")).alias("mean"))


@query(
    "gr8_largest_component",
    f"""WITH RECURSIVE {_TRADE}, e AS (SELECT DISTINCT src AS a, dst AS b FROM trade WHERE src % 50 = dst % 50), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS c FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.c = s.a), k AS (SELECT node, min(c) AS c FROM r GROUP BY node), n AS (SELECT c, count(*) AS n FROM k GROUP BY c)
    SELECT count(*) AS components, max(n) AS largest FROM n""",
)
def _(spark, d):
    """Components of the trades whose ends agree modulo 50, a graph of several components."""
    c = connected_components(trade_edges(spark, d).where("src % 50 = dst % 50")).groupBy("component").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@query(
    "gr10_hub_scores",
    f"""WITH {_WIN}, a AS (SELECT src FROM win WHERE w < 15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 20), b AS (SELECT src FROM win WHERE w >= 15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 20), h AS (SELECT count(*) AS h FROM a JOIN b USING (src))
    SELECT h / (SELECT count(*) FROM b) AS precision, h / (SELECT count(*) FROM a) AS recall, 2 * h / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) AS f1 FROM h""",
)
def _(spark, d):
    e = _win(spark, d)
    return structure.hub_scores(e.where("w < 15"), e.where("w >= 15"), 20)


_FIT = "k AS (SELECT w, k, count(*) AS c FROM (SELECT w, src, count(*) AS k FROM win GROUP BY w, src) WHERE k >= 2 GROUP BY w, k), a AS (SELECT w, 1 + sum(c) / sum(c * ln(k / 1.5)) AS alpha, sum(c) AS n FROM k GROUP BY w), f AS (SELECT k.w, alpha, n, k.k, sum(c) OVER (PARTITION BY k.w ORDER BY k.k) / n AS emp, 1 - pow((k.k + 0.5) / 1.5, 1 - alpha) AS fit FROM k JOIN a ON a.w = k.w), s AS (SELECT w, alpha, max(abs(emp - fit)) AS D FROM f GROUP BY w, alpha)"


def _fits(spark, d):
    """(w, alpha, D) of each window's degrees from 2: closed-form exponent and the largest gap between the distributions."""
    k = _win(spark, d).groupBy("w", "src").agg(F.count("*").alias("k")).where("k >= 2").groupBy("w", "k").agg(F.count("*").alias("c"))
    a = k.groupBy("w").agg((1 + F.sum("c") / F.sum(F.col("c") * F.log(F.col("k") / 1.5))).alias("alpha"), F.sum("c").alias("n"))
    upto = Window.partitionBy("w").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("c").over(upto) / F.col("n") - (1 - F.pow((F.col("k") + 0.5) / 1.5, 1 - F.col("alpha"))))
    return k.join(a, "w").select("w", "alpha", gap.alias("gap")).groupBy("w", "alpha").agg(F.max("gap").alias("D"))


@query("gr12_power_law_distance", f"WITH {_WIN}, {_FIT} SELECT w, round(alpha, 6) AS alpha, round(D, 6) AS D FROM s")
def _(spark, d):
    return _fits(spark, d).select("w", _r(F.col("alpha")).alias("alpha"), _r(F.col("D")).alias("D"))


@query("gr13_power_law_ratio", f"WITH {_WIN}, {_FIT} SELECT round(avg(CASE WHEN D < 0.2 AND alpha BETWEEN 2 AND 3 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM s")
def _(spark, d):
    return _fits(spark, d).agg(_r(F.avg(((F.col("D") < 0.2) & F.col("alpha").between(2, 3)).cast("double"))).alias("ratio"))


_DEG = "k AS (SELECT w, src, count(*) AS k FROM win GROUP BY w, src), hb AS (SELECT w, CAST(least(floor(k / 1.0), 31) AS INT) AS b, count(*) AS n FROM k GROUP BY ALL), hh AS (SELECT w, b, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY w) AS p FROM (SELECT * FROM (SELECT DISTINCT w FROM k), (SELECT unnest(range(0, 32)) AS b)) LEFT JOIN hb USING (w, b))"


def _degree_shares(spark, d):
    k = _win(spark, d).groupBy("w", "src").agg(F.count("*").alias("k"))
    return structure.shares(k, "w", "k", 32, 1.0)


@query("gr19_joint_histograms", f"WITH {_WIN}, {_DEG} SELECT w, string_agg(CAST(CAST(round(p * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY b) AS shares FROM hh GROUP BY w")
def _(spark, d):
    return _degree_shares(spark, d).select("w", F.array_join(F.transform("h", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("shares"))


_MMD = f"WITH {_WIN}, {_DEG}, d AS ({{dist}}), kk AS (SELECT x, y, exp(-d * d / (2 * {{s2}})) AS k FROM d) SELECT round({{f}}((SELECT avg(k) FROM kk WHERE x < 15 AND y < 15) + (SELECT avg(k) FROM kk WHERE x >= 15 AND y >= 15) - 2 * (SELECT avg(k) FROM kk WHERE x < 15 AND y >= 15)), 9) AS mmd"
_TV = "SELECT a.w AS x, b.w AS y, sum(abs(a.p - b.p)) / 2 AS d FROM hh a JOIN hh b USING (b) GROUP BY ALL"
_EMD = "SELECT x, y, sum(abs(g)) AS d FROM (SELECT a.w AS x, b.w AS y, sum(a.p - b.p) OVER (PARTITION BY a.w, b.w ORDER BY a.b) AS g FROM hh a JOIN hh b USING (b)) GROUP BY ALL"
_L2 = "SELECT a.w AS x, b.w AS y, sqrt(sum((a.p - b.p) * (a.p - b.p))) AS d FROM hh a JOIN hh b USING (b) GROUP BY ALL"


def _halves(spark, d):
    h = _degree_shares(spark, d)
    return h.where("w < 15"), h.where("w >= 15")


@query("gr21_gr22_degree_mmd", _MMD.format(dist=_TV, s2="1.0", f="sqrt"))
def _(spark, d):
    a, b = _halves(spark, d)
    return structure.mmd(a, b, "tv", 1.0, root=True).select(_r(F.col("mmd"), 9).alias("mmd"))


@query("gr25_emd_mmd", _MMD.format(dist=_EMD, s2="1.0", f=""))
def _(spark, d):
    a, b = _halves(spark, d)
    return structure.mmd(a, b, "emd", 1.0).select(_r(F.col("mmd"), 9).alias("mmd"))


@query("gr26_degree_array_mmd", _MMD.format(dist=_L2, s2="0.01", f=""))
def _(spark, d):
    a, b = _halves(spark, d)
    return structure.mmd(a, b, "l2", 0.1).select(_r(F.col("mmd"), 9).alias("mmd"))


_RBF = "(SELECT sum(a.n * b.n * exp(-0.01 * (a.k - b.k) * (a.k - b.k))) / sum(a.n * b.n) FROM {0} a, {1} b)"


@query("gr23_rbf_mmd", f"WITH {_WIN}, x AS (SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM win WHERE w < 15 GROUP BY src) GROUP BY k), y AS (SELECT k, count(*) AS n FROM (SELECT count(*) AS k FROM win WHERE w >= 15 GROUP BY src) GROUP BY k) SELECT round({_RBF.format('x', 'x')} + {_RBF.format('y', 'y')} - 2 * {_RBF.format('x', 'y')}, 6) AS mmd")
def _(spark, d):
    k = lambda e: e.groupBy("src").agg(F.count("*").alias("k"))
    e = _win(spark, d)
    return structure.rbf_mmd(k(e.where("w < 15")), k(e.where("w >= 15")), "k", 0.01).select(_r(F.col("mmd")).alias("mmd"))


@query(
    "gr27_hops",
    f"""WITH RECURSIVE {_PAIRS}, s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), q AS (SELECT v FROM (SELECT a AS v FROM p UNION SELECT b FROM p) WHERE v % 20 = 0),
    r AS (SELECT v AS source, v AS node, 0 AS hops FROM q UNION SELECT r.source, s.b, r.hops + 1 FROM r JOIN s ON s.a = r.node WHERE r.hops < 3), m AS (SELECT source, node, min(hops) AS hops FROM r GROUP BY ALL)
    SELECT source, count(*) AS reached, round(avg(hops) FILTER (hops > 0), 6) AS mean_hops, round((count(*) - 1) / sum(hops), 6) AS closeness FROM m GROUP BY source""",
)
def _(spark, d):
    """Path lengths and closeness of a stated set of sources, ids divisible by 20."""
    e = social_edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().where("node % 20 = 0")
    m = paths.reach(e, nodes)
    far, n, steps = F.col("hops") > 0, F.sum("nodes"), F.sum(F.col("hops") * F.col("nodes"))
    return m.groupBy("source").agg(n.alias("reached"), _r(steps / F.sum(F.when(far, F.col("nodes")))).alias("mean_hops"), _r((n - 1) / steps).alias("closeness"))


_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda z: CAST(z AS DOUBLE) * z))) * sqrt(list_sum(list_transform(b.embedding, lambda z: CAST(z AS DOUBLE) * z))))"
_ALL_CHAMBERS = f"""{_PAIRS}, v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT a FROM p UNION SELECT b FROM p)), sm AS (SELECT a.vec_id AS node, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE {_COS} > 0.25), c AS (SELECT node, count(*) AS "similar", count(p.a) AS linked FROM sm LEFT JOIN p ON p.a = least(node, other) AND p.b = greatest(node, other) GROUP BY node HAVING count(*) >= 3)"""
_CHAMBERS = _ALL_CHAMBERS.replace("a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id AND a.vec_id % 20 = 0")


def _chambers(spark, d, edges, every=20):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % every == 0).alias("asked"))
    return structure.echo_chambers(edges, v, vec.cosine, above=0.25)


@query("gr30_echo_chambers", f"""WITH {_CHAMBERS} SELECT node, "similar", linked, linked / "similar" > 0.01 AS chamber FROM c""")
def _(spark, d):
    """For nodes divisible by 20, against all; vectors of the test tables are random, so the bound is 0.25 and not 0.5."""
    return _chambers(spark, d, social_edges(spark, d))


@query("gr31_echo_chamber_difference", f"""WITH {_ALL_CHAMBERS} SELECT abs(count(*) FILTER (linked / "similar" > 0.01) - 2) AS chambers_gap, round(abs(coalesce(avg(linked / "similar"), 0) - 0.5), 6) AS ratio_gap FROM c""")
def _(spark, d):
    """All nodes' chambers, against a stated reading of 2 chambers and a mean ratio of one half."""
    c = _chambers(spark, d, social_edges(spark, d), every=1)
    return c.agg(F.abs(F.count_if("chamber") - 2).alias("chambers_gap"), _r(F.abs(F.coalesce(F.avg(F.col("linked") / F.col("similar")), F.lit(0.0)) - 0.5)).alias("ratio_gap"))


@query(
    "gr33_structure_gaps",
    f"""WITH {_WIN}, a AS (SELECT max(k) AS most, sum(k * (k - 1) / 2) AS wedges, sum(k * (k - 1) * (k - 2) / 6) AS claws FROM (SELECT count(*) AS k FROM win WHERE w < 15 GROUP BY dst)),
    b AS (SELECT max(k) AS most, sum(k * (k - 1) / 2) AS wedges, sum(k * (k - 1) * (k - 2) / 6) AS claws FROM (SELECT count(*) AS k FROM win WHERE w >= 15 GROUP BY dst))
    SELECT abs(a.most - b.most) AS most_gap, abs(a.wedges - b.wedges) AS wedges_gap, abs(a.claws - b.claws) AS claws_gap FROM a, b""",
)
def _(spark, d):
    e = _win(spark, d)
    a, b = graph.degree_motifs(e.where("w < 15")), graph.degree_motifs(e.where("w >= 15"))
    both = a.select("max_degree", "wedges", "claws").toDF("m1", "w1", "c1").join(F.broadcast(b.select("max_degree", "wedges", "claws").toDF("m2", "w2", "c2")))
    return both.select(F.abs(F.col("m1") - F.col("m2")).alias("most_gap"), F.abs(F.col("w1") - F.col("w2")).alias("wedges_gap"), F.abs(F.col("c1") - F.col("c2")).alias("claws_gap"))


_SETS = f"{_WIN}, g AS (SELECT DISTINCT src, dst FROM win WHERE w >= 22), p AS (SELECT DISTINCT src, dst FROM win WHERE w < 22), t AS (SELECT coalesce(g.src, p.src) AS src, count(g.src) AS truth, count(p.src) AS guess, count(*) FILTER (g.src IS NOT NULL AND p.src IS NOT NULL) AS hit FROM g FULL JOIN p ON g.src = p.src AND g.dst = p.dst GROUP BY 1)"


def _sets(spark, d):
    e = _win(spark, d)
    g = e.where("w >= 22").select("src", "dst", F.lit(1).alias("g")).distinct()
    p = e.where("w < 22").select("src", "dst", F.lit(1).alias("p")).distinct()
    return g.join(p, ["src", "dst"], "full_outer").groupBy("src").agg(F.count("g").alias("truth"), F.count("p").alias("guess"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hit"))


def _ratio(a, b):
    return F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))


@query("a36_set_scores", f"WITH {_SETS} SELECT src, coalesce(hit / nullif(guess, 0), 0) AS precision, coalesce(hit / nullif(truth, 0), 0) AS recall, coalesce(2 * hit / nullif(truth + guess, 0), 0) AS f1 FROM t")
def _(spark, d):
    return _sets(spark, d).select("src", _ratio("hit", F.col("guess")).alias("precision"), _ratio("hit", F.col("truth")).alias("recall"), F.coalesce(2 * F.col("hit") / F.nullif(F.col("truth") + F.col("guess"), F.lit(0)), F.lit(0.0)).alias("f1"))


@query("gr34_node_bundle", f"WITH {_SETS} SELECT count(*) AS nodes, round(avg(coalesce(hit / nullif(guess, 0), 0)), 6) AS precision, round(avg(coalesce(2 * hit / nullif(truth + guess, 0), 0)), 6) AS f1, round(sum(hit) / sum(guess), 6) AS micro FROM t")
def _(spark, d):
    f1 = F.coalesce(2 * F.col("hit") / F.nullif(F.col("truth") + F.col("guess"), F.lit(0)), F.lit(0.0))
    return _sets(spark, d).agg(F.count("*").alias("nodes"), _r(F.avg(_ratio("hit", F.col("guess")))).alias("precision"), _r(F.avg(f1)).alias("f1"), _r(F.sum("hit") / F.sum("guess")).alias("micro"))


@query("a37_label_scores", f"WITH {_WIN}, m AS (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r FROM win WHERE w < 22 GROUP BY src, label), j AS (SELECT edge_id, w.label = m.label AS hit FROM win w JOIN m ON m.src = w.src AND m.r = 1 WHERE w.w >= 22) SELECT count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS accuracy FROM j")
def _(spark, d):
    e = _win(spark, d)
    m = e.where("w < 22").groupBy("src", "label").agg(F.count("*").alias("n")).groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("guess"))
    return e.where("w >= 22").join(m, "src").agg(F.count("*").alias("n"), _r(F.avg((F.col("label") == F.col("guess")).cast("int"))).alias("accuracy"))


# Neighbours and negatives


@query("gr38_timestamp_edges", f"WITH {_WIN} SELECT w, src, dst, count(*) AS n FROM win GROUP BY ALL")
def _(spark, d):
    m = _win(spark, d).groupBy("w", "src", "dst").agg(F.count("*").alias("n")).groupBy("w", "src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "n"))).alias("row"))
    return m.select("w", "src", F.explode("row").alias("dst", "n"))


@query("gr39_first_hops", f"WITH {_BOTH}, q AS (SELECT edge_id AS qid, src AS node, t FROM social) SELECT qid, q.node, count(b.t) AS n, max(b.t) AS latest FROM q LEFT JOIN both_ways b ON b.node = q.node AND b.t < q.t GROUP BY qid, q.node")
def _(spark, d):
    """How many neighbours each edge's source had before it, all of them, and when the last: by counts over each node's moments, not by pairs."""
    e = social_edges(spark, d)
    moments = graph.both_ways(e).groupBy("node", "t").agg(F.count("*").alias("n"))
    w = Window.partitionBy("node").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before = moments.select("node", "t", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.max("t").over(w).alias("latest"))
    return e.select(F.col("edge_id").alias("qid"), F.col("src").alias("node"), "t").join(before, ["node", "t"]).select("qid", "node", "n", "latest")


@query(
    "gr40_two_hops",
    f"""WITH {_BOTH}, q AS (SELECT edge_id AS qid, src AS node, t FROM social WHERE t >= (SELECT max(t) FROM social) - 86400),
    h1 AS (SELECT * FROM (SELECT q.qid, b.nbr, b.t, row_number() OVER (PARTITION BY q.qid ORDER BY b.t DESC, b.edge_id DESC, b.nbr DESC) AS r FROM q JOIN both_ways b ON b.node = q.node AND b.t < q.t) WHERE r <= 3),
    h2 AS (SELECT * FROM (SELECT h1.qid, h1.r AS via, b.nbr, b.t, row_number() OVER (PARTITION BY h1.qid, h1.r ORDER BY b.t DESC, b.edge_id DESC, b.nbr DESC) AS r FROM h1 JOIN both_ways b ON b.node = h1.nbr AND b.t < h1.t) WHERE r <= 3)
    SELECT qid, 0 AS via, nbr, t, r AS rank FROM h1 UNION ALL SELECT qid, via, nbr, t, r FROM h2""",
)
def _(spark, d):
    """The three latest neighbours of the last day's sources, and of these, each before its own moment."""
    e = social_edges(spark, d)
    last = e.agg((F.max("t") - DAY).alias("_t0"))
    q = e.join(F.broadcast(last)).where(F.col("t") >= F.col("_t0")).select(F.col("edge_id").alias("qid"), F.col("src").alias("node"), "t")
    h1 = graph.as_of_neighbors(e, q, 3).select("qid", "nbr", F.col("nbr_t").alias("t"), "rank")
    q2 = h1.select((F.col("qid") * 4 + F.col("rank")).alias("qid"), F.col("nbr").alias("node"), "t")
    h2 = graph.as_of_neighbors(e, q2, 3).select(F.floor(F.col("qid") / 4).cast("long").alias("qid"), F.pmod("qid", F.lit(4)).cast("long").alias("via"), "nbr", F.col("nbr_t").alias("t"), "rank")
    return h1.select("qid", F.lit(0).cast("long").alias("via"), "nbr", "t", F.col("rank").cast("long").alias("rank")).unionByName(h2.withColumn("rank", F.col("rank").cast("long")))


@query(
    "gr41_edgebank_window",
    f"WITH {_WIN}, q AS (SELECT quantile_cont(t, 0.85) AS q FROM win WHERE w < 22), m AS (SELECT DISTINCT src, dst FROM win, q WHERE w < 22 AND t >= q) SELECT edge_id, CASE WHEN m.src IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM (SELECT * FROM win WHERE w >= 22) v LEFT JOIN m ON m.src = v.src AND m.dst = v.dst",
)
def _(spark, d):
    """Memory of the last 15 % of the past."""
    e = _win(spark, d)
    past = e.where("w < 22")
    since = dist.quantiles(past, "t", {"_since": 0.85})
    recent = past.join(F.broadcast(since)).where(F.col("t") >= F.col("_since")).select("src", "dst", "t")
    return graph.edgebank(recent, e.where("w >= 22").select("edge_id", "src", "dst")).select("edge_id", "score")


@query(
    "gr44_historical_negatives",
    f"""WITH {_WIN}, h AS (SELECT DISTINCT src, dst FROM win WHERE w < 22 EXCEPT SELECT src, dst FROM win WHERE w >= 22), n AS (SELECT count(*) AS n FROM win WHERE w >= 22)
    SELECT src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY {_u(10, 'src', 'dst')}, src, dst) AS r FROM h) JOIN n ON r <= n""",
)
def _(spark, d):
    """As many past edges that are absent from the future as the future has edges, picked by hash."""
    e = _win(spark, d)
    future = e.where("w >= 22").select("src", "dst")
    h = e.where("w < 22").select("src", "dst").distinct().join(future.distinct(), ["src", "dst"], "left_anti")
    rows = dist.row_numbers(h.withColumn("u", sampling.uniform(10, "src", "dst")), "u", "src", "dst")  # the number grows with the data: no one task takes all
    return rows.join(F.broadcast(future.agg(F.count("*").alias("n")))).where("number < n").select("src", "dst")


@query(
    "gr44_inductive_negatives",
    f"WITH {_WIN}, h AS (SELECT DISTINCT src, dst FROM win WHERE w BETWEEN 22 AND 25 EXCEPT SELECT src, dst FROM win WHERE w >= 26 EXCEPT SELECT src, dst FROM win WHERE w < 22) SELECT src, dst, {_u(11, 'src', 'dst')} < 0.5 AS picked FROM h",
)
def _(spark, d):
    """Edges seen neither in training nor in the batch, but between them."""
    e = _win(spark, d)
    other = e.where("w >= 26 or w < 22").select("src", "dst").distinct()
    h = e.where("w between 22 and 25").select("src", "dst").distinct().join(other, ["src", "dst"], "left_anti")
    return h.select("src", "dst", (sampling.uniform(11, "src", "dst") < 0.5).alias("picked"))


@query(
    "gr44_random_negatives",
    f"WITH {_WIN}, n AS (SELECT min(dst) AS lo, max(dst) - min(dst) + 1 AS n FROM win) SELECT edge_id, src, lo + CAST(floor({_u(12, 'edge_id')} * n) AS BIGINT) AS negative FROM win, n WHERE w >= 22",
)
def _(spark, d):
    e = _win(spark, d)
    span = e.agg(F.min("dst").alias("lo"), (F.max("dst") - F.min("dst") + 1).alias("n"))
    return e.where("w >= 22").join(F.broadcast(span)).select("edge_id", "src", (F.col("lo") + F.floor(sampling.uniform(12, "edge_id") * F.col("n"))).cast("long").alias("negative"))


@query("j12_s7_possible_edges", f"WITH {_SOCIAL} SELECT src, (SELECT count(DISTINCT dst) FROM social) AS possible, (SELECT count(DISTINCT dst) FROM social) - count(DISTINCT dst) AS unseen FROM social GROUP BY src")
def _(spark, d):
    """How many of all possible edges a source has not made: counted, without making them."""
    e = social_edges(spark, d)
    n = e.agg(F.countDistinct("dst").alias("possible"))
    return e.groupBy("src").agg(F.countDistinct("dst").alias("k")).join(F.broadcast(n)).select("src", "possible", (F.col("possible") - F.col("k")).alias("unseen"))


@query(
    "gr47_evaluation_sets",
    f"WITH {_WIN}, s AS (SELECT src AS v FROM win WHERE w < 22 AND src % 10 <> 3 UNION SELECT dst FROM win WHERE w < 22 AND dst % 10 <> 3) SELECT edge_id, w >= 26 AS test, NOT (src IN (SELECT v FROM s) AND dst IN (SELECT v FROM s)) AS inductive FROM win WHERE w >= 22",
)
def _(spark, d):
    """Edges after training by phase, and whether an end was never seen; ids ending in 3 are withheld from training."""
    e = _win(spark, d)
    past = e.where("w < 22")
    seen = past.select(F.col("src").alias("v")).union(past.select("dst")).where("v % 10 <> 3").distinct()
    later = e.where("w >= 22").join(seen.select(F.col("v").alias("src"), F.lit(1).alias("_s")), "src", "left").join(seen.select(F.col("v").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return later.select("edge_id", (F.col("w") >= 26).alias("test"), (F.col("_s").isNull() | F.col("_d").isNull()).alias("inductive"))


@query("gr49_generated_edges", f"WITH {_SOCIAL} SELECT src, dst, t FROM social WHERE edge_id % 7 <> 0")
def _(spark, d):
    """Rows as a generator writes them, ids as text of floats and some unreadable, read back as edges."""
    made = social_edges(spark, d).select(F.concat(F.col("src").cast("string"), F.lit(".0")).alias("src_idx"), F.col("dst").cast("double").cast("string").alias("dst_idx"), F.when(F.col("edge_id") % 7 == 0, "soon").otherwise(F.col("t").cast("string")).alias("t"))
    read = made.select(F.col("src_idx").try_cast("double").cast("long").alias("src"), F.col("dst_idx").try_cast("double").cast("long").alias("dst"), F.col("t").try_cast("long").alias("t"))
    return read.dropna()


@query(
    "gr50_daily_split",
    f"WITH {_WIN}, n AS (SELECT w, count(*) AS edges, greatest(1, count(*) // 2) AS sources FROM win GROUP BY w) SELECT w, i AS place, edges // sources + CASE WHEN i < edges % sources THEN 1 ELSE 0 END AS degree FROM (SELECT *, unnest(range(0, sources)) AS i FROM n)",
)
def _(spark, d):
    """A day's edges dealt evenly over half as many sources."""
    n = _win(spark, d).groupBy("w").agg(F.count("*").alias("edges")).withColumn("sources", F.greatest(F.lit(1).cast("long"), F.floor(F.col("edges") / 2)))
    places = n.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sources") - 1)))
    return places.select("w", "place", structure.split_evenly(F.col("edges"), F.col("place"), F.col("sources")).cast("long").alias("degree"))


@query(
    "a49_shared_history",
    f"WITH {_SOCIAL}, bw AS (SELECT src AS node, dst AS nbr FROM social UNION ALL SELECT dst, src FROM social), c AS (SELECT node, nbr, count(*) AS n FROM bw GROUP BY ALL), q AS (SELECT DISTINCT src, dst FROM social WHERE t >= (SELECT max(t) FROM social) - 86400) SELECT q.src, q.dst, count(*) AS shared, CAST(sum(x.n) AS BIGINT) AS in_src, CAST(sum(y.n) AS BIGINT) AS in_dst FROM q JOIN c x ON x.node = q.src JOIN c y ON y.node = q.dst AND y.nbr = x.nbr GROUP BY q.src, q.dst",
)
def _(spark, d):
    """For the last day's pairs, the ids in both histories and how often each has them."""
    e = social_edges(spark, d)
    c = graph.pair_metrics(e)
    q = e.join(F.broadcast(e.agg((F.max("t") - DAY).alias("_t0")))).where(F.col("t") >= F.col("_t0")).select("src", "dst").distinct()
    x = q.join(c.select(F.col("node").alias("src"), "nbr", F.col("cnt").alias("n")), "src")
    both = x.join(c.select(F.col("node").alias("dst"), "nbr", F.col("cnt").alias("m")), ["dst", "nbr"])
    return both.groupBy("src", "dst").agg(F.count("*").alias("shared"), F.sum("n").alias("in_src"), F.sum("m").alias("in_dst"))


@query(
    "a50_walk_landing",
    f"WITH {_PAIRS}, s AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p), k AS (SELECT u, count(*) AS k FROM s GROUP BY u) SELECT x.u AS source, y.v AS node, round(sum(1.0::DOUBLE / kx.k / ky.k), 9) AS landing FROM s x JOIN k kx ON kx.u = x.u JOIN s y ON y.u = x.v JOIN k ky ON ky.u = x.v WHERE x.u % 20 = 0 GROUP BY x.u, y.v",
)
def _(spark, d):
    """Where a walk of two steps from each source divisible by 20 lands, and how likely."""
    p = graph.simple_pairs(social_edges(spark, d))
    s = p.select(F.col("a").alias("u"), F.col("b").alias("v")).union(p.select("b", "a"))
    s = stored(s)
    p = s.groupBy("u").agg((1.0 / F.count("*")).alias("p"))
    first = s.where("u % 20 = 0").join(p, "u").select(F.col("u").alias("src"), F.col("v").alias("via"), F.col("p").alias("p1"))
    first = first.join(p.select(F.col("u").alias("via"), F.col("p").alias("p2")), "via").select("src", "via", (F.col("p1") * F.col("p2")).alias("p"))
    two = graph.steps_of_two(first, s.select(F.col("u").alias("via"), F.col("v").alias("dst")))
    return two.select(F.col("src").alias("source"), F.col("dst").alias("node"), _r(F.col("p"), 9).alias("landing"))


@query("j10_edge_windows", f"WITH {_SOCIAL}, b AS (SELECT min(t) AS t0, max(t) AS t1 FROM social), v AS (SELECT i, t0 + i * 259200 AS lo, t0 + i * 259200 + 604800 AS hi FROM b, (SELECT unnest(range(0, 20)) AS i)) SELECT i AS snapshot, count(*) AS edges, count(DISTINCT src) AS sources FROM social JOIN v ON t >= lo AND t < hi GROUP BY i")
def _(spark, d):
    """Snapshots of seven days that begin every three; each edge goes to those it stands in, by arithmetic."""
    e = social_edges(spark, d)
    b = e.agg(F.min("t").alias("t0"))
    at = F.col("t") - F.col("t0")
    first = F.greatest(F.floor((at - 7 * DAY) / (3 * DAY)) + 1, F.lit(0))
    x = e.join(F.broadcast(b)).select("src", F.explode(F.sequence(first, F.floor(at / (3 * DAY)))).alias("snapshot"))
    return x.groupBy("snapshot").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


# Retrieval reports

_RANKED = "past AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS r FROM win WHERE w < 22 GROUP BY src, dst), g AS (SELECT DISTINCT src, dst FROM win WHERE w >= 22)"
_PER = f"{_RANKED}, m AS (SELECT g.src, count(*) AS n, " + ", ".join(f"count(r) FILTER (r <= {k}) AS h{k}" for k in (10, 50, 100)) + " FROM g LEFT JOIN past p ON p.src = g.src AND p.dst = g.dst GROUP BY g.src)"


def _per_query(spark, d):
    e = _win(spark, d)
    past = e.where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n"))
    past = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 100").select("src", "dst", "r")
    g = e.where("w >= 22").select("src", "dst").distinct().join(past, ["src", "dst"], "left")
    return g.groupBy("src").agg(F.count("*").alias("n"), *[F.count_if(F.col("r") <= k).alias(f"h{k}") for k in (10, 50, 100)])


@query(
    "a30_rt11_strata",
    "WITH " + _LEVELS + ", win AS (SELECT *, dense_rank() OVER (ORDER BY t // 86400) - 1 AS w FROM social), " + _PER + ", j AS (SELECT m.*, difficulty FROM m JOIN lv USING (src)), s AS (SELECT *, unnest(['All', CASE WHEN difficulty < 3 THEN 'Easy' ELSE 'Hard' END]) AS stratum FROM j) SELECT stratum, count(*) AS queries, "
    + ", ".join(f"round(avg(h{k} / n), 4) AS recall_{k}, round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_{k}" for k in (10, 50, 100)) + " FROM s GROUP BY stratum",
)
def _(spark, d):
    j = _per_query(spark, d).join(_levels(spark, d).select("src", "difficulty"), "src")
    s = j.withColumn("stratum", F.explode(F.array(F.lit("All"), F.when(F.col("difficulty") < 3, "Easy").otherwise("Hard"))))
    means = [m for k in (10, 50, 100) for m in (_r(F.avg(F.col(f"h{k}") / F.col("n")), 4).alias(f"recall_{k}"), _r(F.avg((F.col(f"h{k}") > 0).cast("double")), 4).alias(f"hit_{k}"))]
    return s.groupBy("stratum").agg(F.count("*").alias("queries"), *means)


@query("a31_grouped_votes", f"WITH {_WIN}, v AS (SELECT src, dst, count(DISTINCT w) AS votes FROM win WHERE w < 22 GROUP BY src, dst) SELECT src, dst, votes FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY votes DESC, dst) AS r FROM v) WHERE r <= 20")
def _(spark, d):
    """Candidates of a source's daily queries by the number of days that name them; the first 20."""
    v = _win(spark, d).where("w < 22").groupBy("src", "dst").agg(F.countDistinct("w").alias("votes"))
    return v.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("votes"), "dst"))).where("r <= 20").drop("r")


@query(
    "rt1_rt2_rule_filter",
    f"""WITH {_WIN}, past AS (SELECT * FROM win WHERE w < 22), f AS (SELECT node, count(*) AS SF, count(DISTINCT nbr) AS CN FROM (SELECT src AS node, dst AS nbr FROM past UNION ALL SELECT dst, src FROM past) GROUP BY node), u AS (SELECT src, count(DISTINCT dst) AS dx FROM past GROUP BY src)
    SELECT src, dst, recall FROM (SELECT DISTINCT p.src, p.dst, greatest(20, dx) AS recall FROM past p JOIN u ON u.src = p.src JOIN f ON f.node = p.dst WHERE SF > 150 OR CN >= 90)""",
)
def _(spark, d):
    """Past candidates that pass either of two rules, with the size of the recall."""
    past = _win(spark, d).where("w < 22")
    both = past.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).union(past.select("dst", "src"))
    f = both.groupBy(F.col("node").alias("dst")).agg(F.count("*").alias("SF"), F.countDistinct("nbr").alias("CN"))
    u = past.groupBy("src").agg(F.countDistinct("dst").alias("dx"))
    c = past.select("src", "dst").distinct().join(f, "dst").where(sampling.rule({"SF": ">150", "CN": ">= 90"})).join(u, "src")
    return c.select("src", "dst", sampling.recall_size(20, F.col("dx")).cast("long").alias("recall"))


@query(
    "rt7_inductive_first",
    f"""WITH {_WIN}, past AS (SELECT src, dst, count(*) AS n FROM win WHERE w < 22 GROUP BY ALL), fresh AS (SELECT DISTINCT dst FROM win WHERE w >= 18 AND w < 22 EXCEPT SELECT dst FROM win WHERE w < 18),
    c AS (SELECT src, dst, n, CASE WHEN dst IN (SELECT dst FROM fresh) THEN 0 ELSE 1 END AS kind FROM past) SELECT src, dst, row_number AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY kind, n DESC, dst) AS row_number FROM c) WHERE row_number <= 30""",
)
def _(spark, d):
    """Destinations that are new in the last days of the past stand first."""
    e = _win(spark, d).where("w < 22")
    fresh = e.where("w >= 18").select("dst").distinct().join(e.where("w < 18").select("dst").distinct(), "dst", "left_anti").withColumn("kind", F.lit(0))
    c = e.groupBy("src", "dst").agg(F.count("*").alias("n")).join(fresh, "dst", "left").withColumn("kind", F.coalesce("kind", F.lit(1)))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("kind", F.desc("n"), "dst")).cast("long")).where("rank <= 30").select("src", "dst", "rank")


@query(
    "rt9_assembled_edges",
    f"""WITH {_WIN}, {_RANKED}, q AS (SELECT src, w, count(*) AS dx, min(t // 86400 * 86400) AS t FROM win WHERE w >= 22 GROUP BY src, w), b AS (SELECT *, coalesce(sum(dx) OVER (PARTITION BY src ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
    SELECT b.src, p.dst, b.t FROM b JOIN past p ON p.src = b.src AND p.r > before AND p.r <= before + dx""",
)
def _(spark, d):
    """Ranked candidates dealt to the later windows of a source, as many to each as it has edges, at the window's start."""
    e = _win(spark, d)
    past = e.where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n"))
    ranked = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).select("src", "dst", "r")
    q = e.where("w >= 22").groupBy("src", "w").agg(F.count("*").alias("dx"), F.min(F.floor(F.col("t") / DAY) * DAY).cast("long").alias("t"))
    before = F.coalesce(F.sum("dx").over(Window.partitionBy("src").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = q.withColumn("b", before).withColumn("r", F.explode(F.sequence(F.col("b") + 1, F.col("b") + F.col("dx")))).select("src", "t", F.col("r").cast("int").alias("r"))
    return places.join(ranked, ["src", "r"]).select("src", "dst", "t")


@query(
    "rt10_reranked",
    f"WITH {_WIN}, {_RANKED}, l AS (SELECT src, dst, max(t) AS latest FROM win WHERE w < 22 GROUP BY ALL), c AS (SELECT past.src, past.dst, row_number() OVER (PARTITION BY past.src ORDER BY latest DESC, past.dst) AS r FROM past JOIN l ON l.src = past.src AND l.dst = past.dst WHERE past.r <= 50), m AS (SELECT g.src, count(*) AS n, " + ", ".join(f"count(c.r) FILTER (c.r <= {k}) AS h{k}" for k in (3, 10, 50)) + " FROM g LEFT JOIN c ON c.src = g.src AND c.dst = g.dst GROUP BY g.src) SELECT " + ", ".join(f"round(avg(h{k} / n), 4) AS recall_{k}" for k in (3, 10, 50)) + " FROM m",
)
def _(spark, d):
    """The 50 most frequent candidates ordered anew by a score column, here how recent they are."""
    e = _win(spark, d)
    past = e.where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("t").alias("score"))
    top = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 50")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).select("src", "dst", "r")
    m = e.where("w >= 22").select("src", "dst").distinct().join(top, ["src", "dst"], "left").groupBy("src").agg(F.count("*").alias("n"), *[F.count_if(F.col("r") <= k).alias(f"h{k}") for k in (3, 10, 50)])
    return m.agg(*[_r(F.avg(F.col(f"h{k}") / F.col("n")), 4).alias(f"recall_{k}") for k in (3, 10, 50)])


# Report loaders and tables


@query("rp2_edge_loader", f"WITH {_REPORT} SELECT model, dataset, avg(m1) AS edge_m1, avg(m2) AS edge_m2 FROM report GROUP BY ALL")
def _(spark, d):
    m = reports.required(report_rows(spark, d), ["model", "dataset"]).groupBy("model", "dataset").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    return m.select("model", "dataset", *[F.col(c).alias(f"edge_{c}") for c in ("m1", "m2")])


@query("rp5_three_loaders", f"WITH {_REPORT}, a AS (SELECT model, dataset, avg(m1) AS v FROM report GROUP BY ALL), b AS (SELECT model, dataset, avg(m2) AS v FROM report GROUP BY ALL), c AS (SELECT model, dataset, max(m1) AS v FROM report GROUP BY ALL) SELECT model, dataset, a.v AS structure, b.v AS overlap, c.v AS phenomenon FROM a JOIN b USING (model, dataset) JOIN c USING (model, dataset)")
def _(spark, d):
    r = report_rows(spark, d)
    load = lambda f, name: r.groupBy("model", "dataset").agg(f.alias(name))
    return load(F.avg("m1"), "structure").join(load(F.avg("m2"), "overlap"), ["model", "dataset"]).join(load(F.max("m1"), "phenomenon"), ["model", "dataset"])


@query("rp7_weighted_without_ranks", f"WITH {_REPORT}, s AS (SELECT model, dataset, coalesce((m1 - min(m1) OVER w) / nullif(max(m1) OVER w - min(m1) OVER w, 0), 0) AS a, 1 - coalesce((m2 - min(m2) OVER w) / nullif(max(m2) OVER w - min(m2) OVER w, 0), 0) AS b FROM report WINDOW w AS (PARTITION BY dataset)) SELECT model, dataset, round(0.4 * a + 0.6 * b, 6) AS score FROM s")
def _(spark, d):
    s = reports.min_max(reports.min_max(report_rows(spark, d), "m1"), "m2", reverse=True)
    return s.select("model", "dataset", _r(0.4 * F.col("m1_scaled") + 0.6 * F.col("m2_scaled")).alias("score"))


@query("rp8_degree_models", f"WITH {_WIN}, k AS (SELECT w, src, count(*) AS n, count(DISTINCT dst) AS u FROM win GROUP BY w, src), p AS (SELECT w, src, n, u, lag(n, 1, 0) OVER (PARTITION BY src ORDER BY w) AS last, avg(n) OVER (PARTITION BY src ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM k), e AS (SELECT 'last' AS model, w, avg(abs(n - last)) AS mae, avg((n - last) * (n - last)) AS mse FROM p GROUP BY w UNION ALL SELECT 'mean', w, avg(abs(n - coalesce(mean, 0))), avg((n - coalesce(mean, 0)) * (n - coalesce(mean, 0))) FROM p GROUP BY w) SELECT model, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse FROM e GROUP BY model")
def _(spark, d):
    """Two plain degree models, the last value and the mean so far, by their errors averaged over snapshots."""
    k = graph.window_degrees(social_edges(spark, d), DAY)
    w = Window.partitionBy("src").orderBy("w")
    p = k.select("w", F.col("degree").alias("n"), F.coalesce(F.lag("degree").over(w), F.lit(0)).cast("double").alias("last"), F.coalesce(F.avg("degree").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("mean"))
    e = p.unpivot(["w", "n"], ["last", "mean"], "model", "guess").groupBy("model", "w").agg(F.avg(F.abs(F.col("n") - F.col("guess"))).alias("mae"), F.avg(F.pow(F.col("n") - F.col("guess"), F.lit(2))).alias("mse"))
    return e.groupBy("model").agg(_r(F.avg("mae")).alias("mae"), _r(F.avg("mse")).alias("mse"))


@query("rp9_judge_table", f"WITH {_REPORT}, r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY m1 DESC) AS r FROM report) SELECT model, " + ", ".join(f"max(format('{{}} ({{}})', CAST(floor(m1) AS BIGINT), r)) FILTER (dataset = '{x}') AS {x.lower()}" for x in ("BUILDING", "MACHINERY")) + ", round(avg(r), 4) AS mean_rank FROM r GROUP BY model")
def _(spark, d):
    r = reports.ranked(report_rows(spark, d), "m1").withColumn("shown", F.format_string("%d (%d)", F.floor("m1"), "m1_rank"))
    cells = [F.max(F.when(F.col("dataset") == x, F.col("shown"))).alias(x.lower()) for x in ("BUILDING", "MACHINERY")]
    return r.groupBy("model").agg(*cells, _r(F.avg("m1_rank"), 4).alias("mean_rank"))


@query("rp11_model_means", f"WITH {_REPORT} SELECT model, avg(m1) AS m1, row_number() OVER (ORDER BY CASE model WHEN '7' THEN 0 WHEN '3' THEN 1 ELSE 2 END, model) AS place FROM report GROUP BY model")
def _(spark, d):
    m = report_rows(spark, d).groupBy("model").agg(F.avg("m1").alias("m1"))
    given = F.when(F.col("model") == "7", 0).when(F.col("model") == "3", 1).otherwise(2)
    return m.withColumn("place", F.row_number().over(Window.orderBy(given, "model")).cast("long"))  # one row for each model of a report


@query("rp12_effect_distribution", f"WITH {_WIN}, c AS (SELECT label, count(*) FILTER (w < 15) AS before, count(*) FILTER (w >= 15) AS after FROM win GROUP BY label) SELECT label, round(after * 100.0 / sum(after) OVER () - before * 100.0 / sum(before) OVER (), 6) AS effect FROM c")
def _(spark, d):
    """By how many points of a percent each label's share changed from the first half to the second."""
    c = _win(spark, d).groupBy("label").agg(F.count_if(F.col("w") < 15).alias("before"), F.count_if(F.col("w") >= 15).alias("after"))
    total = c.agg(F.sum("before").alias("_b"), F.sum("after").alias("_a"))
    return c.join(F.broadcast(total)).select("label", _r(F.col("after") * 100.0 / F.col("_a") - F.col("before") * 100.0 / F.col("_b")).alias("effect"))


@query("rp13_dataset_table", "SELECT 'social' AS dataset, format('{:,}', count(*)) AS rows FROM events UNION ALL SELECT 'trade', format('{:,}', count(*)) FROM lineitem")
def _(spark, d):
    size = lambda name, t: table(spark, d, t).agg(F.lit(name).alias("dataset"), F.format_number(F.count("*"), 0).alias("rows"))
    return size("social", "events").union(size("trade", "lineitem"))


@query("l5_pagerank_top")
def _(spark, d):
    """The 100 nodes of most rank."""
    return graph.pagerank(social_edges(spark, d)).select("node", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "node").limit(100)


@query("gr32_macro_bundle")
def _(spark, d):
    """Hub agreement, exponent, distance, chambers and mean rank of the top nodes in one row."""
    e = _win(spark, d)
    hubs = structure.hub_scores(e.where("w < 15"), e.where("w >= 15"), 100)
    fit = _fits(spark, d).agg(_r(F.avg("alpha")).alias("alpha"), _r(F.avg("D")).alias("D"))
    chambers = _chambers(spark, d, social_edges(spark, d)).agg(F.count_if("chamber").alias("chambers"))
    top = graph.pagerank(social_edges(spark, d)).orderBy(F.desc("rank"), "node").limit(100).agg(_r(F.avg("rank"), 9).alias("top_rank"))
    return hubs.join(F.broadcast(fit)).join(F.broadcast(chambers)).join(F.broadcast(top))


@query(
    "v9_edge_search",
    f"WITH {_WIN}, n AS (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0), c AS (SELECT n.q, label, count(*) AS k FROM n JOIN social ON src = n.id WHERE r <= 10 GROUP BY n.q, label) SELECT q, label FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k DESC, label) AS r FROM c) WHERE r = 1",
)
def _(spark, d):
    """The most frequent label among the edges of a query's ten nearest nodes, for queries divisible by 20."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = retrieval.nearest(v.where("vec_id % 20 = 0"), v, 10).select(F.col("src").alias("q"), F.col("dst").alias("id"))
    c = near.join(social_edges(spark, d).select(F.col("src").alias("id"), "label"), "id").groupBy("q", "label").agg(F.count("*").alias("k"))
    return c.groupBy("q").agg(F.min_by("label", F.struct(-F.col("k"), "label")).alias("label"))


@query("a26_running_neighbours", f"WITH {_SOCIAL}, h AS (SELECT edge_id, src, dst, count(*) OVER (PARTITION BY src, dst ORDER BY t, edge_id) - 1 AS before, min(t) OVER (PARTITION BY src, dst) = t AND row_number() OVER (PARTITION BY src, dst ORDER BY t, edge_id) = 1 AS fresh, t FROM social) SELECT edge_id, before, CAST(coalesce(sum(CAST(fresh AS INT)) OVER (PARTITION BY src ORDER BY t, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS partners FROM h")
def _(spark, d):
    """Before each edge: how often its pair had met, and how many partners its source had."""
    pair = Window.partitionBy("src", "dst").orderBy("t", "edge_id")
    own = Window.partitionBy("src").orderBy("t", "edge_id").rowsBetween(Window.unboundedPreceding, -1)
    h = social_edges(spark, d).withColumn("before", F.row_number().over(pair).cast("long") - 1)
    return h.select("edge_id", "before", F.coalesce(F.sum((F.col("before") == 0).cast("long")).over(own), F.lit(0).cast("long")).alias("partners"))


@query("tx17_long_block_penalty", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len([x FOR x IN string_split_regex(text, '[ \\t-\\r]+') IF length(x) > 20]) > 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM documents")
def _(spark, d):
    long = F.exists(F.split("text", r"[ \t-\r]+", -1), lambda x: F.length(x) > 20)
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNull(), None).when(long, -1.0).otherwise(0.0).alias("penalty"))


@query("tx12_score_out_of_ten", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (n_chars % 11) / 10.0 ELSE 0.5 END AS score FROM documents")
def _(spark, d):
    """``Score: x`` as tenths, 0.5 where there is none."""
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("so, Score: "), (F.col("n_chars") % 11).cast("string"), F.lit(" of ten"))).when(F.col("doc_id") % 3 == 1, "no Score: none").otherwise(F.lit("nothing"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_extract(said, r"Score:\s*([0-9]+)", 1).try_cast("double") / 10, F.lit(0.5)).alias("score"))
