"""Graph structure, evaluation and distribution queries, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import vectors as vec
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph
from chronoweave.plans.queries import _BOTH, _PAIRS, _SOCIAL, _TRADE, _WIN, query
from chronoweave.session import table
from chronoweave.sources.tables import DAY, social_edges, trade_edges

_K = _TRADE + ", k AS (SELECT src, count(*) AS k FROM trade GROUP BY src)"
_CLAWS = "SELECT count(*) AS k FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY v"


def _win(spark, d):
    return graph.windowed(social_edges(spark, d), DAY)


def _degrees(spark, d):
    return trade_edges(spark, d).groupBy("src").agg(F.count("*").alias("k"))


def _r(c, n=6):
    return F.round(c, n)


@query("a3_daily_counts", f"WITH {_WIN}, n AS (SELECT count(*) AS n FROM win GROUP BY w) SELECT round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM n")
def _(spark, d):
    n = _win(spark, d).groupBy("w").agg(F.count("*").alias("n"))
    return n.agg(_r(F.avg("n")).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("a8_bucket_start_degrees", f"WITH {_TRADE} SELECT src, t // 86400 AS bucket, count(*) AS degree FROM trade WHERE t % 86400 = 0 GROUP BY ALL")
def _(spark, d):
    e = trade_edges(spark, d).where(f"t % {DAY} = 0")
    return e.groupBy("src", F.floor(F.col("t") / DAY).cast("long").alias("bucket")).agg(F.count("*").alias("degree"))


@query("a9_snapshots", f"WITH {_SOCIAL}, s AS (SELECT *, (t - min(t) OVER ()) // 86400 AS w FROM social) SELECT w, count(*) AS edges, count(DISTINCT (least(src, dst), greatest(src, dst))) AS pairs FROM s GROUP BY w")
def _(spark, d):
    e = social_edges(spark, d)
    s = e.join(F.broadcast(e.agg(F.min("t").alias("t0")))).withColumn("w", F.floor((F.col("t") - F.col("t0")) / DAY).cast("long"))
    return s.groupBy("w").agg(F.count("*").alias("edges"), F.countDistinct(F.struct(F.least("src", "dst"), F.greatest("src", "dst"))).alias("pairs"))


@query("a14_distinct_partners", f"WITH {_TRADE} SELECT src, count(DISTINCT dst) AS partners, count(DISTINCT label) AS labels FROM trade GROUP BY src")
def _(spark, d):
    return trade_edges(spark, d).groupBy("src").agg(F.countDistinct("dst").alias("partners"), F.countDistinct("label").alias("labels"))


@query("a17_quantile_table", f"WITH {_K} SELECT DISTINCT unnest([quantile_cont(k, 0.0), quantile_cont(k, 0.25), quantile_cont(k, 0.5), quantile_cont(k, 0.75), quantile_cont(k, 1.0)]) AS level FROM k")
def _(spark, d):
    q = dist.quantiles(_degrees(spark, d), "k", {f"q{i}": i / 4 for i in range(5)})
    return q.select(F.explode(F.array(*q.columns)).alias("level")).distinct()


@query("a18_bandwidth", f"WITH {_SOCIAL} SELECT max(abs(src - dst)) AS most, round(avg(abs(src - dst)), 6) AS mean, quantile_cont(abs(src - dst), 0.9) AS p90 FROM social")
def _(spark, d):
    b = social_edges(spark, d).select(F.abs(F.col("src") - F.col("dst")).alias("b"))
    return b.agg(F.max("b").alias("most"), _r(F.avg("b")).alias("mean")).join(F.broadcast(dist.quantiles(b, "b", {"p90": 0.9})))


@query("a19_summary", f"WITH {_WIN} SELECT (SELECT count(*) FROM (SELECT src FROM win UNION SELECT dst FROM win)) AS nodes, count(*) AS edges, round(count(*) / count(DISTINCT w), 6) AS per_day, min(t) AS t0, max(t) AS t1 FROM win")
def _(spark, d):
    e = _win(spark, d)
    nodes = e.select("src").union(e.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    rest = e.agg(F.count("*").alias("edges"), _r(F.count("*") / F.countDistinct("w")).alias("per_day"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return rest.join(F.broadcast(nodes))


@query("a21_daily_gaussian", f"WITH {_WIN}, n AS (SELECT count(*) AS n FROM win GROUP BY w) SELECT round(avg(n), 6) AS mu, round(stddev_pop(n), 6) AS sigma FROM n")
def _(spark, d):
    n = _win(spark, d).groupBy("w").agg(F.count("*").alias("n"))
    return n.agg(_r(F.avg("n")).alias("mu"), _r(F.stddev_pop("n")).alias("sigma"))


@query("a26_running_interactions", f"WITH {_SOCIAL} SELECT edge_id, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src, edge_id) AS seen FROM social")
def _(spark, d):
    w = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("src", "edge_id")
    return social_edges(spark, d).select("edge_id", F.row_number().over(w).cast("long").alias("seen"))


_RANKS = f"""WITH {_WIN}, f AS (SELECT dst, count(*) AS s FROM win WHERE w < 22 GROUP BY dst), n AS (SELECT max(dst) + 1 AS n FROM win),
    q AS (SELECT edge_id, dst, unnest(range(1, 21)) AS i FROM win WHERE w >= 22),
    c AS (SELECT q.edge_id, coalesce(p.s, 0) AS pos, coalesce(g.s, 0) AS neg FROM q JOIN n ON true LEFT JOIN f p ON p.dst = q.dst LEFT JOIN f g ON g.dst = (q.dst * 31 + q.i * 17) % n.n),
    r AS (SELECT edge_id, 1 + count(*) FILTER (neg > pos) AS rank FROM c GROUP BY edge_id)"""


@query("a32_hits", _RANKS + " SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS h1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS h3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS h10, round(avg(1.0 / rank), 6) AS mrr FROM r")
def _(spark, d):
    e = _win(spark, d)
    f = e.where("w < 22").groupBy("dst").agg(F.count("*").alias("s"))
    q = e.where("w >= 22").join(F.broadcast(e.agg((F.max("dst") + 1).alias("n")))).select("edge_id", "dst", "n", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    c = q.withColumn("other", (F.col("dst") * 31 + F.col("i") * 17) % F.col("n")).join(f.withColumnRenamed("s", "pos"), "dst", "left")
    c = c.join(f.select(F.col("dst").alias("other"), F.col("s").alias("neg")), "other", "left")
    r = c.groupBy("edge_id").agg((1 + F.count_if(F.coalesce("neg", F.lit(0)) > F.coalesce("pos", F.lit(0)))).alias("rank"))
    hit = lambda k: _r(F.avg((F.col("rank") <= k).cast("double"))).alias(f"h{k}")
    return r.agg(hit(1), hit(3), hit(10), _r(F.avg(1.0 / F.col("rank"))).alias("mrr"))


_LAB = "l AS (SELECT n_chars AS s, toxic AS y FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)"


def _labelled(spark, d):
    return table(spark, d, "labels").where("toxic is not null").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("s")), "doc_id").select("s", F.col("toxic").alias("y"))


@query("a33_auc", f"WITH {_LAB}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM l) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def _(spark, d):
    return dist.auc(_labelled(spark, d), "s", "y").select(_r("auc").alias("auc"))


@query("a33_average_precision", f"WITH {_LAB}, k AS (SELECT s, sum(y) AS p, count(*) AS n FROM l GROUP BY s), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM k) SELECT round(sum(p * cp / cn) / sum(p), 6) AS ap FROM c")
def _(spark, d):
    return dist.average_precision(_labelled(spark, d), "s", "y").select(_r("ap").alias("ap"))


@query("a34_binary_scores", f"WITH {_LAB}, k AS (SELECT count(*) FILTER (y = 1 AND s > 500) AS tp, count(*) FILTER (y = 0 AND s > 500) AS fp, count(*) FILTER (y = 1 AND s <= 500) AS fn, count(*) FILTER (y = 0 AND s <= 500) AS tn FROM l) SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k")
def _(spark, d):
    y, z = F.col("y") == 1, F.col("s") > 500
    k = _labelled(spark, d).agg(F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(y & ~z).alias("fn"), F.count_if(~y & ~z).alias("tn"))
    return k.selectExpr("round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as auc", "round(tp / (tp + fp), 6) as precision", "round(2 * tp / (2 * tp + fp + fn), 6) as f1")


_CLS = """x AS (SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS z FROM lineitem), c AS (SELECT y AS class FROM x UNION SELECT z FROM x),
    s AS (SELECT class, (SELECT count(*) FROM x WHERE y = class) AS support, (SELECT count(*) FROM x WHERE z = class) AS named, (SELECT count(*) FROM x WHERE z = class AND y = class) AS hit FROM c),
    m AS (SELECT class, support, coalesce(hit / nullif(named, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(named + support, 0), 0) AS f1 FROM s)"""


def _classes(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_linestatus") == "F", "R").otherwise("N").alias("z"))
    return dist.classification(x, "y", "z")


@query("a35_classes", f"WITH {_CLS} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def _(spark, d):
    return _classes(spark, d).select("class", "support", *[_r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("a35_macro_weighted", f"WITH {_CLS} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(recall * support) / sum(support), 6) AS micro_f1 FROM m")
def _(spark, d):
    s = F.sum("support")
    return _classes(spark, d).agg(_r(F.avg("f1")).alias("macro_f1"), _r(F.sum(F.col("f1") * F.col("support")) / s).alias("weighted_f1"), _r(F.sum(F.col("recall") * F.col("support")) / s).alias("micro_f1"))


@query(
    "a38_ndcg",
    f"""WITH {_WIN}, h AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS r FROM win WHERE w < 22 GROUP BY src, dst), g AS (SELECT src, dst, count(*) AS rel FROM win WHERE w >= 22 GROUP BY src, dst),
    i AS (SELECT src, rel, row_number() OVER (PARTITION BY src ORDER BY rel DESC, dst) AS r FROM g), dcg AS (SELECT h.src, sum((2 ** rel - 1) / log2(h.r + 1)) AS v FROM h JOIN g USING (src, dst) WHERE h.r <= 10 GROUP BY h.src),
    best AS (SELECT src, sum((2 ** rel - 1) / log2(r + 1)) AS v FROM i WHERE r <= 10 GROUP BY src) SELECT best.src, round(coalesce(dcg.v, 0) / best.v, 6) AS ndcg FROM best LEFT JOIN dcg ON dcg.src = best.src""",
)
def _(spark, d):
    e = _win(spark, d)
    top = lambda df, *order: df.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where("r <= 10")
    h = top(e.where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n")), F.desc("n"), "dst").select("src", "dst", "r")
    g = e.where("w >= 22").groupBy("src", "dst").agg(F.count("*").alias("rel"))
    gain = F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("r") + 1))
    dcg = h.join(g, ["src", "dst"]).groupBy("src").agg(gain.alias("v"))
    best = top(g, F.desc("rel"), "dst").groupBy("src").agg(gain.alias("b"))
    return best.join(dcg, "src", "left").select("src", _r(F.coalesce("v", F.lit(0.0)) / F.col("b")).alias("ndcg"))


_GAPS = f"WITH {_WIN}, g AS (SELECT src FROM (SELECT DISTINCT src FROM win)), k AS (SELECT src, count(*) FILTER (w = 27) AS a, count(*) FILTER (w = 28) AS b FROM win GROUP BY src)"


def _two_days(spark, d):
    return _win(spark, d).groupBy("src").agg(F.count_if(F.col("w") == 27).alias("a"), F.count_if(F.col("w") == 28).alias("b"))


@query("a39_degree_errors", _GAPS + " SELECT round(avg(abs(a - b)), 6) AS mae, round(avg((a - b) * (a - b)), 6) AS mse FROM k")
def _(spark, d):
    x = F.col("a") - F.col("b")
    return _two_days(spark, d).agg(_r(F.avg(F.abs(x))).alias("mae"), _r(F.avg(x * x)).alias("mse"))


@query("a42_distribution_loss", _GAPS + ", m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_samp(a) + 1e-6 AS sa, stddev_samp(b) + 1e-6 AS sb FROM k) SELECT round(avg(((a - ma) / sa - (b - mb) / sb) ** 2) + 0.1 * abs(min(ma) - min(mb)) + 0.1 * abs(min(sa) - min(sb)), 6) AS loss FROM k, m")
def _(spark, d):
    k = _two_days(spark, d)
    m = k.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), (F.stddev_samp("a") + 1e-6).alias("sa"), (F.stddev_samp("b") + 1e-6).alias("sb"))
    z = (F.col("a") - F.col("ma")) / F.col("sa") - (F.col("b") - F.col("mb")) / F.col("sb")
    gap = lambda x, y: 0.1 * F.abs(F.min(x) - F.min(y))
    return k.join(F.broadcast(m)).agg(_r(F.avg(z * z) + gap("ma", "mb") + gap("sa", "sb")).alias("loss"))


@query("a43_relative_errors", _GAPS + ", e AS (SELECT abs(a - b) / a AS e FROM k WHERE a > 0) SELECT round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS median FROM e")
def _(spark, d):
    e = _two_days(spark, d).where("a > 0").select((F.abs(F.col("a") - F.col("b")) / F.col("a")).alias("e"))
    return e.agg(_r(F.avg("e")).alias("mean")).join(F.broadcast(dist.quantiles(e, "e", {"median": 0.5}).select(_r(F.col("median")).alias("median"))))


_BIN = "SELECT {by}CAST(least(floor((k - lo) / (hi - lo) * {n}), {n} - 1) AS BIGINT) AS bin, count(*) AS n FROM {t}, (SELECT CAST(min(k) AS DOUBLE) AS lo, CAST(max(k) AS DOUBLE) AS hi FROM {t}) GROUP BY ALL"


@query("a40_histogram", f"WITH {_K}, h AS ({_BIN.format(by='', n=100, t='k')}) SELECT bin, n, round(n / sum(n) OVER (), 9) AS share FROM h WHERE bin > 0")
def _(spark, d):
    h = dist.histogram(_degrees(spark, d), "k", 100).where("bin > 0")
    return h.join(F.broadcast(h.agg(F.sum("n").alias("_t")))).select("bin", "n", _r(F.col("n") / F.col("_t"), 9).alias("share"))


@query(
    "a41_gr20_distances",
    f"""WITH {_WIN}, k AS (SELECT src, w >= 15 AS late, count(*) AS k FROM win GROUP BY ALL), h AS ({_BIN.format(by='late, ', n=20, t='k')}),
    d AS (SELECT b AS bin, coalesce((SELECT sum(n) FROM h WHERE bin = b AND NOT late), 0) / (SELECT sum(n) FROM h WHERE NOT late) AS p, coalesce((SELECT sum(n) FROM h WHERE bin = b AND late), 0) / (SELECT sum(n) FROM h WHERE late) AS q FROM range(20) t(b)),
    c AS (SELECT *, abs(sum(p - q) OVER (ORDER BY bin)) AS c FROM d)
    SELECT round(sum(c), 6) AS wasserstein, round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sum(CASE WHEN p > 0 THEN p * ln((p + 1e-10) / (q + 1e-10)) ELSE 0 END), 6) AS kl, round(exp(-sum((p - q) ** 2) / 2), 6) AS gaussian FROM c""",
)
def _(spark, d):
    k = _win(spark, d).groupBy("src", (F.col("w") >= 15).alias("late")).agg(F.count("*").alias("k"))
    out = dist.distances(dist.dense_bins(dist.histogram(k, "k", 20, ["late"]), 20, ~F.col("late")))
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query("a45_tag_means", "SELECT event_type AS tag, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS level FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tag")).agg(_r(F.avg("value")).alias("mean"), _r(F.avg((F.col("value") > 10).cast("double"))).alias("level"))


@query("j14_two_hop", f"WITH {_SOCIAL}, e AS (SELECT DISTINCT src, dst FROM social) SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE y.dst <> x.src")
def _(spark, d):
    e = social_edges(spark, d).select("src", "dst").distinct()
    return graph.steps_of_two(e.select("src", F.col("dst").alias("via")), e.select(F.col("src").alias("via"), "dst")).where("src <> dst")


@query("j14_two_hop_all", f"WITH {_SOCIAL}, n AS (SELECT src AS u, dst AS v FROM social UNION SELECT dst, src FROM social) SELECT DISTINCT u AS src, s.dst FROM n JOIN social s ON s.src = n.v")
def _(spark, d):
    return graph.two_hop(social_edges(spark, d))


@query("j15_gathered_features", f"WITH {_SOCIAL} SELECT edge_id, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 5) AS dot, len(x.embedding) + len(y.embedding) AS width FROM social JOIN embeddings x ON x.vec_id = src JOIN embeddings y ON y.vec_id = dst")
def _(spark, d):
    v = table(spark, d, "embeddings")
    e = social_edges(spark, d).select("edge_id", "src", "dst").join(v.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x")), "src").join(v.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y")), "dst")
    return e.select("edge_id", F.round(vec.dot(F.col("x"), F.col("y")), 5).alias("dot"), F.size(F.concat("x", "y")).cast("long").alias("width"))


@query("j16_future_references", f"WITH {_WIN}, f AS (SELECT src, edge_id, row_number() OVER (PARTITION BY src ORDER BY t, edge_id) AS r FROM win WHERE w >= 22) SELECT src, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY r) AS edges FROM f WHERE r <= 3 GROUP BY src")
def _(spark, d):
    f = _win(spark, d).where("w >= 22").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("t", "edge_id"))).where("r <= 3")
    return f.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "edge_id"))), lambda x: x["edge_id"].cast("string")), ",").alias("edges"))


@query("s3_historical_negatives", f"WITH {_WIN} SELECT DISTINCT src, dst FROM win WHERE w < 22 EXCEPT SELECT src, dst FROM win WHERE w = 22")
def _(spark, d):
    e = _win(spark, d)
    return e.where("w < 22").select("src", "dst").distinct().join(e.where("w = 22").select("src", "dst"), ["src", "dst"], "left_anti")


@query("s4_end_points", f"WITH {_TRADE} SELECT 'c' || src AS node FROM trade UNION SELECT 's' || dst FROM trade")
def _(spark, d):
    e = trade_edges(spark, d)
    ends = [e.select(c).distinct().select(F.concat(F.lit(kind), c).alias("node")) for kind, c in (("c", "src"), ("s", "dst"))]  # numbers first: they are shorter than names
    return ends[0].union(ends[1]).distinct()


@query("s6_gr10_hub_precision", f"WITH {_WIN}, a AS (SELECT src FROM win WHERE w < 15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 20), b AS (SELECT src FROM win WHERE w >= 15 GROUP BY src ORDER BY count(*) DESC, src LIMIT 20) SELECT (SELECT count(*) FROM a JOIN b USING (src)) / 20 AS precision_20")
def _(spark, d):
    e = _win(spark, d)
    a, b = (graph.top_hubs(e.where(c), 20).select("src") for c in ("w < 15", "w >= 15"))
    return a.join(b, "src").agg((F.count("*") / 20).alias("precision_20"))


@query("w10_most_recent", f"WITH {_BOTH}, r AS (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY t DESC, edge_id DESC, nbr DESC) AS r FROM both_ways) SELECT node, lpad(string_agg(CAST(nbr AS VARCHAR), ',' ORDER BY r DESC), 40, '_') AS recent FROM r WHERE r <= 5 GROUP BY node")
def _(spark, d):
    r = graph.both_ways(social_edges(spark, d)).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("t"), F.desc("edge_id"), F.desc("nbr")))).where("r <= 5")
    recent = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "nbr"))), lambda x: x["nbr"].cast("string")), ",")
    return r.groupBy("node").agg(F.lpad(recent, 40, "_").alias("recent"))


@query("w11_time_weights", f"WITH {_SOCIAL}, x AS (SELECT src, t, edge_id, exp(1e-6 * (t - max(t) OVER (PARTITION BY src))) AS e FROM social) SELECT edge_id, round(e / sum(e) OVER (PARTITION BY src ORDER BY t, edge_id ROWS UNBOUNDED PRECEDING), 6) AS weight FROM x")
def _(spark, d):
    e = social_edges(spark, d).withColumn("x", F.exp(1e-6 * (F.col("t") - F.max("t").over(Window.partitionBy("src")))))
    return e.select("edge_id", _r(F.col("x") / F.sum("x").over(Window.partitionBy("src").orderBy("t", "edge_id").rowsBetween(Window.unboundedPreceding, 0))).alias("weight"))


@query("w12_repeat_interval", f"WITH {_SOCIAL}, g AS (SELECT src, dst, t - lag(t) OVER (PARTITION BY src, dst ORDER BY t, edge_id) AS g FROM social), m AS (SELECT src, dst, avg(g) AS m FROM g GROUP BY ALL) SELECT round(sum(m) / count(*), 4) AS interval FROM m")
def _(spark, d):
    g = social_edges(spark, d).withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("src", "dst").orderBy("t", "edge_id")))
    return g.groupBy("src", "dst").agg(F.avg("g").alias("m")).agg(F.round(F.sum("m") / F.count("*"), 4).alias("interval"))


@query("gr5_clustering", f"WITH {_PAIRS}, k AS ({_CLAWS}), t AS (SELECT count(*) AS t FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b) SELECT round(3 * t / sum(k * (k - 1) * (k - 2) / 6), 9) AS clustering, round(3 * t / sum(k * (k - 1) / 2), 9) AS transitivity FROM k, t GROUP BY t")
def _(spark, d):
    e = social_edges(spark, d)
    c = graph.local_clustering(e)
    k = F.col("k")
    tri = F.sum("triangles")  # a triangle counts at each of its corners
    return c.agg(F.round(tri / F.sum(k * (k - 1) * (k - 2) / 6), 9).alias("clustering"), F.round(tri / F.sum(k * (k - 1) / 2), 9).alias("transitivity"))


@query("gr6_gini", f"WITH {_K}, r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM k) SELECT round(2 * sum(i * k) / (count(*) * sum(k)) - (count(*) + 1) / count(*), 9) AS gini FROM r")
def _(spark, d):
    return dist.gini(_degrees(spark, d), "k").select(_r("gini", 9).alias("gini"))


@query("gr7_edge_entropy", f"WITH {_K}, m AS (SELECT sum(k) AS m, count(*) AS n FROM k) SELECT round(sum(-(k / m) * ln(k / m + 0.0001)) / ln(min(n)), 9) AS entropy FROM k, m")
def _(spark, d):
    k = _degrees(spark, d)
    p = F.col("k") / F.col("m")
    return k.join(F.broadcast(k.agg(F.sum("k").alias("m"), F.count("*").alias("n")))).agg(_r(F.sum(-p * F.log(p + 0.0001)) / F.log(F.min("n")), 9).alias("entropy"))


@query("gr14_snapshots", f"WITH {_WIN} SELECT w, src, dst, arg_max(label, (t, edge_id)) AS label FROM win GROUP BY w, src, dst")
def _(spark, d):
    return _win(spark, d).groupBy("w", "src", "dst").agg(F.max_by("label", F.struct("t", "edge_id")).alias("label"))


@query("gr15_simple_graph", f"WITH {_SOCIAL} SELECT src, dst, arg_max(label, (t, edge_id)) AS label, max(t) AS t FROM social GROUP BY src, dst")
def _(spark, d):
    return social_edges(spark, d).groupBy("src", "dst").agg(F.max_by("label", F.struct("t", "edge_id")).alias("label"), F.max("t").alias("t"))


@query("gr28_block_densities", f"WITH {_PAIRS}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT x.label AS la, y.label AS lb, round(count(*) / (min(nx.n) * min(ny.n)), 9) AS density FROM p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b JOIN n nx ON nx.label = x.label JOIN n ny ON ny.label = y.label GROUP BY ALL")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    p = graph.simple_pairs(social_edges(spark, d)).join(v.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(v.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    n = v.groupBy("label").agg(F.count("*").alias("n"))
    k = p.groupBy("la", "lb").agg(F.count("*").alias("c"))
    k = k.join(n.select(F.col("label").alias("la"), F.col("n").alias("na")), "la").join(n.select(F.col("label").alias("lb"), F.col("n").alias("nb")), "lb")
    return k.select("la", "lb", _r(F.col("c") / (F.col("na") * F.col("nb")), 9).alias("density"))




@query("gr29_four_cliques", f"WITH {_PAIRS} SELECT count(*) AS cliques FROM p ab JOIN p ac ON ac.a = ab.a AND ac.b > ab.b JOIN p bc ON bc.a = ab.b AND bc.b = ac.b JOIN p ad ON ad.a = ab.a AND ad.b > ac.b JOIN p bd ON bd.a = ab.b AND bd.b = ad.b JOIN p cd ON cd.a = ac.b AND cd.b = ad.b")
def _(spark, d):
    return graph.four_cliques(social_edges(spark, d)).agg(F.count("*").alias("cliques"))


@query("gr29_four_cliques_by_node", f"WITH {_PAIRS}, q AS (SELECT ab.a AS x, ab.b AS y, ac.b AS z, ad.b AS v FROM p ab JOIN p ac ON ac.a = ab.a AND ac.b > ab.b JOIN p bc ON bc.a = ab.b AND bc.b = ac.b JOIN p ad ON ad.a = ab.a AND ad.b > ac.b JOIN p bd ON bd.a = ab.b AND bd.b = ad.b JOIN p cd ON cd.a = ac.b AND cd.b = ad.b), m AS (SELECT node, count(*) AS n FROM (SELECT unnest([x, y, z, v]) AS node FROM q) GROUP BY node) SELECT node, coalesce(n, 0) AS cliques FROM (SELECT a AS node FROM p UNION SELECT b FROM p) LEFT JOIN m USING (node)")
def _(spark, d):
    return graph.four_cliques_by_node(social_edges(spark, d))


@query("gr43_edgebank_progressive", f"WITH {_WIN}, f AS (SELECT src, dst, min(w) AS first FROM win GROUP BY ALL) SELECT edge_id, CASE WHEN first < w THEN 1.0 ELSE 0.0 END AS score FROM win JOIN f USING (src, dst) WHERE w >= 22")
def _(spark, d):
    e = _win(spark, d)
    f = e.groupBy("src", "dst").agg(F.min("w").alias("first"))
    return e.where("w >= 22").join(f, ["src", "dst"]).select("edge_id", (F.col("first") < F.col("w")).cast("double").alias("score"))


@query("gr45_active_edges", f"WITH {_WIN}, b AS (SELECT min(t) FILTER (w = 5) AS t0, max(t) FILTER (w = 9) AS t1 FROM win) SELECT DISTINCT src, dst FROM win, b WHERE t BETWEEN t0 AND t1")
def _(spark, d):
    e = _win(spark, d)
    b = e.agg(F.min(F.when(F.col("w") == 5, F.col("t"))).alias("t0"), F.max(F.when(F.col("w") == 9, F.col("t"))).alias("t1"))
    return e.join(F.broadcast(b)).where("t between t0 and t1").select("src", "dst").distinct()


@query("gr48_output_graph", f"WITH {_WIN}, n AS (SELECT max(w) + 1 AS n FROM win) SELECT edge_id, src, dst, w - (n - 4) AS step FROM win, n WHERE w >= n - 4")
def _(spark, d):
    e = _win(spark, d)
    return e.join(F.broadcast(e.agg((F.max("w") + 1).alias("n")))).where("w >= n - 4").select("edge_id", "src", "dst", (F.col("w") - F.col("n") + 4).alias("step"))
