"""Two graphs or two lists compared, and data sets of several files; each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import vectors as vec
from chronoweave.operators import graph, history, structure
from chronoweave.plans.queries import _REPORT, _SOCIAL, _WIN, query
from chronoweave.plans.structure_queries import _COS, _r, _win
from chronoweave.session import shared_dir, table
from chronoweave.sources import files, market
from chronoweave.sources.tables import report_rows


def _halves(spark, d):
    e = _win(spark, d)
    return e.where("w < 15"), e.where("w >= 15")


_HUBS = """{0}d AS (SELECT src, count(*) AS k FROM win WHERE w {1} GROUP BY src), {0}h AS (SELECT src FROM (SELECT src, row_number() OVER (ORDER BY k DESC, src) AS r FROM {0}d) WHERE r <= (SELECT k FROM kk))"""


def _hub_sql(k):
    return f"""WITH {_WIN}, n AS (SELECT count(*) AS n FROM (SELECT src FROM win UNION SELECT dst FROM win)), kk AS (SELECT {k} AS k FROM n), {_HUBS.format('a', '< 15')}, {_HUBS.format('b', '>= 15')},
    c AS (SELECT (SELECT count(*) FROM ah) AS t, (SELECT count(*) FROM bh) AS g, (SELECT count(*) FROM ah JOIN bh USING (src)) AS h, n FROM n)
    SELECT round(h / g, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (t + g), 6) AS f1, round((h / t + 1 - (g - h) / (n - t)) / 2, 6) AS auc FROM c"""


@query("gr10_hubs_at_20", _hub_sql("20"))
def _(spark, d):
    """The 20 nodes of most edges in one half of the windows against those in the other, the area under the curve included."""
    return structure.hub_metrics(*_halves(spark, d), k=20).select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "auc")])


@query("gr10_hubs_at_a_fifth", _hub_sql("CAST(floor(0.2 * n) AS BIGINT)"))
def _(spark, d):
    """The same for a fifth of all nodes."""
    return structure.hub_metrics(*_halves(spark, d), share=0.2).select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "auc")])


_TWO = f"{_WIN}, v AS (SELECT vec_id, embedding FROM embeddings)" + "".join(
    f""", {n}p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM win WHERE w {rule}), {n}n AS (SELECT a AS x FROM {n}p UNION SELECT b FROM {n}p),
    {n}s AS (SELECT a.vec_id AS node, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 WHERE a.vec_id IN (SELECT x FROM {n}n) AND b.vec_id IN (SELECT x FROM {n}n) AND {_COS} > 0.25),
    {n}c AS (SELECT node, count(*) AS "similar", count({n}p.a) AS linked FROM {n}s LEFT JOIN {n}p ON {n}p.a = least(node, other) AND {n}p.b = greatest(node, other) GROUP BY node HAVING count(*) >= 3),
    {n}m AS (SELECT count(*) FILTER (linked / "similar" > 0.01) AS chambers, coalesce(avg(CAST(linked / "similar" > 0.01 AS INT)), 0) AS ratio, coalesce(avg("similar") FILTER (linked / "similar" > 0.01), 0) AS size FROM {n}c)"""
    for n, rule in (("g", "< 15"), ("h", ">= 15"))
)


@query("gr31_chambers_of_two_graphs", f"WITH {_TWO} SELECT abs(gm.chambers - hm.chambers) AS chambers_gap, round(abs(gm.ratio - hm.ratio), 6) AS ratio_gap, round(abs(gm.size - hm.size), 6) AS size_gap FROM gm, hm")
def _(spark, d):
    """Echo chambers of the two halves of the windows: number, share and mean size apart; vectors are random, so the bound is 0.25."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 20 == 0).alias("asked"))
    gaps = structure.chamber_gaps(*[structure.echo_chambers(e, v, vec.cosine, above=0.25) for e in _halves(spark, d)])
    return gaps.select("chambers_gap", _r(F.col("ratio_gap")).alias("ratio_gap"), _r(F.col("size_gap")).alias("size_gap"))


_BUNDLE = "".join(
    f""", {n}e AS (SELECT src, dst FROM win WHERE w {rule}), {n}p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {n}e), {n}k AS (SELECT dst, count(*) AS k FROM {n}e GROUP BY dst),
    {n}t AS (SELECT count(*) AS t FROM {n}p x JOIN {n}p y ON x.b = y.a JOIN {n}p z ON z.a = x.a AND z.b = y.b),
    {n}m AS (SELECT sum(k) / (SELECT count(*) FROM (SELECT src FROM {n}e UNION SELECT dst FROM {n}e)) AS mean, sum(k * (k - 1) / 2) AS wedges, sum(k * (k - 1) * (k - 2) / 6) AS claws, (SELECT t FROM {n}t) AS triangles FROM {n}k)"""
    for n, rule in (("g", "< 15"), ("h", ">= 15"))
)


@query(
    "gr33_structure_bundle",
    f"""WITH {_WIN}{_BUNDLE} SELECT round(abs(a.mean - b.mean), 6) AS mean_gap, abs(a.wedges - b.wedges) AS wedges_gap, abs(a.claws - b.claws) AS claws_gap, abs(a.triangles - b.triangles) AS triangles_gap,
    round(abs(coalesce(3 * a.triangles / nullif(a.claws, 0), 0) - coalesce(3 * b.triangles / nullif(b.claws, 0), 0)), 9) AS clustering_gap FROM gm a, hm b""",
)
def _(spark, d):
    """Mean degree, wedges, claws, triangles and the clustering coefficient of two graphs: how far each is apart."""
    g = structure.structure_gaps(*_halves(spark, d))
    return g.select(_r(F.col("mean_gap")).alias("mean_gap"), "wedges_gap", "claws_gap", "triangles_gap", _r(F.col("clustering_gap"), 9).alias("clustering_gap"))


# Labels

_LABELS = f"{_WIN}, past AS (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r FROM win WHERE w < 22 GROUP BY src, label), guess AS (SELECT src, list(label ORDER BY r) AS guess FROM past WHERE r <= 2 GROUP BY src), truth AS (SELECT src, dst, list(DISTINCT label) AS truth FROM win WHERE w >= 22 GROUP BY src, dst)"


@query(
    "a37_label_lists",
    f"WITH {_LABELS}, s AS (SELECT edge_id, label, guess, truth, len(list_intersect(guess, truth)) AS hit FROM win JOIN guess USING (src) JOIN truth USING (src, dst) WHERE w >= 22) SELECT edge_id, CAST(list_contains(truth, guess[1]) AS INT) AS label_acc, hit / len(guess) AS label_precision, hit / len(truth) AS label_recall, CASE WHEN hit = 0 THEN 0.0 ELSE 2.0 * (hit / len(guess)) * (hit / len(truth)) / (hit / len(guess) + hit / len(truth)) END AS label_f1 FROM s",
)
def _(spark, d):
    """A source's two most frequent past labels as the guess for each later edge, against all labels of its pair."""
    e = _win(spark, d)
    past = e.where("w < 22").groupBy("src", "label").agg(F.count("*").alias("n"))
    past = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "label"))).where("r <= 2")
    guess = past.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("guess"))
    late = e.where("w >= 22")
    truth = late.groupBy("src", "dst").agg(F.collect_set("label").alias("truth"))
    rows = late.join(guess, "src").join(truth, ["src", "dst"])
    return rows.select("edge_id", *structure.list_scores(F.col("guess"), F.col("truth")))


@query(
    "j16_references_of_both_sides",
    f"""WITH {_WIN}, f AS (SELECT * FROM win WHERE w >= 22), q AS (SELECT edge_id AS qid, src, dst FROM win WHERE w < 22 AND edge_id % 20 = 0),
    l AS (SELECT qid, 0 AS side, f.t, f.edge_id, label FROM q JOIN f USING (src) UNION ALL SELECT qid, 1, f.t, f.edge_id, label FROM q JOIN f USING (dst)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY side, t, edge_id) AS r FROM l)
    SELECT qid, coalesce(string_agg(label, ',' ORDER BY r) FILTER (r <= 3), '') AS labels FROM q LEFT JOIN r USING (qid) GROUP BY qid""",
)
def _(spark, d):
    """The first three labels to come of a past edge's source, then of its destination; edges whose id is divisible by 20."""
    e = _win(spark, d)
    q = e.where("w < 22 and edge_id % 20 = 0").select(F.col("edge_id").alias("qid"), "src", "dst")
    return history.future_references(q, e.where("w >= 22")).select("qid", F.array_join("labels", ",").alias("labels"))


# Files


def _folder(spark):
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("io9_metric_tree", f"WITH {_REPORT} SELECT model, dataset, CAST(CAST(floor(m1) AS BIGINT) AS VARCHAR) AS m1, CAST(CAST(m2 AS BIGINT) AS VARCHAR) AS m2 FROM report")
def _(spark, d):
    """A metric file for each model and data set; both names come back from the path."""
    root = _folder(spark)
    values = F.struct(F.floor("m1").cast("string").alias("m1"), F.col("m2").cast("long").cast("string").alias("m2"))
    report_rows(spark, d).select("model", "dataset", values.alias("test metrics")).write.partitionBy("model", "dataset").json(root)
    return files.read_metric_tree(spark, root).select("model", "dataset", "m1", "m2")


@query("io19_published", f"WITH {_SOCIAL} SELECT edge_id, src, dst FROM social WHERE src % 2 = 0 AND dst % 3 <> 0")
def _(spark, d):
    """A table rewritten twice under one name, each time from what the name opened before."""
    root = _folder(spark)
    files.publish(_win(spark, d).select("edge_id", "src", "dst"), root)
    files.publish(files.current(spark, root).where("src % 2 = 0"), root)
    files.publish(files.current(spark, root).where("dst % 3 <> 0"), root)
    return files.current(spark, root)


_MARKET = "SELECT l_orderkey, l_linenumber, o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, l_partkey AS id, CAST(floor(epoch(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP))) AS BIGINT) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 7 <> 0"


@query(
    "io14_market_edges",
    f"WITH e AS ({_MARKET}) SELECT src, dst, t, (t - min(t) OVER ()) // 86400 AS w, id, CASE WHEN id % 5 = 0 THEN '' ELSE array_to_string([p_size] || range(0, id % 3), ',') END AS codes FROM e JOIN part ON p_partkey = id",
)
def _(spark, d):
    """Line items as interactions of customers and suppliers, written as the files of a market data set and read again."""
    e, _features = _market(spark, d)
    return e.select("src", "dst", "t", "w", "id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@query("io14_market_features", "SELECT c_custkey * 2 AS node, CAST(3 AS BIGINT) AS n, round(c_acctbal + c_nationkey + length(c_mktsegment), 2) AS total FROM customer")
def _(spark, d):
    _edges, f = _market(spark, d)
    return f.select("node", F.size("features").cast("long").alias("n"), F.round(vec.summed(F.col("features")), 2).alias("total"))


def _market(spark, d):
    root = _folder(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    i = table(spark, d, "lineitem").join(o, "l_orderkey")
    member = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    i.select(member("c", "o_custkey").alias("src_member_id"), member("s", "l_suppkey").alias("dst_member_id"), F.col("l_partkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ds")).write.option("header", True).csv(f"{root}/interactions")
    codes = F.concat(F.array("p_size"), F.when(F.col("p_partkey") % 3 > 0, F.sequence(F.lit(0), (F.col("p_partkey") % 3 - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    table(spark, d, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("id"), codes.alias("codes")).write.json(f"{root}/items")
    customers = table(spark, d, "customer").select(member("c", "c_custkey").alias("member_id"), (F.col("c_custkey") * 2).alias("node"))
    suppliers = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(member("s", "s_suppkey").alias("member_id"), (F.col("s_suppkey") * 2 + 1).alias("node"))
    customers.union(suppliers).write.option("header", True).csv(f"{root}/mapping")
    features = F.concat(F.lit(":"), F.concat_ws(":", F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"), F.length("c_mktsegment").cast("string")))
    table(spark, d, "customer").select(member("c", "c_custkey").alias("member_id"), features.alias("feature_list")).write.option("header", True).csv(f"{root}/members")
    return market.read_market(spark, f"{root}/interactions", f"{root}/items", f"{root}/mapping", f"{root}/members")
