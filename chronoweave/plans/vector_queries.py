"""Vectors, time features, ranks and rewards, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import calendar as cal
from chronoweave.functions import vectors as vec
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, ranks
from chronoweave.plans.queries import _SOCIAL, _TRADE, _WIN, query
from chronoweave.session import table
from chronoweave.sources.tables import DAY, social_edges, trade_edges


def _r(c, n=6):
    return F.round(c, n)


def _win(spark, d):
    return graph.windowed(social_edges(spark, d), DAY)


def _text(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


# Time


@query("dt2_by_frequency", "SELECT event_id, hour(ts) / 23.0 - 0.5 AS hour, (isodow(ts) - 1) / 6.0 - 0.5 AS day_of_week, (day(ts) - 1) / 30.0 - 0.5 AS day_of_month, (dayofyear(ts) - 1) / 365.0 - 0.5 AS day_of_year FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *cal.features("h", F.col("ts")))


@query("dt3_raw", "SELECT event_id, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS weekday, hour(ts) AS hour, minute(ts) // 15 AS quarter FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[c.cast("long") for c in cal.raw(F.col("ts"))]).toDF("event_id", "month", "day", "weekday", "hour", "quarter")


@query("dt5_time_encoding", f"WITH {_SOCIAL}, g AS (SELECT edge_id, t - lag(t, 1, t) OVER (PARTITION BY src ORDER BY t, edge_id) AS dt FROM social) SELECT edge_id, " + ", ".join(f"round(cos({10.0 ** (-3 * i)!r} * dt), 6) AS c{i}" for i in range(4)) + " FROM g")
def _(spark, d):
    g = social_edges(spark, d).select("edge_id", (F.col("t") - F.lag("t", 1).over(Window.partitionBy("src").orderBy("t", "edge_id"))).alias("dt"))
    e = vec.time_encoding(F.coalesce("dt", F.lit(0)), 4)
    return g.select("edge_id", *[_r(e[i]).alias(f"c{i}") for i in range(4)])


@query("dt6_min_max_time", f"WITH {_SOCIAL} SELECT edge_id, round((t - lo) / (hi - lo + 1e-6), 9) AS scaled FROM social, (SELECT min(t) AS lo, max(t) AS hi FROM social)")
def _(spark, d):
    e = social_edges(spark, d)
    span = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return e.join(F.broadcast(span)).select("edge_id", _r((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 9).alias("scaled"))


# Vectors

_LONG = "l AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query("v4_min_max_dims", f"WITH {_LONG}, m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM l GROUP BY i) SELECT vec_id, round(sum(coalesce((x - lo) / nullif(hi - lo, 0), 0)), 6) AS total, round(max(coalesce((x - lo) / nullif(hi - lo, 0), 0)), 6) AS most FROM l JOIN m USING (i) GROUP BY vec_id")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    dims = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    spans = dims.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("m"))  # one row for each dimension
    scaled = F.zip_with("embedding", "m", lambda x, m: F.coalesce((x.cast("double") - m["lo"]) / F.nullif(m["hi"] - m["lo"], F.lit(0.0)), F.lit(0.0)))
    return v.join(F.broadcast(spans)).select("vec_id", scaled.alias("s")).select("vec_id", _r(vec.summed(F.col("s"))).alias("total"), _r(F.array_max("s")).alias("most"))


_DEG = f"{_WIN}, k AS (SELECT src, w, count(*) AS n, count(DISTINCT dst) AS u FROM win GROUP BY src, w)"


@query("v5_log_degrees", f"WITH {_DEG} SELECT src, w, round(ln(1 + n + 1e-10), 6) AS log_degree, round(ln(1 + u + 1e-10), 6) AS log_unique, round(exp(ln(1 + n)) - 1, 6) AS back FROM k")
def _(spark, d):
    k = graph.window_degrees(social_edges(spark, d), DAY)
    return k.select("src", "w", _r(F.log1p(F.col("degree") + 1e-10)).alias("log_degree"), _r(F.log1p(F.col("unique_degree") + 1e-10)).alias("log_unique"), _r(F.expm1(F.log1p("degree"))).alias("back"))


@query("v6_softmax", f"WITH {_LONG}, e AS (SELECT vec_id, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM l) SELECT vec_id, round(max(e) / sum(e), 6) AS most, round(min(e) / sum(e), 6) AS least FROM e GROUP BY vec_id")
def _(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", vec.softmax(F.col("embedding")).alias("s"))
    return s.select("vec_id", _r(F.array_max("s")).alias("most"), _r(F.array_min("s")).alias("least"))


@query(
    "v7_similarity_statistics",
    f"WITH {_LONG}, p AS (SELECT sum(a.x * b.x) AS dot FROM l a JOIN l b ON a.i = b.i GROUP BY a.vec_id, b.vec_id) SELECT round(avg(dot), 6) AS mean, round(stddev_pop(dot), 6) AS std FROM p",
)
def _(spark, d):
    """Mean and deviation of all pairs' dot products from the Gram matrix of dimensions, without the pairs."""
    e = table(spark, d, "embeddings").select("embedding")
    n = e.agg(F.count("*").cast("double").alias("n"))
    x = e.select(F.posexplode("embedding").alias("i", "x"))
    mean = x.groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("first"))
    pairs = e.select(F.posexplode("embedding").alias("i", "x"), "embedding").select("i", "x", F.posexplode("embedding").alias("j", "y"))
    gram = pairs.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias("second"))
    one = mean.join(F.broadcast(gram)).join(F.broadcast(n))
    m = F.col("first") / (F.col("n") * F.col("n"))
    return one.select(_r(m).alias("mean"), _r(F.sqrt(F.col("second") / (F.col("n") * F.col("n")) - m * m)).alias("std"))


_CENTRES = f"{_LONG}, c AS (SELECT label, i, avg(x) AS y FROM l GROUP BY label, i)"


@query(
    "v8_label_search",
    f"WITH {_CENTRES}, s AS (SELECT vec_id, c.label, sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-8) AS sim FROM l JOIN c USING (i) GROUP BY vec_id, c.label) SELECT vec_id, label, round(sim, 6) AS sim, 1 - sim < 1e-5 AS exact FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, label) AS r FROM s) WHERE r = 1",
)
def _(spark, d):
    """The label whose mean vector is nearest; the labels, few whatever the vectors, go to each row as one array."""
    e = table(spark, d, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("y"))
    centres = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda z: z["y"]).alias("c"))
    found = e.select("vec_id", "embedding").join(F.broadcast(centres)).select("vec_id", "label", vec.cosine(F.col("embedding"), F.col("c")).alias("sim"))
    best = found.groupBy("vec_id").agg(F.min(F.struct((-_r(F.col("sim"), 9)).alias("o"), "label", "sim")).alias("b"))
    return best.select("vec_id", "b.label", _r(F.col("b.sim")).alias("sim"), (1 - F.col("b.sim") < 1e-5).alias("exact"))


@query("v10_assembled_features", f"WITH {_DEG} SELECT src, w, 2 + coalesce(len(embedding), 0) AS width, round(ln(1 + n + 1e-10) + ln(1 + u + 1e-10) + coalesce(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 0), 5) AS total FROM k LEFT JOIN embeddings ON vec_id = src")
def _(spark, d):
    k = graph.window_degrees(social_edges(spark, d), DAY)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("src"), F.col("embedding").cast("array<double>").alias("v"))
    none = F.expr("cast(array() as array<double>)")
    f = k.join(v, "src", "left").select("src", "w", F.concat(F.array(F.log1p(F.col("degree") + 1e-10), F.log1p(F.col("unique_degree") + 1e-10)), F.coalesce("v", none)).alias("f"))
    return f.select("src", "w", F.size("f").cast("long").alias("width"), _r(vec.summed(F.col("f")), 5).alias("total"))


_LISTS = f"{_SOCIAL}, h AS (SELECT src, list(dst ORDER BY t, edge_id) AS h FROM social GROUP BY src)"


def _bounded(spark, d, k, newest=False):
    """(src, h): the first ``k`` destinations of each source, or its last ones, in order; others go before they are shuffled."""
    e = social_edges(spark, d)
    order = [F.desc("t"), F.desc("edge_id")] if newest else ["t", "edge_id"]
    few = e.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where(F.col("r") <= k)
    h = few.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("t", "edge_id", "dst"))).alias("h"))
    return h.select("src", F.transform("h", lambda x: x["dst"]).alias("h"))


def _counted(spark, d):
    return social_edges(spark, d).groupBy("src").agg(F.count("*").alias("n"), F.max_by("dst", F.struct("t", "edge_id")).alias("next"))


@query("v11_padded_lists", f"WITH {_LISTS} SELECT src, array_to_string((h[:-2] || list_resize([]::BIGINT[], 40, -1))[:40], ',') AS past, h[-1] AS next FROM h")
def _(spark, d):
    """All but the last item, padded to 40 with -1, and the last as what is to be predicted."""
    past = F.slice("h", F.lit(1), F.least(F.size("h"), F.col("n") - 1).cast("int"))
    return _bounded(spark, d, 40).join(_counted(spark, d), "src").select("src", _text(vec.padded(past, 40, F.lit(-1).cast("long"))).alias("past"), "next")


@query("v12_multi_hot", "SELECT vec_id, array_to_string(([i FOR i IN range(1, 65) IF embedding[i] > 0.2] || list_resize([]::BIGINT[], 6, 0))[:6], ',') AS places FROM embeddings")
def _(spark, d):
    places = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long")), lambda i: F.get("embedding", i.cast("int") - 1) > 0.2)
    return table(spark, d, "embeddings").select("vec_id", _text(vec.padded(places, 6, F.lit(0).cast("long"))).alias("places"))


@query("v13_clipped_edges", f"WITH {_LISTS} SELECT src, array_to_string((h || list_resize([]::BIGINT[], 16, 0))[:16], ',') AS edges, least(len(h), 16) AS n FROM h")
def _(spark, d):
    return _bounded(spark, d, 16).select("src", _text(vec.padded(F.col("h"), 16, F.lit(0).cast("long"))).alias("edges"), F.size("h").cast("long").alias("n"))


@query("v14_patched", f"WITH {_LISTS}, s AS (SELECT src, [src] || h[greatest(len(h) - 30, 1) :] AS s FROM h) SELECT src, len(s) AS n, array_to_string(s || list_resize([]::BIGINT[], (8 - len(s) % 8) % 8, 0), ',') AS patches FROM s")
def _(spark, d):
    """The node itself, then its last 31 partners, padded to a multiple of eight."""
    s = _bounded(spark, d, 31, newest=True).select("src", F.concat(F.array("src"), "h").alias("s"))
    pad = F.array_repeat(F.lit(0).cast("long"), F.pmod(8 - F.size("s") % 8, F.lit(8)))
    return s.select("src", F.size("s").cast("long").alias("n"), _text(F.concat("s", pad)).alias("patches"))


# Rewards

_HIT = f"""{_WIN}, p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS r FROM win WHERE w < 22 GROUP BY src, dst), g AS (SELECT DISTINCT src, dst FROM win WHERE w >= 22),
    o AS (SELECT g.src, count(*) AS truth, count(r) FILTER (r <= 10) AS hits FROM g LEFT JOIN p ON p.src = g.src AND p.dst = g.dst GROUP BY g.src)"""


def _hits(spark, d, k=10):
    e = _win(spark, d)
    past = e.where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n"))
    past = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where(F.col("r") <= k).select("src", "dst", F.lit(1).alias("hit"))
    return e.where("w >= 22").select("src", "dst").distinct().join(past, ["src", "dst"], "left").groupBy("src").agg(F.count("*").alias("truth"), F.count("hit").alias("hits"))


@query("v15_curriculum_reward", f"WITH {_HIT} SELECT src, hits / 10 + 2.5 * (hits / truth) AS reward FROM o")
def _(spark, d):
    return _hits(spark, d).select("src", vec.curriculum(F.col("hits") / 10, F.col("hits") / F.col("truth"), 250).alias("reward"))


@query("v16_retrieval_reward", f"WITH {_HIT}, s AS (SELECT avg(hits) AS m, stddev_pop(hits) AS s FROM o) SELECT src, CAST(trunc(20 * (hits / truth) + 10 * CAST(hits > 0 AS INT) + 20 * (hits - m) / (s + 1e-6)) AS BIGINT) AS reward FROM o, s")
def _(spark, d):
    o = _hits(spark, d)
    s = o.agg(F.avg("hits").alias("m"), F.stddev_pop("hits").alias("s"))
    z = (F.col("hits") - F.col("m")) / (F.col("s") + 1e-6)
    return o.join(F.broadcast(s)).select("src", (20 * (F.col("hits") / F.col("truth")) + 10 * (F.col("hits") > 0).cast("int") + 20 * z).cast("long").alias("reward"))


@query(
    "v17_sequence_reward",
    f"""WITH {_HIT}, {_LONG}, q AS (SELECT src, dst FROM p WHERE r <= 10), dd AS (SELECT q.src, q.dst, sum(a.x * b.x) AS dot FROM q JOIN l a ON a.vec_id = q.src JOIN l b ON b.vec_id = q.dst AND a.i = b.i GROUP BY ALL),
    m AS (SELECT src, avg(dot) AS dot FROM dd GROUP BY src) SELECT o.src, round(0.7 * CAST(hits > 0 AS INT) + 0.3 * coalesce(dot, 0), 6) AS reward FROM o LEFT JOIN m USING (src)""",
)
def _(spark, d):
    past = _win(spark, d).where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n"))
    q = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 10")
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = q.join(v.toDF("src", "x"), "src").join(v.toDF("dst", "y"), "dst")
    m = q.groupBy("src").agg(F.avg(vec.dot(F.col("x"), F.col("y"))).alias("dot"))
    return _hits(spark, d).join(m, "src", "left").select("src", _r(0.7 * (F.col("hits") > 0).cast("int") + 0.3 * F.coalesce("dot", F.lit(0.0))).alias("reward"))


@query(
    "v18_token_losses",
    """WITH x AS (SELECT l_orderkey, l_linenumber, -l_tax AS logp, -l_discount AS old, l_quantity - 25 AS a FROM lineitem), r AS (SELECT *, exp(logp - old) AS ratio FROM x),
    c AS (SELECT *, greatest(-a * ratio, -a * least(greatest(ratio, 0.98), 1.02)) AS loss FROM r)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN a < 0 THEN least(loss, -a * 1.05) ELSE loss END, 9) AS loss, round(exp(old - logp) - (old - logp) - 1, 9) AS kl FROM c""",
)
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_tax")).alias("logp"), (-F.col("l_discount")).alias("old"), (F.col("l_quantity") - 25).alias("a"))
    return x.select("l_orderkey", "l_linenumber", _r(vec.clipped_ratio(F.col("logp"), F.col("old"), F.col("a"), 0.02, 1.05), 9).alias("loss"), _r(vec.k3(F.col("logp"), F.col("old")), 9).alias("kl"))


@query(
    "a28_rewards_by_id",
    f"WITH {_WIN}, r AS (SELECT dst AS id, sum(1.0::DOUBLE) FILTER (w < 22) AS candidate, sum(2.0::DOUBLE) FILTER (w >= 22) AS selected FROM win GROUP BY dst), s AS (SELECT id, coalesce(candidate, 0) + coalesce(selected, 0) AS reward FROM r), e AS (SELECT *, exp((reward - max(reward) OVER ()) / 10) AS e FROM s) SELECT id, reward, round(e / sum(e) OVER (), 9) AS weight FROM e",
)
def _(spark, d):
    s = _win(spark, d).groupBy(F.col("dst").alias("id")).agg(F.sum(F.when(F.col("w") < 22, 1.0).otherwise(2.0)).alias("reward"))
    e = s.join(F.broadcast(s.agg(F.max("reward").alias("most")))).withColumn("e", F.exp((F.col("reward") - F.col("most")) / 10)).select("id", "reward", "e")
    return e.join(F.broadcast(e.agg(F.sum("e").alias("all")))).select("id", "reward", _r(F.col("e") / F.col("all"), 9).alias("weight"))


# Ranks and distributions

_K = _TRADE + ", k AS (SELECT src, count(*) AS k FROM trade GROUP BY src), g AS (SELECT dst, count(*) AS k FROM trade GROUP BY dst)"


def _pair(spark, d):
    t = trade_edges(spark, d)
    return t.groupBy("src").agg(F.count("*").alias("k")), t.groupBy("dst").agg(F.count("*").alias("k"))


@query("w16_cumulative", f"WITH {_K}, h AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT k, n, round(sum(n) OVER (ORDER BY k) / sum(n) OVER (), 9) AS share FROM h")
def _(spark, d):
    h = _pair(spark, d)[0].groupBy("k").agg(F.count("*").alias("n"))
    return dist.running_sums(h, "k", "n").join(F.broadcast(h.agg(F.sum("n").alias("_t")))).select("k", "n", _r((F.col("n_before") + F.col("n")) / F.col("_t"), 9).alias("share"))


_MAP = f"""WITH {_K}, r AS (SELECT src, k, {{rank}} AS q FROM k), g2 AS (SELECT k AS v, row_number() OVER (ORDER BY k, dst) - 1 AS i FROM g), m AS (SELECT count(*) AS m FROM g),
    p AS (SELECT src, k, {{clip}} AS pos FROM r, m) SELECT p.src, p.k, round(lo.v + (hi.v - lo.v) * (pos - floor(pos)), 6) AS mapped FROM p JOIN g2 lo ON lo.i = floor(pos) JOIN g2 hi ON hi.i = ceil(pos)"""


@query("w17_quantile_mapped", _MAP.format(rank="(rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0) / (SELECT count(*) FROM k)", clip="q * (m - 1)"))
def _(spark, d):
    """Values moved to the target's distribution by their mean rank."""
    have, target = _pair(spark, d)
    return ranks.mapped(have, "k", target.select("k"), "k", ties="mean").select("src", "k", _r(F.col("mapped")).alias("mapped"))


@query("w18_ordinal_mapped", _MAP.format(rank="(row_number() OVER (ORDER BY k, src) - 1) / greatest((SELECT count(*) FROM k) - 1, 1)", clip="q * (m - 1)"))
def _(spark, d):
    have, target = _pair(spark, d)
    return ranks.mapped(have, "k", target.select("k"), "k", ties="src").select("src", "k", _r(F.col("mapped")).alias("mapped"))


@query("w19_rescaled", f"WITH {_WIN}, a AS (SELECT src, count(*) AS n FROM win WHERE w < 22 GROUP BY src), b AS (SELECT count(*) AS n FROM win WHERE w >= 22) SELECT src, CAST(trunc(a.n * (b.n / (SELECT sum(n) FROM a))) AS BIGINT) AS scaled FROM a, b")
def _(spark, d):
    e = _win(spark, d)
    a = e.where("w < 22").groupBy("src").agg(F.count("*").alias("n"))
    share = a.agg(F.sum("n").alias("_a")).join(F.broadcast(e.where("w >= 22").agg(F.count("*").alias("_b"))))
    return a.join(F.broadcast(share)).select("src", (F.col("n") * (F.col("_b") / F.col("_a"))).cast("long").alias("scaled"))


@query(
    "w20_level_and_rate",
    f"WITH {_K}, q AS (SELECT [quantile_cont(k, 0.0), quantile_cont(k, 0.25), quantile_cont(k, 0.5), quantile_cont(k, 0.75), quantile_cont(k, 1.0)] AS c FROM k), l AS (SELECT src, k, c, greatest(1, least(4, len([x FOR x IN c IF x <= k]))) AS level FROM k, q) SELECT src, level, round(coalesce((k - c[level]) / nullif(c[level + 1] - c[level], 0), 0), 9) AS rate, round(c[level] + coalesce((k - c[level]) / nullif(c[level + 1] - c[level], 0), 0) * (c[level + 1] - c[level]), 6) AS back FROM l",
)
def _(spark, d):
    """Which quarter of the degrees a degree stands in, how far into it, and the degree from these."""
    k = _pair(spark, d)[0]
    q = dist.quantiles(k, "k", {f"q{i}": i / 4 for i in range(5)})
    c = q.select(F.array(*q.columns).alias("c"))
    x = k.join(F.broadcast(c)).withColumn("level", F.greatest(F.lit(1), F.least(F.lit(4), F.size(F.filter("c", lambda v: v <= F.col("k"))))))
    low, high = F.element_at("c", F.col("level")), F.element_at("c", F.col("level") + 1)
    rate = F.coalesce((F.col("k") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    return x.select("src", F.col("level").cast("long").alias("level"), _r(rate, 9).alias("rate"), _r(low + rate * (high - low)).alias("back"))
