"""Report algebra, projections, sampling and retrieval assembly, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import vectors as vec
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, reports, retrieval
from chronoweave.plans.queries import _REPORT, _SOCIAL, _WIN, query
from chronoweave.session import stored, table
from chronoweave.sources.tables import DAY, report_rows, social_edges


def _r(c, n=6):
    return F.round(c, n)


_NORM = _REPORT + ", s AS (SELECT *, coalesce((m1 - min(m1) OVER w) / nullif(max(m1) OVER w - min(m1) OVER w, 0), 0) AS m1_scaled, coalesce((m2 - min(m2) OVER w) / nullif(max(m2) OVER w - min(m2) OVER w, 0), 0) AS m2_scaled FROM report WINDOW w AS (PARTITION BY dataset))"


@query("a2_rounded_means", "SELECT o_orderpriority AS k, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(_r(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))


@query("a12_pivot_difference", "SELECT o_orderpriority AS k, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS gap FROM orders GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).pivot("o_orderstatus", ["F", "O"]).count()
    return p.select("k", (F.coalesce("F", F.lit(0)) - F.coalesce("O", F.lit(0))).alias("gap"))


@query("a20_prompt_lengths", "SELECT role, round(avg(length(text)), 6) AS mean, max(length(text)) AS most FROM conversations GROUP BY role")
def _(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").groupBy("role").agg(_r(F.avg(n)).alias("mean"), F.max(n).cast("long").alias("most"))


@query("w3_w4_rank_scores", f"WITH {_REPORT}, r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY m1 DESC) AS r1, rank() OVER (PARTITION BY dataset ORDER BY m2 DESC) AS r2 FROM report) SELECT model, dataset, r1 + r2 AS total, (r1 + r2) / 2 AS mean FROM r")
def _(spark, d):
    r = reports.ranked(reports.ranked(report_rows(spark, d), "m1"), "m2")
    total = F.col("m1_rank") + F.col("m2_rank")
    return r.select("model", "dataset", total.alias("total"), (total / 2).alias("mean"))


@query("w7_best_two", f"WITH {_REPORT}, v AS (SELECT dataset, m1, row_number() OVER (PARTITION BY dataset ORDER BY m1 DESC) AS r FROM report) SELECT model, report.dataset, CASE WHEN abs(report.m1 - a.m1) < 1e-6 THEN 'bold' WHEN abs(report.m1 - b.m1) < 1e-6 THEN 'underline' ELSE '' END AS mark FROM report JOIN v a ON a.dataset = report.dataset AND a.r = 1 LEFT JOIN v b ON b.dataset = report.dataset AND b.r = 2")
def _(spark, d):
    return reports.marked(report_rows(spark, d), "m1").select("model", "dataset", "mark")


@query("w8_model_order", f"WITH {_REPORT} SELECT model, dataset, coalesce(nullif(list_position(['7', '3', '11'], model), 0), 4) AS place FROM report")
def _(spark, d):
    place = F.array_position(F.array(*map(F.lit, ["7", "3", "11"])), F.col("model"))
    return report_rows(spark, d).select("model", "dataset", F.when(place > 0, place).otherwise(4).alias("place"))


@query("rp3_composite_score", f"WITH {_NORM} SELECT model, dataset, round(0.5 * m1_scaled + 0.5 * m2_scaled, 6) AS score, rank() OVER (PARTITION BY dataset ORDER BY round(0.5 * m1_scaled + 0.5 * m2_scaled, 6) DESC) AS place FROM s")
def _(spark, d):
    return _composite(spark, d, 0.5, 0.5)


@query("rp6_weighted_score", f"WITH {_NORM} SELECT model, dataset, round(0.4 * m1_scaled + 0.6 * (1 - m2_scaled), 6) AS score, rank() OVER (PARTITION BY dataset ORDER BY round(0.4 * m1_scaled + 0.6 * (1 - m2_scaled), 6) DESC) AS place FROM s")
def _(spark, d):
    return _composite(spark, d, 0.4, 0.6, reverse=True)


def _composite(spark, d, a, b, reverse=False):
    s = reports.min_max(reports.min_max(report_rows(spark, d), "m1"), "m2", reverse=reverse)
    s = s.select("model", "dataset", _r(a * F.col("m1_scaled") + b * F.col("m2_scaled")).alias("score"))
    return reports.ranked(s, "score").withColumnRenamed("score_rank", "place")


@query("rp4_top_models", f"WITH {_NORM}, t AS (SELECT model, dataset, round(0.5 * m1_scaled + 0.5 * m2_scaled, 6) AS score FROM s) SELECT dataset, model, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) AS r FROM t) WHERE r = 1")
def _(spark, d):
    return reports.best(_composite(spark, d, 0.5, 0.5), "score")


@query("j1_j2_three_way", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("j4_frequent_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(o.groupBy("o_custkey").count().where("count >= 5"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("j5_lookup", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("j8_edge_lists", f"WITH {_SOCIAL} SELECT src, dst, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS edges FROM social GROUP BY src, dst")
def _(spark, d):
    edges = F.array_join(F.transform(F.array_sort(F.collect_list("edge_id")), lambda x: x.cast("string")), ",")
    return social_edges(spark, d).groupBy("src", "dst").agg(edges.alias("edges"))


@query("pf3_dense_ids", f"WITH {_SOCIAL}, f AS (SELECT src, min(edge_id) AS e FROM social GROUP BY src) SELECT src, row_number() OVER (ORDER BY e) AS id FROM f")
def _(spark, d):
    f = social_edges(spark, d).groupBy("src").agg(F.min("edge_id").alias("e"))
    return reports.dense_ids(f, "e").select("src", "id")


@query("pf9_renamed", f"WITH {_REPORT} SELECT model, dataset, CASE WHEN regexp_matches(model, '^1[0-9]$') THEN 'teen' WHEN starts_with(model, '2') THEN 'two' ELSE model END AS name FROM report")
def _(spark, d):
    m = F.col("model")
    return report_rows(spark, d).select("model", "dataset", F.when(m.rlike("^1[0-9]$"), "teen").when(m.startswith("2"), "two").otherwise(m).alias("name"))


@query("pf10_replaced", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).replace({"F": "final", "O": "open"}, subset=["status"])


@query("pf11_pf12_cleaned", "SELECT doc_id, coalesce(trim(source), 'Unknown') AS source, coalesce(TRY_CAST(left(text, 2) AS DOUBLE), 0) AS number FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.trim("source"), F.lit("Unknown")).alias("source"), F.coalesce(F.substring("text", 1, 2).try_cast("double"), F.lit(0.0)).alias("number"))


@query(
    "pf14_interpolated",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    x AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER a AS r0, first_value(v IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER b AS r1 FROM e
    WINDOW a AS (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (r - r0) / (r1 - r0) END, 6) AS value FROM x""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return reports.interpolated(e, "v", ["user_id"], ["ts", "event_id"]).select("event_id", _r("v_filled").alias("value"))


@query("pf16_number_lists", "SELECT l_orderkey, l_linenumber, l_partkey, round(list_sum(list_transform(string_split(CAST(l_quantity AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ':'), lambda x: CAST(x AS DOUBLE))), 6) AS total FROM lineitem")
def _(spark, d):
    text = F.concat(F.lit(":"), F.col("l_quantity").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit(":"))
    values = F.transform(F.split(F.btrim(text, F.lit(":")), ":"), lambda x: x.cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _r(F.aggregate(values, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("pf17_id_domain", f"WITH {_SOCIAL} SELECT unnest(generate_series(min(dst), max(dst))) AS id FROM social")
def _(spark, d):
    return social_edges(spark, d).agg(F.min("dst").alias("a"), F.max("dst").alias("b")).select(F.explode(F.sequence("a", "b")).alias("id"))


@query("pf22_length_bounds", "SELECT doc_id FROM documents WHERE len([x FOR x IN string_split_regex(text, '[ \\t-\\r]+') IF x <> '']) BETWEEN 6 AND 100")
def _(spark, d):
    n = F.size(F.filter(F.split("text", r"[ \t-\r]+", -1), lambda x: x != ""))
    return table(spark, d, "documents").where(n.between(6, 100)).select("doc_id")


@query("pf24_group_rule", "SELECT event_id FROM (SELECT event_id, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE n = 1 OR (m > 5 AND m < 40) OR s > 30")
def _(spark, d):
    k = ["user_id", "event_type"]
    e = table(spark, d, "events").select("event_id", "value", *k)
    g = e.groupBy(*k).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("n = 1 or (m > 5 and m < 40) or s > 30")
    return e.join(g, k, "left_semi").select("event_id")


@query("s1_union", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("l17_quantile_split", "WITH q AS (SELECT quantile_disc(ts, 0.8) AS q FROM events) SELECT event_id, ts <= q AS train FROM events, q")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    q = dist.quantiles(e, "t", {"q": 0.8}, discrete=True)
    return e.join(F.broadcast(q)).select("event_id", (F.col("t") <= F.col("q")).alias("train"))


@query("w15_strided_windows", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), w AS (SELECT user_id, i // 5 * 5 AS s0, i, event_id FROM e) SELECT user_id, s AS start, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS items FROM (SELECT user_id, s0 AS s, i, event_id FROM w UNION ALL SELECT user_id, s0 - 5, i, event_id FROM w WHERE s0 >= 5) GROUP BY ALL")
def _(spark, d):
    return reports.strided(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id", 10, 5)


@query("w17_quantile_ranks", "SELECT c_custkey, round((rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2) / count(*) OVER (), 9) AS q FROM customer")
def _(spark, d):
    return reports.quantile_rank(table(spark, d, "customer"), "c_nationkey").select("c_custkey", _r("q", 9).alias("q"))


@query("w21_sample_weights", "SELECT doc_id, round(1.5 - (n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER ()), 9) AS weight FROM documents WHERE n_chars IS NOT NULL")
def _(spark, d):
    e = table(spark, d, "documents").select("doc_id", "n_chars").where("n_chars is not null")
    m = e.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return e.join(F.broadcast(m)).select("doc_id", _r(1.5 - (F.col("n_chars") - F.col("lo")) / (F.col("hi") - F.col("lo")), 9).alias("weight"))


@query(
    "w21_batch_weights",
    """WITH l AS (SELECT doc_id, max(1 - quality + toxic) AS difficulty FROM labels GROUP BY doc_id),
    x AS (SELECT doc_id, floor(doc_id / 512.0) AS b, coalesce(n_chars, 0) AS n, CASE WHEN difficulty IS NULL THEN 1.0 ELSE 0.5 + 1.5 * least(greatest(difficulty, 0), 1) END AS dw FROM documents LEFT JOIN l USING (doc_id)),
    y AS (SELECT *, dw * (1.5 - (n - min(n) OVER (PARTITION BY b)) / (max(n) OVER (PARTITION BY b) - min(n) OVER (PARTITION BY b) + 1e-8)) AS w FROM x)
    SELECT doc_id, round(w * count(*) OVER (PARTITION BY b) / (sum(w) OVER (PARTITION BY b) + 1e-8), 6) AS weight FROM y""",
)
def _(spark, d):
    """Batches of 512 neighbouring ids; poor and toxic documents are the hard ones, both at once no harder than one."""
    hard = table(spark, d, "labels").groupBy("doc_id").agg(F.max(1 - F.col("quality") + F.col("toxic")).cast("double").alias("difficulty"))
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(hard, "doc_id", "left").withColumn("batch", F.floor(F.col("doc_id") / 512))
    return reports.batch_weights(rows, "batch", "n_chars", "difficulty").select("doc_id", F.round("weight", 6).alias("weight"))


@query("w22_position_weights", f"WITH {_SOCIAL} SELECT edge_id, CASE WHEN row_number() OVER (PARTITION BY src ORDER BY t, edge_id) <= 3 THEN 1.0 ELSE 0.2 END AS weight FROM social")
def _(spark, d):
    rn = F.row_number().over(Window.partitionBy("src").orderBy("t", "edge_id"))
    return social_edges(spark, d).select("edge_id", F.when(rn <= 3, 1.0).otherwise(0.2).alias("weight"))


_SIM = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(
    "rt_retrieval_composite",
    f"""WITH {_WIN}, past AS (SELECT * FROM win WHERE w < 22), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({_SIM.replace('x.', 'a.').replace('y.', 'b.')}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    f AS (SELECT v AS dst, count(*) AS sf FROM (SELECT src AS v FROM past UNION ALL SELECT dst FROM past) GROUP BY v),
    g AS (SELECT s.*, coalesce(sf, 0) > 100 AS pass FROM s LEFT JOIN f USING (dst)), h AS (SELECT *, count(*) FILTER (pass) OVER (PARTITION BY src) >= 10 AS enough FROM g),
    c AS (SELECT src, dst, sim, 1 AS kind FROM h WHERE pass OR NOT enough UNION ALL SELECT s.src, s.dst, sim, 0 FROM s JOIN (SELECT DISTINCT src, dst FROM past) p ON p.src = s.src AND p.dst = s.dst),
    u AS (SELECT src, dst, min(kind) AS kind, max(sim) AS sim FROM c GROUP BY src, dst)
    SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY kind, sim DESC, dst) AS rank FROM u) WHERE rank <= 50""",
)
def _(spark, d):
    """For sources divisible by 20: past partners first, then candidates over the frequency rule, by similarity."""
    past = graph.windowed(social_edges(spark, d), DAY).where("w < 22")
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    freq = past.select(F.col("src").alias("dst")).union(past.select("dst")).groupBy(F.col("dst").alias("vec_id")).agg(F.count("*").alias("sf"))
    rows = stored(v.join(freq, "vec_id", "left").select("vec_id", "embedding", (F.coalesce("sf", F.lit(0)) > 100).alias("pass")))
    ruled = retrieval.ruled_nearest(v.where("vec_id % 20 = 0"), rows, 50, 10, score=vec.dot)
    met = past.where("src % 20 = 0 and src <> dst").select("src", "dst").distinct()
    met = met.join(v.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x")), "src").join(v.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y")), "dst")
    near = met.select("src", "dst", F.round(vec.dot(F.col("x"), F.col("y")), 6).alias("sim"))
    return retrieval.merged([near, ruled], 50)
