"""Queries over the driver tables, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import text as tx
from chronoweave.functions import vectors as vec
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, reports, retrieval
from chronoweave.operators.components import connected_components
from chronoweave.session import table
from chronoweave.sources.tables import DAY, report_rows, social_edges, trade_edges

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_SOCIAL = """social AS (SELECT event_id AS edge_id, user_id AS src, dst, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS label
  FROM (SELECT *, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND dst <> user_id)"""
_TRADE = "trade AS (SELECT o_custkey AS src, l_suppkey AS dst, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS t, l_returnflag AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_WIN = _SOCIAL + ", win AS (SELECT *, dense_rank() OVER (ORDER BY t // 86400) - 1 AS w FROM social)"
_REPORT = "report AS (SELECT CAST(c_nationkey AS VARCHAR) AS model, c_mktsegment AS dataset, avg(c_acctbal) AS m1, CAST(count(*) AS DOUBLE) AS m2 FROM customer GROUP BY ALL)"
_BOTH = _SOCIAL + ", both_ways AS (SELECT src AS node, dst AS nbr, t, edge_id FROM social UNION ALL SELECT dst, src, t, edge_id FROM social)"
_PAIRS = _SOCIAL + ", p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM social)"
_DOT = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("pf2_social_edges", f"WITH {_SOCIAL} SELECT * FROM social")
def _(spark, d):
    return social_edges(spark, d)


@query("pf4_windows", f"WITH {_WIN} SELECT w, count(*) AS edges FROM win GROUP BY w")
def _(spark, d):
    return graph.windowed(social_edges(spark, d), DAY).groupBy("w").agg(F.count("*").alias("edges"))


@query("a5_a6_window_degrees", f"WITH {_WIN} SELECT src, w, count(*) AS degree, count(DISTINCT dst) AS unique_degree FROM win GROUP BY src, w")
def _(spark, d):
    return graph.window_degrees(social_edges(spark, d), DAY)


@query(
    "a5_dense_degrees",
    f"""WITH {_WIN}, g AS (SELECT * FROM (SELECT DISTINCT src FROM win), (SELECT DISTINCT w FROM win)), k AS (SELECT src, w, count(*) AS n, count(DISTINCT dst) AS u FROM win GROUP BY src, w)
    SELECT src, w, coalesce(n, 0) AS degree, coalesce(u, 0) AS unique_degree FROM g LEFT JOIN k USING (src, w)""",
)
def _(spark, d):
    return graph.dense_degrees(social_edges(spark, d), DAY)


@query(
    "pf5_chronological_split",
    f"""WITH {_WIN}, n AS (SELECT max(w) + 1 AS n FROM win) SELECT CASE WHEN w < n - 8 THEN 'train' WHEN w < n - 4 THEN 'val' ELSE 'test' END AS split, count(*) AS edges, min(t) AS t0, max(t) AS t1 FROM win, n WHERE w >= n - 18 - 8 GROUP BY 1""",
)
def _(spark, d):
    return graph.chronological_split(social_edges(spark, d), DAY, 18, 4).groupBy("split").agg(F.count("*").alias("edges"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query(
    "j7_inductive_mask",
    f"""WITH {_WIN}, seen AS (SELECT src AS v FROM win WHERE w < 22 UNION SELECT dst FROM win WHERE w < 22)
    SELECT edge_id, NOT (src IN (SELECT v FROM seen) AND dst IN (SELECT v FROM seen)) AS new_node FROM win WHERE w >= 22""",
)
def _(spark, d):
    e = graph.windowed(social_edges(spark, d), DAY)
    past = e.where("w < 22")
    seen = past.select(F.col("src").alias("v")).union(past.select("dst")).distinct()
    e = e.where("w >= 22").join(seen.select(F.col("v").alias("src"), F.lit(1).alias("_s")), "src", "left").join(seen.select(F.col("v").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return e.select("edge_id", (F.col("_s").isNull() | F.col("_d").isNull()).alias("new_node"))


@query("j6_unseen_edges", f"WITH {_WIN} SELECT edge_id FROM win v WHERE w >= 22 AND NOT EXISTS (SELECT 1 FROM win x WHERE x.w < 22 AND x.src = v.src AND x.dst = v.dst)")
def _(spark, d):
    e = graph.windowed(social_edges(spark, d), DAY)
    return e.where("w >= 22").join(e.where("w < 22").select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("edge_id")


@query("a10_edge_multiplicity", f"WITH {_TRADE} SELECT src, dst, count(*) AS n FROM trade GROUP BY src, dst")
def _(spark, d):
    return trade_edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    "a22_node_metrics",
    f"""WITH {_BOTH}, pairs AS (SELECT node, nbr, count(*) AS c FROM both_ways GROUP BY ALL)
    SELECT node, CAST(sum(c) AS BIGINT) AS frequency, count(*) AS neighbors, CAST(floor(avg(c)) AS BIGINT) AS avg_frequency,
    (SELECT count(*) FROM social WHERE src = node) AS as_src, (SELECT count(*) FROM social WHERE dst = node) AS as_dst FROM pairs GROUP BY node""",
)
def _(spark, d):
    return graph.node_metrics(social_edges(spark, d))


@query("a24_pair_counts", f"WITH {_BOTH} SELECT node, nbr, count(*) AS cnt FROM both_ways GROUP BY ALL")
def _(spark, d):
    return graph.pair_metrics(social_edges(spark, d))


@query(
    "a25_neighbor_frequency",
    f"WITH {_BOTH}, f AS (SELECT node, count(*) AS c FROM both_ways GROUP BY node) SELECT p.node, avg(f.c) AS nbr_frequency FROM (SELECT DISTINCT node, nbr FROM both_ways) p JOIN f ON f.node = p.nbr GROUP BY p.node",
)
def _(spark, d):
    return graph.neighbor_frequency(social_edges(spark, d))


@query("a27_adjacency_lists", f"WITH {_SOCIAL} SELECT src, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS edges FROM social GROUP BY src")
def _(spark, d):
    return social_edges(spark, d).groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("edge_id")), lambda x: x.cast("string")), ",").alias("edges"))


@query("a47_time_shifts", f"WITH {_SOCIAL} SELECT round(avg(s), 4) AS mean_shift, round(stddev_pop(s), 4) AS std_shift FROM (SELECT t - lag(t, 1, 0) OVER (PARTITION BY src ORDER BY t, edge_id) AS s FROM social)")
def _(spark, d):
    s = social_edges(spark, d).select((F.col("t") - F.lag("t", 1, 0).over(Window.partitionBy("src").orderBy("t", "edge_id"))).alias("s"))
    return s.agg(F.round(F.avg("s"), 4).alias("mean_shift"), F.round(F.stddev_pop("s"), 4).alias("std_shift"))


@query("a48_last_message", f"WITH {_BOTH} SELECT node, arg_max(nbr, (t, edge_id)) AS nbr, max(t) AS t FROM both_ways GROUP BY node")
def _(spark, d):
    return graph.both_ways(social_edges(spark, d)).groupBy("node").agg(F.max_by("nbr", F.struct("t", "edge_id")).alias("nbr"), F.max("t").alias("t"))


@query("gr1_gr3_degree_motifs", f"WITH {_TRADE}, k AS (SELECT dst, count(*) AS k FROM trade GROUP BY dst) SELECT max(k) AS max_degree, min(k) AS min_degree, sum(k * (k - 1) / 2) AS wedges, sum(k * (k - 1) * (k - 2) / 6) AS claws FROM k")
def _(spark, d):
    return graph.degree_motifs(trade_edges(spark, d))


@query("gr4_triangles", f"WITH {_PAIRS} SELECT count(*) AS triangles FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b")
def _(spark, d):
    return graph.triangles(social_edges(spark, d)).agg(F.count("*").alias("triangles"))


@query(
    "gr16_local_clustering",
    f"""WITH {_PAIRS}, k AS (SELECT v AS node, count(*) AS k FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY v),
    t AS (SELECT unnest([x.a, x.b, y.b]) AS node FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b), c AS (SELECT node, count(*) AS n FROM t GROUP BY node)
    SELECT node, k, coalesce(n, 0) AS triangles, CASE WHEN k < 2 THEN 0.0 ELSE 2.0 * coalesce(n, 0) / (k * (k - 1)) END AS clustering FROM k LEFT JOIN c USING (node)""",
)
def _(spark, d):
    return graph.local_clustering(social_edges(spark, d))


@query(
    "gr8_components",
    f"""WITH RECURSIVE {_SOCIAL}, e AS (SELECT DISTINCT src AS a, dst AS b FROM social), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS c FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.c = s.a) SELECT node, min(c) AS component FROM r GROUP BY node""",
)
def _(spark, d):
    return connected_components(social_edges(spark, d))


@query("gr9_pagerank")
def _(spark, d):
    return graph.pagerank(social_edges(spark, d)).select("node", F.round("rank", 9).alias("rank"))


@query("l4_top_hubs", f"WITH {_SOCIAL} SELECT src, count(*) AS degree FROM social GROUP BY src ORDER BY degree DESC, src LIMIT 20")
def _(spark, d):
    return graph.top_hubs(social_edges(spark, d), 20)


@query("gr12_power_law", f"WITH {_SOCIAL}, k AS (SELECT count(*) AS k FROM social GROUP BY src) SELECT 1 + count(*) / sum(ln(k / 1.5)) AS alpha, count(*) AS n FROM k WHERE k >= 2")
def _(spark, d):
    return graph.power_law(social_edges(spark, d))


@query(
    "gr11_edge_overlap",
    f"WITH {_WIN}, g AS (SELECT DISTINCT src, dst FROM win WHERE w < 15), p AS (SELECT DISTINCT src, dst FROM win WHERE w >= 15) SELECT (SELECT count(*) FROM g JOIN p USING (src, dst)) / (SELECT count(*) FROM g) AS overlap",
)
def _(spark, d):
    e = graph.windowed(social_edges(spark, d), DAY)
    g = e.where("w < 15").select("src", "dst").distinct().withColumn("g", F.lit(1))
    p = e.where("w >= 15").select("src", "dst").distinct().withColumn("p", F.lit(1))
    return g.join(p, ["src", "dst"], "left").agg((F.count("p") / F.count("g")).alias("overlap"))


@query(
    "j9_as_of_neighbors",
    f"""WITH {_BOTH}, q AS (SELECT edge_id AS qid, src AS node, t FROM social)
    SELECT qid, node, t, nbr, nbr_t, rank FROM (SELECT q.qid, q.node, q.t, b.nbr, b.t AS nbr_t, row_number() OVER (PARTITION BY q.qid ORDER BY b.t DESC, b.edge_id DESC, b.nbr DESC) AS rank
    FROM q JOIN both_ways b ON b.node = q.node AND b.t < q.t) WHERE rank <= 5""",
)
def _(spark, d):
    e = social_edges(spark, d)
    return graph.as_of_neighbors(e, e.select(F.col("edge_id").alias("qid"), F.col("src").alias("node"), "t"), 5)


def _bank(spark, d, **how):
    e = graph.windowed(social_edges(spark, d), DAY)
    return graph.edgebank(e.where("w < 22").select("src", "dst", "t"), e.where("w >= 22").select("edge_id", "src", "dst"), **how).select("edge_id", "score")


_EB = "SELECT edge_id, CASE WHEN m.src IS NULL THEN 0.0 ELSE 1.0 END AS score FROM (SELECT * FROM win WHERE w >= 22) v LEFT JOIN ({}) m ON m.src = v.src AND m.dst = v.dst"


@query("gr41_edgebank_unlimited", f"WITH {_WIN} " + _EB.format("SELECT DISTINCT src, dst FROM win WHERE w < 22"))
def _(spark, d):
    return _bank(spark, d)


@query("gr41_edgebank_repeat", f"WITH {_WIN}, f AS (SELECT src, dst, count(*) AS n FROM win WHERE w < 22 GROUP BY ALL) " + _EB.format("SELECT src, dst FROM f WHERE n >= (SELECT avg(n) FROM f)"))
def _(spark, d):
    return _bank(spark, d, repeat=True)


@query(
    "j13_common_neighbors",
    f"WITH {_PAIRS}, s AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), e AS (SELECT a, b FROM p) SELECT e.a, e.b, count(y.v) AS common FROM e JOIN s x ON x.u = e.a LEFT JOIN s y ON y.u = e.b AND y.v = x.v GROUP BY ALL",
)
def _(spark, d):
    p = graph.simple_pairs(social_edges(spark, d))
    return p.join(graph.triangles_by_pair(social_edges(spark, d)), ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0).cast("long")).alias("common"))


@query("a15_a16_difficulty", f"WITH {_SOCIAL}, k AS (SELECT src, count(DISTINCT dst) AS n FROM social GROUP BY src), q AS (SELECT quantile_cont(n, 0.3) AS lo, quantile_cont(n, 0.7) AS hi FROM k) SELECT src, n, CASE WHEN n <= lo THEN 3 WHEN n <= hi THEN 2 ELSE 1 END AS difficulty FROM k, q")
def _(spark, d):
    k = social_edges(spark, d).groupBy("src").agg(F.countDistinct("dst").alias("n"))
    q = dist.quantiles(k, "n", {"lo": 0.3, "hi": 0.7})
    return k.join(F.broadcast(q)).select("src", "n", F.when(F.col("n") <= F.col("lo"), 3).when(F.col("n") <= F.col("hi"), 2).otherwise(1).alias("difficulty"))


@query("a11_value_counts", "SELECT event_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM events GROUP BY event_type")
def _(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("a1_group_mean", f"WITH {_REPORT} SELECT dataset, avg(m1) AS m1, avg(m2) AS m2 FROM report GROUP BY dataset")
def _(spark, d):
    return report_rows(spark, d).groupBy("dataset").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))


@query("a13_pivot", "SELECT c_mktsegment AS dataset, " + ", ".join(f"avg(c_acctbal) FILTER (n_regionkey = {r}) AS m_{r}" for r in range(5)) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.groupBy(F.col("c_mktsegment").alias("dataset")).pivot("n_regionkey", list(range(5))).agg(F.avg("c_acctbal"))
    return p.select("dataset", *[F.col(str(r)).alias(f"m_{r}") for r in range(5)])


@query("w5_min_max", f"WITH {_REPORT} SELECT *, coalesce((m1 - min(m1) OVER w) / nullif(max(m1) OVER w - min(m1) OVER w, 0), 0) AS m1_scaled FROM report WINDOW w AS (PARTITION BY dataset)")
def _(spark, d):
    return reports.min_max(report_rows(spark, d), "m1")


@query("w1_rank", f"WITH {_REPORT} SELECT *, rank() OVER (PARTITION BY dataset ORDER BY m2 DESC) AS m2_rank FROM report")
def _(spark, d):
    return reports.ranked(report_rows(spark, d), "m2")


@query("w2_rank_max", f"WITH {_REPORT} SELECT *, rank() OVER (PARTITION BY dataset ORDER BY m2) + count(*) OVER (PARTITION BY dataset, m2) - 1 AS m2_rank FROM report")
def _(spark, d):
    return reports.ranked(report_rows(spark, d), "m2", ascending=True, method="max")


@query("w6_best_model", f"WITH {_REPORT} SELECT dataset, model, m2 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m2 DESC, model) AS r FROM report) WHERE r = 1")
def _(spark, d):
    return reports.best(report_rows(spark, d), "m2")


@query("l8_first_per_key", f"WITH {_WIN} SELECT src, dst, w, arg_min(edge_id, (t, edge_id)) AS edge_id FROM win GROUP BY src, dst, w")
def _(spark, d):
    return graph.windowed(social_edges(spark, d), DAY).groupBy("src", "dst", "w").agg(F.min_by("edge_id", F.struct("t", "edge_id")).alias("edge_id"))


@query("a51_frequent_keys", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 50)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return e.join(e.groupBy("user_id").count().where("count >= 50"), "user_id", "left_semi").select("event_id", "user_id")


@query("w14_sequences", "SELECT user_id, (rn - 1) // 10 AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return e.groupBy("user_id", F.floor((F.col("rn") - 1) / 10).cast("long").alias("chunk")).agg(items.alias("items"))


@query(
    "dt1_calendar",
    "SELECT event_id, second(ts) / 59.0 - 0.5 AS s, minute(ts) / 59.0 - 0.5 AS m, hour(ts) / 23.0 - 0.5 AS h, (isodow(ts) - 1) / 6.0 - 0.5 AS dow, (day(ts) - 1) / 30.0 - 0.5 AS dom, (dayofyear(ts) - 1) / 365.0 - 0.5 AS doy, (month(ts) - 1) / 11.0 - 0.5 AS mon, (weekofyear(ts) - 1) / 52.0 - 0.5 AS woy FROM events",
)
def _(spark, d):
    part = lambda f, lo, n: (f("ts") - lo) / F.lit(float(n)) - 0.5
    parts = {"s": (F.second, 0, 59), "m": (F.minute, 0, 59), "h": (F.hour, 0, 23), "dow": (F.weekday, 0, 6), "dom": (F.dayofmonth, 1, 30), "doy": (F.dayofyear, 1, 365), "mon": (F.month, 1, 11), "woy": (F.weekofyear, 1, 52)}
    return table(spark, d, "events").select("event_id", *[part(*p).alias(k) for k, p in parts.items()])


@query("v1_cosine_top_k", f"""WITH s AS (SELECT x.vec_id AS q, y.vec_id AS id, {_DOT} / (sqrt(list_sum(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE) * v))) * sqrt(list_sum(list_transform(y.embedding, lambda v: CAST(v AS DOUBLE) * v)))) AS sim FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id)
    SELECT q, id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, id) AS r FROM s) WHERE r <= 10""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(e.where("vec_id % 20 = 0"), e, 10).select(F.col("src").alias("q"), F.col("dst").alias("id"), "sim")


@query("tx16_repetition", """WITH w AS (SELECT conv_id, turn, [x FOR x IN string_split_regex(lower(text), '[ \\t-\\r]+') IF x <> ''] AS w FROM conversations),
    g AS (SELECT conv_id, turn, w, [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] AS g FROM w) SELECT conv_id, turn, CASE WHEN len(w) < 3 THEN 0.0 ELSE -(1 - len(list_distinct(g)) / len(g)) END AS penalty FROM g""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.repetition(F.col("text")).alias("penalty"))


@query("if_rules", """SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS keywords, NOT contains(lower(text), 'license') AS forbidden, length(text) - length(replace(text, 'e', '')) AS letters,
    len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '^\\s*[*-]')]) AS bullets, len(regexp_extract_all(text, '\\[(.*?)\\]')) AS placeholders, len(regexp_extract_all(text, '\\*(.*?)\\*')) AS highlights,
    text = upper(text) AS upper, text = lower(text) AS lower, NOT contains(text, ',') AS no_commas, regexp_matches(text, '<<(.*?)>>') AS title FROM documents""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", tx.contains_all(t, ["the", "and"]).alias("keywords"), tx.contains_none(t, ["license"]).alias("forbidden"), tx.letter_count(t, "e").cast("long").alias("letters"), tx.bullets(t).cast("long").alias("bullets"),
        tx.placeholders(t).cast("long").alias("placeholders"), tx.highlights(t).cast("long").alias("highlights"), (t == F.upper(t)).alias("upper"), (t == F.lower(t)).alias("lower"), (~F.contains(t, F.lit(","))).alias("no_commas"), tx.has_title(t).alias("title"),
    )


@query("tx4_last_period", "SELECT doc_id, CASE WHEN contains(right(text, 120), '.') THEN regexp_extract(right(text, 120), '(?s)^(.*)\\.', 1) ELSE right(text, 120) END AS tail FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.to_last_period(F.col("text"), 120).alias("tail"))


@query("tx17_longest_word", "SELECT doc_id, list_max([length(x) FOR x IN string_split_regex(text, '[ \\t-\\r]+')]) AS longest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_max(F.transform(F.split("text", r"[ \t-\r]+", -1), F.length)).cast("long").alias("longest"))


@query("pf29_format_number", "SELECT c_custkey, format('{:,.2f}', c_acctbal) AS shown FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.format_number("c_acctbal", 2).alias("shown"))


@query("j3_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("s2_l6_ordered_dedup", f"WITH {_SOCIAL}, h AS (SELECT src, dst, min(edge_id) AS e FROM social GROUP BY ALL) SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY e) AS candidates FROM h GROUP BY src")
def _(spark, d):
    return retrieval.ordered_dedup(social_edges(spark, d), "edge_id").select("src", _listed())


def _listed():
    return F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates")


@query(
    "s2_candidate_overlap",
    f"""WITH {_WIN}, g AS (SELECT DISTINCT src, dst FROM win WHERE w >= 22), n AS (SELECT src, count(*) AS n FROM g GROUP BY src),
    h AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY min(edge_id)) AS r, min(edge_id) AS e FROM win WHERE w < 22 GROUP BY src, dst), c AS (SELECT h.* FROM h JOIN n ON n.src = h.src AND r <= n),
    k AS (SELECT c.src, string_agg(CAST(c.dst AS VARCHAR), ',' ORDER BY e) AS candidates, count(g.dst) AS overlap FROM c LEFT JOIN g ON g.src = c.src AND g.dst = c.dst GROUP BY c.src)
    SELECT src, coalesce(candidates, '') AS candidates, coalesce(n, 0) AS n_truth, coalesce(overlap, 0) AS overlap FROM (SELECT DISTINCT src FROM win) LEFT JOIN n USING (src) LEFT JOIN k USING (src)""",
)
def _(spark, d):
    e = graph.windowed(social_edges(spark, d), DAY)
    return retrieval.candidate_overlap(e.where("w < 22"), e.where("w >= 22"), "edge_id").select("src", _listed(), "n_truth", "overlap")


@query(
    "a29_retrieval_metrics",
    f"""WITH {_WIN}, h AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS r FROM win WHERE w < 22 GROUP BY src, dst), gt AS (SELECT DISTINCT src, dst FROM win WHERE w >= 22),
    m AS (SELECT g.src, count(*) AS n, count(h.dst) FILTER (r <= 10) AS hit FROM gt g LEFT JOIN h ON h.src = g.src AND h.dst = g.dst GROUP BY g.src) SELECT avg(hit / n) AS recall_10, avg(hit / 10) AS precision_10, avg(CASE WHEN hit > 0 THEN 1.0 ELSE 0.0 END) AS hit_10 FROM m""",
)
def _(spark, d):
    """Flagship: recall, precision and hit rate at 10 of the most frequent past partners against future edges."""
    e = graph.windowed(social_edges(spark, d), DAY)
    past = e.where("w < 22").groupBy("src", "dst").agg(F.count("*").alias("n"))
    past = past.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 10").select("src", "dst", F.lit(1).alias("hit"))
    m = e.where("w >= 22").select("src", "dst").distinct().join(past, ["src", "dst"], "left").groupBy("src").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    return m.agg(F.avg(F.col("hit") / F.col("n")).alias("recall_10"), F.avg(F.col("hit") / 10).alias("precision_10"), F.avg((F.col("hit") > 0).cast("double")).alias("hit_10"))
