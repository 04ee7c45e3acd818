"""Projections, samplers and text blocks, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.functions import text as tx
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, reports, sampling
from chronoweave.plans.queries import _REPORT, _SOCIAL, _WIN, query
from chronoweave.session import table
from chronoweave.sources.tables import DAY, report_rows, social_edges


def _win(spark, d):
    return graph.windowed(social_edges(spark, d), DAY)


def _u(seed, *keys):
    return f"(CAST('0x' || left(md5(concat_ws(':', '{seed}', " + ", ".join(keys) + ")), 8) AS UBIGINT) / 4294967296.0)"


# Projections


@query("pf6_excluded", f"WITH {_REPORT} SELECT * FROM report WHERE model NOT IN ('3', '7', '11')")
def _(spark, d):
    return reports.required(report_rows(spark, d), ["model", "dataset", "m1", "m2"]).where(~F.col("model").isin("3", "7", "11"))


@query("pf7_members", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')")
def _(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "purchase", "view")).select("event_id", "event_type")


@query("pf15_sentences", "SELECT p_partkey, concat_ws('; ', 'Brand: ' || p_brand, 'Type: ' || p_type, 'Size: ' || p_size) AS head, concat_ws('; ', 'Name: ' || p_name, 'Brand: ' || p_brand) AS with_remark FROM part")
def _(spark, d):
    said = lambda **kv: F.concat_ws("; ", *[F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in kv.items()])
    return table(spark, d, "part").select("p_partkey", said(Brand="p_brand", Type="p_type", Size="p_size").alias("head"), said(Name="p_name", Brand="p_brand").alias("with_remark"))



@query("pf18_parse_flags", "SELECT doc_id, text LIKE '%license%' OR text LIKE '%License%' AS license, regexp_extract(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS address, regexp_matches(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS success FROM documents")
def _(spark, d):
    pattern = r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.contains(t, F.lit("license")) | F.contains(t, F.lit("License"))).alias("license"), F.regexp_extract(t, pattern, 0).alias("address"), t.rlike(pattern).alias("success"))


@query(
    "pf20_safe_timestamp",
    "SELECT event_id, coalesce(CAST(epoch(try_strptime(s, '%Y-%m-%d %H:%M:%S')) AS BIGINT), event_id) AS t FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN event_type ELSE strftime(ts, '%d.%m.%Y') END AS s FROM events)",
)
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.date_format(ts, "dd.MM.yyyy")).alias("s"))
    return e.select("event_id", F.coalesce(F.unix_timestamp(F.try_to_timestamp("s", F.lit("yyyy-MM-dd HH:mm:ss"))), F.col("event_id")).alias("t"))


@query("pf23_default_domain", "SELECT conv_id, turn, coalesce(CASE WHEN turn > 2 THEN 'late' END, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'ifeval' END, 'math_rule') AS domain FROM conversations")
def _(spark, d):
    given = F.when(F.col("turn") > 2, "late")
    by_tag = F.create_map(F.lit("user"), F.lit("prompt"), F.lit("assistant"), F.lit("ifeval"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(given, F.try_element_at(by_tag, F.coalesce("role", F.lit(""))), F.lit("math_rule")).alias("domain"))


_LEVELS = f"{_SOCIAL}, k AS (SELECT src, count(DISTINCT dst) AS n FROM social GROUP BY src), q AS (SELECT quantile_cont(n, 0.3) AS lo, quantile_cont(n, 0.7) AS hi FROM k), lv AS (SELECT src, n, CASE WHEN n <= lo THEN 3 WHEN n <= hi THEN 2 ELSE 1 END AS difficulty FROM k, q)"


def _levels(spark, d):
    k = social_edges(spark, d).groupBy("src").agg(F.countDistinct("dst").alias("n"))
    return k.join(F.broadcast(dist.quantiles(k, "n", {"lo": 0.3, "hi": 0.7}))).select("src", "n", F.when(F.col("n") <= F.col("lo"), 3).when(F.col("n") <= F.col("hi"), 2).otherwise(1).alias("difficulty"))


@query("pf25_difficulty_one", f"WITH {_LEVELS} SELECT src, n FROM lv WHERE difficulty = 1")
def _(spark, d):
    return _levels(spark, d).where("difficulty = 1").select("src", "n")


@query("pf26_strata", f"WITH {_LEVELS} SELECT 'Easy' AS stratum, count(*) AS n, round(avg(n), 4) AS mean FROM lv WHERE difficulty < 3 UNION ALL SELECT 'Hard', count(*), round(avg(n), 4) FROM lv WHERE NOT difficulty < 3 UNION ALL SELECT 'All', count(*), round(avg(n), 4) FROM lv")
def _(spark, d):
    strata = F.array(F.lit("All"), F.when(F.col("difficulty") < 3, "Easy").otherwise("Hard"))
    return _levels(spark, d).withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("n"), 4).alias("mean"))


@query("pf27_reordered", f"WITH {_REPORT} SELECT m2, model, m1 FROM report")
def _(spark, d):
    return report_rows(spark, d).withColumn("Unnamed: 0", F.lit(0)).drop("Unnamed: 0", "experiment_name", "dataset").select("m2", "model", "m1")


@query(
    "pf28_transposed",
    "SELECT metric, max(v) FILTER (k = 'F') AS F, max(v) FILTER (k = 'O') AS O, max(v) FILTER (k = 'P') AS P FROM (SELECT o_orderstatus AS k, 'n' AS metric, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, 'most', max(o_totalprice) FROM orders GROUP BY 1) GROUP BY metric",
)
def _(spark, d):
    wide = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("most"))
    return wide.unpivot("k", ["n", "most"], "metric", "v").groupBy("metric").pivot("k", ["F", "O", "P"]).agg(F.max("v"))


@query("j17_side_by_side", "SELECT a.id, c_custkey, p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS id FROM customer) a JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS id FROM part) b USING (id)")
def _(spark, d):
    """Rows of two tables put together by position."""
    a = reports.dense_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return a.join(reports.dense_ids(table(spark, d, "part").select("p_partkey"), "p_partkey"), "id").select("id", "c_custkey", "p_partkey")


@query("j18_columns_by_row", "SELECT o_orderkey, o_totalprice, sum(l_quantity) AS quantity, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def _(spark, d):
    more = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("items"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(more, "o_orderkey")


@query("a46_response_lengths", "SELECT role, avg(length(text)) AS mean, max(length(text)) AS most, min(length(text)) AS least FROM conversations GROUP BY role")
def _(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").groupBy("role").agg(F.avg(n).alias("mean"), F.max(n).cast("long").alias("most"), F.min(n).cast("long").alias("least"))


@query("a44_accumulated", f"WITH {_REPORT} SELECT model, sum(m1) / count(*) AS mean, string_agg(dataset, ',' ORDER BY dataset) AS datasets FROM report GROUP BY model")
def _(spark, d):
    return report_rows(spark, d).groupBy("model").agg((F.sum("m1") / F.count("*")).alias("mean"), F.array_join(F.array_sort(F.collect_list("dataset")), ",").alias("datasets"))


# Samplers


@query("l9_fraction", f"SELECT event_id, CASE WHEN {_u(1, 'event_id')} < 0.5 THEN 'sampled' ELSE event_type END AS domain FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.when(sampling.uniform(1, "event_id") < 0.5, "sampled").otherwise(F.col("event_type")).alias("domain"))


@query("l10_n_sample", f"SELECT event_id FROM events ORDER BY {_u(2, 'event_id')}, event_id LIMIT 300")
def _(spark, d):
    return sampling.n_sample(table(spark, d, "events").select("event_id"), "event_id", 300, 2)


@query("l11_in_time_order", f"SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM (SELECT event_id, ts FROM events ORDER BY {_u(3, 'event_id')}, event_id LIMIT 200)")
def _(spark, d):
    e = sampling.n_sample(table(spark, d, "events").select("event_id", "ts"), "event_id", 200, 3)
    return e.select("event_id", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long").alias("place"))  # at most 200 rows


@query(
    "l12_fallback",
    f"WITH {_SOCIAL}, ids AS (SELECT DISTINCT dst FROM social), n AS (SELECT min(dst) AS lo, max(dst) - min(dst) + 1 AS n FROM ids) SELECT src, draw, lo + CAST(floor({_u(4, 'src', 'draw')} * n) AS BIGINT) AS dst FROM (SELECT DISTINCT src FROM social), (SELECT unnest(range(1, 6)) AS draw), n",
)
def _(spark, d):
    """Five candidates for each source, drawn with replacement from the domain of ids."""
    e = social_edges(spark, d)
    span = e.agg(F.min("dst").alias("lo"), (F.max("dst") - F.min("dst") + 1).alias("n"))
    draws = e.select("src").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).join(F.broadcast(span))
    return draws.select("src", "draw", (F.col("lo") + F.floor(sampling.uniform(4, "src", "draw") * F.col("n"))).cast("long").alias("dst"))


@query(
    "l13_weighted",
    f"WITH {_SOCIAL}, c AS (SELECT src, dst, count(*) AS n FROM social GROUP BY ALL) SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY -ln(greatest({_u(5, 'src', 'dst')}, pow(2.0, -33))) / n, dst) AS r FROM c) WHERE r <= 5",
)
def _(spark, d):
    c = social_edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return sampling.weighted(c, "src", "dst", F.col("n"), 5, 5).select("src", "dst")


@query("l14_few_shot", f"SELECT lang, string_agg(left(text, 80), chr(10) || chr(10) ORDER BY u, doc_id) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) AS r FROM (SELECT lang, text, doc_id, {_u(6, 'doc_id')} AS u FROM documents)) WHERE r <= 3 GROUP BY lang")
def _(spark, d):
    e = table(spark, d, "documents").select("lang", "doc_id", F.left("text", F.lit(80)).alias("text"), sampling.uniform(6, "doc_id").alias("u"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))).where("r <= 3")
    return e.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n\n").alias("shots"))


@query("l15_bernoulli_edges", f"WITH {_SOCIAL} SELECT edge_id, src, dst FROM social WHERE {_u(7, 'edge_id')} < 0.8")
def _(spark, d):
    return sampling.fraction(social_edges(spark, d).select("edge_id", "src", "dst"), "edge_id", 0.8, 7)


@query("l16_split_flag", f"SELECT c_custkey, {_u(8, 'c_custkey')} < 0.95 AS is_train FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", (sampling.uniform(8, "c_custkey") < 0.95).alias("is_train"))


@query(
    "l18_sampled_history",
    f"WITH {_WIN}, h AS (SELECT src, list(dst ORDER BY t, edge_id) AS h FROM win WHERE w < 22 GROUP BY src) SELECT src, draw, h[CAST(floor({_u(9, 'src', 'draw')} * len(h)) AS BIGINT) + 1] AS picked FROM h, (SELECT unnest(range(1, 4)) AS draw)",
)
def _(spark, d):
    """Three draws a source from its past: places in the numbered history are drawn, no history is one row."""
    e = _win(spark, d).where("w < 22").select("src", "t", "edge_id", "dst")
    rows = dist.row_numbers(e, "src", "t", "edge_id", name="at")
    span = rows.groupBy("src").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    drawn = span.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("at", F.col("first") + F.floor(sampling.uniform(9, "src", "draw") * F.col("n")))
    return drawn.select("src", "draw", "at").join(rows.select("at", "dst"), "at").select("src", F.col("draw").cast("long").alias("draw"), F.col("dst").alias("picked"))


@query("l1_sorted", f"WITH {_SOCIAL} SELECT edge_id, src, dst, t FROM social ORDER BY t, src, dst, edge_id")
def _(spark, d):
    return social_edges(spark, d).select("edge_id", "src", "dst", "t").orderBy("t", "src", "dst", "edge_id")


@query("l19_original_order", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn, role")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role").repartition(4, "role").orderBy("conv_id", "turn", "role")


@query(
    "l20_matched_first",
    f"WITH {_WIN}, g AS (SELECT src, arg_max(dst, (t, edge_id)) AS target FROM win WHERE w < 22 GROUP BY src) SELECT w.src, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY dst = target DESC, edge_id) AS edges FROM win w JOIN g ON g.src = w.src WHERE w < 22 GROUP BY w.src",
)
def _(spark, d):
    """Each source's past edges, those to its latest partner first."""
    e = _win(spark, d).where("w < 22").select("src", "dst", "t", "edge_id")
    g = e.groupBy("src").agg(F.max_by("dst", F.struct("t", "edge_id")).alias("target"))
    listed = F.array_sort(F.collect_list(F.struct((F.col("dst") != F.col("target")).alias("other"), "edge_id")))
    return e.join(g, "src").groupBy("src").agg(F.array_join(F.transform(listed, lambda x: x["edge_id"].cast("string")), ",").alias("edges"))


# Text blocks


@query("tx2_key_filter", "SELECT c_custkey, c_name AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer")
def _(spark, d):
    tags = F.concat(F.lit("<name>"), "c_name", F.lit("</name><segment>"), "c_mktsegment", F.lit("</segment>"))
    m = F.map_filter(tx.tags(tags), lambda k, v: k.isin("name", "segment") & (v != "BUILDING"))
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(m, F.lit("name")).alias("name"), F.try_element_at(m, F.lit("segment")).alias("segment"))


@query("tx3_json_or_raw", "SELECT event_id, CASE WHEN json_valid(s) THEN json_type(s) ELSE s END AS parsed FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE event_type END AS s FROM events)")
def _(spark, d):
    s = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    parsed = F.from_json(s, "map<string,string>")
    return table(spark, d, "events").select("event_id", F.when(parsed.isNotNull() & F.get_json_object(s, "$").isNotNull(), "OBJECT").otherwise(s).alias("parsed"))


_PAST = f"{_WIN}, past AS (SELECT * FROM win WHERE w < 22), f AS (SELECT v AS node, count(*) AS sf FROM (SELECT src AS v FROM past UNION ALL SELECT dst FROM past) GROUP BY v)"


@query(
    "tx6_node_text",
    f"WITH {_PAST}, hi AS (SELECT src, dst, count(*) AS hi FROM past GROUP BY ALL) SELECT src, string_agg('Node ' || dst || ' HI: ' || hi || ' SF: ' || sf, chr(10) ORDER BY hi DESC, dst) AS block FROM hi JOIN f ON f.node = hi.dst GROUP BY src",
)
def _(spark, d):
    past = _win(spark, d).where("w < 22")
    f = past.select(F.col("src").alias("dst")).union(past.select("dst")).groupBy("dst").agg(F.count("*").alias("sf"))
    hi = past.groupBy("src", "dst").agg(F.count("*").alias("hi")).join(f, "dst")
    line = F.concat(F.lit("Node "), F.col("dst").cast("string"), F.lit(" HI: "), F.col("hi").cast("string"), F.lit(" SF: "), F.col("sf").cast("string"))
    return hi.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hi")).alias("o"), "dst", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


@query(
    "tx7_pair_history",
    f"WITH {_PAST} SELECT src, dst, string_agg('<edge>' || label || ' at ' || t || '</edge>', chr(10) || chr(10) ORDER BY t, edge_id) AS history FROM past GROUP BY src, dst",
)
def _(spark, d):
    line = F.concat(F.lit("<edge>"), "label", F.lit(" at "), F.col("t").cast("string"), F.lit("</edge>"))
    past = _win(spark, d).where("w < 22").groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("t", "edge_id", line.alias("line")))).alias("h"))
    return past.select("src", "dst", F.array_join(F.transform("h", lambda x: x["line"]), "\n\n").alias("history"))


@query(
    "tx8_destination_prompt",
    f"WITH {_PAST}, k AS (SELECT src, count(*) AS n, count(DISTINCT dst) AS u FROM past GROUP BY src) SELECT src, 'Actor ' || src || ' made ' || n || ' contacts with ' || u || ' partners. Name ' || least(u, 5) || ' likely next partners.' AS prompt FROM k",
)
def _(spark, d):
    k = _win(spark, d).where("w < 22").groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("u"))
    return k.select("src", F.format_string("Actor %d made %d contacts with %d partners. Name %d likely next partners.", "src", "n", "u", F.least("u", F.lit(5))).alias("prompt"))


@query("tx9_judge_prompt", "SELECT conv_id, turn, 'Reference:' || chr(10) || coalesce(u, '') || chr(10) || 'Answer:' || chr(10) || coalesce(text, '') AS prompt FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS u FROM conversations) WHERE role = 'assistant'")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("u", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("role = 'assistant'")
    none = F.lit("")
    return c.select("conv_id", "turn", F.concat(F.lit("Reference:\n"), F.coalesce("u", none), F.lit("\nAnswer:\n"), F.coalesce("text", none)).alias("prompt"))


@query("tx13_boxed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '\\frac{' || left(translate(text, '{}', '()'), 20) || '}{2}' WHEN doc_id % 3 = 1 THEN left(translate(text, '{}', '()'), 20) END AS boxed FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    """The boxed answer of built texts: nested, plain, or never closed."""
    t = F.left(F.translate("text", "{}", "()"), F.lit(20))
    nested = F.concat(F.lit("So \\boxed{\\frac{"), t, F.lit("}{2}} or \\boxed{no}"))
    built = F.when(F.col("doc_id") % 3 == 0, nested).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\\boxed{"), t, F.lit("} end }"))).otherwise(F.concat(F.lit("\\boxed{"), t))
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.first_boxed(built).alias("boxed"))


@query(
    "tx21_code_blocks",
    "SELECT doc_id, len(b) AS blocks, coalesce(trim(regexp_replace(b[1], '[ \\t]+', ' ', 'g')), '') AS first FROM (SELECT doc_id, regexp_extract_all('```python' || chr(10) || replace(text, '.', chr(10) || '```' || chr(10)), '(?s)```python\\n(.*?)```', 1) AS b FROM documents WHERE text IS NOT NULL)",
)
def _(spark, d):
    fenced = F.concat(F.lit("```python\n"), F.replace("text", F.lit("."), F.lit("\n```\n")))
    b = tx.code_blocks(fenced)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(b).cast("long").alias("blocks"), F.coalesce(F.trim(F.regexp_replace(F.try_element_at(b, F.lit(1)), "[ \\t]+", " ")), F.lit("")).alias("first"))
