"""File sources and sinks as round trips: a test table is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.operators import graph
from chronoweave.plans.queries import _REPORT, _SOCIAL, _WIN, query
from chronoweave.session import shared_dir, table
from chronoweave.sources import files
from chronoweave.sources.tables import DAY, report_rows, social_edges


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


_EVENT = "event_id long, user_id long, event_type string, value double"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("io1_io16_csv", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path = _at(spark, "events.csv")
    _events(spark, d).write.option("header", True).csv(path)
    return files.read_csv(spark, path, _EVENT)


@query("io2_indexed_csv", "SELECT event_id, user_id FROM events")
def _(spark, d):
    path = _at(spark, "events.csv")
    _events(spark, d).select(F.lit(0).alias("Unnamed: 0"), "event_id", "user_id").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "i long, event_id long, user_id long", index=True)


@query("io3_json_lines", "SELECT conv_id, turn, role, CAST(NULL AS VARCHAR) AS predict FROM conversations WHERE role IN ('user', 'assistant')")
def _(spark, d):
    root = _at(spark, "prompts")
    for role in ("user", "assistant"):
        table(spark, d, "conversations").where(F.col("role") == role).select("conv_id", "turn", "role").write.json(f"{root}/{role}.jsonl")
    return files.read_prompts(spark, [f"{root}/user.jsonl", f"{root}/assistant.jsonl"], ["conv_id", "turn", "role", "predict"])


@query("io4_csv_to_json_lines", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer")
def _(spark, d):
    source, path = _at(spark, "c.csv"), _at(spark, "c.jsonl")
    table(spark, d, "customer").select("c_custkey", "c_name").write.option("header", True).csv(source)
    files.csv_to_jsonl(files.read_csv(spark, source, "c_custkey long, c_name string"), path, [], ["c_custkey"])
    return files.read_any(spark, path, "c_custkey long, c_name string, id long")


_THREE = ("3", "7", "11")


@query("io5_report_scan", f"WITH {_REPORT} SELECT model, 'd' AS dataset, 's' AS split, 't' AS task, dataset AS segment, m1 FROM report WHERE model IN ('3', '7', '11')")
def _(spark, d):
    root = _at(spark, "reports")
    for m in _THREE:
        report_rows(spark, d).where(F.col("model") == m).select(F.lit(0).alias("Unnamed: 0"), F.col("dataset").alias("segment"), "m1").coalesce(1).write.option("header", True).csv(f"{root}/{m}/d/s/t")
    return files.read_reports(spark, root, "*.csv")


@query("io6_concatenated", f"WITH {_REPORT} SELECT model, 'D' AS dataset, 'S' AS split, CASE WHEN model = 'a' THEN v END AS m1, CASE WHEN model = 'b' THEN v END AS m2 FROM (SELECT 'a' AS model, m1 AS v FROM report UNION ALL SELECT 'b', m2 FROM report)")
def _(spark, d):
    r = report_rows(spark, d)
    return files.concat_reports({"a": r.select("model", "m1"), "b": r.select("model", "m2")}, "D", "S").select("model", "dataset", "split", "m1", "m2")


@query("io7_baseline_edges", f"WITH {_WIN} SELECT src, dst, w * 86400 + 100 AS t FROM win WHERE w <= 20 AND edge_id % 9 <> 0")
def _(spark, d):
    path = _at(spark, "edges.csv")
    e = graph.windowed(social_edges(spark, d), DAY)
    written = e.select(F.concat(F.col("src").cast("string"), F.lit(".0")).alias("src"), "dst", F.when(F.col("edge_id") % 9 == 0, "soon").otherwise(F.col("w").cast("string")).alias("t"))
    written.write.option("header", True).csv(path)
    return files.read_baseline_edges(spark, path, 100, DAY, cut_time=20 * DAY + 100)


@query("io8_graph_bundle", f"WITH {_WIN} SELECT model, src, dst, t FROM (SELECT 'early' AS model, src, dst, t FROM win WHERE w < 10 UNION ALL SELECT 'late', src, dst, t FROM win WHERE w >= 20)")
def _(spark, d):
    """Several graphs from their files as one table with the graph's name."""
    e = graph.windowed(social_edges(spark, d), DAY)
    paths = {}
    for name, rule in (("early", "w < 10"), ("late", "w >= 20")):
        paths[name] = _at(spark, f"{name}.csv")
        e.where(rule).select("src", "dst", "t").write.option("header", True).csv(paths[name])
    return files.read_graphs(spark, paths)


@query("io9_metric_files", "SELECT 'm' AS model, 'x' AS dataset, CAST(count(*) AS VARCHAR) AS edges, CAST(max(value) AS VARCHAR) AS most FROM (SELECT floor(value) AS value FROM events)")
def _(spark, d):
    path = _at(spark, "metrics")
    e = table(spark, d, "events").agg(F.count("*").cast("string").alias("edges"), F.concat(F.max(F.floor("value")).cast("string"), F.lit(".0")).alias("most"))
    e.select(F.struct("edges", "most").alias("test metrics")).coalesce(1).write.json(path)
    return files.read_metric_json(spark, path).select(F.lit("m").alias("model"), F.lit("x").alias("dataset"), "edges", "most")


@query("io10_log_files", "SELECT o_orderstatus AS key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1")
def _(spark, d):
    path = _at(spark, "logs")
    k = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n")).orderBy("k").coalesce(1)
    k.select(F.concat(F.lit("INFO - test "), "k", F.lit(", tensor("), F.col("n").cast("string"), F.lit(")")).alias("value")).write.text(path)
    return files.read_logs(spark, path).select("key", "value")


@query("io13_io15_by_ending", "SELECT c_custkey, c_name, c_acctbal, kind FROM customer, (SELECT unnest(['json', 'orc', 'parquet']) AS kind)")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = None
    for kind in ("json", "orc", "parquet"):
        path = _at(spark, f"c.{kind}")
        (c.write.option("compression", "gzip").json(path) if kind == "json" else getattr(c.write, kind)(path))
        one = files.read_any(spark, path, "c_custkey long, c_name string, c_acctbal double").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("io18_split_tables", f"WITH {_WIN} SELECT edge_id, src, dst FROM win WHERE w >= 22 AND w < 26")
def _(spark, d):
    """One split of a table kept by split; only its files are listed."""
    path = _at(spark, "splits")
    e = graph.windowed(social_edges(spark, d), DAY)
    files.write_split(e.withColumn("split", F.when(F.col("w") < 22, "train").when(F.col("w") < 26, "val").otherwise("test")).select("edge_id", "src", "dst", "split"), path)
    return spark.read.parquet(path).where("split = 'val'").select("edge_id", "src", "dst")


@query("io19_rewritten", f"WITH {_SOCIAL} SELECT edge_id, src, dst FROM social WHERE src % 2 = 0")
def _(spark, d):
    """A filtered table put in the place of the one it was read from: written beside it, and only then named by readers."""
    old, new = _at(spark, "edges"), _at(spark, "edges")
    social_edges(spark, d).select("edge_id", "src", "dst").write.parquet(old)
    spark.read.parquet(old).where("src % 2 = 0").write.parquet(new)
    return spark.read.parquet(new)
