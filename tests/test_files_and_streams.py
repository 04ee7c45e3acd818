"""File sources and sinks, streaming forms against batch, distributions and text scores against plain Python."""

import random

from pyspark.sql import functions as F

from chronoweave.functions import rules
from chronoweave.operators import distributions as dist
from chronoweave.operators import reports, retrieval
from chronoweave.sources import files
from chronoweave.streaming import windows


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,name,tags\n0,"x, y","[""a"",""b""]"\n1,z,plain\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), index=True)
    assert df.columns == ["name", "tags"] and df.count() == 2
    files.csv_to_jsonl(df, str(tmp_path / "out.jsonl"), ["tags"], ["name"])
    got = {r.id: (r.name, r.tags) for r in files.read_any(spark, str(tmp_path / "out.jsonl")).collect()}
    assert got == {0: ("x, y", ["a", "b"]), 1: ("z", ["plain"])}
    assert files.read_prompts(spark, [str(tmp_path / "out.jsonl")], ["name", "other"]).where("other is null").count() == 2


def test_reports(spark, tmp_path):
    for model in ("m1", "m2"):
        p = tmp_path / "r" / model / "d" / "s" / "t"
        p.mkdir(parents=True)
        (p / "x.csv").write_text("Unnamed: 0,score\n0,1.5\n")
    (tmp_path / "r" / "x.csv").write_text("Unnamed: 0,score\n0,9\n")
    df = files.read_reports(spark, str(tmp_path / "r"), "x.csv")
    assert sorted((r.model, r.dataset, r.split, r.task, r.score) for r in df.collect()) == [(m, "d", "s", "t", 1.5) for m in ("m1", "m2")]
    both = files.concat_reports({"a": df.select("model", "score"), "b": df.select("model", "task")}, "D", "S")
    assert both.columns[0] == "model" and both.where("task is null").count() == 2
    assert files.markdown_table(df.select("model").orderBy("model")).splitlines()[2] == "| m1 |"
    assert r"m1 \\" in files.latex_table(df.select("model"))


def test_baseline_logs_and_metrics(spark, tmp_path):
    (tmp_path / "e.csv").write_text("src,dst,t\n1.0,2,0\nx,2,1\n3,4,2\n")
    got = files.read_baseline_edges(spark, str(tmp_path / "e.csv"), 100, 10, cut_edges=5)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 100), (3, 4, 120)]
    assert files.read_baseline_edges(spark, str(tmp_path / "e.csv"), 100, 10, cut_time=110).count() == 1
    (tmp_path / "l.log").write_text("INFO - test old, 1\n" + "x\n" * 20 + "INFO - test mae, tensor(0.5)\nINFO - test mae, 2\nINFO - test auc, 3\n")
    assert {r.key: r.value for r in files.read_logs(spark, str(tmp_path / "l.log")).collect()} == {"mae_degree": 0.5, "mae_unique": 2.0, "auc": 3.0}
    (tmp_path / "m.json").write_text('{"test metrics": {"auc": "0.9"},\n "x": 1}')
    assert files.read_metric_json(spark, str(tmp_path / "m.json")).first().auc == "0.9"
    files.write_split(got.withColumn("split", F.lit("a")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'a'").count() == 2


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, i % 3, (i + 1) % 3, i * 7000) for i in range(40)]
    e = spark.createDataFrame(rows, "edge_id long, src long, dst long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.edge_stream(spark, str(tmp_path / "in"), e.schema)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(map(tuple, spark.table(name).collect()))

    want = e.groupBy("src", F.window("ts", "1 day").start.alias("start")).count()
    assert run(windows.window_degrees(stream), "degrees") == sorted(map(tuple, want.collect()))
    want = {}
    for i, a, b, s in rows:
        want[a], want[b] = b, a
    assert {n: m for n, m, _ in run(windows.last_messages(stream), "last")} == want


def test_distributions(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s long, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(dist.auc(df, "s", "y").first()[0] - auc) < 1e-9
    x = sorted(s for s, _ in rows)
    n = len(x)
    for first in (0, 1):
        want = 2 * sum((i + first) * v for i, v in enumerate(x)) / (n * sum(x)) - (n + 1) / n
        assert abs(dist.gini(df, "s", first).first()[0] - want) < 1e-9
    assert dist.auc(df.where("y = 1"), "s", "y").first()[0] is None
    assert dist.auc(df.where("false"), "s", "y").first()[0] is None
    assert dist.histogram(df.where("s = 3"), "s", 10).collect()[0].bin == 0


def test_report_helpers(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.0), (3, "a", None), (4, "a", 3.0), (5, "a", None)], "i int, g string, v double")
    assert [r.v_filled for r in reports.interpolated(df, "v", ["g"], ["i"]).orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, 3.0]
    assert {r.start: r["items"] for r in reports.strided(df, ["g"], ["i"], "i", 3, 2).collect()} == {0: "1,2,3", 2: "3,4,5", 4: "5"}


def test_retrieval_rule(spark):
    c = spark.createDataFrame([(1, 2, 0.5, True), (1, 3, 0.9, False), (4, 2, 0.1, True), (4, 3, 0.2, True)], "src long, dst long, sim double, pass boolean")
    kept = retrieval.enough_or_all(c, 2)
    assert sorted((r.src, r.dst) for r in kept.collect()) == [(1, 2), (1, 3), (4, 2), (4, 3)]
    top = retrieval.merged([c.where("src = 1 and dst = 2"), c], 2)
    assert [(r.src, r.dst, r["rank"]) for r in top.orderBy("src", "rank").collect()] == [(1, 2, 1), (1, 3, 2), (4, 3, 1), (4, 2, 2)]


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert rules.lcs_length(a, b) == slow(a, b)
