"""Hand-computed fixtures of the graph and text operators, and some queries against DuckDB."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoweave import registry
from chronoweave.functions import text as tx
from chronoweave.operators import graph
from chronoweave.operators.components import connected_components
from chronoweave.plans import graph_queries, queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def edges(spark, rows):
    return spark.createDataFrame([(i, *(list(r) + [0])[:3]) for i, r in enumerate(rows)], "edge_id long, src long, dst long, t long")


def test_motifs(spark):
    path, triangle = [(1, 2), (2, 3)], [(1, 2), (2, 3), (3, 1)]
    clique = [(a, b) for a in range(4) for b in range(a)]
    assert [graph.triangles(edges(spark, e)).count() for e in (path, triangle, clique)] == [0, 1, 4]
    assert {r.clustering for r in graph.local_clustering(edges(spark, path)).collect()} == {0.0}
    star = graph.degree_motifs(edges(spark, [(i, 9) for i in range(4)])).first()
    assert (star.wedges, star.claws, star.max_degree) == (6, 4, 4)


def some_edges(spark, monkeypatch, days=30):
    """Random edges over ``days`` days, and the two plan modules reading them in place of the tables."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(14), rnd.randrange(14), rnd.randrange(days) * 86400) for _ in range(90)] + [(20, 21, 29 * 86400)]
    rows = [r for r in rows if r[0] != r[1]]
    for module in (queries, graph_queries):
        monkeypatch.setattr(module, "social_edges", lambda spark, d: edges(spark, rows))
    return rows


def test_two_hop_and_four_cliques_of_all_edges(spark, monkeypatch):
    rows = some_edges(spark, monkeypatch)
    pairs, links = {r[:2] for r in rows}, {frozenset(r[:2]) for r in rows}
    nodes = sorted({x for p in pairs for x in p})
    near = {a: {b for b in nodes if frozenset((a, b)) in links} for a in nodes}
    got = [tuple(r) for r in registry.QUERIES["j14_two_hop_all"](spark, "").select("src", "dst").collect()]
    assert sorted(got) == sorted({(a, d) for a in nodes for b in near[a] for c, d in pairs if b == c})
    want = dict.fromkeys(nodes, 0)
    for four in itertools.combinations(nodes, 4):
        if all(frozenset(p) in links for p in itertools.combinations(four, 2)):
            want |= {x: want[x] + 1 for x in four}
    got = registry.QUERIES["gr29_four_cliques_by_node"](spark, "").collect()
    assert len(got) == len(want) and {r.node: r.cliques for r in got} == want and sum(want.values()) > 0


def test_steps_of_two_by_lists_and_by_rows(spark, monkeypatch):
    """Ends far apart, below 0 and null; a source of many pairs goes by rows and has the same ends."""
    rnd = random.Random(8)
    first = list({(rnd.randrange(6), rnd.randrange(9)) for _ in range(30)} | {(None, 1), (7, 1)})
    second = list({(rnd.randrange(9), rnd.choice([-5, 3, 1 << 20, 1 << 40, rnd.randrange(300)])) for _ in range(60)} | {(2, None), (1, 4)})
    want = {}
    for a, v in first:
        for w, b in second:
            if v == w:
                want[a, b] = want.get((a, b), 0.0) + v / 4
    x = spark.createDataFrame([(a, v, v / 4) for a, v in first], "src long, via long, p double")
    y = spark.createDataFrame(second, "via long, dst long")
    for most in (2_000_000, 20, 0):
        monkeypatch.setattr(graph, "LISTED", most)
        got = graph.steps_of_two(x, y).collect()
        assert len(got) == len(want) and {(r.src, r.dst): r.p for r in got} == pytest.approx(want)
        got = [tuple(r) for r in graph.steps_of_two(x.drop("p"), y).collect()]
        assert len(got) == len(want) and set(got) == set(want)


def test_ordered_dedup_and_overlap(spark, monkeypatch):
    rows = some_edges(spark, monkeypatch) + [(30, x, x * 1000) for x in range(40, 70)]
    monkeypatch.setattr(queries, "social_edges", lambda spark, d: edges(spark, rows))
    first = lambda src, some: list(dict.fromkeys(r[1] for r in some if r[0] == src))
    listed = lambda x: ",".join(map(str, x))
    got = {r.src: r.candidates for r in registry.QUERIES["s2_l6_ordered_dedup"](spark, "").collect()}
    assert got == {s: listed(first(s, rows)) for s in {r[0] for r in rows}} and len(got[30].split(",")) == 30
    days = sorted({r[2] // 86400 for r in rows})
    past, later = ([r for r in rows if (days.index(r[2] // 86400) >= 22) == late] for late in (False, True))
    got = {r.src: tuple(r)[1:] for r in registry.QUERIES["s2_candidate_overlap"](spark, "").collect()}
    want = {}
    for s in {r[0] for r in rows}:
        truth = set(first(s, later))
        cut = first(s, past)[: len(truth)]
        want[s] = (listed(cut), len(truth), len(truth & set(cut)))
    assert got == want and any(x[2] for x in want.values()) and want[20] == ("", 1, 0) and want[30] == ("", 0, 0)


def test_windows_and_degrees(spark):
    e = edges(spark, [(1, 2, 0), (1, 2, 5), (1, 3, 9), (1, 2, 55)])
    got = {r.w: (r.degree, r.unique_degree) for r in graph.window_degrees(e, 10).collect()}
    assert got == {0: (3, 2), 1: (1, 1)}  # windows without edges get no number


def test_as_of_is_strict(spark):
    e = edges(spark, [(1, 2, 5), (1, 3, 5), (1, 4, 7)])
    q = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 1, 9)], "qid long, node long, t long")
    got = {}
    for r in graph.as_of_neighbors(e, q, 2).collect():
        got.setdefault(r.qid, {})[r.rank] = r.nbr
    assert got == {2: {1: 3, 2: 2}, 3: {1: 4, 2: 3}}


def test_edgebank_threshold(spark):
    train = edges(spark, [(1, 2)] * 3 + [(1, 3)])
    got = {r.dst: r.score for r in graph.edgebank(train, train.select("src", "dst").distinct(), repeat=True).collect()}
    assert got == {2: 1.0, 3: 0.0}


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(edges(spark, rows).select("src", "dst")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges(spark, [])).count() == 0


def test_pagerank_sums_to_one(spark):
    r = graph.pagerank(edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1)])).agg(F.sum("rank")).first()[0]
    assert abs(r - 1) < 1e-9


def test_pagerank_converges(spark):
    rows = [(i, i + 1) for i in range(40)] + [(41, 42), (42, 41), (42, 43), (43, 41), (50, 41), (50, 0), (50, 0)]
    got = {r.node: r.rank for r in graph.pagerank(edges(spark, rows)).collect()}
    links = set(rows)
    nodes = sorted({x for r in rows for x in r})
    out = {x: [b for a, b in links if a == x] for x in nodes}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(400):
        lost = sum(want[x] for x in nodes if not out[x]) / len(nodes)
        new = {x: 0.15 / len(nodes) + 0.85 * lost for x in nodes}
        for a, b in links:
            new[b] += 0.85 * want[a] / len(out[a])
        want = new
    assert sum(abs(got[x] - want[x]) for x in nodes) < 1e-5 and len(got) == len(nodes)


def test_text(spark):
    one = spark.createDataFrame([("<a>1</a><b>2</><a>3</a>", "x.y.z", "GF: 7 gf: [8]")], "x string, y string, z string")
    r = one.select(tx.tags(F.col("x")).alias("m"), tx.to_last_period(F.col("y"), 4).alias("p"), tx.after_last_think(F.lit("a</think>\n\nb")).alias("t")).first()
    assert r.m == {"a": "3", "b": "2"} and r.p == ".y" and r.t == "b"


@pytest.mark.parametrize("name", ["a29_retrieval_metrics", "j9_as_of_neighbors", "gr16_local_clustering", "w2_rank_max", "gr8_components"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(repr([round(float(x), 9) if isinstance(x, (int, float)) else x for x in r]) for r in rows)
    assert plain(registry.QUERIES[name](spark, SF).select(*columns).collect()) == plain(want.fetchall())


def test_common_neighbours_open_wedges_at_the_lesser_corner(spark):
    """Before, a hub's neighbours were looked up for each of its edges: the square of its degree."""
    hub = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1, 199, 3)]
    e = spark.createDataFrame([(i, a, b, i) for i, (a, b) in enumerate(hub)], "edge_id long, src long, dst long, t long")
    got = {(r.a, r.b): r.common for r in graph.triangles_by_pair(e).collect()}
    near = {}
    for a, b in hub:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert got == {(a, b): n for a, b in hub if (n := len(near[a] & near[b]))}
