"""Samplers, quantiles, ranks, snapshots and distances against brute force on small fixtures."""

import math
import random
from collections import Counter, deque
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave import registry
from chronoweave.functions import calendar as cal
from chronoweave.functions import text as tx
from chronoweave.functions import vectors as vec
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, paths, ranks, reports, retrieval, sampling, structure
from chronoweave.operators.components import connected_components


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, i) for i, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long, t long")


def random_edges(seed, nodes=25, n=80):
    rnd = random.Random(seed)
    return [(a, b) for a, b in ((rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(n)) if a != b]


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], [3.0, 1.0, 2.0, 2.0, 9.5, -4.0], list(np.random.default_rng(1).normal(size=300))])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    assert list(dist.quantiles(df, "v", shares).first()) == pytest.approx([np.quantile(values, p) for p in shares.values()])
    disc = dist.quantiles(df, "v", shares, discrete=True).first()
    assert list(disc) == [sorted(values)[max(0, int(np.ceil(p * len(values))) - 1)] for p in shares.values()]
    assert dist.quantiles(df.where("v > 1e9"), "v", {"a": 0.5}).first().a is None


def test_ranks_mapped(spark):
    have, target = [3, 1, 1, 2, 7, 7, 7], [10, 20, 20, 40]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(have)], "i long, v long")
    t = spark.createDataFrame([(v,) for v in target], "w long")
    place = lambda q: np.interp(q * (len(target) - 1), range(len(target)), sorted(target))
    got = {r.i: r.mapped for r in ranks.mapped(df, "v", t, "w", "mean").collect()}
    assert got == pytest.approx({i: place((1 + sum(x < v for x in have) + (have.count(v) - 1) / 2) / len(have)) for i, v in enumerate(have)})
    order = sorted(range(len(have)), key=lambda i: (have[i], i))
    got = {r.i: r.mapped for r in ranks.mapped(df, "v", t, "w", "i").collect()}
    assert got == pytest.approx({i: place(k / (len(have) - 1)) for k, i in enumerate(order)})


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000)
    for draw in (lambda d: sampling.n_sample(d, "id", 50, 3), lambda d: sampling.fraction(d, "id", 0.3, 4)):
        a, b = (sorted(r.id for r in draw(d).collect()) for d in (df.repartition(2), df.repartition(9)))
        assert a == b and len(set(a)) == len(a)
    assert 500 < sampling.fraction(df, "id", 0.3, 4).count() < 700 and sampling.n_sample(df, "id", 50, 3).count() == 50
    rows = spark.createDataFrame([(1, i, 1.0 if i else 50.0) for i in range(60)], "by long, id long, p double")
    assert Counter(r.id == 0 for s in range(20) for r in sampling.weighted(rows, "by", "id", F.col("p"), 1, s).collect())[True] > 4
    h = spark.createDataFrame([(1, [5, 6]), (2, [])], "src long, h array<long>")
    drawn = sampling.with_replacement(h, "h", 4, 1, "src").collect()
    assert len(drawn) == 4 and {r.picked for r in drawn} <= {5, 6}


def test_rules_are_read_and_not_run(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 1, 9), (3, 1, 1)], "id long, SF int, CN int")
    kept = lambda r: [x.id for x in df.where(sampling.rule(r)).orderBy("id").collect()]
    assert kept({"SF": ">1"}) == [1] and kept({"SF": "> 1", "CN": ">=9"}) == [1, 2] and kept({"SF": "!=5"}) == [2, 3] and kept({}) == [1, 2, 3]
    for bad in ("1", ">x", "=> 1", "__import__('os')", "> nan", "> inf"):
        with pytest.raises(ValueError):
            sampling.rule({"SF": bad})
    with pytest.raises(ValueError):
        reports.required(df, ["missing"])
    assert [r[0] for r in df.select(sampling.recall_size(3, F.col("SF"))).collect()] == [5, 3, 3] and df.select(sampling.recall_size(3, F.col("SF"), 1.5)).first()[0] == 7


def test_text_expressions(spark):
    cases = {"a \\boxed{x{y}{z}} b \\boxed{no}": "x{y}{z}", "\\boxed{}": "", "\\boxed{open {": None, "none": None, None: None, "\\boxed{a}}": "a"}
    df = spark.createDataFrame([(t, w) for t, w in cases.items()], "t string, w string")
    assert all(r.g == r.w for r in df.select("w", tx.first_boxed(F.col("t")).alias("g")).collect())
    words = [("a b c a b c", 3), ("a b", 3), ("", 3), (None, 3), ("x x x x", 2), ("A a\tb", 1)]

    def brute(t, n):
        w = t.lower().split()
        g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        return -(1 - len(set(g)) / len(g)) if g else 0.0

    for t, n in words:
        got = spark.createDataFrame([(t,)], "t string").select(tx.repetition(F.col("t"), n)).first()[0]
        assert (got is None or got == 0) if t is None else got == pytest.approx(brute(t, n))
    code = "x\n```python\na = 1\n```\n```js\nno\n```\n```python\nb\n```"
    assert spark.createDataFrame([(code,)], "t string").select(tx.code_blocks(F.col("t"))).first()[0] == ["a = 1\n", "b\n"]


def test_calendar_and_vectors(spark):
    one = spark.sql("SELECT timestamp'2024-02-29 13:44:59' AS ts, array(1.0D, 2.0D, 4.0D) AS v")
    assert one.select(*cal.features("15min", F.col("ts"))).columns == ["minute", "hour", "day_of_week", "day_of_month", "day_of_year"]
    assert list(one.select(*cal.raw(F.col("ts"))).first()) == [2, 29, 3, 13, 2] and cal.features("Y", F.col("ts")) == []
    with pytest.raises(ValueError):
        cal.features("fortnight", F.col("ts"))
    e = np.exp(np.array([1, 2, 4]) - 4.0)
    assert one.select(vec.softmax(F.col("v"))).first()[0] == pytest.approx((e / e.sum()).tolist())
    assert one.select(vec.padded(F.col("v"), 5, F.lit(-1.0)), vec.padded(F.col("v"), 2, F.lit(-1.0))).first()[0:2] == ([1, 2, 4, -1, -1], [1, 2])
    assert one.select(vec.k3(F.lit(-1.0), F.lit(-1.0)), vec.clipped_ratio(F.lit(0.0), F.lit(-5.0), F.lit(-1.0))).first()[0:2] == (0.0, 3.0)


def test_snapshots_compared(spark):
    rnd = np.random.default_rng(2)
    values = [(w, float(v)) for w in range(4) for v in rnd.integers(0, 9, 30)]
    h = structure.shares(spark.createDataFrame(values, "w int, v double"), "w", "v", 6, 1.0)
    got = {r.w: np.array(r.h) for r in h.collect()}
    want = {w: np.bincount([min(5, int(v)) for x, v in values if x == w], minlength=6) / 30 for w in range(4)}
    assert all(got[w] == pytest.approx(want[w]) for w in want)
    kernels = {"tv": lambda a, b: abs(a - b).sum() / 2, "emd": lambda a, b: abs(np.cumsum(a - b)).sum(), "l2": lambda a, b: np.linalg.norm(a - b)}
    for name, d in kernels.items():
        k = lambda xs, ys: np.mean([np.exp(-d(want[x], want[y]) ** 2 / (2 * 0.25)) for x in xs for y in ys])  # noqa: B023, E731
        value = k([0, 1], [0, 1]) + k([2, 3], [2, 3]) - 2 * k([0, 1], [2, 3])
        assert structure.mmd(h.where("w < 2"), h.where("w >= 2"), name, 0.5).first().mmd == pytest.approx(value)
        assert structure.mmd(h, h, name, 0.5, root=True).first().mmd == pytest.approx(0, abs=1e-7)
    x, y = ([1.0, 2.0, 2.0], [0.0, 5.0])
    df = lambda v: spark.createDataFrame([(a,) for a in v], "k double")
    k = lambda a, b: np.mean([np.exp(-0.3 * (p - q) ** 2) for p in a for q in b])
    assert structure.rbf_mmd(df(x), df(y), "k", 0.3).first().mmd == pytest.approx(k(x, x) + k(y, y) - 2 * k(x, y))


def test_distances(spark):
    pairs = random_edges(3, 40, 45)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in [n for n in near if n % 5 == 0]:
        seen, queue = {s: 0}, deque([s])
        while queue:
            for m in near[x := queue.popleft()]:
                if m not in seen:
                    seen[m] = seen[x] + 1
                    queue.append(m)
        want |= {(s, n): h for n, h in seen.items()}
    sources = spark.createDataFrame([(n,) for n in near if n % 5 == 0], "node long")
    assert {(r.source, r.node): r.hops for r in paths.distances_from(edges(spark, pairs), sources).collect()} == want


def test_pagerank_equals_dense_iteration(spark):
    pairs = random_edges(4) + [(3, 99)]
    ids = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b in set(pairs):
        m[at[b], at[a]] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(ids))
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(300):
        r = 0.15 / len(ids) + 0.85 * m @ r
    got = {x.node: x["rank"] for x in graph.pagerank(edges(spark, pairs), 1e-9).collect()}
    assert [got[v] for v in ids] == pytest.approx(r.tolist(), abs=1e-8)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    from chronoweave.operators import components

    monkeypatch.setattr(components, "FEW", few)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 13] + [(100, i) for i in range(101, 160)] + random_edges(5, 200, 90)
    root = {v: v for p in pairs for v in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in connected_components(edges(spark, pairs).repartition(6)).collect()} == root


def test_echo_chambers_and_hubs(spark):
    rnd = np.random.default_rng(6)
    vectors = {i: rnd.normal(size=4) for i in range(30)}
    pairs = random_edges(7, 30, 120) + [(500, 501)]
    df = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, asked boolean")
    got = {r.node: (r.similar, r.linked, r.chamber) for r in structure.echo_chambers(edges(spark, pairs), df, vec.cosine).collect()}
    nodes = {v for p in pairs for v in p} - {500, 501}
    linked = {frozenset(p) for p in pairs}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = {}
    for i in (i for i in nodes if i % 3 == 0):
        like = [j for j in nodes if j != i and cos(vectors[i], vectors[j]) > 0.5]
        if len(like) >= 3:
            k = sum(frozenset((i, j)) in linked for j in like)
            want[i] = (len(like), k, k / len(like) > 0.01)
    assert got == want
    a, b = [(1, 2), (1, 3), (2, 3), (4, 1), (4, 2)], [(1, 2), (2, 3), (2, 1), (5, 1)]
    s = structure.hub_scores(edges(spark, a), edges(spark, b), 2).first()
    assert (s.precision, s.recall, s.f1) == (0.5, 0.5, 0.5)


def _vectors(spark, n, width=6, seed=3):
    """Random vectors of few different numbers, so that scores tie, with copies, a null, a null inside, another length and nothing."""
    rnd = random.Random(seed)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(width)]) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(40)]
    return rows, spark.createDataFrame(rows + [(n + 40, None), (n + 41, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 42, [1.0]), (n + 43, [])], "vec_id long, embedding array<float>").repartition(3)


def _score(x, y, unit):
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    return dot(x, y) / max(math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)), 1e-8) if unit else dot(x, y)


@pytest.mark.parametrize("score", [vec.cosine, vec.dot])
def test_nearest_by_blocks_keeps_ties_copies_and_odd_vectors_in_order(spark, monkeypatch, score):
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    monkeypatch.setattr(retrieval, "BLOCK", 10)
    rows, df = _vectors(spark, 150)
    found = retrieval.nearest(df.where("vec_id % 10 = 0 and vec_id < 190"), df, 12, score)
    got = {}
    for r in found.collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.sim))
    sound = dict(rows)
    for q in range(0, 190, 10):
        sims = sorted((-round(_score(sound[q], y, score is vec.cosine), 6), i) for i, y in rows if i != q)
        assert [(k, i) for k, i, _ in sorted(got[q])] == [(k + 1, i) for k, (_, i) in enumerate(sims[:12])]
        assert [s for _, _, s in sorted(got[q])] == pytest.approx([-s for s, _ in sims[:12]], abs=1e-12)


def test_count_above_by_blocks_decides_a_bound_as_the_sum_does(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    rows, df = _vectors(spark, 150)
    for score, above in ((vec.dot, 2.0), (vec.cosine, 0.5)):  # many pairs lie at the bound itself
        got = {r.src: r.n for r in retrieval.count_above(df.where("vec_id % 10 = 0"), df, above, score).collect()}
        sure = dict(rows)
        want = {q: sum(_score(sure[q], y, score is vec.cosine) > above for i, y in rows if i != q) for q in sure if q % 10 == 0}
        assert got == {q: n for q, n in want.items() if n}


def test_count_above_in_single_precision_decides_a_bound_as_the_sum_does(spark):
    """Blocks of plain vectors are compared as float32, and what is near the bound is summed: many pairs lie on it, one just beside it."""
    rnd = random.Random(5)
    rows = [(i, [float(rnd.choice((-2, -1, 1, 2))) for _ in range(4)]) for i in range(120)] + [(120, [1.0, 1.0, 1.0, 1.0]), (121, [1e9, 1e9, 1e9, 1.0]), (122, [1e-3, 1e-3, 1e-3, 1e-3 + 1e-12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    for above in (0.5, 0.6, 0.25, _score(rows[120][1], rows[121][1], True), 1.0 - 1e-15):
        got = {r.src: r.n for r in retrieval.count_above(df, df, above).collect()}
        want = {q: sum(_score(x, y, True) > above for i, y in rows if i != q) for q, x in rows}
        assert got == {q: n for q, n in want.items() if n}
    ids, x = [i for i, _ in rows], np.array([x for _, x in rows])
    pair = retrieval._Pair({"ids": ids, "r_ids": ids, "block": 0, "sound": b"\1" * len(ids), "r_sound": b"\1" * len(ids), "width": 4, "r_width": 4, "values": x.tobytes(), "r_values": x.tobytes()}, True)
    s, off = pair.near_units()
    i, j = np.nonzero(~np.eye(len(ids), dtype=bool))
    assert pair.plain() and s.dtype == np.float32 and np.abs(s[i, j] - pair.exact(i, j)).max() < off / 2 and np.isneginf(np.diag(s)).all()


def test_ruled_nearest_falls_back_to_all_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i < 3) for i in range(20)], "vec_id long, embedding array<float>, pass boolean")
    got = {}
    for r in retrieval.ruled_nearest(df.where("vec_id in (0, 10)"), df, 4, 3, score=vec.dot).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    # 10 has three passing others, 0 is itself one of the three
    assert sorted(got[10]) == [(1, 2), (2, 1), (3, 0)] and sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_echo_chambers_make_no_row_of_a_pair_of_similar_nodes(spark, monkeypatch):
    """Before, every pair of a query and a row was scored and joined as a row."""
    seen = []
    joined = retrieval._block_pairs
    monkeypatch.setattr(retrieval, "_block_pairs", lambda *a: seen.extend(joined(*a)) or seen[-1:])
    pairs = [(i, (i + 1) % 300) for i in range(300)]
    v = spark.createDataFrame([(i, [1.0, float(i % 2)], i % 20 == 0) for i in range(300)], "vec_id long, embedding array<float>, asked boolean").repartition(1)
    got = {r.node: (r.similar, r.linked, r.chamber) for r in structure.echo_chambers(edges(spark, pairs), v, vec.cosine, above=0.9).collect()}
    assert got == {i: (149, 0, False) for i in range(0, 300, 20)}
    assert sum(x.count() for x in seen) <= 4 * 4  # pairs of blocks, not 15 x 300 pairs


def test_chambers_of_all_nodes_are_told_apart_from_the_stated_reading(spark, tmp_path):
    """Before, only nodes divisible by 20 were asked, of which there are none here."""
    events = [(i, datetime(2024, 1, 1, 0, 0, i), i, "a") for i in range(1, 7)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1, 9)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["gr31_echo_chamber_difference"](spark, str(tmp_path)).first()
    assert tuple(got) == (6 - 2, round(0.5 - 10 / 5 / 6, 6))  # a path of six: ten ends of edges, five similar to each


def test_reach_counts_the_nodes_of_every_hop_by_bits(spark, monkeypatch):
    """A source is a bit: no level holds a row for each source and node, as levels did before."""
    monkeypatch.setattr(paths, "WORDS", 2)
    pairs = random_edges(5, nodes=180, n=260) + [(1000 + i, 1001 + i) for i in range(70)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    sources = sorted(near)[:150] + [5000]  # more than one bundle of 128, the far path and a node without edges among them
    want = {}
    for s in sources:
        hops, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near.get(x, ()):
                if y not in hops:
                    hops[y] = hops[x] + 1
                    todo.append(y)
        for h, n in Counter(hops.values()).items():
            want[s, h] = n
    kept = []
    keep = paths.stored
    monkeypatch.setattr(paths, "stored", lambda df: kept.append(keep(df)) or kept[-1])
    got = {(r.source, r.hops): r.nodes for r in paths.reach(edges(spark, pairs), spark.createDataFrame([(s,) for s in sources], "node long")).collect()}
    assert got == want
    most = max(x.count() for x in kept if "_0" in x.columns)
    assert most <= 2 * len(near)
    assert paths.reach(edges(spark, pairs), spark.createDataFrame([], "node long")).count() == 0
