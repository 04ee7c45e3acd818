"""Iterative graph algorithms against brute force on small graphs, and on graphs without edges."""

import math
import random
from collections import Counter, deque
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave import registry
from chronoweave.operators import distributions as dist
from chronoweave.operators import graph, kernels, orbits, ordering, paths, projection, sampling, spectrum, structure
from chronoweave.session import release, stored

EDGES = "edge_id long, src long, dst long, t long"


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, i) for i, (a, b) in enumerate(pairs)], EDGES)


def random_pairs(seed, nodes, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(n)]


def adjacency(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def hops_from(near, s):
    seen, queue = {s: 0}, deque([s])
    while queue:
        for m in near[x := queue.popleft()]:
            if m not in seen:
                seen[m] = seen[x] + 1
                queue.append(m)
    return seen


def test_row_numbers(spark):
    rows = [(k % 7, k) for k in random.Random(1).sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = {(r.a, r.b): r.number for r in dist.row_numbers(df, "a", "b").collect()}
    assert got == {x: k for k, x in enumerate(sorted(rows))}
    assert dist.row_numbers(df.limit(0), "a").count() == 0


def test_running_counts(spark):
    rows = [(k % 5, k, k % 3 % 2) for k in random.Random(2).sample(range(500), 200)]
    got = {(r.a, r.b): r.n for r in dist.running_counts(spark.createDataFrame(rows, "a long, b long, f int").repartition(4), "f", "a", "b", name="n").collect()}
    total, want = 0, {}
    for a, b, f in sorted(rows):
        total += f
        want[a, b] = total
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_as_of_neighbours(spark, k):
    pairs = [p for p in random_pairs(13, 5, 60) if p[0] != p[1]]
    rows = [(i, a, b, i // 3) for i, (a, b) in enumerate(pairs)]
    queries = [(q, q % 6, q // 2) for q in range(40)]  # node 5 has no events
    got = {}
    for r in graph.as_of_neighbors(spark.createDataFrame(rows, EDGES), spark.createDataFrame(queries, "qid long, node long, t long"), k).collect():
        got.setdefault(r.qid, {})[r.rank] = (r.nbr, r.nbr_t)
    for q, x, t in queries:
        past = sorted((u, i, y) for i, a, b, u in rows for n, y in ((a, b), (b, a)) if n == x and u < t)[-k:]
        assert got.get(q, {}) == {k_ + 1: (y, u) for k_, (u, i, y) in enumerate(reversed(past))}


def test_release_deletes_what_was_stored(spark):
    one = stored(spark.range(5))
    assert one.count() == 5 and release(spark) > 0 and release(spark) == 0
    with pytest.raises(Exception):
        one.collect()


# --- orders ------------------------------------------------------------------------------------------------------


def plain_cuthill_mckee(near, peripheral):
    done, out, starts, left = set(), [], [], set(near)
    while left:
        part = set(hops_from(near, next(iter(left))))
        left -= part
        start = min(part, key=lambda x: (len(near[x]), x))
        if peripheral:
            best, far, asked = start, -1, start
            while True:
                hops = hops_from(near, asked)
                reach = max(hops.values())
                if reach <= far:
                    break
                best, far = asked, reach
                asked = min((x for x in hops if hops[x] == reach), key=lambda x: (len(near[x]), x))
            start = best
        starts.append(start)
    for start in sorted(starts, key=lambda x: (len(near[x]), x)):
        queue = deque([start])
        done.add(start)
        while queue:
            x = queue.popleft()
            out.append(x)
            for m in sorted(near[x] - done, key=lambda m: (len(near[m]), m)):
                done.add(m)
                queue.append(m)
    return out


@pytest.mark.parametrize("peripheral", [False, True])
def test_cuthill_mckee(spark, peripheral):
    pairs = random_pairs(5, 40, 38) + [(100, 101), (101, 102), (102, 103), (103, 104), (101, 105), (200, 200)]
    order = plain_cuthill_mckee(adjacency(pairs), peripheral)
    got = {r.node: r.number for r in ordering.cuthill_mckee(edges(spark, pairs), reverse=False, peripheral=peripheral).collect()}
    assert got == {x: k for k, x in enumerate(order)}
    reverse = ordering.cuthill_mckee(edges(spark, pairs), peripheral=peripheral)
    assert {r.node: r.number for r in reverse.collect()} == {x: len(order) - 1 - k for k, x in enumerate(order)}
    gaps = sorted(r.gap for r in ordering.bandwidth(edges(spark, pairs), reverse).collect())
    assert gaps == sorted(abs(got[a] - got[b]) for a, b in pairs if a != b)


def test_order_of_nothing(spark):
    assert ordering.cuthill_mckee(edges(spark, [])).count() == 0


# --- paths -------------------------------------------------------------------------------------------------------


def test_hops_have_no_bound(spark):
    path = [(k, k + 1) for k in range(70)]
    got = paths.distances_from(edges(spark, path), spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.hops for r in got.collect()} == {k: k for k in range(71)}


def plain_betweenness(near, sources):
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        hops, count, order = hops_from(near, s), Counter({s: 1}), []
        order = sorted(hops, key=hops.get)
        for x in order[1:]:
            count[x] = sum(count[y] for y in near[x] if hops[y] == hops[x] - 1)
        dep = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            for y in near[x]:
                if hops[y] == hops[x] - 1:
                    dep[y] += count[y] / count[x] * (1 + dep[x])
            if x != s:
                total[x] += dep[x]
    return total


def test_betweenness(spark):
    pairs = [(a, b) for a, b in random_pairs(6, 30, 45) if a != b] + [(50, 51)]
    near = adjacency(pairs)
    for sources in (list(near), [x for x in near if x % 3 == 0]):
        got = paths.betweenness(edges(spark, pairs), spark.createDataFrame([(x,) for x in sources], "node long"))
        assert {r.node: r.dependency for r in got.collect()} == pytest.approx(plain_betweenness(near, sources))
    star = [(0, k) for k in range(1, 6)]
    got = {r.node: r.dependency for r in paths.betweenness(edges(spark, star), spark.range(6).toDF("node")).collect()}
    assert got == {0: 20.0, **dict.fromkeys(range(1, 6), 0.0)}  # (n - 1)(n - 2): the centre's normalised value is 1
    assert paths.betweenness(edges(spark, []), spark.range(3).toDF("node")).count() == 0


def test_betweenness_by_blocks(spark, monkeypatch):
    """Blocks of several nodes and sources, some full and some nearly empty, chunks of few edges: rows are blocks, not (source, node)."""
    for name, size in (("NODES", 7), ("SOURCES", 4), ("CHUNK", 16)):
        monkeypatch.setattr(paths, name, size)
    made, along = [], paths._along
    monkeypatch.setattr(paths, "_along", lambda *a: made.append(along(*a)) or made[-1])
    pairs = [(a, b) for a, b in random_pairs(6, 30, 60) if a != b] + [(50, 51)] + [(60, 61), (61, 62), (62, 63)]
    near = adjacency(pairs)
    sources = [x for x in near if x % 2 == 0]
    got = paths.betweenness(edges(spark, pairs), spark.createDataFrame([(x,) for x in sources], "node long"))
    assert {r.node: r.dependency for r in got.collect()} == pytest.approx(plain_betweenness(near, sources))
    assert max(x.count() for x in made) <= -(-len(near) // 7) * -(-len(sources) // 4)


@pytest.mark.parametrize("chunk", [1, 5, paths.CHUNK])
def test_betweenness_keeps_what_is_of_a_source_in_its_task(spark, monkeypatch, chunk):
    """Before, blocks of nodes beside sources were stored and shuffled at each level, every block to all blocks of its batch."""
    made, keep = [], paths.stored
    monkeypatch.setattr(paths, "CHUNK", chunk)
    monkeypatch.setattr(paths, "stored", lambda df: made.append(keep(df)) or made[-1])
    pairs = [(a, b) for a, b in random_pairs(8, 40, 90) if a != b] + [(k, k + 1) for k in range(100, 150)] + [(200, k) for k in range(201, 240)]
    near = adjacency(pairs)
    sources = [x for x in near if x % 7 == 0]
    got = paths.betweenness(edges(spark, pairs), spark.createDataFrame([(x,) for x in sources], "node long"))
    assert {r.node: r.dependency for r in got.collect()} == pytest.approx(plain_betweenness(near, sources))
    assert len(made) == 4 and not any("batch" in x.columns for x in made)  # edges, two numberings and lists of neighbours, whatever the levels


@pytest.mark.parametrize("values", [[0.0] * 40, [0.0] * 39 + [2.0], [1.0, 65535.0] * 20, [1.0, 65536.0] * 20, [0.0] * 39 + [0.5], [1e300, -1.0] * 20])
def test_blocks_are_packed_without_loss(values):
    x = np.array(values).reshape(8, 5)
    assert (paths._unpacked(paths._packed(x), (8, 5)) == x).all()


# --- spectra -----------------------------------------------------------------------------------------------------


def laplacian(pairs):
    near = adjacency([p for p in pairs if p[0] != p[1]])
    at = {x: k for k, x in enumerate(near)}
    m = np.zeros((len(at), len(at)))
    for a in near:
        for b in near[a]:
            m[at[a], at[b]] = 1
    d = 1 / np.sqrt(m.sum(axis=0))
    return np.eye(len(at)) - m * d * d[:, None]


def test_spectral_shares_of_many_snapshots(spark):
    parts = {0: random_pairs(7, 300, 900), 1: random_pairs(8, 200, 2500), 2: [(k, k + 1) for k in range(250)] + [(3, 3)]}
    rows = [(w, a, b) for w, part in parts.items() for a, b in part]
    got = {r.w: r for r in spectrum.spectra(spark.createDataFrame(rows, "w long, src long, dst long"), "w", 20).collect()}
    for w, part in parts.items():
        values = np.linalg.eigvalsh(laplacian(part))
        want = np.histogram(values, bins=20, range=(0, 2 + 1e-9))[0] / len(values)
        assert got[w].nodes == len(values) and sum(got[w].h) == pytest.approx(1)
        assert abs(np.array(got[w].h) - want).sum() / 2 < 0.08  # total variation from the dense shares


def test_moments_equal_traces(spark):
    pairs = random_pairs(9, 60, 150)
    m = laplacian(pairs) - np.eye(len(laplacian(pairs)))
    t = [np.eye(len(m)), m]
    for _ in range(8):
        t.append(2 * m @ t[-1] - t[-2])
    want = [np.trace(x) / len(m) for x in t[:7]]
    one = edges(spark, pairs).withColumn("w", F.lit(1))
    got = spectrum.moments(one, "w", 7, probes=24).first()
    assert len(got.moments) == 7 and got.moments[0] == 1.0
    assert got.moments == pytest.approx(want, abs=0.08)
    assert len(spectrum.moments(one, "w", 1, probes=2).first().moments) == 1
    assert spectrum.spectra(one.where("w = 2"), "w", 5).count() == 0


def test_moments_of_small_and_large_snapshots(spark, monkeypatch):
    """Snapshots that a task takes by itself and those that go by joins have the same moments; the first store one table of edges and no vectors."""
    rows = [(0, a, b) for a, b in random_pairs(4, 20, 40)] + [(1, a, b) for a, b in random_pairs(5, 30, 80)]
    e = spark.createDataFrame(rows, "w long, src long, dst long")
    found, tables = {}, {}
    for most in (2_000_000, 45, 0):
        monkeypatch.setattr(spectrum, "WHOLE", most)
        made = []
        monkeypatch.setattr(spectrum, "stored", lambda df: made.append(df) or stored(df))
        found[most] = {r.w: (r.nodes, r.moments) for r in spectrum.moments(e, "w", 6, probes=3).collect()}
        tables[most] = len(made)
    for w, (nodes, moments) in found[0].items():
        for most in (2_000_000, 45):
            assert found[most][w][0] == nodes and found[most][w][1] == pytest.approx(moments)
    assert tables[2_000_000] == 2 < tables[0]


# --- orbits ------------------------------------------------------------------------------------------------------


def plain_orbits(near):
    out = {x: [0] * 15 for x in near}
    linked = lambda *v: [(a, b) for a, b in combinations(v, 2) if b in near[a]]
    for a, b in combinations(near, 2):
        if b in near[a]:
            out[a][0] += 1
            out[b][0] += 1
    for v in combinations(near, 3):
        e = linked(*v)
        if len(e) == 3:
            for x in v:
                out[x][3] += 1
        if len(e) == 2:
            k = Counter(x for p in e for x in p)
            for x in v:
                out[x][k[x]] += 1
    names = {(3, (1, 1, 2, 2)): {1: 4, 2: 5}, (3, (1, 1, 1, 3)): {1: 6, 3: 7}, (4, (2, 2, 2, 2)): {2: 8}, (4, (1, 2, 2, 3)): {1: 9, 2: 10, 3: 11}, (5, (2, 2, 3, 3)): {2: 12, 3: 13}, (6, (3, 3, 3, 3)): {3: 14}}
    for v in combinations(near, 4):
        e = linked(*v)
        k = Counter(x for p in e for x in p)
        name = names.get((len(e), tuple(sorted(k[x] for x in v))))
        if name:
            for x in v:
                out[x][name[k[x]]] += 1
    return out


@pytest.mark.parametrize("seed,nodes,n", [(1, 14, 30), (2, 12, 60), (3, 25, 50), (4, 9, 200)])
def test_orbits(spark, seed, nodes, n):
    pairs = [p for p in random_pairs(seed, nodes, n) if p[0] != p[1]] + [(90, 91), (92, 92)]
    want = plain_orbits(adjacency([p for p in pairs if p[0] != p[1]]))
    assert {r.node: r.orbits for r in orbits.orbit_counts(edges(spark, pairs)).collect()} == want


def test_orbits_take_no_row_for_a_pair_of_neighbours(spark, monkeypatch):
    made = []
    for module in (graph, orbits):
        monkeypatch.setattr(module, "stored", lambda df: made.append(stored(df)) or made[-1])
    sides = [(a, b) for a in range(20) for b in range(20, 40)]
    got = orbits.orbit_counts(edges(spark, sides)).collect()
    assert {r.orbits[8] for r in got} == {19 * 190} and len(got) == 40
    assert max(df.count() for df in made) == len(sides)  # of 7,600 pairs of neighbours


@pytest.mark.parametrize("listed,flushed,far", [(30, 40, 1), (30, 1_000_000, 1 << 17), (2_000_000, 40, 1)])
def test_orbits_by_slices_and_flushes(spark, monkeypatch, listed, flushed, far):
    monkeypatch.setattr(graph, "LISTED", listed)
    monkeypatch.setattr(graph, "FLUSHED", flushed)
    if far > 1:  # gaps of four bytes
        ranked = graph.ranked
        spread = lambda n, p: (n.withColumn("rank", F.col("rank") * far), p.withColumn("lo", F.col("lo") * far).withColumn("hi", F.col("hi") * far))
        monkeypatch.setattr(graph, "ranked", lambda e: spread(*ranked(e)))
    pairs = [p for p in random_pairs(5, 20, 110) if p[0] != p[1]] + [(0, k) for k in range(30, 50)]
    want = plain_orbits(adjacency(pairs))
    assert {r.node: r.orbits for r in orbits.orbit_counts(edges(spark, pairs)).collect()} == want
    assert graph.triangles(edges(spark, pairs)).count() * 3 == sum(o[3] for o in want.values())
    assert graph.four_cliques(edges(spark, pairs)).count() * 4 == sum(o[14] for o in want.values())


def test_measures_by_snapshot(spark):
    parts = {3: random_pairs(11, 12, 40), 4: random_pairs(12, 12, 20)}
    df = spark.createDataFrame([(w, a, b) for w, part in parts.items() for a, b in part if a != b], "w long, src long, dst long")
    got = {(r.w, r.node): r.orbits for r in structure.by_snapshot(orbits.orbit_counts, df, "w").collect()}
    assert got == {(w, x): o for w, part in parts.items() for x, o in plain_orbits(adjacency([p for p in part if p[0] != p[1]])).items()}
    clustering = {(r.w, r.node): r.triangles for r in structure.by_snapshot(graph.local_clustering, df, "w").collect()}
    assert clustering == {k: o[3] for k, o in got.items()}


def test_snapshot_bundle_makes_its_windows_and_counts_once(spark, monkeypatch):
    plans = []
    counts = orbits.orbit_counts
    monkeypatch.setattr(orbits, "orbit_counts", lambda e: plans.append(e._jdf.queryExecution().optimizedPlan().toString()) or counts(e))
    monkeypatch.setattr(graph, "local_clustering", None)
    got = {r.kind: r.mmd for r in registry.QUERIES["gr22_snapshot_bundle"](spark, "/root/testdata/sf0.001").collect()}
    assert len(plans) == 1 and "Window" not in plans[0]
    monkeypatch.undo()
    assert got["cluster"] == registry.QUERIES["gr22_cluster_mmd"](spark, "/root/testdata/sf0.001").first().mmd


# --- kernels -----------------------------------------------------------------------------------------------------


def plain_features(near, radius, distance):
    labels = [{x: (len(near[x]),) for x in near}]
    for _ in range(radius):
        last = labels[-1]
        labels.append({x: (last[x], tuple(sorted(map(repr, (last[y] for y in near[x]))))) for x in near})
    counts = Counter()
    for a in near:
        for b, h in hops_from(near, a).items():
            if a <= b and h <= distance:
                for r in range(radius + 1):
                    counts[(r, h, *sorted((repr(labels[r][a]), repr(labels[r][b]))))] += 1
    size = Counter()
    for f, n in counts.items():
        size[f[:2]] += n * n
    return {f: n / math.sqrt(size[f[:2]]) / math.sqrt(len(size)) for f, n in counts.items()}


@pytest.mark.parametrize("radius,distance", [(0, 0), (2, 1), (2, 3)])
def test_neighbourhood_kernel(spark, radius, distance):
    parts = {w: [p for p in random_pairs(20 + w, 15, 18 + 4 * w) if p[0] != p[1]] for w in range(4)}
    df = spark.createDataFrame([(w, a, b) for w, part in parts.items() for a, b in part], "w long, src long, dst long")
    found = kernels.neighbourhood_pairs(df, "w", radius, distance)
    vectors = {}
    for r in found.collect():
        vectors.setdefault(r.w, {})[r.feature] = r.weight
    want = {w: plain_features(adjacency(part), radius, distance) for w, part in parts.items()}
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    for a in parts:
        for b in parts:
            assert dot(vectors[a], vectors[b]) == pytest.approx(dot(want[a], want[b]))
        assert dot(vectors[a], vectors[a]) == pytest.approx(1)
    mean = lambda x, y: np.mean([dot(want[a], want[b]) for a in x for b in y])
    got = kernels.kernel_mmd(found.where("w < 2"), found.where("w >= 2"), "w").first().mmd
    assert got == pytest.approx(mean([0, 1], [0, 1]) + mean([2, 3], [2, 3]) - 2 * mean([0, 1], [2, 3]))


def test_largest_mmd(spark):
    rnd = np.random.default_rng(3)
    a, b = (rnd.dirichlet(np.ones(5), size=k) for k in (4, 3))
    df = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "h array<double>")
    emd = lambda x, y: np.abs(np.cumsum(x - y)).sum()
    square = lambda x, y: np.array([[emd(p, q) ** 2 for q in y] for p in x])
    for scaled in (False, True):
        factor = math.sqrt(square(a, b).mean()) if scaled else 1
        want = max(np.exp(-square(a, a) / (2 * (s * factor) ** 2)).mean() + np.exp(-square(b, b) / (2 * (s * factor) ** 2)).mean() - 2 * np.exp(-square(a, b) / (2 * (s * factor) ** 2)).mean() for s in (0.1, 0.5, 2))
        assert structure.largest_mmd(df(a), df(b), "emd", [0.1, 0.5, 2], scaled).first().mmd == pytest.approx(want)


# --- projections -------------------------------------------------------------------------------------------------


def normals(spark, n, seed, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    return {r.k: np.array(r.g) for r in df.select("k", sampling.gaussians(n, seed, "k").alias("g")).collect()}


def test_normal_numbers(spark):
    g = np.array(list(normals(spark, 6, 1, range(4000)).values()))
    assert g.shape == (4000, 6) and abs(g.mean()) < 0.02 and abs(g.std() - 1) < 0.02
    assert abs(np.corrcoef(g.T) - np.eye(6)).max() < 0.06 and abs((g**4).mean() - 3) < 0.2


@pytest.mark.parametrize("longest,with_features", [(1000, False), (23, False), (1000, True), (37, True)])
def test_projection_equals_dense_product(spark, longest, with_features):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(8), rnd.randrange(8), i // 2, rnd.random() * 9, rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, t long, u double, v double")
    vectors = {x: [rnd.random() for _ in range(3)] for x in range(6)}
    features = spark.createDataFrame(list(vectors.items()), "node long, x array<double>") if with_features else None
    scale = lambda c: (c - c.min()) / (c.max() - c.min() + 1e-6)
    t, u, v = (scale(np.array([r[k] for r in rows], float)) for k in (3, 4, 5))
    flat = np.array(list(vectors.values()))
    own = {x: (np.array(f) - flat.min()) / (flat.max() - flat.min() + 1e-6) for x, f in vectors.items()}
    feature = lambda x: own.get(x, np.zeros(3)) if with_features else np.zeros(0)
    events = {}
    for k, (i, a, b, *_rest) in enumerate(rows):
        for role, (x, y) in enumerate(((a, b), (b, a))):
            events.setdefault(x, []).append((t[k], i, y, [*feature(y), u[k], v[k], t[k], role]))
    matrix = normals(spark, 5, 7, range(longest))
    want = {}
    for x, own_events in events.items():
        line = np.concatenate([e[3] for e in sorted(own_events, key=lambda e: e[:3])] + [feature(x)])[:longest]
        want[x] = sum((w * matrix[k] for k, w in enumerate(line)), np.zeros(5)) / math.sqrt(longest)
    found = projection.node_projections(df, ["u", "v"], 5, 7, longest, features)
    got = {r.node: r.z for r in found.collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x].tolist(), abs=1e-9) for x in want)
    side = normals(spark, 4, 8, want)
    whole = sum(np.outer(want[x], side[x]) for x in want) / math.sqrt(len(want))
    rows_ = {r.i: r.row for r in projection.projection(df, ["u", "v"], 5, 4, 7, longest, features).collect()}
    assert np.allclose([rows_[i] for i in range(5)], whole)


def test_projection_keeps_distances(spark):
    """Johnson and Lindenstrauss: with 64 columns, squared lengths of these vectors' differences stay within half of themselves."""
    rnd = random.Random(9)
    rows = [(i, i % 6, 100 + i, i, rnd.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, t long, u double")
    longest = 400
    z = {r.node: np.array(r.z) for r in projection.node_projections(df, ["u"], 64, 3, longest).where("node < 6").collect()}
    t = (np.arange(240) / (239 + 1e-6)).tolist()
    u = np.array([r[4] for r in rows])
    u = (u - u.min()) / (u.max() - u.min() + 1e-6)
    line = {x: np.concatenate([[u[i], t[i], 0.0] for i in range(x, 240, 6)]) for x in range(6)}
    for a, b in combinations(range(6), 2):
        got, want = ((z[a] - z[b]) ** 2).sum() * longest / 64, ((line[a] - line[b]) ** 2).sum()
        assert 0.5 * want < got < 1.5 * want


def test_similarity_of_a_graph_with_itself(spark):
    df = spark.createDataFrame([(i, i % 5, (i * 3 + 1) % 5, i, float(i % 4)) for i in range(40)], "edge_id long, src long, dst long, t long, u double")
    one = projection.projection(df, ["u"], 6, 3)
    assert projection.similarity(one, one, 3).first().similarity == pytest.approx(1, abs=1e-4)
