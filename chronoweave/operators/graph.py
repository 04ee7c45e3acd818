"""Temporal graph operators over edge DataFrames (src, dst, t, label, edge_id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.distributions import row_numbers, running_counts
from chronoweave.session import stored


def windowed(edges: DataFrame, width: int) -> DataFrame:
    """Edges with w, the rank of their time bucket among the buckets that have edges, from 0."""
    bucket = F.floor(F.col("t") / width).cast("long")
    dim = edges.select(bucket.alias("_b")).distinct().withColumn("w", F.row_number().over(Window.orderBy("_b")).cast("long") - 1)
    return edges.withColumn("_b", bucket).join(F.broadcast(dim), "_b").drop("_b")


def window_degrees(edges: DataFrame, width: int) -> DataFrame:
    """(src, w, degree, unique_degree) of the windows in which a node has edges."""
    return windowed(edges, width).groupBy("src", "w").agg(F.count("*").alias("degree"), F.countDistinct("dst").alias("unique_degree"))


def dense_degrees(edges: DataFrame, width: int) -> DataFrame:
    """``window_degrees`` on the grid of all sources and windows, zeros filled in."""
    some = window_degrees(edges, width)
    grid = some.select("src").distinct().join(F.broadcast(some.select("w").distinct()))
    return grid.join(some, ["src", "w"], "left").select("src", "w", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("unique_degree", F.lit(0)).alias("unique_degree"))


def chronological_split(edges: DataFrame, width: int, input_len: int, pred_len: int) -> DataFrame:
    """Edges with their split by window: train before the last two horizons, then val, then test."""
    e = windowed(edges, width)
    last = e.agg((F.max("w") + 1).alias("_n"))
    n = F.col("_n")
    split = F.when(F.col("w") < n - 2 * pred_len, "train").when(F.col("w") < n - pred_len, "val").otherwise("test")
    return e.join(F.broadcast(last)).where(F.col("w") >= n - input_len - 2 * pred_len).withColumn("split", split).drop("_n")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "t", "edge_id").union(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "t", "edge_id"))


def pair_metrics(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node", "nbr").agg(F.count("*").alias("cnt"))


def node_metrics(edges: DataFrame) -> DataFrame:
    """(node, frequency, neighbors, as_src, as_dst, avg_frequency): touches and their truncated mean by neighbour."""
    pairs = pair_metrics(edges)
    roles = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("s"), F.lit(0).alias("d")).union(edges.groupBy("dst").agg(F.lit(0), F.count("*")))
    roles = roles.groupBy("node").agg(F.sum("s").alias("as_src"), F.sum("d").alias("as_dst"))
    return pairs.groupBy("node").agg(F.sum("cnt").alias("frequency"), F.count("*").alias("neighbors"), F.avg("cnt").cast("long").alias("avg_frequency")).join(roles, "node")


def neighbor_frequency(edges: DataFrame) -> DataFrame:
    f = node_metrics(edges).select(F.col("node").alias("nbr"), F.col("frequency"))
    return pair_metrics(edges).join(f, "nbr").groupBy("node").agg(F.avg("frequency").alias("nbr_frequency"))


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Undirected simple edges (a < b)."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def ranked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, pairs), stored: rank, from 0 in the order of (degree, id), node, k; and simple edges lo < hi by rank, with klo and khi.

    A node has at most sqrt(2 m) neighbours of higher rank.
    """
    p = stored(simple_pairs(edges))
    deg = p.select(F.col("a").alias("node")).union(p.select("b")).groupBy("node").agg(F.count("*").alias("k"))
    nodes = stored(row_numbers(deg, "k", "node", name="rank").select("rank", "node", "k"))
    ends = [nodes.select(F.col("node").alias(c), F.struct("rank", "k").alias(f"_{c}")) for c in ("a", "b")]
    q = p.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("l"), F.greatest("_a", "_b").alias("h"))
    return nodes, stored(q.select(F.col("l.rank").alias("lo"), F.col("h.rank").alias("hi"), F.col("l.k").alias("klo"), F.col("h.k").alias("khi")))


#: Numbers that one flush of ``corners_met`` sorts at once.
FLUSHED = 1_000_000


def corners_met(pairs: DataFrame, cycles: bool = False) -> DataFrame:
    """Rows (x, y, z) of every triangle of ``ranked`` edges, x < y < z, n null; and with ``cycles`` also (x, n), y and z null: cycles of four to add up a node.

    A node hands its neighbours of lower rank to each one of higher rank as one packed list, in place of a row for each
    pair: below itself for triangles, below the receiver for cycles too. At the receiver, an entry of two or more lists
    closes cycles of which the receiver is the highest corner, and an entry that is its own neighbour closes a triangle.
    The work is that of listing wedges at corners of low rank, at most m sqrt(2 m). A receiver of over ``LISTED`` entries
    takes them in slices by entry, each a key of its own; a node's neighbours are one list.
    """
    mass = pairs.groupBy("hi").agg(F.sum("klo").alias("n"))
    heavy = F.broadcast(stored(mass.where(F.col("n") > LISTED).select("hi", F.ceil(F.col("n") / LISTED).cast("int").alias("parts"))))
    tasks = 1 + (pairs.agg(F.sum("klo")).first()[0] or 0) // (2 * TOLD)
    one = F.coalesce("parts", F.lit(1)).alias("parts")
    upward = pairs.join(heavy, "hi", "left").select(F.col("lo").alias("node"), F.struct(F.col("hi").alias("x"), one).alias("s"))
    near = upward.union(pairs.select("hi", F.struct(F.col("lo").alias("x"), F.lit(1).alias("parts")))).groupBy("node").agg(F.collect_list("s").alias("s"))
    near = near.join(heavy, F.col("node") == F.col("hi"), "left").select("node", one, F.col("s.x").alias("x"), F.col("s.parts").alias("slices"))
    names = ["top", "part", "node", "first", "wide", "ends"]

    def packed(x):
        """The first of ascending numbers, the bytes a gap takes, and the gaps."""
        gaps = np.diff(x, prepend=x[:1])
        wide = 2 if gaps.max() < 1 << 16 else 4 if gaps.max() < 1 << 32 else 8
        return int(x[0]), wide, gaps.astype(f"<u{wide}").tobytes()

    def handed(batches):
        out, size = [], 0
        for batch in batches:
            starts, xs, slices = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            for k, (node, parts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, n = xs[starts[k] : starts[k + 1]], slices[starts[k] : starts[k + 1]]
                order = np.argsort(x)
                x, n = x[order], n[order]
                at = int(np.searchsorted(x, node))
                first, wide, raw = packed(x)
                to = [(top, i if cycles else at, s, node) for i, (top, s) in enumerate(zip(x[at:].tolist(), n[at:].tolist()), at)]
                for top, upto, s, of in [*to, (node, at, parts, -1)]:  # -1: the receiver's own
                    if not upto:
                        continue
                    if s == 1:
                        out.append((top, 0, of, first, wide, raw[: upto * wide]))
                        size += upto * wide + 40
                    else:
                        for part in range(s):
                            y = x[:upto][x[:upto] % s == part]
                            if len(y):
                                out.append((top, part, of, *packed(y)))
                                size += len(out[-1][-1]) + 40
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def closed(top, key, node, first, wide, ends):
        """(triangles, sums) of whole keys; rows of a key lie side by side."""
        at, x = [], []
        for w in (2, 4, 8):
            rows = np.flatnonzero(wide == w)
            if len(rows):
                lists = [ends[r] for r in rows.tolist()]
                n = np.array([len(e) // w for e in lists])
                total = np.cumsum(np.frombuffer(b"".join(lists), f"<u{w}"), dtype=np.int64)
                x.append(total - np.repeat(total[np.cumsum(n) - n] - first[rows], n))
                at.append(np.repeat(rows, n))
        at, x = np.concatenate(at), np.concatenate(x)
        span, listed = int(x.max()) + 1, node[at] >= 0
        mine = np.sort(key[at[~listed]] * span + x[~listed])
        below = listed & (x < node[at])
        a, b = at[below], x[below]
        asked = key[a] * span + b
        hit = mine[np.minimum(np.searchsorted(mine, asked), len(mine) - 1)] == asked if len(mine) else np.zeros(len(asked), dtype=bool)
        triangles = b[hit], node[a[hit]], top[a[hit]]
        if not cycles:
            return triangles, None
        bits = len(top).bit_length()
        code = np.sort(x[listed] << bits | at[listed])
        x, at = code >> bits, code & ((1 << bits) - 1)
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (key[at[1:]] != key[at[:-1]])
        lead = np.flatnonzero(new)
        n = np.diff(np.append(lead, len(x)))
        many = n > 1
        lead, both = lead[many], n[many] * (n[many] - 1) // 2
        inside = np.repeat(many, n)
        middle = at[inside]
        return triangles, summed([(x[lead], both), (top[at[lead]], both), (node[middle], np.repeat(n - 1, n)[inside])])

    def summed(parts):
        nodes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(total, at, np.concatenate([p[1] for p in parts]))
        return nodes, total

    def met(batches):
        held, mass, sums, size = [], 0, [], 0

        def flush(last):
            """The triangles of the keys held, of the last one only at the end."""
            nonlocal held, size, sums
            t = pa.Table.from_batches(held).combine_chunks()
            top, part, node, first, wide = (t.column(c).to_numpy() for c in names[:5])
            new = np.ones(len(top), dtype=bool)
            new[1:] = (top[1:] != top[:-1]) | (part[1:] != part[:-1])
            cut = len(top) if last else int(np.flatnonzero(new)[-1])
            held = t.slice(cut).to_batches()
            if not cut:
                return None
            triangles, more = closed(top[:cut], np.cumsum(new[:cut]), node[:cut], first[:cut], wide[:cut], t.column("ends").slice(0, cut).to_pylist())
            if more:
                sums.append(more)
                size += len(more[0])
                if size > 4 * FLUSHED:
                    sums = [summed(sums)]
                    size = len(sums[0][0])
            return rows(*triangles, None) if len(triangles[0]) else None

        def rows(x, y, z, n):
            nothing = lambda v: pa.nulls(len(x), pa.int64()) if v is None else pa.array(v, pa.int64())
            return pa.RecordBatch.from_arrays([nothing(v) for v in (x, y, z, n)], names=["x", "y", "z", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            mass += batch.column(5).nbytes // 2
            if mass > FLUSHED:
                out, mass = flush(False), 0
                if out:
                    yield out
        if held:
            out = flush(True)
            if out:
                yield out
        if sums:
            yield rows(*(lambda s: (s[0], None, None, s[1]))(summed(sums)))

    lists = near.mapInArrow(handed, "top long, part int, node long, first long, wide int, ends binary")
    lists = lists.repartition(min(tasks, 10_000), "top", "part").sortWithinPartitions("top", "part")
    return stored(lists.mapInArrow(met, "x long, y long, z long, n long"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z): every triangle once, corners in the order of (degree, id)."""
    nodes, pairs = ranked(edges)
    t = corners_met(pairs)
    for c in ("x", "y", "z"):
        t = t.join(nodes.select(F.col("rank").alias(c), F.col("node").alias(f"_{c}")), c)
    return t.select(*[F.col(f"_{c}").alias(c) for c in ("x", "y", "z")])


def triangles_by_pair(edges: DataFrame) -> DataFrame:
    """(a, b, common): the common neighbours of linked nodes a < b, the triangles on their edge; pairs of none are left out."""
    sides = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("x", "y"), ("x", "z"), ("y", "z"))])
    return triangles(edges).select(F.explode(sides).alias("s")).groupBy("s.a", "s.b").agg(F.count("*").alias("common"))


def four_cliques_of(corners: DataFrame, linked: DataFrame) -> DataFrame:
    """(x, y, z, v): every clique of four of ranked triangles and edges (lo, hi): two triangles on one edge whose far corners are linked."""
    pairs = corners.select("x", "y", "z").join(corners.select("x", "y", F.col("z").alias("v")), ["x", "y"]).where("z < v")
    return pairs.join(linked.select(F.col("lo").alias("z"), F.col("hi").alias("v")), ["z", "v"]).select("x", "y", "z", "v")


def four_cliques(edges: DataFrame) -> DataFrame:
    """(x, y, z, v): every clique of four once, corners in the order of (degree, id)."""
    nodes, pairs = ranked(edges)
    k = four_cliques_of(corners_met(pairs), pairs)
    for c in ("x", "y", "z", "v"):
        k = k.join(nodes.select(F.col("rank").alias(c), F.col("node").alias(f"_{c}")), c)
    return k.select(*[F.col(f"_{c}").alias(c) for c in ("x", "y", "z", "v")])


def four_cliques_by_node(edges: DataFrame) -> DataFrame:
    """(node, cliques): the cliques of four that a node is part of, 0 for nodes of none."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node is not null").distinct()
    k = four_cliques(edges).select(F.explode(F.array("x", "y", "z", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("cliques"))
    return nodes.join(k, "node", "left").select("node", F.coalesce("cliques", F.lit(0)).alias("cliques"))


#: Pairs of edges from one node up to which one task tells their ends apart by itself.
LISTED = 2_000_000
#: Such pairs of all its nodes that a task tells apart.
TOLD = 1_000_000


def steps_of_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst), distinct, of the rows (src, via) of ``first`` and (via, dst) of ``second``; if ``first`` has p, also its sum.

    Neither holds a row twice. The ends behind a ``via`` go along each row of ``first`` as one list of bytes, and the lists
    of a src meet in one task, so pairs of rows are not shuffled. A src of over ``LISTED`` pairs goes by rows, as nulls do.
    """
    weighted = "p" in first.columns
    names, types = (["src", "dst", "p"], "src long, dst long, p double") if weighted else (["src", "dst"], "src long, dst long")
    first, second = stored(first), stored(second)
    size = second.where("dst is not null").groupBy("via").agg(F.count("*").alias("_n"))
    mass = stored(first.join(size, "via").groupBy("src").agg(F.sum("_n").alias("_n")))
    large = mass.where((F.col("_n") > LISTED) | F.col("src").isNull()).select(F.col("src").alias("_src"))
    tasks = 1 + (mass.agg(F.sum("_n")).first()[0] or 0) // TOLD  # by pairs: the bytes of the lists are few, and would be dealt to few tasks

    def packed(batches):
        for batch in batches:
            vias, out = batch.column(0), []
            for ends in batch.column(1):
                ends = np.sort(ends.values.to_numpy(zero_copy_only=False))
                gaps = np.diff(ends, prepend=ends[:1])
                wide = 2 if gaps.max() < 1 << 16 else 4 if gaps.max() < 1 << 32 else 8
                out.append(bytes([wide]) + ends[:1].tobytes() + gaps.astype(f"<u{wide}").tobytes())
            yield pa.RecordBatch.from_arrays([vias, pa.array(out, pa.binary())], names=["via", "ends"])

    def told_apart(src, lists, p):
        parts = [np.frombuffer(x, "<i8", 1, 1) + np.cumsum(np.frombuffer(x, f"<u{x[0]}", offset=9), dtype=np.int64) for x in lists]
        if not weighted:
            ends = np.unique(np.concatenate(parts))
            return [np.full(len(ends), src), ends]
        ends, at = np.unique(np.concatenate(parts), return_inverse=True)
        return [np.full(len(ends), src), ends, np.bincount(at, weights=np.repeat(p, [len(x) for x in parts]))]

    def joined(batches):
        src, lists, p, out, n = None, [], [], [], 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for row in rows:
            if row[0] != src:
                if lists:
                    out.append(told_apart(src, lists, p))
                    n += len(out[-1][0])
                src, lists, p = row[0], [], []
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)
                    out, n = [], 0
            lists.append(row[1])
            if weighted:
                p.append(row[2])
        if lists:
            out.append(told_apart(src, lists, p))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    some, heavy = not large.isEmpty(), F.broadcast(large)
    light = first.where("src is not null")
    if some:
        light = light.join(large, F.col("src") == F.col("_src"), "left_anti")
    few = size.where(F.col("_n") <= LISTED).select("via")  # a longer list has no src but large ones
    lists = second.where("dst is not null").join(few, "via", "left_semi").groupBy("via").agg(F.collect_list(F.col("dst").cast("long")).alias("ends"))
    lists = stored(lists.mapInArrow(packed, "via long, ends binary"))
    met = light.join(lists, "via").select("src", "ends", *(["p"] if weighted else []))
    out = met.repartition(min(tasks, 10_000), "src").sortWithinPartitions("src").mapInArrow(joined, types)
    rows = []
    if some:
        rows.append(first.join(heavy, F.col("src").eqNullSafe(F.col("_src")), "left_semi").join(second.where("dst is not null"), "via"))
    if not second.where("dst is null").isEmpty():
        rows.append(first.join(second.where("dst is null"), "via"))
    for x in rows:
        x = x.groupBy("src", "dst").agg(F.sum("p").alias("p")) if weighted else x.select("src", "dst").distinct()
        out = out.union(x.select(names))
    return out


def two_hop(edges: DataFrame) -> DataFrame:
    """(src, dst): the distinct destinations of edges that start at a neighbour (either way) of src, src itself among them."""
    near = both_ways(edges).select(F.col("node").alias("src"), F.col("nbr").alias("via")).distinct()
    return steps_of_two(near, edges.select(F.col("src").alias("via"), "dst").distinct())


def local_clustering(edges: DataFrame) -> DataFrame:
    nodes, pairs = ranked(edges)
    t = corners_met(pairs).select(F.explode(F.array("x", "y", "z")).alias("rank")).groupBy("rank").agg(F.count("*").alias("tri"))
    return nodes.join(t, "rank", "left").select("node", "k", F.coalesce("tri", F.lit(0)).alias("triangles"), F.when(F.col("k") < 2, 0.0).otherwise(2.0 * F.coalesce("tri", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("clustering"))


def degree_motifs(edges: DataFrame) -> DataFrame:
    """max, min in-degree, wedges and claws by in-degree with multiplicity."""
    k = edges.groupBy("dst").agg(F.count("*").alias("k"))
    c = F.col("k")
    return k.agg(F.max(c).alias("max_degree"), F.min(c).alias("min_degree"), F.sum(c * (c - 1) / 2).alias("wedges"), F.sum(c * (c - 1) * (c - 2) / 6).alias("claws"))


def as_of_neighbors(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, node, t, nbr, nbr_t, rank): the k most recent neighbours strictly before each query's time.

    One union of history and queries in the order of (node, time), in place of a range join: the running count of
    history up to a query is the place of its latest neighbour, and it takes the k places up to that and from its node's
    first on. Counts go by ranges of the order and places by number, so a busy node is neither one task nor one key.
    """
    h = both_ways(edges).select("node", "t", F.lit(1).alias("o"), "edge_id", "nbr", F.lit(None).cast("long").alias("qid"))
    q = queries.select("node", "t", F.lit(0).alias("o"), F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("long").alias("nbr"), "qid")
    ranked = stored(running_counts(h.unionByName(q), "o", "node", "t", "o", "edge_id", "nbr", "qid", name="n"))  # at equal times a query comes before history
    first = ranked.groupBy("node").agg((F.min(F.col("n") - F.col("o")) + 1).alias("lowest"))
    asked = ranked.where("o = 0").select("qid", "node", F.col("t").alias("qt"), F.col("n").alias("upto")).join(first, "node").where("upto >= lowest")
    asked = asked.withColumn("n", F.explode(F.sequence(F.greatest(F.col("lowest"), F.col("upto") - (k - 1)), F.col("upto"))))
    past = ranked.where("o = 1").select("n", "nbr", F.col("t").alias("nbr_t"))
    return asked.join(past, "n").select("qid", "node", F.col("qt").alias("t"), "nbr", "nbr_t", (F.col("upto") - F.col("n") + 1).alias("rank"))


def edgebank(train: DataFrame, test: DataFrame, since=None, repeat: bool = False) -> DataFrame:
    """``test`` with score 1.0 where its pair is in memory: all pairs, those since a time, or the repeated ones."""
    mem = train if since is None else train.where(F.col("t") >= since)
    mem = mem.groupBy("src", "dst").agg(F.count("*").alias("_n"))
    if repeat:
        mem = mem.join(F.broadcast(mem.agg(F.avg("_n").alias("_m")))).where("_n >= _m")
    return test.join(mem.select("src", "dst", F.lit(1.0).alias("_hit")), ["src", "dst"], "left").withColumn("score", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def pagerank(edges: DataFrame, tol: float = 1e-6, alpha: float = 0.85, rounds: int | None = None) -> DataFrame:
    """(node, rank), iterated until a round changes the ranks by less than ``tol`` in sum, or for a stated number of rounds.

    Multi-edges collapse and dangling mass is spread evenly. The reference stops at ``tol`` times the nodes, a
    bound that large graphs meet after one round; this one implies it. The change shrinks by ``alpha`` a round
    at least, so there are at most log(tol / 2) / log(alpha) rounds, 90 as it stands. Each is stored with its change.
    """
    e = stored(edges.select("src", "dst").distinct())
    nodes = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out")), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", "out", F.lit(1.0 / n).alias("rank"))
    change, done = 1.0, 0
    while change >= tol if rounds is None else done < rounds:
        lost = F.broadcast(ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))
        got = e.join(ranks.where("out is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("c").alias("got"))
        new = (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")
        ranks = stored(ranks.select("node", "out", F.col("rank").alias("was")).join(got, "node", "left").join(lost).select("node", "out", "was", new))
        change, done = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] if rounds is None else change, done + 1
    return ranks.select("node", "rank")


def top_hubs(edges: DataFrame, k: int) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "src").limit(k)


def power_law(edges: DataFrame, xmin: int = 2) -> DataFrame:
    """Closed-form exponent of the degree distribution from ``xmin``: 1 + n / sum ln(x / (xmin - 1/2))."""
    k = edges.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") >= xmin)
    return k.agg((1 + F.count("*") / F.sum(F.log(F.col("k") / (xmin - 0.5)))).alias("alpha"), F.count("*").alias("n"))
