"""Shortest paths from stated sources: hops, closeness and betweenness, by rounds from the frontier."""

from __future__ import annotations

import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import graph
from chronoweave.operators.distributions import row_numbers
from chronoweave.session import stored


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b), stored: each undirected simple edge both ways."""
    pairs = graph.simple_pairs(edges)
    return stored(pairs.select("a", "b").union(pairs.select("b", "a")))


def levels_from(near: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """One stored table (source, node, hops, paths) for each number of hops: the nodes first reached then, and by how many shortest paths.

    A neighbour of a level lies in it, in the one before or in the next, so only two levels are looked up in a
    round; rounds go on until nothing new is reached, as many as the longest of the shortest paths.
    """
    front = stored(sources.select(F.col("node").alias("source"), F.col("node"), F.lit(0).alias("hops"), F.lit(1.0).alias("paths")).distinct())
    levels = [front]
    while True:
        known = front if len(levels) < 2 else front.unionByName(levels[-2])
        reached = front.join(near, front["node"] == near["a"]).groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        front = reached.join(known.select("source", "node"), ["source", "node"], "left_anti")
        front = stored(front.select("source", "node", F.lit(len(levels)).alias("hops"), "paths"))
        if front.isEmpty():
            return levels
        levels.append(front)


def distances_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops): fewest steps along undirected edges from each of few stated sources to all that they reach."""
    levels = levels_from(neighbours(edges), sources)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("source", "node", "hops")


#: Words of 64 sources in a row of ``reach``.
WORDS = 16


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, hops, nodes): how many nodes lie at each number of hops from each source, itself at 0.

    A source is a bit: a row is a node beside ``64 * WORDS`` sources, and an edge hands on all bits at once, or-ed before the
    shuffle. Rows of a round are at most nodes times sources / 1,024, not one for each source and node.
    """
    near = neighbours(edges)
    at = stored(row_numbers(sources.select("node").distinct(), "node"))
    words, number = [f"_{i}" for i in range(WORDS)], F.col("number")
    bit = lambda i: F.when(F.floor(number / 64) % WORDS == i, F.expr("shiftleft(1L, int(number % 64))")).otherwise(F.lit(0).cast("long")).alias(f"_{i}")
    front = stored(at.select("node", F.floor(number / (64 * WORDS)).alias("bundle"), *[bit(i) for i in range(WORDS)]))
    before, counts, hops = front.limit(0), [], 0
    while not front.isEmpty():
        counts.append(_set_bits(front, words).select("bundle", "bits", F.lit(hops).alias("hops")))
        handed = front.join(near, front["node"] == near["a"]).groupBy(F.col("b").alias("node"), "bundle").agg(*[F.bit_or(w).alias(w) for w in words])
        # a neighbour of a level lies in it, in the one before or in the next
        known = (front.unionByName(before) if hops else front).groupBy("node", "bundle").agg(*[F.bit_or(w).alias(f"k{w}") for w in words])
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"k{w}", F.lit(0).cast("long")))).alias(w) for w in words]
        reached = handed.join(known, ["node", "bundle"], "left").select("node", "bundle", *fresh)
        before, front, hops = front, stored(reached.where(" or ".join(f"{w} <> 0" for w in words))), hops + 1
    if not counts:
        return sources.select(F.col("node").alias("source"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("nodes")).limit(0)
    bits = reduce(DataFrame.unionByName, counts).select("hops", F.col("bundle"), F.posexplode("bits").alias("place", "n")).where("n > 0")
    bits = bits.groupBy((F.col("bundle") * 64 * WORDS + F.col("place")).alias("number"), "hops").agg(F.sum("n").alias("nodes"))
    return bits.join(at, "number").select(F.col("node").alias("source"), "hops", "nodes")


def _set_bits(rows: DataFrame, words: list[str]) -> DataFrame:
    """(bundle, bits): how often each bit is set, for a batch of rows and a bundle."""

    def counted(batches):
        for batch in batches:
            bundle = batch.column(0).to_numpy()
            data = np.stack([batch.column(i + 1).to_numpy() for i in range(len(words))], axis=1).astype("<i8")
            for b in np.unique(bundle):
                bits = np.unpackbits(np.ascontiguousarray(data[bundle == b]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(b)]), pa.array([bits.tolist()], pa.list_(pa.int64()))], names=["bundle", "bits"])

    return rows.select("bundle", *words).mapInArrow(counted, "bundle long, bits array<long>")


#: Nodes and sources of a block, and edges of a chunk: a block is 8 to 32 MB when it is full, a chunk 1 MB.
NODES, SOURCES, CHUNK = 32_768, 128, 262_144


def _packed(x: np.ndarray) -> bytes:
    """A block of numbers, nothing for zeros: places and values if few are set, values in two bytes if these can hold them."""
    flat = x.ravel()
    at = np.flatnonzero(flat)
    if not len(at):
        return b""
    sparse = 8 * len(at) < len(flat)
    values = flat[at] if sparse else flat
    small = bool(values.min() >= 0 and values.max() < 65_536 and (values == np.rint(values)).all())
    return bytes([sparse, small]) + (at.astype("<i4").tobytes() if sparse else b"") + values.astype("<u2" if small else "<f8").tobytes()


def _unpacked(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    x = np.zeros(shape[0] * shape[1])
    if data:
        kind = np.dtype("<u2" if data[1] else "<f8")
        if data[0]:
            n = (len(data) - 2) // (4 + kind.itemsize)
            x[np.frombuffer(data, "<i4", n, 2)] = np.frombuffer(data, kind, n, 2 + 4 * n)
        else:
            x[:] = np.frombuffer(data, kind, offset=2)
    return x.reshape(shape)


def _add_along(y: np.ndarray, x: np.ndarray, to: np.ndarray, of: np.ndarray) -> None:
    """Add to each row ``to`` of y the row ``of`` of x; ``to`` is sorted. The r-th edges of many nodes are added at once."""
    nodes, start, count = np.unique(to, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    for i in range(0, len(order), 512):
        some = order[i : i + 512]
        first, fewer = start[some], -count[some]
        total = np.zeros((len(some), x.shape[1]))
        for r in range(-fewer[0]):
            m = np.searchsorted(fewer, -r)
            total[:m] += x[of[first[:m] + r]]
        y[nodes[some]] += total


def _edge_chunks(near: DataFrame, numbers: DataFrame, height: int) -> DataFrame:
    """(block, part, to, of), stored: the edges from each block of nodes (``part``) to each other, about ``CHUNK`` in a row, as places in their blocks."""
    size = CHUNK

    def cut(block, part, x, y):
        ends = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1
        for i, j in zip([0, *ends], [*ends, len(x)]):
            data = [[int(block[i])], [int(part[i])], [x[i:j].astype("<u2").tobytes()], [y[i:j].astype("<u2").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "part", "to", "of"])

    def chunks(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= size:
                yield from cut(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from cut(*map(np.concatenate, zip(*held)))

    e = near.join(numbers.select(F.col("node").alias("a"), F.col("number").alias("x")), "a").join(numbers.select(F.col("node").alias("b"), F.col("number").alias("y")), "b")
    place = lambda c: [F.floor(F.col(c) / height), F.pmod(F.col(c), F.lit(height))]
    e = e.select(*[c.cast("long").alias(n) for c, n in zip(place("x") + place("y"), ("block", "to", "part", "of"))]).select("block", "part", "to", "of")
    return stored(e.repartitionByRange("block", "part", "to").sortWithinPartitions("block", "part", "to").mapInArrow(chunks, "block long, part long, to binary, of binary"))


def _along(own: DataFrame, given: DataFrame, wanted: DataFrame, edges: DataFrame, shape, backward: bool) -> DataFrame:
    """(batch, block, n, paths, dependency), stored: what the blocks ``given`` hand along the edges to the ``wanted`` (batch, block).

    Forward, numbers of paths, but to nodes set in ``own``; backward, shares of the dependency, to nodes set in ``own``.
    A task takes one wanted block after the other and of each the given blocks in turn, every one followed by its edges, so it holds three blocks
    and a chunk at a time, and neither the graph nor all of a source's nodes.
    """
    wanted = F.broadcast(wanted.select("batch", "block"))
    whole = ["batch", "block", "part", "kind", "x", "y"]
    mine = own.join(wanted, ["batch", "block"]).select("batch", "block", F.lit(-1).cast("long").alias("part"), F.lit(0).alias("kind"), F.col("paths").alias("x"), F.col("dependency").alias("y"))
    come = given.withColumnRenamed("block", "part").join(wanted, "batch").select("batch", "block", "part", F.lit(0).alias("kind"), F.col("paths").alias("x"), F.col("dependency").alias("y"))
    keys = F.broadcast(given.select("batch", F.col("block").alias("part")).join(wanted, "batch"))
    links = edges.join(keys, ["block", "part"]).select("batch", "block", "part", F.lit(1).alias("kind"), F.col("to").alias("x"), F.col("of").alias("y"))

    def result(key, set_, y):
        out = set_ * y if backward else np.where(set_ > 0, 0.0, y)
        n = int(np.count_nonzero(set_ if backward else out))
        if n:
            row = [[key[0]], [key[1]], [n], [_packed(set_ if backward else out)], [_packed(out) if backward else b""]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["batch", "block", "n", "paths", "dependency"])

    def step(batches):
        key = set_ = x = y = None
        for batch in batches:
            for i in range(batch.num_rows):
                s, p, part, kind, first, second = (c[i].as_py() for c in batch.columns)
                if key != (s, p):
                    if key:
                        yield from result(key, set_, y)
                    key, set_, y = (s, p), np.zeros(shape(s, p)), np.zeros(shape(s, p))
                if part < 0:
                    set_ += _unpacked(first, shape(s, p))
                elif not kind:
                    x = _unpacked(first, shape(s, part))
                    if backward:
                        x = np.divide(1 + _unpacked(second, x.shape), x, out=np.zeros_like(x), where=x > 0)
                else:
                    _add_along(y, x, np.frombuffer(first, "<u2"), np.frombuffer(second, "<u2"))
        if key:
            yield from result(key, set_, y)

    rows = mine.select(whole).union(come.select(whole)).union(links.select(whole))
    tasks = max(1, min(wanted.count(), 2_000))
    rows = rows.repartition(tasks, "batch", "block").sortWithinPartitions("batch", "block", "part", "kind")
    return stored(rows.mapInArrow(step, "batch long, block long, n long, paths binary, dependency binary"))


def _by_blocks(near: DataFrame, numbers: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """(number, dependency): a row is a block of ``NODES`` nodes beside ``SOURCES`` sources, not a node and a source, and an edge is handed on once for each batch of sources."""
    height, width = NODES, SOURCES
    shape = lambda s, p: (min(height, n - p * height), min(width, k - s * width))

    def starts(batches):
        for batch in batches:
            for s, p, places in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.zeros(shape(s, p))
                x[[v["at"] % height for v in places], [v["number"] % width for v in places]] = 1
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([p]), pa.array([len(places)]), pa.array([_packed(x)]), pa.array([b""])], names=["batch", "block", "n", "paths", "dependency"])

    first = asked.groupBy(F.floor(F.col("number") / width).cast("long").alias("batch"), F.floor(F.col("at") / height).cast("long").alias("block")).agg(F.collect_list(F.struct("at", "number")).alias("places"))
    levels = [stored(first.mapInArrow(starts, "batch long, block long, n long, paths binary, dependency binary"))]
    chunks = _edge_chunks(near, numbers, height)
    spark = near.sparkSession
    grid = spark.range(-(-k // width)).select(F.col("id").alias("batch")).join(spark.range(-(-n // height)).select(F.col("id").alias("block")))
    full = F.least(F.lit(height), n - F.col("block") * height) * F.least(F.lit(width), k - F.col("batch") * width)
    while True:
        # a neighbour of a level lies in it, in the one before or in the next; where all is reached nothing is new
        have = reduce(DataFrame.unionByName, [x.select("batch", "block", "n") for x in levels]).groupBy("batch", "block").agg(F.sum("n").alias("n"))
        still = stored(grid.join(have, ["batch", "block"], "left").where(F.coalesce("n", F.lit(0)) < full).select("batch", "block"))
        if still.isEmpty():
            break
        level = _along(reduce(DataFrame.unionByName, levels[-2:]), levels[-1], still, chunks, shape, False)
        if level.isEmpty():
            break
        levels.append(level)

    def summed(batches):
        for batch in batches:
            for s, p, data in zip(*(c.to_pylist() for c in batch.columns)):
                total = _unpacked(data, shape(s, p)).sum(axis=1)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at + p * height, pa.int64()), pa.array(total[at])], names=["number", "dependency"])

    parts = levels[-1:]
    for level in reversed(levels[1:-1]):
        parts.append(_along(level, parts[-1], level, chunks, shape, True))
    parts = reduce(DataFrame.unionByName, parts).where(F.length("dependency") > 0).select("batch", "block", "dependency")
    return parts.mapInArrow(summed, "number long, dependency double")


#: Chunks of edges up to which a task walks the whole graph: 268,435,456 neighbours, 1 GB of its scratch folder.
CHUNKS = 1_024


def _neighbour_lists(near: DataFrame, numbers: DataFrame) -> DataFrame:
    """(low, high, nodes, counts, near), stored: the numbers of nodes ``low`` to ``high``, how many neighbours of each follow, and these; about ``CHUNK`` neighbours a row."""
    size = CHUNK

    def cut(x, y):
        for i in range(0, len(x), size):
            nodes, counts = np.unique(x[i : i + size], return_counts=True)
            data = [[int(nodes[0])], [int(nodes[-1])], *([v.astype("<i4").tobytes()] for v in (nodes, counts, y[i : i + size]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, [pa.int64()] * 2 + [pa.binary()] * 3)], names=["low", "high", "nodes", "counts", "near"])

    def lists(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= size:
                yield from cut(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from cut(*map(np.concatenate, zip(*held)))

    e = near.join(numbers.select(F.col("node").alias("a"), F.col("number").alias("x")), "a").join(numbers.select(F.col("node").alias("b"), F.col("number").alias("y")), "b").select("x", "y")
    return stored(e.repartitionByRange("x").sortWithinPartitions("x", "y").mapInArrow(lists, "low long, high long, nodes binary, counts binary, near binary"))


class _Walk:
    """Dependencies of all nodes on one source after the other.

    The lists of neighbours lie in a scratch file that is mapped, of a node some numbers are in memory, and lists of about ``some`` neighbours at a time.
    """

    def __init__(self, n: int, places: int, some: int):
        self.file, self.places, self.some = tempfile.TemporaryFile(), places, some
        self.start, self.near = np.zeros(n + 1, np.int64), None
        self.total, self.paths, self.given, self.level = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int32)

    def add(self, nodes: bytes, counts: bytes, near: bytes) -> None:
        """The next lists in the order of nodes; one may be told in several rows."""
        self.start[np.frombuffer(nodes, "<i4") + 1] += np.frombuffer(counts, "<i4")
        self.file.write(near)

    def _lists(self, nodes):
        """(i, j, counts, neighbours of the nodes i to j - 1)."""
        first = self.start[nodes]
        counts = self.start[nodes + 1] - first
        ends, i = np.cumsum(counts), 0
        while i < len(nodes):
            before = ends[i] - counts[i]
            j = max(i + 1, int(np.searchsorted(ends, before + self.some, "right")))
            c = counts[i:j]
            yield i, j, c, self.near[np.arange(ends[j - 1] - before) + np.repeat(first[i:j] - (ends[i:j] - c - before), c)]
            i = j

    def _many(self, nodes) -> int:
        return int((self.start[nodes + 1] - self.start[nodes]).sum())

    def _give(self, nodes, values):
        """(nodes, sums): what the neighbours of ``nodes`` get if these hand on their values."""
        if 16 * self._many(nodes) < len(self.total):
            to, x = zip(*((to, np.repeat(values[i:j], c)) for i, j, c, to in self._lists(nodes)))
            to, at = np.unique(np.concatenate(to), return_inverse=True)
            return to, np.bincount(at, np.concatenate(x))
        y = np.zeros(len(self.total))
        for i, j, c, to in self._lists(nodes):
            y += np.bincount(to, np.repeat(values[i:j], c), minlength=len(y))
        to = np.flatnonzero(y)
        return to, y[to]

    def _take(self, nodes, givers, values):
        """What each of ``nodes`` gets if ``givers`` hand on their values."""
        x, y = np.zeros(len(self.total)), np.empty(len(nodes))
        x[givers] = values
        for i, j, c, to in self._lists(nodes):
            y[i:j] = np.add.reduceat(x[to], np.cumsum(c) - c)
        return y

    def source(self, s: int) -> None:
        """Forward by levels, then backward; edges are looked up from the side that has fewer of them."""
        if self.near is None:
            self.file.flush()
            np.cumsum(self.start, out=self.start)
            self.near = np.memmap(self.file, "<i4", "r")
        level, paths, given = self.level, self.paths, self.given
        level.fill(-1)
        given.fill(0)
        levels, level[s], paths[s] = [np.array([s])], 0, 1
        left = self.places - self._many(levels[0])
        while left:
            front = levels[-1]
            if self._many(front) <= left:
                new, got = self._give(front, paths[front])
                fresh = level[new] < 0
            else:
                new = np.flatnonzero(level < 0)
                got = self._take(new, front, paths[front])
                fresh = got > 0
            new = new[fresh]
            if not len(new):
                break
            level[new], paths[new] = len(levels), got[fresh]
            levels.append(new)
            left -= self._many(new)
        for h in range(len(levels) - 1, 1, -1):
            low, to = levels[h], levels[h - 1]
            share = (1 + given[low]) / paths[low]
            if self._many(low) < self._many(to):
                to, got = self._give(low, share)
                before = level[to] == h - 1
                to, got = to[before], got[before]
            else:
                got = self._take(to, low, share)
            given[to] = paths[to] * got
            self.total[to] += given[to]


def _walked(near: DataFrame, numbers: DataFrame, asked: DataFrame, n: int, k: int, places: int) -> DataFrame:
    """(number, dependency): sources dealt to tasks, two a core; each is sent the lists of neighbours once and hands on one sum a node.

    What is shuffled and written grows with the edges and the tasks, not with the sources.
    """
    tasks, some = min(k, 2 * near.sparkSession.sparkContext.defaultParallelism), 16 * CHUNK

    def summed(batches):
        task = walk = None
        for batch in batches:
            for i in range(batch.num_rows):
                mine, of_source, low, _, *lists = (c[i].as_py() for c in batch.columns)
                if task != mine:
                    if walk:
                        yield from out(walk)
                    task, walk = mine, _Walk(n, places, some)
                if of_source:
                    walk.source(low)
                else:
                    walk.add(*lists)
        if walk:
            yield from out(walk)

    def out(walk):
        at = np.flatnonzero(walk.total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(walk.total[at])], names=["number", "dependency"])

    none = [F.lit(None).cast("binary").alias(c) for c in ("nodes", "counts", "near")]
    lists = _neighbour_lists(near, numbers).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(0).alias("of_source"), "low", "high", "nodes", "counts", "near")
    sources = asked.select((F.col("number") % tasks).cast("int").alias("task"), F.lit(1).alias("of_source"), F.col("at").alias("low"), F.col("at").alias("high"), *none)
    rows = lists.union(sources).repartitionById(tasks, "task").sortWithinPartitions("task", "of_source", "low", "high")
    return rows.mapInArrow(summed, "number long, dependency double")


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, dependency): the sum over sources s and nodes t of the share of shortest paths from s to t that pass the node.

    Neither end counts as passed. With all nodes as sources this is twice the usual undirected count, and divided
    by (n - 1)(n - 2) the normalised betweenness; with some, the part of it that these sources give. Forward,
    levels carry the numbers of paths; backward, from the last level, each node hands its paths' share of
    (1 + its own dependency) to its neighbours one level before. Where the numbers of one source are no more than a block
    and the edges at most ``CHUNKS`` chunks, tasks walk from their sources one by one and nothing of a source leaves its task;
    larger graphs go by blocks.
    """
    near = neighbours(edges)
    numbers = stored(row_numbers(near.select(F.col("a").alias("node")).distinct(), "node"))
    asked = stored(row_numbers(sources.select("node").distinct().join(numbers, "node").select("node", F.col("number").alias("at")), "node"))
    n, k, places = numbers.count(), asked.count(), near.count()
    if not k:
        return numbers.select("node", F.lit(0.0).alias("dependency"))
    whole = n <= NODES * SOURCES and places <= CHUNKS * CHUNK
    parts = _walked(near, numbers, asked, n, k, places) if whole else _by_blocks(near, numbers, asked, n, k)
    total = parts.groupBy("number").agg(F.sum("dependency").alias("dependency"))
    return numbers.join(total, "number", "left").select("node", F.coalesce("dependency", F.lit(0.0)).alias("dependency"))
