"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

1. Each document's set of word shingles is hashed to 64 bits and sketched by SuperMinHash.
2. Documents with one and the same set collapse to the smallest doc_id.
3. The others meet in band buckets. Every member of a bucket meets the bucket's smallest set, its centre, once
   (a star, not all pairs), and full sets are compared. What differs from the centre is kept: two documents of
   one centre are compared exactly by |x ^ y| = |dx| + |dy| - 2 |dx & dy|, without their sets.
4. Where the members of a centre are then not yet one group, further stars and at last the pairs of different
   groups are compared so (see ``_inner_links``), without a cap.
5. Verified links and collapsed copies go to connected components.

Scale: signatures, not texts, meet in buckets; a group of any number of copies is one aggregate row each. Texts
of documents that have a candidate are read again once, and their sets are shuffled once, to their centres, in
parts of bounded size. Nothing but counts reaches the driver. Pairs at the threshold miss all 32 bands of 4 with
probability 5e-8.

Defined cases: null, empty and white-space texts have no shingles and no links; a null doc_id links with
nothing and is its own (null) component; rows that share a doc_id are one document whose links are the
union of theirs, each row is returned; empty tables give no rows; other columns are kept or ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.hashing import byte_values, mix, pieces, prefix_sums, shingle_hashes, slice_hashes, text_bytes, words
from chronoweave.operators.components import connected_components
from chronoweave.session import small_batches, stored

SLOTS, ROWS = 128, 4
#: Up to so many documents with a candidate (some 50 MB), their centres go to the texts by a broadcast, beyond by a shuffled join.
MAX_BROADCAST_IDS = 200_000
#: Members of a centre that one task compares with it.
PART = 1000
#: Words of 64 bits in the sketch of a difference.
WIDE = 8
#: Pairs to compare for each member of a centre, on average, above which further stars come first, and how often at most.
MANY, STARS = 10, 3
_U = np.uint64


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, pointers): the distinct shingle hashes of each text, sorted; those of text i at pointers[i]:pointers[i+1].

    Words are what stands between white space, A-Z lower-cased; a text of fewer words is one shingle.
    """
    raw = b"\n".join(t.lower() for t in texts) + b"\n"
    buf = np.frombuffer(raw, dtype=np.uint8)
    space = np.ones(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = False
    start, end = words(buf, space)
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, start, side="right")
    word = slice_hashes(prefix_sums(buf, byte_values(7)), start, end)
    h, owner = shingle_hashes(word, doc, width)
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.array([_short(word[first[i] : first[i + 1]]) for i in few], dtype=_U)
        h, owner = np.concatenate((h, short)), np.concatenate((owner, few))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _short(word: np.ndarray):
    h = np.array([len(word)], dtype=_U)
    for w in word:
        h = mix(h * _U(0x9E3779B97F4A7C15) + w)
    return h[0]


def superminhash(elements: np.ndarray, pointers: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures [documents, slots] of sets of hashes.

    Element e takes part in round j with value j + r(e, j) in slot pi_e(j), pi_e a random permutation of
    its own, so the slots of one element have correlated ranks. A document whose slots all hold values
    below j stops: later rounds cannot lower any. pi_e is drawn step by step (Fisher-Yates).
    """
    n = len(pointers) - 1
    out = np.full(n * slots, np.inf)
    doc = np.repeat(np.arange(n), np.diff(pointers))
    drawn = mix(elements ^ _U(0xA0761D6478BD642F))
    slot = (drawn & _U(2047)).astype(np.int64) % slots
    np.minimum.at(out, doc * slots + slot, (drawn >> _U(11)).astype(np.float64) * 2.0**-53)
    perm = None
    for j in range(1, slots):
        going = out.reshape(n, slots).max(axis=1, initial=0) > j
        keep = going[doc]
        if not keep.any():
            break
        elements, doc, slot = elements[keep], doc[keep], slot[keep]
        rows = np.arange(len(elements))
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            perm[rows, slot] = 0
            perm[rows, 0] = slot
        elif not keep.all():
            perm = perm[keep]
        drawn = mix(elements ^ mix(np.full(1, j, dtype=_U) * _U(0xE7037ED1A0B428DB)))
        k = j + (drawn & _U(2047)).astype(np.int64) % (slots - j)
        slot = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[rows, j]
        np.minimum.at(out, doc * slots + slot, j + (drawn >> _U(11)).astype(np.float64) * 2.0**-53)
    return out.reshape(n, slots)


def band_hashes(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(_U)
    bands = bits.reshape(len(bits), -1, rows)
    h = np.tile(np.arange(1, bands.shape[1] + 1, dtype=_U), (len(bits), 1))
    for j in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + bands[:, :, j])
    return h.view(np.int64)


def prints(elements: np.ndarray, pointers: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.concatenate(([_U(0)], np.cumsum(mix(elements ^ _U(seed)), dtype=_U)))
    return mix(sums[pointers[1:]] - sums[pointers[:-1]] + np.diff(pointers).astype(_U)).view(np.int64)


def sketches(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set1, set2, bands): set1 and set2 fingerprint the whole set."""

    def sketch(batches):
        for batch in batches:
            texts = [text_bytes(t) for t in batch["text"]]
            for a, b in pieces(texts):
                elements, pointers = shingle_sets(texts[a:b], width)
                n = np.diff(pointers)
                bands = band_hashes(superminhash(elements, pointers))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, "n_shingles": n, "set1": prints(elements, pointers, 1), "set2": prints(elements, pointers, 2), "bands": [x if c else None for x, c in zip(bands, n)]})

    source = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInPandas(sketch, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>")


def _routes(classes: DataFrame, percent: int) -> DataFrame:
    """(a, own, to): documents that share a bucket with another, the fingerprint of their set, and whom they meet.

    The smallest set of a bucket is its centre, known by its fingerprint. ``to`` lists (c, part, lead): the centres
    c of the document's buckets. The members of a centre are dealt to parts of about ``PART``; the centre itself,
    which leads, goes to each of them, so that no centre makes a long task.
    """
    members = classes.select("n", "set1", F.explode("bands").alias("bucket"))
    of = F.struct("n", "set1")
    centres = members.groupBy("bucket").agg(F.min(of).alias("_c"), F.max(of).alias("_d")).where("_c < _d").select("bucket", F.col("_c.set1").alias("c"), F.col("_c.n").alias("least"))
    pairs = members.join(centres, "bucket").where("set1 <> c")
    pairs = stored(pairs.groupBy("set1", "c").agg(F.first("n").alias("n"), F.first("least").alias("least")))
    several = pairs.groupBy("c").agg((F.count("*") > 1).alias("several"))
    # a lone member too unlike its centre in size has nothing to be compared with
    pairs = pairs.join(several, "c").where((100 * F.col("least") >= percent * F.col("n")) | F.col("several")).select("set1", "c")
    parts = pairs.groupBy("c").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "c").select("set1", "c", F.pmod(F.xxhash64("set1", "c"), "parts").alias("part"), F.lit(False).alias("lead"))
    leads = parts.select(F.col("c").alias("set1"), "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"))
    to = dealt.unionByName(leads).groupBy("set1").agg(F.collect_list(F.struct("c", "part", "lead")).alias("to"))
    return to.join(classes.select("set1", "rep"), "set1").select(F.col("rep").alias("a"), F.col("set1").alias("own"), "to")


def _compared(docs: DataFrame, routes: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """(c, b, a, linked, n, d, bits) of each document a and each centre b (fingerprint c) that it meets, from full sets.

    ``linked``: 100 * intersection >= percent * union; ``n``: the size of a's set; ``d``: the symmetric difference,
    from which two documents of one centre can be compared without their sets; ``bits``: which of ``64 * WIDE``
    places the elements of d fall on.
    """

    def build(batches):
        for batch in batches:
            texts = [text_bytes(t) for t in batch["text"]]
            for i, j in pieces(texts):
                elements, pointers = shingle_sets(texts[i:j], width)
                mine = prints(elements, pointers, 1) == batch["own"].to_numpy()[i:j]  # not another text of the same doc_id
                at = np.flatnonzero(mine)
                yield pd.DataFrame({"a": batch["a"].to_numpy()[i:j][at], "to": batch["to"].iloc[i:j].array[at], "x": [elements[pointers[k] : pointers[k + 1]].tobytes() for k in at]})

    def check(batches):
        c = b = q = None
        for batch in batches:
            rows = []
            for centre, lead, a, x in zip(batch["c"], batch["lead"], batch["a"], batch["x"]):
                p = np.frombuffer(x, dtype=_U)
                if lead:
                    c, b, q = centre, a, p
                elif centre == c:
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    same = q[at] == p
                    both = int(same.sum())
                    other = np.ones(len(q), dtype=bool)
                    other[at[same]] = False
                    d = np.concatenate((p[~same], q[other])).view(np.int64)
                    places = np.zeros(64 * WIDE, dtype=bool)
                    places[d & (64 * WIDE - 1)] = True
                    rows.append((c, b, a, 100 * both >= percent * (len(p) + len(q) - both), len(p), d, np.packbits(places).view(np.int64)))
            yield pd.DataFrame(rows, columns=["c", "b", "a", "linked", "n", "d", "bits"])

    to = F.broadcast(routes) if routes.count() <= MAX_BROADCAST_IDS else routes
    wanted = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text")).join(to, F.col("_id") == to["a"]).select("a", "own", "to", "text")
    sets = wanted.mapInPandas(build, "a long, to array<struct<c:bigint,part:bigint,lead:boolean>>, x binary")
    dealt = sets.select("a", "x", F.inline("to")).repartition("c", "part").sortWithinPartitions("c", "part", F.desc("lead"))
    return dealt.select("c", "lead", "a", "x").mapInPandas(check, "c long, b long, a long, linked boolean, n long, d array<long>, bits array<long>")


def _near(x, y, percent: int):
    """100 * intersection >= percent * union of two sets, from their sizes n and differences d to a third.

    |d_x & d_y| is at most the places that both hit and the elements that share a place with another, of the side
    with fewer; pairs for which even that is too few are settled before the elements are looked at.
    """
    k = (100 + percent) / (100 - percent)
    apart, room = F.size(x["d"]) + F.size(y["d"]), (x["n"] + y["n"] + F.lit(1e-6)) / k
    possible = F.abs(F.size(x["d"]) - F.size(y["d"])) <= room
    shared = sum((F.bit_count(x["bits"][i].bitwiseAND(y["bits"][i])) for i in range(1, WIDE)), F.bit_count(x["bits"][0].bitwiseAND(y["bits"][0])))
    most = shared + F.least(F.size(x["d"]) - x["places"], F.size(y["d"]) - y["places"])
    return possible & (apart - 2 * most <= room) & (apart - 2 * F.size(F.array_intersect(x["d"], y["d"])) <= room)


def _groups(links: DataFrame) -> DataFrame:
    return stored(connected_components(links, "a", "b").select(F.col("node").alias("_node"), F.col("component").alias("_g")))


def _open(members: DataFrame) -> DataFrame:
    """Of (c, g, ...): rows of centres whose members form several groups, with the largest as ``main``."""
    size = members.groupBy("c", "g").agg(F.count("*").alias("_k"))
    main = size.groupBy("c").agg(F.count("*").alias("_groups"), F.max_by("g", F.struct("_k", -F.col("g"))).alias("main"))
    return stored(members.join(main.where("_groups > 1").select("c", "main"), "c"))


def _inner_links(compared: DataFrame, percent: int) -> DataFrame:
    """Links whose components are those of all links between a centre and its members, and between its members.

    Documents that a centre leaves outside its members' largest group are the rest. It is compared with all members of
    other groups, inside the join, so that only links come out of it. While that would be over ``MANY`` pairs for each
    member, further stars first join most of the rest: round the member nearest to the centre that no star has reached.
    All comparisons are exact.
    """
    links = compared.where("linked").select("a", "b")
    groups = _groups(links)
    members = compared.select("c", "a", F.size("d").alias("far"))
    left = _open(members.join(groups, members["a"] == groups["_node"], "left").select("c", "a", "far", F.coalesce("_g", "a").alias("g")))
    apart = None
    for _ in range(STARS):
        size = left.groupBy("c").agg(F.count("*").alias("k"), F.count_if(F.col("g") != F.col("main")).alias("r")).agg(F.sum(F.col("k") * F.col("r")).alias("pairs"), F.sum("k").alias("k")).first()
        if size.k is None:
            return links
        if apart is None:
            places = sum((F.bit_count(F.col("bits")[i]) for i in range(1, WIDE)), F.bit_count(F.col("bits")[0]))
            apart = compared.select("c", F.struct("a", "n", "d", "bits", places.alias("places")).alias("x"))
            apart = apart.join(left.select("c").distinct(), "c", "left_semi")
        if size.pairs <= MANY * size.k:
            break
        rest = left.where("g <> main and far is not null")
        star = rest.groupBy("c").agg(F.min_by("a", F.struct("far", "a")).alias("star"))
        named = apart.join(star, "c")
        centre = named.where(F.col("x")["a"] == F.col("star")).select("c", F.col("x").alias("y"))
        pairs = named.where(F.col("x")["a"] != F.col("star")).join(centre, "c")
        more = stored(pairs.where(_near(F.col("x"), F.col("y"), percent)).select("c", F.col("x")["a"].alias("a"), F.col("star").alias("b")))
        links = links.unionByName(more.select("a", "b"))
        # groups of groups: only what the new links join
        g = left.select(F.col("a").alias("_n"), "g").distinct()
        joined = more.select("a", "b").join(g.toDF("a", "ga"), "a").join(g.toDF("b", "gb"), "b").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
        groups = _groups(joined)
        gone = more.select("c", "a").unionByName(star.select("c", F.col("star").alias("a"))).distinct().withColumn("_gone", F.lit(True))
        left = left.drop("main").join(groups, F.col("g") == F.col("_node"), "left").join(gone, ["c", "a"], "left")
        left = _open(left.select("c", "a", F.expr("if(_gone, null, far)").alias("far"), F.coalesce("_g", "g").alias("g")))
    x, y = F.col("x"), F.col("y")
    placed = left.select("c", F.col("a").alias("_a"), "g", "main").distinct()
    placed = stored(apart.join(placed, (apart["c"] == placed["c"]) & (F.col("x")["a"] == F.col("_a"))).select(apart["c"], "g", "main", "x"))
    rest = placed.where("g <> main")
    other = placed.select("c", F.col("g").alias("h"), F.col("x").alias("y"))
    pairs = rest.join(other, "c").where((F.col("g") != F.col("h")) & ((F.col("h") == F.col("main")) | (x["a"] < y["a"])) & _near(x, y, percent))
    return links.unionByName(pairs.select(x["a"].alias("a"), y["a"].alias("b")))


def near_duplicate_links(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(sketches, links): links (a, b) whose connected components are the near-duplicate groups."""
    sketch = stored(sketches(docs, width, text, key))
    some = sketch.where("doc_id is not null and n_shingles > 0")
    classes = stored(some.groupBy("set1", "set2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.count("*").alias("rows")))
    several = classes.where("rows > 1").select("set1", "set2", "rep")
    copies = some.join(several, ["set1", "set2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    compared = stored(_compared(docs, stored(_routes(classes, percent)), width, percent, text, key))
    return sketch, stored(_inner_links(compared, percent).unionByName(copies))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    sketch, links = near_duplicate_links(docs, width, percent, text, key)
    groups = connected_components(links, "a", "b")
    out = sketch.join(groups, sketch["doc_id"] == groups["node"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs``, same columns, with the document of the smallest doc_id of each group."""
    _, links = near_duplicate_links(docs, width, percent, text, key)
    gone = connected_components(links, "a", "b").where("node <> component").select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
