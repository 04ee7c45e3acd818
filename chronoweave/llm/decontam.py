"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence that occurs in some benchmark item. Each document is streamed
through it; after every word the longest suffix read so far that occurs in the benchmark is known, and
with it whether a whole window ends there and whose items have that window.

Scale: documents never move. The benchmark is dealt by a hash of item_id into shards of about ``MAX_SHARD_WORDS``
words; tasks build one automaton for each and write it to the shared folder, and the driver passes them on one at
a time to be broadcast. The rows pass through the shards one after the other, each adding its hits; after every
``TOGETHER`` shards they are written out, so that no worker holds more automata than that.

Defined cases: null, empty and wordless texts have no words and no hits; null or wordless items have no
windows; repeated items count once by item_id, repeated documents each get their row; an empty benchmark
hits nothing; other columns of the input are kept, and the working columns have names of their own.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm.hashing import text_bytes
from chronoweave.session import small_batches, stored

#: One shard's automaton has at most twice as many states as words: about 200 MB in a worker.
MAX_SHARD_WORDS = 400_000
#: Automata that one chain of workers holds.
TOGETHER = 4
#: Bytes that are part of words, after A-Z became a-z: digits, a-z and everything beyond ASCII.
WORD_BYTES = bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_SPACED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))


def words_of(text) -> list[bytes]:
    return text_bytes(text).translate(_SPACED).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, annotated for windows of ``window`` words.

    ``add`` extends it online with one item. ``finish`` gives each state the items whose windows end in
    it: sequences of at least ``window`` words through their substrings of that length, shorter items
    through their whole sequence.
    """

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[tuple] = []
        #: Items by the state of their windows, and short items by the state that they end in.
        self.owners: dict[int, set] = {}
        self.whole: dict[int, set] = {}
        self.shortest = window

    def _new(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of (longest string of p) + c, cut off from longer strings if it shared their state."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def add(self, item, words: list[bytes]) -> None:
        if not words:
            return
        self.shortest = min(self.shortest, len(words))
        state = 0
        self.items.append((item, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]))
        for c in self.items[-1][1]:
            state = self._extend(state, c)

    def finish(self) -> "SuffixAutomaton":
        """Walks the items once more, now that states no longer split, and notes who owns which window.

        A short item is the longest string of its state, for it stands at its own start, where no longer one ends.
        """
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: The state of the last ``window`` words of a state's strings, and the next state up the suffix links that is a short item.
        self.window_state, self.short_above = [0] * len(self.next), [0] * len(self.next)
        for s in order:
            self.window_state[s] = self.window_state[self.link[s]] if self.length[self.link[s]] >= self.window else s
        for item, ids in self.items:
            state = 0
            for n, c in enumerate(ids, 1):
                state = self.next[state][c]
                if n >= self.window:
                    self.owners.setdefault(self.window_state[state], set()).add(item)
            if len(ids) < self.window:
                self.whole.setdefault(state, set()).add(item)
        for s in order:
            up = self.link[s]
            self.short_above[s] = up if up in self.whole else self.short_above[up]
        self.items = []
        return self

    def scan(self, ids: list[int], offset: int, spans: list, windows: set, shorts: set, longest: int = 0) -> int:
        """Streams words through the automaton; adds merged hit spans [from, to) and the states of windows and short items found; the longest match.

        Of what ends at a word only the longest makes a span; short items inside another are noted on the way up the
        suffix links, which stops at one that is noted already. So time and memory are in proportion to words and states.
        """
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = match = 0
        for i, c in enumerate(ids, offset + 1):
            while state and c not in nxt[state]:
                state = link[state]
                match = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                match += 1
            short = state if match == length[state] and state in self.whole else self.short_above[state]
            reach = length[short]
            if match >= window:
                reach = window
                windows.add(self.window_state[state])
            while short and short not in shorts:
                shorts.add(short)
                short = self.short_above[short]
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
            if match > longest:
                longest = match
        return longest

    def hits(self, words: list[bytes]) -> tuple[list, set, int]:
        """Merged hit spans, owning items and longest match of a document's words."""
        spans: list = []
        windows: set = set()
        shorts: set = set()
        longest = 0
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.shortest  # a word of no item ends every match
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist()):
            longest = self.scan(ids[a:b].tolist(), a, spans, windows, shorts, longest)
        items = set().union(*(self.owners[s] for s in windows if s in self.owners), *(self.whole[s] for s in shorts))
        return merge(spans), items, longest


def merge(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def automata(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> Iterator[bytes]:
    """Pickled automata over the benchmark in shards of bounded words, built by tasks, one at a time in the driver."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    shards = max(1, -(-total // MAX_SHARD_WORDS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton(window)
        for i, t in sorted(zip(group["item"], group["text"])):
            automaton.add(i, words_of(t))
        return pd.DataFrame({"automaton": [cloudpickle.dumps(automaton.finish())]})  # by value: executors need no installed package

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    built = stored(dealt.groupBy("shard").applyInPandas(build, "automaton binary"))
    for row in built.toLocalIterator():
        yield bytes(row.automaton)


_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("text", T.StringType())])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", into: str = "contamination", cut: bool = False) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, longest match, sorted items, merged hit spans in words, text without them if ``cut``."""
    spark = small_batches(docs).sparkSession
    shards = automata(benchmark, window)
    shard = next(shards, None) or cloudpickle.dumps(SuffixAutomaton(window).finish())
    docs = docs.withColumn(into, F.lit(None).cast(_HITS))
    k = 0
    while shard is not None:
        following = next(shards, None)
        if k and k % TOGETHER == 0:
            docs = stored(docs)
        find = F.pandas_udf(_finder(spark.sparkContext.broadcast(shard), cut and following is None), _HITS).asNondeterministic()
        before = F.struct(F.col(into)["longest"].alias("longest"), F.col(into)["items"].alias("items"), F.col(into)["spans"].alias("spans"))
        docs = docs.withColumn(into, find(F.col(text), before))
        shard, k = following, k + 1
    return docs


def _finder(shared, cut: bool):
    """Adds one automaton's hits to those found before; asked to be evaluated once by being non-deterministic."""

    def find(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automaton = pickle.loads(shared.value)
        for texts, before in batches:
            rows = []
            for t, most, own, old in zip(texts, before["longest"], before["items"], before["spans"]):
                words = words_of(t)
                spans, items, longest = automaton.hits(words)
                if old is not None:
                    spans = merge([*spans, *(tuple(x) for x in old)])
                    items, longest = items | set(own), max(longest, int(most))
                rows.append((len(words), longest, sorted(items), [list(s) for s in spans], without(t, spans) if cut else None))
            yield pd.DataFrame(rows, columns=_HITS.names)

    return find


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, hit words, items with occurring windows and their digest."""
    c = F.col("contamination")
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return find_hits(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id",
        c["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without(text, spans: list):
    """The text without the words of the spans; what stands between two cut words goes with them."""
    if text is None or not spans:
        return text
    raw = text_bytes(text)
    flags = np.frombuffer(bytes(b > 0x20 for b in raw.translate(_SPACED)), dtype=np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0]))))
    starts, ends = edge[::2], edge[1::2]
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without contaminated spans; rows whose hit words pass ``max_coverage`` of all words go whole.

    Columns are those of ``docs``; a row without hits is returned as it is, null text included.
    """
    c = F.col("_contamination")
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    found = find_hits(docs, benchmark, window, text, "_contamination", cut=True).where(hit <= F.lit(max_coverage) * c["n_words"])
    return found.withColumn(text, c["text"]).select(*docs.columns)
