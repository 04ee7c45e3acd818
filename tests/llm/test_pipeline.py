"""The corpus pipeline as a whole: every stage on its own input against brute force, and defined cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoweave.llm import packing, toxicity
from tests.llm.test_operators import DOCS, brute_groups, prose, words_of

INSULTS = ["grobian", "fiesling", "lout"]


def corpus(rnd):
    """(documents, labels, benchmark) with toxic rows, boilerplate, copies, near copies and benchmark passages."""
    docs, labels = [], []
    items = [(i, prose(rnd, 25, 5000)) for i in range(4)] + [(9, None)]

    def add(text, source="a", toxic=None):
        docs.append((len(docs), text, "en", source, len(text or "")))
        if toxic is not None:
            labels.append((docs[-1][0], 1, toxic))

    for _ in range(260):
        words, y = prose(rnd, rnd.randrange(20, 80), 5000).split(), int(rnd.random() < 0.3)
        for _ in range(3 * y):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        add("Top of the site\n" + " ".join(words), rnd.choice("ab"), y)
    base = prose(rnd, 60, 5000)
    for _ in range(6):
        add(base)
    for k in range(4):
        w = base.split()
        w[10 * k] = "edited"
        add(" ".join(w), "b")
    add("before words " + items[0][1] + " after words " + prose(rnd, 60, 5000))
    add(items[1][1], "b")
    for text in (None, "", " \n", "one", "long " + prose(rnd, 30_000, 5000)):
        add(text, None)
    return docs, labels, items


def tables(spark, folder, docs, labels, items, extra=False):
    d = spark.createDataFrame(docs, DOCS)
    if extra:
        for c in ("a", "b", "c", "to", "node", "component", "id", "bucket", "slot", "_id", "_gone", "contamination", "lines", "n_tokens", "text_"):
            d = d.withColumn(c, F.lit("clash"))
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def boilerplate_free(docs):
    """Line dedup by brute force: lines of over 2 % and at least five of a site's different texts."""
    pages = defaultdict(set)
    for d in docs:
        pages[d.source].add(d.text)
    hot = defaultdict(set)
    for site, texts in pages.items():
        n = Counter(line for t in texts if t is not None for line in {x.strip(" ") for x in t.split("\n")} if line)
        hot[site] = {line for line, k in n.items() if k >= 5 and k > 0.02 * len(texts)}
    return {d.doc_id: d.text if d.text is None else "\n".join(x for x in d.text.split("\n") if x.strip(" ") not in hot[d.source]) for d in docs}


def decontaminated(text, items):
    """The text without benchmark windows of ten words, None if over half of its words are in them."""
    words, hit = words_of(text), set()
    for _, x in items:
        v = words_of(x)
        k = min(10, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
    return len(hit), len(words)


@pytest.mark.parametrize("extra", [False, True])
def test_run_stage_by_stage(spark, tmp_path, extra):
    docs, labels, items = corpus(random.Random(20))
    folder = tables(spark, tmp_path, docs, labels, items, extra)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{name}")
        out, before = spark.read.parquet(f"{folder}/{name}"), now.collect()
        rows = out.collect()
        ids = Counter(r.doc_id for r in rows)
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            g = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            assert ids == Counter(r.doc_id for r in before if g.score(r.text) < 0.5)
            assert not any(i in ids for i, _, y in labels if y) and all(i in ids for i, _, y in labels if not y)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in rows} == boilerplate_free(before) and not any("Top of" in (r.text or "") for r in rows)
        elif name == "minhash":
            order = sorted(before, key=lambda r: r.doc_id)
            groups = brute_groups([r.text for r in order], width=5)
            assert ids == Counter(r.doc_id for r, (_, _, kept) in zip(order, groups) if kept)
        elif name == "decontamination":
            want = {r.doc_id: decontaminated(r.text, items) for r in before}
            assert set(ids) == {i for i, (hit, n) in want.items() if hit <= 0.5 * n}
            got = {r.doc_id: r.text for r in rows}
            assert all(decontaminated(got[i], items)[0] == 0 for i in got) and all(got[r.doc_id] == r.text for r in before if want[r.doc_id][0] == 0)
        else:
            assert ids == Counter(r.doc_id for r in before)
            n = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in before}
            assert all(r.n_tokens == n[r.doc_id] for r in rows)
            lengths = Counter(x for x in n.values() if x)
            bounds = packing.optimal_boundaries(sorted(lengths), [lengths[x] for x in sorted(lengths)], 16)
            assert all(r.bucket_length == min(b for b in bounds if b >= r.n_tokens) for r in rows if r.n_tokens)
        now = out
    whole = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "bucket", "batch", "slot").collect()]
    assert sorted(whole) == sorted(tuple(r) for r in now.select("doc_id", "n_tokens", "bucket", "batch", "slot").collect())


def test_run_on_empty_tables_and_repeats(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "r").mkdir()
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "e", [], [], [])).count() == 0
    docs = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(None, "a b c d e f g", None, None, None), (None, None, None, None, None), (2, "x", None, None, None)]
    rows = corpus_pipeline.run(spark, tables(spark, tmp_path / "r", docs, [(1, None, None)], [(1, "")])).collect()
    assert Counter(r.doc_id for r in rows) == {1: 3, None: 2, 2: 1}  # rows of one doc_id are one document to the near-duplicate stage
