"""Columns of clashing names, and links of near-duplicates on the test tables against all pairs."""

import re

from pyspark.sql import functions as F

from chronoweave.llm import decontam, langid, minhash, toxicity

SF = "/root/testdata/sf0.001"
NAMES = ["contamination", "spans", "items", "n_words", "held_out", "score", "predicted", "_id", "toxic", "lang_pred", "grammar", "shard", "_bound", "component_id"]


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_columns_of_clashing_names(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    more = docs.withColumns({c: F.lit("clash") for c in NAMES})
    assert rows(decontam.contamination_report(more, items)) == rows(decontam.contamination_report(docs, items))
    assert rows(langid.identify(more, langid.fit(more))) == rows(langid.identify(docs, langid.fit(docs)))
    assert rows(toxicity.score(more, toxicity.fit(more, labels))) == rows(toxicity.score(docs, toxicity.fit(docs, labels)))
    kept = decontam.decontaminate(more, items)
    assert kept.columns == more.columns and rows(kept.select(docs.columns)) == rows(decontam.decontaminate(docs, items))


def test_no_link_is_missed(spark):
    """Documents whose id is divisible by 5 against all: every pair at the threshold shares a component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        k = min(4, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    component = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, width=4, percent=80).collect()}
    links = [(a, b) for a in sets if a % 5 == 0 for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 10 and all(component[a] == component[b] for a, b in links)
