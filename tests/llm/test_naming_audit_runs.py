"""Block naming, the filter audit and periodic runs against brute force, and on nulls, long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from chronoweave.llm import block_naming, filter_audit, periodic
from chronoweave.llm.lce import COVER, MODULUS, DifferenceCoverLce

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASH = ["number", "kind", "block", "held", "name", "round", "_words", "_n", "_a", "_p", "_h", "mask", "part", "digest", "label", "size"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def clashing(df):
    for c in CLASH:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


# --- block naming ------------------------------------------------------------------------------------------------


def brute_groups(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    best = {}
    for p, (i, t, _) in zip(plain, rows):
        best.setdefault(p, []).append((-len(t or ""), i is None, i or 0, i))
    return sorted((str(i), str(min(best[p])[3]), len(best[p]), i == min(best[p])[3], sha(p)) for p, (i, _, _) in zip(plain, rows))


def groups_of(df, **kw):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in block_naming.exact_groups(df, **kw).collect())


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_block_naming_equals_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(block_naming, "BATCH_ROWS", 7)
    rnd = random.Random(width)
    base = ["", None, " \n", "a b", "ab", "a\tb ", "b a", "ü ß", "üß", " ", "abcabcabcabc", "abcabcabc", "abcabcabcabd", "xabcabcabc", "aaaa", "aaaaa", "aa aa"]
    base += ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(12))) for _ in range(60)]
    rows = [(i, rnd.choice(base), "en") for i in rnd.sample(range(1000), 150)] + [(None, "a b", "en"), (None, "only null", "en"), (3000, "a b", "en"), (3000, "a b", "en")]
    assert groups_of(frame(spark, rows).repartition(5), width=width) == brute_groups(rows)


def test_block_naming_long_texts_clashes_and_empty_tables(spark):
    long = "wordy " * 400_000
    rows = [(1, long, "en"), (2, long.replace(" ", "  "), "en"), (3, long + "x", "en"), (4, "x" + long, "en"), (5, long[:-6] + "wordz ", "en")]
    df = clashing(frame(spark, rows))
    assert groups_of(df) == brute_groups(rows)
    assert [r.doc_id for r in block_naming.drop_copies(df).orderBy("doc_id").collect()] == [2, 3, 4, 5]
    assert block_naming.drop_copies(df).columns == df.columns
    assert block_naming.exact_groups(frame(spark, [])).count() == 0


def test_equal_names_are_equal_blocks(spark):
    rows = [(k * 10, bytes([65 + k % 7]), 1) for k in range(50)]
    names = block_naming.named(spark.createDataFrame(rows, "number long, block binary, held long"), "block").collect()
    assert {(r.number // 10) % 7: r.name for r in names} == {k: k * 10 for k in range(7)}
    assert {r.held for r in names} == {7, 8}


def test_a_hot_text_leaves_a_batch_once(spark):
    pack = block_naming.packed(frame(spark, [(i, "same text", "en") for i in range(3000)]).repartition(2))
    assert pack.where("kind = 0").count() == 2 and pack.where("kind = 1").count() == 2


# --- filter audit ------------------------------------------------------------------------------------------------


def brute_masks(rows):
    out, least = [], {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        out.append((lang or "", sum(1 << k for k, x in enumerate(fails) if x), i))
    return out


def brute_audit(rows, labels):
    masks, out = brute_masks(rows), []
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for part in {m[0] for m in masks}:
        mine = [(m, i) for p, m, i in masks if p == part]
        share = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            alive = mine
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in alive if x[0] & bit]
                rest = [x for x in alive if not x[0] & bit]
                redundant = sum(1 for x in mine if x[0] & bit) - len(gone)
                steps.append((part, "".join(order), k + 1, len(rest), len(gone), redundant, sum(1 for x in mine if x[0] == bit), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone), f))
                share[f] += len(gone)
                alive = rest
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(seed):
    rnd = random.Random(seed)
    texts = ["", None, "short", "A" * 30, "word " * 120, " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}" for i in range(120)), " ".join(f"w{i}" for i in range(119)) + " 5%", "ÄÖÜ é", "a|b"]
    return [(i, rnd.choice(texts), rnd.choice(["en", "de", None])) for i in rnd.sample(range(500), 120)]


def test_audit_retracts_and_equals_brute_force(spark, tmp_path):
    rows = audit_rows(1)
    rows += [(rows[0][0], rows[0][1], "de"), (None, rows[1][1], "en"), (None, None, None)]
    rows.sort(key=lambda r: -(r[0] or 0))  # smaller ids of a text come with later files
    labels = [(r[0], k % 2, k % 3 % 2) for k, r in enumerate(rows[:80])] + [(9999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path = str(tmp_path / "documents.parquet")
    for k in range(0, len(rows), 25):
        clashing(frame(spark, rows[k : k + 25])).coalesce(1).write.mode("append").parquet(path)
    got = filter_audit.audit(spark, path, known, micro_batches=3)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(rows, labels)


def test_audit_of_more_files_reads_only_these(spark, tmp_path):
    rows, labels = audit_rows(2), [(5, 1, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    for part, so_far in ((rows[60:], rows[60:]), (rows[:60], rows)):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        filter_audit.update(spark, path, known, folder)
        got = filter_audit.interactions(filter_audit.counters(spark, folder))
        assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(so_far, labels)
    seen = spark.read.parquet(f"{folder}/rows/*")
    assert seen.count() == len(rows)
    negative = spark.read.parquet(f"{folder}/counters/*").where("n < 0").count()
    assert negative > 0  # earlier masks were retracted


def test_audit_of_empty_tables_and_one_file(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty, one = str(tmp_path / "none.parquet"), str(tmp_path / "one.parquet")
    frame(spark, []).coalesce(1).write.parquet(empty)
    assert filter_audit.audit(spark, empty, none).count() == 0
    rows = audit_rows(3)
    pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).to_parquet(one)
    assert sorted(map(tuple, filter_audit.audit(spark, one, none).select(COLUMNS).collect())) == brute_audit(rows, [])


# --- periodic runs -----------------------------------------------------------------------------------------------


def brute_runs(w, least=24):
    n, seen, out = len(w), set(), []
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e - s >= q and (s, e + q) not in seen:
                seen.add((s, e + q))
                if e + q - s >= max(least, 3 * q):
                    out.append((s, e + q - s, q))
            s = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(i, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repetitive(rnd):
    kind = rnd.randrange(4)
    if kind == 0:
        return " ".join(rnd.choice("ab") for _ in range(rnd.randrange(150)))
    block = [f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(1, 30))]
    words = (block * 40)[: rnd.randrange(300)]
    if words and kind == 1:
        words[rnd.randrange(len(words))] = "odd"
    return rnd.choice([" ", "\n", "\t "]).join(words + [f"v{rnd.randrange(50)}" for _ in range(kind * 20)])


def test_cover_has_every_difference():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_extensions_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        line = []
        for k in range(rnd.randrange(1, 6)):
            block = [rnd.randrange(rnd.choice([1, 2, 40])) for _ in range(rnd.randrange(1, 50))]
            line += (block * 30)[: rnd.randrange(500)] + [1000 + k]
        i, j = np.array([(rnd.randrange(len(line)), rnd.randrange(len(line))) for _ in range(200)]).T
        i, j = i[i != j], j[i != j]
        lce = DifferenceCoverLce(np.array(line))
        for a, b, got in zip(i, j, lce.extension(i, j)):
            k = 0
            while max(a, b) + k < len(line) and line[a + k] == line[b + k]:
                k += 1
            assert got == k


def test_runs_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, repetitive(rnd), "en") for i in range(300)] + [(500, None, "en"), (501, "", "en"), (502, "\n ", "en"), (503, "a " * 24, "en"), (504, "a " * 23, "en"), (504, "a " * 23, "en"), (505, "x y " * 30, "en")]
    rows += [(i, None, "en") for i in range(510, 600)] + [(i, "", "en") for i in range(600, 700)]  # some of them would be rotated
    got = periodic.run_report(clashing(frame(spark, rows))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_report(i, t)) for i, t, _ in rows)
    free = periodic.run_report(spark.createDataFrame([(None, "b " * 30)], "doc_id long, text string")).first()
    assert (free.doc_id, free.n_runs, free.period, free.exponent_milli) == (None, 1, 1, 30000)
    assert periodic.run_report(frame(spark, [])).count() == 0


def test_shorter_runs_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 50)
    rnd = random.Random(5)
    texts = [repetitive(rnd) for _ in range(80)]
    got = periodic.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_length=3).collect()
    assert [[tuple(r) for r in x.runs] for x in sorted(got)] == [brute_runs(t.split(), 3) for t in texts]
    monkeypatch.undo()
    words = [f"w{k % 70_001}" for k in range(250_000)]
    row = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row.n_words, [tuple(r) for r in row.runs], len(row.collapsed.split())) == (250_000, [(0, 250_000, 70_001)], 70_001)
