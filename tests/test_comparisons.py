"""Histories, fits, stems, scorers by name, comparisons of graphs, and files of several parts, against brute force."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import duckdb
import pytest
from pyspark.sql import functions as F

from chronoweave import registry
from chronoweave.functions import fits, stems
from chronoweave.functions import vectors as vec
from chronoweave.operators import history, reports, scoring, structure
from chronoweave.sources import files, market

EDGES = "edge_id long, src long, dst long, t long, label string"


def random_edges(seed, nodes, n):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(n)]
    return [(i, a, b, i // 3, "xyz"[rnd.randrange(3)]) for i, (a, b) in enumerate(pairs) if a != b]


# --- histories ---------------------------------------------------------------------------------------------------


def test_common_neighbours_as_edges_are_read(spark):
    rows = random_edges(1, 12, 90)
    order, near, want = {}, defaultdict(set), {}
    for i, a, b, t, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        order.setdefault(a, []).append((i, b))
    for a, own in order.items():  # source by source, as first seen
        for i, b in own:
            near[a].add(b)
            near[b].add(a)
            want[i] = len(near[a] & near[b])
    got = {r.edge_id: r.common for r in history.common_neighbours(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == want and max(want.values()) > 2


def test_histories_in_order(spark):
    rows = random_edges(2, 6, 60)
    events = defaultdict(list)
    for i, a, b, t, _ in rows:
        events[a].append((t, i, b))
        events[b].append((t, i, a))
    df = spark.createDataFrame(rows, EDGES).repartition(3)
    got = {(r.node, r.place): (r.t, r.edge_id, r.nbr) for r in history.ordered_history(df).collect()}
    assert got == {(x, k): e for x, own in events.items() for k, e in enumerate(sorted(own))}
    queries = [(q, q % 7, q // 2) for q in range(30)]  # node 6 has no events
    lists = history.first_hop_lists(df, spark.createDataFrame(queries, "qid long, node long, t long")).collect()
    assert {r.qid: [(e.t, e.edge_id, e.nbr) for e in r.neighbours] for r in lists} == {q: [e for e in sorted(events[x]) if e[0] < t] for q, x, t in queries}


def test_future_references(spark):
    rows = random_edges(3, 8, 40)
    queries = [(q, q % 9, (q * 5) % 9) for q in range(20)]
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    want = {q: ([r[4] for r in order if r[1] == a] + [r[4] for r in order if r[2] == b])[:3] for q, a, b in queries}
    got = history.future_references(spark.createDataFrame(queries, "qid long, src long, dst long"), spark.createDataFrame(rows, EDGES))
    assert {r.qid: r.labels for r in got.collect()} == want


# --- fits and stems ----------------------------------------------------------------------------------------------


def test_zeta():
    assert fits.zeta(2.0, np.array([1]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-13)
    for s in (1.5, 2.3, 3.7, 8.0):
        for q in (1, 2, 5.5, 40):
            head = sum((q + k) ** -s for k in range(200_000))
            tail = (q + 200_000) ** (1 - s) / (s - 1) + (q + 200_000) ** -s / 2
            assert fits.zeta(s, np.array([q]))[0] == pytest.approx(head + tail, rel=1e-9)


@pytest.mark.parametrize("alpha,least", [(2.5, 1), (2.1, 2), (3.5, 2)])
def test_power_law_fit(spark, alpha, least):
    rng = np.random.default_rng(5)
    support = np.arange(least, 20_000)
    p = support**-alpha
    sample = rng.choice(support, size=4000, p=p / p.sum())
    counts = Counter(sample.tolist())
    grid = np.linspace(alpha - 0.3, alpha + 0.3, 60_001)
    direct = np.array([math.log(float((np.arange(least, 3000) ** -a).sum() + 3000.0 ** (1 - a) / (a - 1) + 3000.0**-a / 2)) for a in grid[::600]])
    loss = 4000 * direct + grid[::600] * np.log(sample).sum()
    df = spark.createDataFrame([(0, [(v, n) for v, n in counts.items()]), (1, []), (2, None), (3, [(0, 5), (None, 2)])], "w int, h array<struct<value: long, count: long>>")
    got = {r.w: r.f for r in df.select("w", fits.power_law(F.col("h"), least).alias("f")).collect()}
    low = grid[::600][loss.argmin()]
    assert abs(got[0].alpha - low) < 0.0061 and abs(got[0].alpha - alpha) < 0.12 and got[0].D < 0.03 and got[0].n == 4000
    slope = lambda a: (fits.zeta(a + 1e-5, np.array([least]))[0] - fits.zeta(a - 1e-5, np.array([least]))[0]) / 2e-5 / fits.zeta(a, np.array([least]))[0] + np.log(sample).mean()
    assert slope(got[0].alpha - 2e-6) < 0 < slope(got[0].alpha + 2e-6)  # the likelihood's slope changes its sign within 1e-6
    assert [got[k].alpha for k in (1, 2, 3)] == [None] * 3


# Words of the published examples of the rules, and their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems(spark):
    assert {w: stems.stem(w) for w in STEMS} == STEMS
    rnd = random.Random(6)
    lines = [" ".join(rnd.choice([*STEMS, "The", "cat", "X-1"]) for _ in range(rnd.randrange(12))) for _ in range(30)] + ["", "...", None]

    def brute(a, b):
        a, b = ([stems.stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (x or "").lower())] for x in (a, b))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 2 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0

    pairs = [(rnd.choice(lines), rnd.choice(lines)) for _ in range(80)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.s == pytest.approx(brute(r.a, r.b)) for r in df.select("a", "b", stems.rouge_l(F.col("a"), F.col("b")).alias("s")).collect())


# --- scorers -----------------------------------------------------------------------------------------------------

CASES = [
    ("The Cat sat", {"func_name": "verify_keywords", "keyword_list": ["cat", "THE"]}, 1),
    ("The Cat sat", {"func_name": "verify_keywords", "keyword_list": ["dog", "cat"]}, 0),
    ("one two three", {"func_name": "verify_keyword_frequency", "word": "two", "N": 3}, 1),
    ("a secret", {"func_name": "validate_forbidden_words", "forbidden_words": ["Secret"]}, 0),
    ("a plain", {"func_name": "validate_forbidden_words", "forbidden_words": ["Secret"]}, 1),
    ("banana", {"func_name": "verify_letter_frequency", "letter": "a", "N": 3}, 1),
    ("banana", {"func_name": "verify_letter_frequency", "letter": "an", "N": 2}, 0),
    ("one\n* * *\ntwo", {"func_name": "verify_paragraph_count", "N": 2}, 1),
    ("one\n* * *\n ", {"func_name": "verify_paragraph_count", "N": 2}, 0),
    ("a b c d", {"func_name": "validate_word_constraint", "N": 4, "quantifier": "at least"}, 1),
    ("a b c d", {"func_name": "validate_word_constraint", "N": 3, "quantifier": "at most"}, 0),
    ("a b c d", {"func_name": "validate_word_constraint", "N": 5, "quantifier": "around"}, 1),
    ("a b c d", {"func_name": "validate_word_constraint", "N": 4, "quantifier": "exactly"}, 0),
    ("Dr. Who came. He left? Yes", {"func_name": "verify_sentence_constraint", "N": 3, "quantifier": "at most"}, 1),
    ("One. Two. Three.", {"func_name": "verify_sentence_constraint", "N": 4, "quantifier": "at least"}, 0),
    ("a\n\nThen b", {"func_name": "validate_paragraphs", "N": 2, "first_word": "Then", "i": 2}, 1),
    ("a\n\nThen b", {"func_name": "validate_paragraphs", "N": 2, "first_word": "Then", "i": 1}, 0),
    ("text P.S. more", {"func_name": "verify_postscript", "postscript_marker": "P.S."}, 1),
    ("text P.S. ", {"func_name": "verify_postscript", "postscript_marker": "P.S."}, 0),
    ("[a] and [b]", {"func_name": "validate_placeholders", "N": 2}, 1),
    ("* a\n - b\nc", {"func_name": "verify_bullet_points", "N": 2}, 1),
    ("<<t>> x", {"func_name": "validate_title"}, 1),
    ("yes", {"func_name": "validate_choice", "options": ["oh yes", "no"]}, 1),
    ("maybe", {"func_name": "validate_choice", "options": ["oh yes", "no"]}, 0),
    ("*a* *b*", {"func_name": "validate_highlighted_sections", "N": 2}, 1),
    ("S1 a S2 b", {"func_name": "validate_sections", "section_splitter": "S", "N": 2}, 1),
    ("x S1 a", {"func_name": "validate_sections", "section_splitter": "S", "N": 1}, 0),
    ('{"a": 1}', {"func_name": "validate_json_format"}, 1),
    ("{a", {"func_name": "validate_json_format"}, 0),
    ("Say hi. hi", {"func_name": "validate_repeat_prompt", "original_prompt": "Say hi."}, 1),
    ("hi", {"func_name": "validate_repeat_prompt", "original_prompt": "Say hi."}, 0),
    ("a******b", {"func_name": "validate_two_responses"}, 1),
    ("a******a", {"func_name": "validate_two_responses"}, 0),
    ("ABC", {"func_name": "validate_uppercase"}, 1),
    ("abC", {"func_name": "validate_lowercase"}, 0),
    ("AB cd EF", {"func_name": "validate_frequency_capital_words", "N": 2, "quantifier": "around"}, 1),
    ("AB cd EF", {"func_name": "validate_frequency_capital_words", "N": 1, "quantifier": "around"}, 0),
    ("the end", {"func_name": "validate_end", "end_phrase": "end"}, 1),
    ('"q"', {"func_name": "validate_quotation"}, 1),
    ("a, b", {"func_name": "validate_no_commas"}, 0),
    ("any", {"func_name": "unheard_of"}, 0),
    ("any", {}, 0),
    (None, {"func_name": "validate_title"}, 0),
    ("no arguments", {"func_name": "verify_keywords"}, 0),
]


def test_rules_by_name(spark):
    df = spark.createDataFrame([(i, t, json.dumps(c)) for i, (t, c, _) in enumerate(CASES)] + [(900, "x", None), (901, "x", "no json")], "i int, text string, c string")
    got = {r.i: r.score for r in scoring.checked(df, "text", "c").collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: float(want) for i, (_, _, want) in enumerate(CASES)} and got[900] == got[901] == 0
    assert {c.get("func_name") for _, c, _ in CASES} >= set(scoring.RULES)
    with pytest.raises(ValueError):
        scoring.checked(df, "text", "c", only=["unheard_of"])


def test_scorers_by_tag(spark):
    rows = [
        (0, "fmt", "<think>a</think><answer>b</answer>", "", 0.0),
        (1, "fmt", "b", "", -1.0),
        (2, "rep", "a b c a b c", "", -0.1 * (1 - 3 / 4)),
        (3, "len", "x" * 500 + "<pad>", "", 0.025),
        (4, "choice", "a</think>so \\boxed{b) no}", "B", 1.0),
        (5, "boxed", "is \\boxed{x^{2}} or", "x^{2}", 1.0),
        (6, "boxed", "is \\boxed{3}", "4", 0.0),
        (7, "yes", "Yes indeed", "", 1.0),
        (8, "exact", "t</think>\n42<|im_end|>", "42", 1.0),
        (9, "block", "y" * 21, "", -1.0),
        (10, "other", "z", "", 0.0),
        (11, "yes", None, None, 0.0),
    ]
    df = spark.createDataFrame(rows, "i int, tag string, r string, truth string, want double")
    by = {"fmt": "think_format", "rep": "repetition", "len": "length", "choice": "choice", "boxed": "boxed", "yes": "yes_no", "exact": "exact", "block": "long_block"}
    assert all(r.reward == pytest.approx(r.want) for r in scoring.scored(df, "tag", "r", "truth", by).collect())
    with pytest.raises(ValueError):
        scoring.scored(df, "tag", "r", "truth", {"a": "unheard_of"})


# --- comparisons -------------------------------------------------------------------------------------------------


def test_hub_metrics(spark):
    a, b = random_edges(7, 15, 60), random_edges(8, 15, 60)
    nodes = {x for r in a + b for x in r[1:3]}
    for k, share in ((3, None), (None, 0.4)):
        n = k or math.floor(share * len(nodes))
        top = lambda rows: {x for x, _ in sorted(Counter(r[1] for r in rows).items(), key=lambda c: (-c[1], c[0]))[:n]}
        t, g = top(a), top(b)
        hit = len(t & g)
        auc = np.mean([((x in g) > (y in g)) + ((x in g) == (y in g)) / 2 for x in t for y in nodes - t])
        got = structure.hub_metrics(spark.createDataFrame(a, EDGES), spark.createDataFrame(b, EDGES), k, share).first()
        assert list(got) == pytest.approx([hit / len(g), hit / len(t), 2 * hit / (len(t) + len(g)), auc])


def test_gaps_of_two_graphs(spark):
    tri = [(0, 1, 2, 0, "x"), (1, 2, 3, 1, "x"), (2, 3, 1, 2, "x"), (3, 4, 1, 3, "x"), (4, 5, 1, 4, "x")]
    none = [(0, 1, 2, 0, "x"), (1, 3, 2, 1, "x")]
    got = structure.structure_gaps(spark.createDataFrame(tri, EDGES), spark.createDataFrame(none, EDGES)).first()
    assert (got.mean_gap, got.wedges_gap, got.claws_gap, got.triangles_gap, got.clustering_gap) == (pytest.approx(1 - 2 / 3), 2.0, 1.0, 1, 3.0)
    c = lambda rows: spark.createDataFrame(rows, "node long, similar long, linked long, chamber boolean")
    gaps = structure.chamber_gaps(c([(1, 4, 1, True), (2, 6, 2, True), (3, 5, 0, False)]), c([])).first()
    assert tuple(gaps) == (2, pytest.approx(2 / 3), 5.0)


def test_list_scores_and_softmax(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), (["a"], ["a"]), ([], ["a"]), (["a"], [])], "g array<string>, t array<string>")
    got = [tuple(r) for r in df.select(*structure.list_scores(F.col("g"), F.col("t"))).collect()]
    assert got[0] == (0, 0.5, pytest.approx(1 / 3), pytest.approx(0.4)) and got[1:] == [(1, 1.0, 1.0, 1.0), (0, 0.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0)]
    v = [float(x) for x in np.random.default_rng(1).normal(size=300) * 9]
    soft = spark.createDataFrame([(v,)], "v array<double>").select(vec.softmax(F.col("v")).alias("s")).first().s
    e = np.exp(np.array(v) - max(v))
    assert soft == pytest.approx((e / e.sum()).tolist())


# --- files -------------------------------------------------------------------------------------------------------


def test_publish_and_current(spark, tmp_path):
    root = str(tmp_path / "t")
    assert files.versions(spark, root) == {}
    with pytest.raises(FileNotFoundError):
        files.current(spark, root)
    assert files.publish(spark.range(10), root) == 1
    old = files.current(spark, root)
    assert files.publish(files.current(spark, root).where("id % 2 = 0"), root) == 2
    assert sorted(r.id for r in files.current(spark, root).collect()) == [0, 2, 4, 6, 8] and old.count() == 10


def test_arrow_files(spark, tmp_path):
    rows = pa.table({"b": ["x", None, "z"], "a": pa.array([1, 2, None], pa.int32()), "c": [1.5, 2.5, 3.5]})
    folder = tmp_path / "t.arrow"
    folder.mkdir()
    with pa.OSFile(str(folder / "one.arrow"), "wb") as f, pa.ipc.new_file(f, rows.schema) as w:
        w.write_table(rows, max_chunksize=2)
    with pa.OSFile(str(folder / "two.arrow"), "wb") as f, pa.ipc.new_stream(f, rows.schema) as w:
        w.write_table(rows)
    got = files.read_any(spark, str(folder), "a long, b string")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(["(1, 'x')", "(2, None)", "(None, 'z')"] * 2)


def test_metric_tree(spark, tmp_path):
    for m, s, x in (("m1", "d1", 1), ("m1", "d 2", 2), ("m2", "d1", 3)):
        (tmp_path / m / s).mkdir(parents=True)
        (tmp_path / m / s / "r.json").write_text(json.dumps({"test metrics": {"auc": x}}))
    assert sorted(map(tuple, files.read_metric_tree(spark, str(tmp_path)).collect())) == [("m1", "d 2", 2), ("m1", "d1", 1), ("m2", "d1", 3)]


def test_market(spark, tmp_path):
    (tmp_path / "i.csv").write_text("src_member_id,dst_member_id,id,ds\na,b,7,2024-01-02\nb,a,8,2024-01-01\na,zz,7,2024-01-05\na,b,9,no date\nb,c,9,2024-01-03 06:00:00\n")
    (tmp_path / "items.json").write_text('{"id": "7", "codes": [4, 5]}\n{"id": "8", "codes": []}\n')
    (tmp_path / "map.csv").write_text("member_id,node\na,0\nb,1\nc,2\nd,bad\n")
    (tmp_path / "members.csv").write_text("member_id,feature_list\na,:1.5:2\nb,3:x:\nd,1\nc,\n")
    e, f = market.read_market(spark, *(str(tmp_path / x) for x in ("i.csv", "items.json", "map.csv", "members.csv")))
    day = 1704067200  # 2024-01-01
    assert sorted(map(tuple, e.collect())) == [(0, 1, day + 86400, 1, 7, [4, 5]), (1, 0, day, 0, 8, []), (1, 2, day + 2 * 86400 + 21600, 2, 9, [])]
    assert {r.node: r.features for r in f.collect()} == {0: [1.5, 2.0], 1: [3.0, None]}


def test_batch_weights(spark):
    """Against the formula on whole batches; nulls, one length, one row, difficulties out of bounds, a clashing column."""
    rnd = random.Random(21)
    rows = [(i, rnd.choice([0, 1, 2, None]), rnd.choice([None, 5, 40, 400]), rnd.choice([None, -1.0, 0.0, 0.3, 1.0, 7.0])) for i in range(60)]
    rows += [(100, 8, 12, 0.5), (101, 9, 7, None), (102, 9, 7, 1.0), (102, 9, 7, 1.0)]
    df = spark.createDataFrame(rows, "id long, b int, n int, d double").withColumn("s", F.lit("x"))
    for difficulty in ("d", None):
        got = reports.batch_weights(df, "b", "n", difficulty)
        assert got.columns == [*df.columns, "weight"]
        got = got.collect()
        assert len(got) == len(rows)
        for b in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == b]
            low, high = min(r[2] or 0 for r in mine), max(r[2] or 0 for r in mine)
            hard = [0.5 + 1.5 * min(max(r[3], 0), 1) if difficulty and r[3] is not None else 1 for r in mine]
            w = [h * (1.5 - ((r[2] or 0) - low) / (high - low + 1e-8)) for h, r in zip(hard, mine)]
            want = sorted((r[0], x * len(mine) / (sum(w) + 1e-8)) for r, x in zip(mine, w))
            assert sorted((r.id, r.weight) for r in got if r.b == b) == [(i, pytest.approx(x, abs=1e-9)) for i, x in want]
    assert reports.batch_weights(df.limit(0), "b", "n").count() == 0


def test_choices_of_texts_change_case_by_letter_as_the_sql_does(spark, tmp_path):
    """Before, Spark's upper case of ß was SS."""
    texts = ["Stra\u00dfe \u00fcber", "\u0149x \u1f80 \ufb01n", "\U00010428 ab", "\u0130I \u0391\u03a3 \u0391\u03a3.", "", "\u01c6a \u00ff"]
    rows = [(i, texts[i // 5], lang, 9) for i in range(5 * len(texts)) for lang in [["de", "\u00dfx", "ru"][i % 3]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["tx14_choices_of_texts"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLE_SQL["tx14_choices_of_texts"]).fetchall())


def test_market_files_are_read_and_joined_once(spark, tmp_path):
    """Before, the first second was looked for in a second reading and joining of all files."""
    for name, lines in {"i.csv": ["src_member_id,dst_member_id,id,ds", "a,b,1,2024-01-02", "b,a,2,2024-01-05"], "items.json": ['{"id": "1", "codes": [4, 5]}'], "map.csv": ["member_id,node", "a,1", "b,2"], "members.csv": ["member_id,feature_list", "a,:1:2"]}.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    e, _ = market.read_market(spark, *(str(tmp_path / x) for x in ("i.csv", "items.json", "map.csv", "members.csv")))
    assert sorted((r.src, r.dst, r.w, r.id, r.codes) for r in e.collect()) == [(1, 2, 0, 1, [4, 5]), (2, 1, 3, 2, [])]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "csv" not in plan and plan.count("Join ") <= 1


def test_end_points_are_told_apart_as_numbers(spark):
    """Before, every trade's two names were grouped as strings."""
    plan = registry.QUERIES["s4_end_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [src" in line for line in plan.split("\n")) and any("Aggregate [dst" in line for line in plan.split("\n"))
