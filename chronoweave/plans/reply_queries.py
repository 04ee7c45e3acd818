"""Parsers of replies over real texts: both sides build the same reply from a text and then read it, branches without a find included."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import answers, rules
from chronoweave.functions import text as tx
from chronoweave.plans.queries import query
from chronoweave.session import table


def _replies(spark, d, *cases):
    """(doc_id, lang, n_chars, text, r): one of several replies by doc_id; ``cases`` are SQL of Spark and DuckDB alike."""
    c = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases))
    return table(spark, d, "documents").selectExpr("doc_id", "lang", "n_chars", "text", f"CASE doc_id % {len(cases)} {c} END AS r")


def _sql(out, *cases):
    c = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases))
    return f"SELECT doc_id, {out} FROM (SELECT doc_id, lang, n_chars, text, CASE doc_id % {len(cases)} {c} END AS r FROM documents)"


_THINK = ["text", "concat(left(text, 40), '</think>', chr(10), chr(10), substr(text, 41))", "concat('<think>', left(text, 9), '</think>', lang, '</think>', text)", "concat(text, '</think>')"]


@query("tx15_after_think_of_texts", _sql("sha256(regexp_replace(list_last(string_split(r, '</think>')), '^\\n+', '')) AS digest", *_THINK))
def _(spark, d):
    """What follows the last end of thinking, in texts with none, one, two and an empty rest."""
    return _replies(spark, d, *_THINK).select("doc_id", F.sha2(tx.after_last_think(F.col("r")), 256).alias("digest"))


_FORMAT = ["text", "concat('<think>', left(text, 60), '</think>', chr(10), '<answer>', text, '</answer>')", "concat('<think>', text, '<answer>', lang, '</answer>')", "concat(lang, chr(10), '<think>', lang, '</think><answer>', left(text, 30), '</answer>', chr(10), lang)", "concat('x<think>', lang, '</think><answer>', lang, '</answer>')"]


@query("tx18_format_of_texts", _sql("CASE WHEN regexp_matches(r, '(?sm)^<think>.*?</think>.*?<answer>.*?</answer>$') THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS reward", *_FORMAT))
def _(spark, d):
    return _replies(spark, d, *_FORMAT).select("doc_id", tx.think_answer_format(F.col("r")).alias("reward"))


_JUDGED = ["concat('GF: ', n_chars % 11, ' cr: [', doc_id % 7, '] ', left(text, 50))", "concat(left(text, 80), ' gf = ', n_chars % 5, '; GF: [', n_chars % 3, ']')", "text", "concat('CR', chr(10), '- ', doc_id % 9, ' GF none')"]
_MARK = "coalesce(CAST(list_last(regexp_extract_all(r, '(?is)\\b{0}\\b\\W*([0-9]+)', 1)) AS DOUBLE), 0.0)"


@query("tx11_scores_of_texts", _sql(f"{_MARK.format('GF')} AS gf, {_MARK.format('CR')} AS cr", *_JUDGED))
def _(spark, d):
    return _replies(spark, d, *_JUDGED).select("doc_id", tx.score(F.col("r"), "GF").alias("gf"), tx.score(F.col("r"), "CR").alias("cr"))


_FOUR = ["concat('GF: 2 REL: [', n_chars % 6, '] rel: ', doc_id % 5, ' KNO:', n_chars % 4)", "concat('REL : 3 KNO: [ ', doc_id % 6, ' ]')", "text"]
_FOURTH = "(coalesce(CAST(list_last(regexp_extract_all(r, '(?i){0}:\\s*\\[?\\s*(\\d+)', 1)) AS DOUBLE), 0.0) - 1) / 4.0 * 0.33"


@query("tx12_fourth_score", _sql(f"round({_FOURTH.format('REL')} + {_FOURTH.format('KNO')}, 9) AS score", *_FOUR))
def _(spark, d):
    """The judge's marks in the fourth form: the last of each key counts."""
    return _replies(spark, d, *_FOUR).select("doc_id", F.round(answers.judge_score(F.col("r")), 9).alias("score"))


_TENTH = ["concat('so, Score: ', n_chars % 11, ' of ten')", "concat(left(text, 30), ' Score:', doc_id % 10)", "concat('Score: none ', lang)", "text"]


@query("tx12_score_of_texts", _sql("coalesce(CAST(nullif(regexp_extract(r, 'Score:\\s*([0-9]+)', 1), '') AS DOUBLE) / 10, 0.5) AS score", *_TENTH))
def _(spark, d):
    return _replies(spark, d, *_TENTH).select("doc_id", F.coalesce(F.regexp_extract("r", r"Score:\s*([0-9]+)", 1).try_cast("double") / 10, F.lit(0.5)).alias("score"))


_CHOICE = ["text", "concat(left(text, 40), ' The Answer IS ', lang, ' ', substr(text, 41, 60))", "concat('\\\\boxed{', lang, '} then \\\\boxed{', upper(left(text, 12)), '}')", "concat('answer is B, \\\\boxed{c}')", "lower(left(text, 50))"]
_CHOICE_SQL = [x.replace("\\\\", "\\") for x in _CHOICE]
#: The SQL changes case letter by letter, where Spark makes SS of ß and looks at a letter's neighbours: so here, too.
_LETTERS = "array_join(transform(regexp_extract_all({0}, '(?s).', 0), c -> {1}), '')"
_UPPER = _LETTERS.format("{0}", "CASE WHEN c = 'ß' THEN 'ẞ' WHEN length(upper(c)) = 1 THEN upper(c) WHEN c BETWEEN 'ᾀ' AND 'ῼ' AND length(initcap(c)) = 1 THEN initcap(c) ELSE c END")
_LOWER = _LETTERS.format("{0}", "substring(lower(c), 1, 1)")
_CHOICE_SPARK = [x.replace("upper(left(text, 12))", _UPPER.format("left(text, 12)")).replace("lower(left(text, 50))", _LOWER.format("left(text, 50)")) for x in _CHOICE]
_RIGHT = "coalesce(nullif(regexp_extract(a, '(\\p{Lu})', 1), '') = upper(left(lang, 1)), false)"


@query(
    "tx14_choices_of_texts",
    f"""WITH r AS ({_sql('lang, r', *_CHOICE_SQL)}), b AS (SELECT *, list_last(regexp_extract_all(r, '\\\\boxed\\{{([^}}]+)\\}}', 1)) AS boxed FROM r),
    x AS (SELECT doc_id, lang, boxed IS NOT NULL AS boxed, coalesce(boxed, CASE WHEN contains(lower(r), 'answer is') THEN regexp_extract(r, '(?is)^.*answer is(.*)$', 1) END, r) AS a FROM b), y AS (SELECT *, {_RIGHT} AS ok FROM x)
    SELECT doc_id, sha256(a) AS answer, boxed, ok AS "right", CASE WHEN ok THEN 1.0 ELSE -1.0 END::DOUBLE AS loose, CASE WHEN ok THEN CASE WHEN boxed THEN 1.0 ELSE 0.5 END WHEN boxed THEN -0.5 ELSE -1.0 END::DOUBLE AS soft, CASE WHEN ok AND boxed THEN 1.0 ELSE -1.0 END::DOUBLE AS strict FROM y""",
)
def _(spark, d):
    """A choice read from a box, after "answer is", or from the whole text, and its three rewards."""
    rows = _replies(spark, d, *_CHOICE_SPARK).select("doc_id", answers.choice_rewards(F.col("r"), F.expr(_UPPER.format("left(lang, 1)"))).alias("c"))
    return rows.select("doc_id", F.sha2("c.answer", 256).alias("answer"), "c.boxed", "c.right", "c.loose", "c.soft", "c.strict")


_TAGGED = ["concat('<kind>', left(text, 30), '</kind>', text)", "concat('<kind>a</kind> <who>', lang, '</who> <kind>', lang, n_chars, '</kind>')", "text", "concat('<who>', text)"]


@query("tx1_tags_of_texts", _sql("list_last(regexp_extract_all(r, '(?s)<kind>(.*?)</[^>]*>', 1)) AS kind, list_last(regexp_extract_all(r, '(?s)<who>(.*?)</[^>]*>', 1)) AS who", *_TAGGED))
def _(spark, d):
    """Two tags of replies with both, one or none, the last of each."""
    m = _replies(spark, d, *_TAGGED).select("doc_id", tx.tags(F.col("r")).alias("m"))
    return m.select("doc_id", F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("who")).alias("who"))


_NUMBER = ["text", "concat('tensor(', n_chars, '.5, device)')", "concat('', n_chars)", "concat(lang, ' -1.5e3 ', n_chars)"]


@query("io12_values_of_texts", _sql("coalesce(TRY_CAST(trim(r) AS DOUBLE), TRY_CAST(nullif(regexp_extract(r, '[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?'), '') AS DOUBLE)) AS value", *_NUMBER))
def _(spark, d):
    """The number that a text is, or the first one in it."""
    return _replies(spark, d, *_NUMBER).select("doc_id", rules.number_in(F.col("r")).alias("value"))


_PATHS = ["concat('/runs/bwr', n_chars, '_qm', lang, '_uf1_cmx', doc_id, '/log')", "concat('bwr_qm', lang)", "source", "concat(source, '/bwr7_qma_ufb_cmc')"]
_PART = "coalesce(nullif(regexp_extract(r, 'bwr(\\d+)_qm(\\w+)_uf(\\w+)_cm(\\w+)', {0}), ''), 'unknown') AS {1}"


@query("io11_configs_of_paths", _sql(", ".join(_PART.format(i + 1, k) for i, k in enumerate(("bwr", "qm", "uf", "cm"))), *_PATHS).replace("lang, n_chars, text,", "lang, n_chars, source,"))
def _(spark, d):
    """The parts of paths that name a configuration, and of some that do not."""
    c = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_PATHS))
    rows = table(spark, d, "documents").selectExpr("doc_id", f"CASE doc_id % {len(_PATHS)} {c} END AS r")
    return rows.select("doc_id", *[v.alias(k) for k, v in rules.path_config(F.col("r")).items()])


@query("if18_prompts_of_texts", "SELECT doc_id, starts_with(text, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) ELSE substr(text, 2, 20) END) AS ok FROM documents")
def _(spark, d):
    """A prompt that half of the texts repeat."""
    prompt = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(20))).otherwise(F.substring("text", 2, 20))
    return table(spark, d, "documents").select("doc_id", rules.repeats(F.col("text"), prompt).alias("ok"))


_CODE = [
    "concat('<think>x</think>', '```python', chr(10), 'import os', chr(10), 'def f():', chr(10), '    return ', n_chars, chr(10), '```')",
    "concat(left(text, 50), '```', chr(10), lang, chr(10), '```', left(text, 20))",
    "left(text, 300)",
    "concat(text, repeat('x', 4001))",
]


@query(
    "tx21_code_answers",
    _sql(
        r"""CASE WHEN contains(r, '```') THEN CASE WHEN len(regexp_extract_all(r, '(?s)```(cpp|python|python3|java|javascript|ruby|go)\s*\n*(.*?)```', 1)) > 0 THEN len(regexp_extract_all(r, '(?s)```(cpp|python|python3|java|javascript|ruby|go)\s*\n*(.*?)```', 1)) ELSE len(regexp_extract_all(r, '(?s)```\s*\n*(.*?)```', 1)) END WHEN length(CASE WHEN contains(r, '</think>') THEN trim(list_last(string_split(r, '</think>'))) ELSE r END) <= 4000 THEN 1 ELSE 0 END AS n,
        CASE WHEN contains(r, '</think>') AND contains(r, '```') THEN 1 ELSE 0 END AS format,
        CASE WHEN contains(r, 'import os') THEN 'def f():' || chr(10) || '    return ' || n_chars || chr(10) END AS code""",
        *_CODE,
    ),
)
def _(spark, d):
    """Code of replies with a named fence, a bare one, none, and none in a long text; of the first, the function alone."""
    rows = _replies(spark, d, *_CODE).select("doc_id", "r", answers.code_answers(F.col("r")).alias("a"))
    first = answers.without_entry_point(F.col("a")[0]["code"])
    return rows.select("doc_id", F.size("a").cast("long").alias("n"), answers.has_thought_and_code(F.col("r")).alias("format"), F.when(F.contains("r", F.lit("import os")), first).alias("code"))
