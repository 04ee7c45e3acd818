"""Instruction rules and response parsers as queries of their own, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import rules
from chronoweave.functions import text as tx
from chronoweave.plans.queries import query
from chronoweave.session import table


def _rule(name: str, column, sql: str, source: str = "documents", key: str = "doc_id", out: str = "ok"):
    """A query (key, ``out``) of one text rule; ``sql`` says the column over the same rows."""
    keys = key.split(", ")

    @query(name, f"SELECT {key}, {sql} AS {out} FROM {source}")
    def _(spark, d):
        return table(spark, d, source).select(*keys, column(F.col("text")).alias(out))


_rule("if1_keywords", lambda t: tx.contains_all(t, ["The", "and"]), "contains(lower(text), 'the') AND contains(lower(text), 'and')")
_rule("if2_word_total", lambda t: rules.word_total(t) == 100, "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) = 100")
_rule("if2_keyword_frequency", lambda t: rules.keyword_count(t, "the"), "len([x FOR x IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') IF x = 'the'])", out="n")
_rule("if3_forbidden_words", lambda t: tx.contains_none(t, ["license", "copyright"]), "NOT (contains(lower(text), 'license') OR contains(lower(text), 'copyright'))")
_rule("if4_letter_frequency", lambda t: tx.letter_count(t, "e").cast("long"), "length(text) - length(replace(text, 'e', ''))", out="n")
_rule("if6_divided_paragraphs", lambda t: tx.paragraph_count(t, 2), "len(string_split(text, '* * *')) = 2 AND len([x FOR x IN string_split(text, '* * *') IF trim(x) = '']) = 0")
_rule("if7_words_at_least", lambda t: tx.words_relation(t, 50, "at least"), "len([x FOR x IN string_split_regex(text, '[ \\t-\\r]+') IF x <> '']) >= 50")
_rule("if7_words_around", lambda t: tx.words_relation(t, 50, "around"), "len([x FOR x IN string_split_regex(text, '[ \\t-\\r]+') IF x <> '']) BETWEEN 45 AND 55")
_rule("if8_sentences", lambda t: rules.sentence_count(t), "len(string_split_regex(text, '[.?] '))", out="n")
_rule("if9_paragraph_start", lambda t: rules.paragraph_starts(t, 1, "The"), "coalesce(starts_with(trim(string_split(text, chr(10) || chr(10))[1]), 'The'), false)")
_rule("if10_postscript", lambda t: rules.has_postscript(t, "P.S."), "contains(text, 'P.S.') AND length(trim(split_part(text, 'P.S.', 2))) > 0")
_rule("if11_placeholders", lambda t: tx.placeholders(t).cast("long") >= 1, "len(regexp_extract_all(text, '\\[(.*?)\\]')) >= 1")
_rule("if12_bullets", lambda t: tx.bullets(t).cast("long"), "len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '^\\s*[*-]')])", out="n")
_rule("if13_title", lambda t: tx.has_title(t), "regexp_matches(text, '<<(.*?)>>')")
_rule("if14_choice", lambda t: rules.chosen(F.lower("role"), ["user or assistant", "system"]), "contains('user or assistant', lower(role)) OR contains('system', lower(role))", "conversations", "conv_id, turn")
_rule("if15_highlights", lambda t: tx.highlights(t).cast("long") >= 1, "len(regexp_extract_all(text, '\\*(.*?)\\*')) >= 1")
_rule("if16_sections", lambda t: rules.sections(t, "License"), "len(string_split(text, 'License')) - CASE WHEN trim(string_split(text, 'License')[1]) = '' THEN 1 ELSE 0 END", out="n")
_rule("if17_json", lambda t: rules.is_json(F.col("props")), "json_valid(props)", "events", "event_id")
_rule("if18_repeats_prompt", lambda t: rules.repeats(t, F.substring(t, 1, 20)), "starts_with(text, left(text, 20))")
_rule("if19_two_responses", lambda t: rules.two_responses(t), "len(string_split(text, '******')) = 2 AND trim(string_split(text, '******')[1]) <> trim(string_split(text, '******')[2])")
_rule("if20_uppercase", lambda t: t == F.upper(t), "text = upper(text)")
_rule("if21_lowercase", lambda t: t == F.lower(t), "text = lower(text)")
_rule("if22_capital_words", lambda t: rules.capital_words(t), "len([x FOR x IN regexp_extract_all(text, '[\\p{L}\\p{N}_]+') IF regexp_full_match(x, '[A-Z]+')])", out="n")
_rule("if23_end", lambda t: F.endswith(F.rtrim(t), F.lit(".")), "ends_with(rtrim(text), '.')")
_rule("if24_quotation", lambda t: F.startswith(F.trim(t), F.lit('"')) & F.endswith(F.trim(t), F.lit('"')), "starts_with(trim(text), '\"') AND ends_with(trim(text), '\"')")
_rule("if25_no_commas", lambda t: ~F.contains(t, F.lit(",")), "NOT contains(text, ',')")

_rule("tx5_template", lambda t: F.format_string("<user id=\"%s\">%s</user>", F.col("c_custkey").cast("string"), F.col("c_name")), "'<user id=\"' || c_custkey || '\">' || c_name || '</user>'", "customer", "c_custkey", "shown")
_rule("tx10_strip_prefix", lambda t: rules.without_prefix(F.col("c_name"), "Customer#"), "regexp_replace(c_name, '^Customer#', '')", "customer", "c_custkey", "rest")
_rule("tx15_after_think", lambda t: tx.after_last_think(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a</think>b</think>\n\n"), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit("</think>"))).otherwise(F.col("c_name"))), "CASE WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END", "customer", "c_custkey", "answer")
_rule("tx18_format_reward", lambda t: tx.think_answer_format(F.concat(F.when(F.col("turn") % 2 == 0, "<think>x</think><answer>").otherwise("x</think><answer>"), t, F.lit("</answer>"))), "CASE WHEN text IS NULL OR turn % 2 = 1 THEN -1.0 ELSE 0.0 END", "conversations", "conv_id, turn", "reward")
_rule("tx20_special_tokens", lambda t: rules.without(t, ["<|im_end|>", "<pad>", "the"]), "replace(replace(replace(text, '<|im_end|>', ''), '<pad>', ''), 'the', '')", "conversations", "conv_id, turn", "clean")
_rule("tx14_choice_reward", lambda t: rules.choice_reward(F.concat(F.when(F.col("turn") % 3 == 0, "so ").otherwise("so \\boxed{"), F.substring("role", 1, 1), F.lit("}")), F.lit("U")), "CASE WHEN turn % 3 <> 0 AND upper(left(role, 1)) = 'U' THEN 1.0 ELSE 0.0 END", "conversations", "conv_id, turn", "reward")
_rule("tx12_yes_no", lambda t: F.when(F.contains(F.lower(t), F.lit("yes")), 1.0).otherwise(0.0), "CASE WHEN contains(lower(text), 'yes') THEN 1.0 ELSE 0.0 END", "conversations", "conv_id, turn", "score")
_rule("tx19_length_reward", lambda t: rules.length_reward(F.length(t), 200, 1000), "round(CASE WHEN length(text) <= 200 THEN 0.0 WHEN length(text) >= 1000 THEN -1.0 ELSE -(length(text) - 200) / 800 END, 6)", "conversations", "conv_id, turn", "reward")
_rule("io12_parsed_value", lambda t: rules.number_in(F.concat(F.lit("tensor("), F.col("value").cast("string"), F.lit(", device='x')"))), "value", "events", "event_id", "value")
_rule("io11_path_config", lambda t: rules.path_config(F.concat(F.lit("/a/bwr"), F.col("event_id").cast("string"), F.lit("_qmx_ufy_cmz/b")))["bwr"], "CAST(event_id AS VARCHAR)", "events", "event_id", "bwr")


@query(
    "tx11_scores",
    "SELECT event_id, CAST(event_id % 11 AS DOUBLE) AS gf, CAST(event_id % 7 AS DOUBLE) AS cr, round((event_id % 11 + event_id % 7) / 30, 6) AS average FROM events",
)
def _(spark, d):
    """Scores read back from judge replies in which each key stands twice, in brackets the last time."""
    n = F.col("event_id")
    reply = F.format_string("GF: 3\ncr: 1\ngf: [%d]\nCR: [%d]", n % 11, n % 7)
    s = table(spark, d, "events").select("event_id", tx.score(reply, "GF").alias("gf"), tx.score(reply, "CR").alias("cr"))
    return s.select("event_id", "gf", "cr", F.round((F.col("gf") + F.col("cr")) / 30, 6).alias("average"))


@query("tx1_tags", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who, value > 10 AS complete FROM events")
def _(spark, d):
    """Tagged replies: the last of each tag wins; a reply is complete if it has the optional tag, too."""
    reply = F.concat(F.lit("<kind>x</kind><who>"), F.col("user_id").cast("string"), F.lit("</who> <kind>"), F.col("event_type"), F.lit("</kind>"), F.when(F.col("value") > 10, "<more>1</more>").otherwise(""))
    m = table(spark, d, "events").select("event_id", tx.tags(reply).alias("m"))
    return m.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["who"].alias("who"), F.map_contains_key("m", "more").alias("complete"))


@query("tx22_rouge_l")
def _(spark, d):
    """ROUGE-L of each turn against the turn before it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rules.rouge_l(F.col("text"), F.col("earlier")), 6).alias("rouge"))
