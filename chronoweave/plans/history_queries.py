"""Histories as lists, common neighbours so far, exact power-law fits, stems, and scorers by name; each beside its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import fits, stems
from chronoweave.operators import history, scoring
from chronoweave.plans.queries import _BOTH, _SOCIAL, query
from chronoweave.plans.structure_queries import _r, _win
from chronoweave.session import table
from chronoweave.sources.tables import social_edges


# Histories


@query(
    "a26_common_neighbours",
    f"""WITH {_SOCIAL}, o AS (SELECT *, min(struct_pack(t := t, e := edge_id)) OVER (PARTITION BY src) AS s FROM social), e AS (SELECT edge_id, src, dst, row_number() OVER (ORDER BY s, t, edge_id) AS seq FROM o),
    m AS (SELECT a, b, min(seq) AS seq FROM (SELECT src AS a, dst AS b, seq FROM e UNION ALL SELECT dst, src, seq FROM e) GROUP BY a, b), c AS (SELECT e.edge_id, count(*) AS common FROM e JOIN m x ON x.a = e.src AND x.seq <= e.seq JOIN m y ON y.a = e.dst AND y.b = x.b AND y.seq <= e.seq GROUP BY e.edge_id)
    SELECT e.edge_id, coalesce(common, 0) AS common FROM e LEFT JOIN c USING (edge_id)""",
)
def _(spark, d):
    """Common neighbours of both ends when an edge is read, source by source."""
    return history.common_neighbours(social_edges(spark, d))


@query("w9_ordered_history", f"WITH {_BOTH} SELECT node, nbr, t, edge_id, row_number() OVER (PARTITION BY node ORDER BY t, edge_id, nbr) - 1 AS place FROM both_ways")
def _(spark, d):
    return history.ordered_history(social_edges(spark, d))


@query(
    "gr39_first_hop_lists",
    f"WITH {_BOTH}, q AS (SELECT edge_id AS qid, src AS node, t FROM social WHERE edge_id % 20 = 0) SELECT qid, q.node, q.t, count(b.t) AS n, coalesce(string_agg(b.nbr || '@' || b.t, ',' ORDER BY b.t, b.edge_id, b.nbr), '') AS neighbours FROM q LEFT JOIN both_ways b ON b.node = q.node AND b.t < q.t GROUP BY qid, q.node, q.t",
)
def _(spark, d):
    """All earlier neighbours of the sources of the events whose id is divisible by 20, in order of time."""
    e = social_edges(spark, d)
    found = history.first_hop_lists(e, e.where("edge_id % 20 = 0").select(F.col("edge_id").alias("qid"), F.col("src").alias("node"), "t"))
    shown = F.array_join(F.transform("neighbours", lambda x: F.concat(x.nbr.cast("string"), F.lit("@"), x.t.cast("string"))), ",")
    return found.select("qid", "node", "t", F.size("neighbours").cast("long").alias("n"), shown.alias("neighbours"))


# Power laws


def _discrete(spark, d):
    k = _win(spark, d).groupBy("w", "src").agg(F.count("*").alias("value")).groupBy("w", "value").agg(F.count("*").alias("count"))
    h = k.groupBy("w").agg(F.collect_list(F.struct("value", "count")).alias("h"))
    return h.select("w", fits.power_law(F.col("h")).alias("f")).select("w", "f.*")


@query("gr12_discrete_fit")
def _(spark, d):
    """The likeliest exponent of each window's degrees from 2, and the largest gap between the distributions."""
    return _discrete(spark, d).select("w", _r(F.col("alpha")).alias("alpha"), _r(F.col("D")).alias("D"))


@query("gr13_discrete_ratio")
def _(spark, d):
    """The share of windows of a good fit: a gap under 0.1 and an exponent from 2 to 3."""
    return _discrete(spark, d).agg(F.avg(((F.col("D") < 0.1) & F.col("alpha").between(2, 3)).cast("double")).alias("ratio"))


# Stems


@query("tx22_rouge_l_stems")
def _(spark, d):
    """ROUGE-L of each turn against the turn before it, on stems."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("earlier"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(stems.rouge_l(F.col("text"), F.col("earlier")), 6).alias("rouge"))


# Rules and scorers by name

_CONSTRAINTS = [
    '{"func_name": "verify_keywords", "keyword_list": ["The", "a"]}',
    '{"func_name": "validate_word_constraint", "N": 12, "quantifier": "at least"}',
    '{"func_name": "verify_letter_frequency", "letter": "e", "N": 5}',
    '{"func_name": "validate_no_commas"}',
    '{"func_name": "validate_end", "end_phrase": "."}',
    '{"func_name": "validate_frequency_capital_words", "N": 1, "quantifier": "at most"}',
    '{"func_name": "validate_sections", "section_splitter": " ", "N": 12}',
    '{"func_name": "no_such_rule", "N": 1}',
    '{"func_name": "validate_lowercase"}',
]
_KEPT = [
    "contains(lower(x), 'the') AND contains(lower(x), 'a')",
    "len([w FOR w IN string_split_regex(x, '[ \\t-\\r]+') IF w <> '']) >= 12",
    "length(x) - length(replace(x, 'e', '')) = 5",
    "NOT contains(x, ',')",
    "ends_with(x, '.')",
    "len([w FOR w IN regexp_extract_all(x, '[\\p{L}\\p{N}_]+') IF regexp_full_match(w, '[A-Z]+')]) <= 1",
    "length(x) - length(replace(x, ' ', '')) + 1 - CAST(starts_with(x, ' ') AS INT) = 12",
    "false",
    "x = lower(x)",
]


@query("u3_rules_by_name", "SELECT conv_id, turn, CASE WHEN " + " WHEN ".join(f"k = {i} THEN CAST(({s}) AS DOUBLE)" for i, s in enumerate(_KEPT)) + f" END AS score FROM (SELECT conv_id, turn, coalesce(text, '') AS x, (conv_id * 3 + turn) % {len(_KEPT)} AS k FROM conversations)")
def _(spark, d):
    """Each turn checked by the rule that its JSON constraint names, all rules in one scan; an unknown name scores 0."""
    k = ((F.col("conv_id") * 3 + F.col("turn")) % len(_CONSTRAINTS)).cast("int")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.get(F.array(*map(F.lit, _CONSTRAINTS)), k).alias("constraint"))
    return scoring.checked(rows, "text", "constraint").select("conv_id", "turn", "score")


_TAGS = {"user0": "yes_no", "user1": "length", "user2": "think_format", "user3": "exact", "assistant0": "repetition", "assistant1": "long_block", "assistant2": "choice", "assistant3": "boxed"}


@query(
    "u2_u6_scorers_by_tag",
    """WITH c AS (SELECT conv_id, turn, role || (conv_id + turn // 2) % 4 AS tag, coalesce(text, '') AS x, upper(left(trim(coalesce(text, '')), 1)) AS truth, [w FOR w IN string_split_regex(lower(coalesce(text, '')), '[ \\t-\\r]+') IF w <> ''] AS w FROM conversations)
    SELECT conv_id, turn, round(CASE tag WHEN 'user0' THEN CAST(contains(lower(x), 'yes') AS DOUBLE) WHEN 'user1' THEN length(x) / 20000.0 WHEN 'user2' THEN CASE WHEN regexp_matches(x, '(?sm)^<think>.*?</think>.*?<answer>.*?</answer>$') THEN 0.0 ELSE -1.0 END
      WHEN 'user3' THEN CAST(trim(x) = truth AS DOUBLE) WHEN 'assistant0' THEN CASE WHEN len(w) < 3 THEN 0.0 ELSE (1 - len(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) / (len(w) - 2)) * -0.1 END
      WHEN 'assistant1' THEN CASE WHEN len([w FOR w IN string_split_regex(x, '[ \\t-\\r]+') IF length(w) > 20]) > 0 THEN -1.0 ELSE 0.0 END WHEN 'assistant2' THEN CAST(coalesce(upper(left(trim(list_last(regexp_extract_all(x, '\\\\boxed\\{([^{}]*)\\}', 1))), 1)) = truth, false) AS DOUBLE)
      WHEN 'assistant3' THEN CAST(coalesce(trim(nullif(regexp_extract(x, '\\\\boxed\\{([^{}]*)\\}', 1), '')) = truth, false) AS DOUBLE) ELSE 0.0 END, 9) + 0.0 AS reward FROM c""",
)
def _(spark, d):
    """Each turn scored by the scorer of its tag, eight of them in one scan."""
    text = F.coalesce("text", F.lit(""))
    tag = F.concat("role", ((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 4).cast("string"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", tag.alias("tag"), F.upper(F.left(F.trim(text), F.lit(1))).alias("truth"))
    return scoring.scored(rows, "tag", "text", "truth", _TAGS).select("conv_id", "turn", (F.round("reward", 9) + F.lit(0.0)).alias("reward"))
