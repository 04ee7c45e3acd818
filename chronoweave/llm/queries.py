"""One query per operator over its whole table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from chronoweave.llm import block_naming, chat, decontam, filter_audit, html_extract, langid, line_dedup, media, minhash, packing, periodic, suffix_dedup, toxicity
from chronoweave.session import table


def op1_decontamination(spark, d):
    return decontam.contamination_report(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)


def op2_packing(spark, d):
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), budget=16384, buckets=16)


def op3_suffix_dedup(spark, d):
    return suffix_dedup.repeat_report(table(spark, d, "documents"), length=100)


def op4_language_id(spark, d):
    docs = table(spark, d, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


def op6_html_extraction(spark, d):
    return html_extract.extract(table(spark, d, "pages"))


def op7_minhash(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"), width=4, percent=80)


def op8_chat_formatting(spark, d):
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.format_report(table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op9_line_dedup(spark, d):
    return line_dedup.line_report(table(spark, d, "documents"), ratio=0.02, min_pages=5)


def op10_media_columns(spark, d):
    return media.media_report(table(spark, d, "documents"))


def op11_exact_dedup(spark, d):
    return block_naming.exact_groups(table(spark, d, "documents"))


def op12_filter_audit(spark, d):
    return filter_audit.audit(spark, f"{d}/documents.parquet", table(spark, d, "labels"))


def op13_periodic_runs(spark, d):
    return periodic.run_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_suffix_dedup, op4_language_id, op5_toxicity, op6_html_extraction, op7_minhash, op8_chat_formatting, op9_line_dedup, op10_media_columns, op11_exact_dedup, op12_filter_audit, op13_periodic_runs)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op1_decontamination": f"""
        WITH items AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
                    FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items)),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        found AS (SELECT p.r, p.i, p.k, v.item_id
                  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k) p
                  JOIN windows v ON v.k = p.k AND v.g = array_to_string(p.w[p.i : p.i + p.k - 1], ' ')),
        hit AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM found) GROUP BY r),
        own AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
               sha256(coalesce(own.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
    "op7_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex({_LOWER.format('coalesce(text, chr(32))')}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.c = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "op8_chat_formatting": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(replace(replace(replace(role || chr(10) || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS n FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(n + 7) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
        pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
        lines AS (SELECT source, line, count(*) AS k FROM (SELECT DISTINCT r, source, trim(x) AS line FROM (SELECT r, source, unnest(l) AS x FROM d)) WHERE line <> '' GROUP BY source, line),
        hot AS (SELECT l.source, list(line) AS b FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source WHERE k >= 5 AND k > 0.02 * n GROUP BY l.source),
        k AS (SELECT d.*, [x FOR x IN l IF trim(x) = '' OR NOT list_contains(coalesce(b, []), trim(x))] AS kept FROM d LEFT JOIN hot ON d.source IS NOT DISTINCT FROM hot.source)
        SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(kept), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
        FROM k""",
    "op11_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
        k AS (SELECT doc_id, plain, count(*) OVER (PARTITION BY plain) AS group_size, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(plain) AS text_sha256 FROM k""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
                     + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
              FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (SELECT [p.f, q.f, r.f, s.f, u.f] AS letters, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits FROM f p, f q, f r, f s, f u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
        e AS (SELECT array_to_string(letters, '') AS filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
        r AS (SELECT part, filter_order, CAST(step AS INT) AS step, bit,
                     CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                     CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                     CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                     CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                     CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
                     CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS BIGINT) AS toxic_lost
              FROM c, e GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
