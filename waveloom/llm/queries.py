"""Queries of the corpus operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from waveloom.llm.common import table
from waveloom.llm.exactdedup import exact_dedup
from waveloom.llm.filteraudit import audit_filters
from waveloom.llm.htmlmain import main_text
from waveloom.llm.jpegmedia import payload_media
from waveloom.llm.langid import identify_held_out
from waveloom.llm.linededup import dedup_lines
from waveloom.llm.lmscore import score_held_out
from waveloom.llm.ngramjoin import jaccard_components
from waveloom.llm.packing import pack
from waveloom.llm.sentpiece import encode_spans
from waveloom.llm.sstable import read_shards, write_shards
from waveloom.llm.turnrepair import repair_damaged
from waveloom.llm.warc import read_chunks, records, write_archives


def op1_pattern_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op2_warc_chunks(spark, sf_dir):
    return records(read_chunks(write_archives(table(spark, sf_dir, "pages")))).withColumnRenamed("record_id", "page_id")


def op3_sentencepiece_spans(spark, sf_dir):
    return encode_spans(table(spark, sf_dir, "documents"), digests=True)


def op4_fuzzy_lines(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "dropped", "text")


def op5_language_mixtures(spark, sf_dir):
    return identify_held_out(table(spark, sf_dir, "documents")).drop("mixture")


def op6_template_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op7_jpeg_media(spark, sf_dir):
    return payload_media(table(spark, sf_dir, "documents"))


def op8_shingle_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_sorted_shards(spark, sf_dir):
    return read_shards(write_shards(table(spark, sf_dir, "documents")))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_filter_bitmaps(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_repair(spark, sf_dir):
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op13_maxent_scores(spark, sf_dir):
    return score_held_out(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pattern_packing, op2_warc_chunks, op3_sentencepiece_spans, op4_fuzzy_lines, op5_language_mixtures, op6_template_main_text, op7_jpeg_media, op8_shingle_join, op9_sorted_shards, op10_exact_dedup, op11_filter_bitmaps, op12_turn_repair, op13_maxent_scores)}

#: One bit of a CRC-32, and of a byte's eight.
_BIT = "xor({0} >> 1, 3988292384::UBIGINT * ({0} & 1))"
_BYTE = "n::UBIGINT"
for _ in range(8):
    _BYTE = f"list_transform([{_BYTE}], lambda c: {_BIT.format('c')})[1]"
_CRC = f"""tab AS (SELECT list_transform(range(256), lambda n: {_BYTE}) AS tab)"""

ORACLE_SQL = {
    "op2_warc_chunks": r"""
        WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        g AS (SELECT payload, min(page_id) AS first_id FROM t GROUP BY payload)
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
               CASE WHEN octet_length(payload) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(payload) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM t JOIN g USING (payload)
    """,
    "op10_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op11_filter_bitmaps": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
        f AS (SELECT part, [(len(ws) < 100)::INT, (100 * len(list_distinct(ws)) < 80 * len(ws))::INT,
                (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT,
                regexp_matches(t, '[#$%&*|]')::INT, coalesce(doc_id > first_id, false)::INT] AS fails,
                coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
        n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        i AS (SELECT unnest(range(1, 6)) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT p, i.i AS step, p[i.i] AS own, p[1:i.i - 1] AS before FROM o, i),
        r AS (SELECT part, p, step, own, n, good, toxic, fails[own] AS bad, list_sum(fails) AS bad_all,
                coalesce(list_sum(list_transform(before, lambda x: fails[x])), 0) AS bad_before FROM n, s),
        t AS (SELECT part, p, step, own,
                coalesce(sum(n) FILTER (bad_before = 0 AND bad = 0), 0) AS kept,
                coalesce(sum(n) FILTER (bad_before = 0 AND bad = 1), 0) AS removed,
                coalesce(sum(n) FILTER (bad_before > 0 AND bad = 1), 0) AS redundant,
                coalesce(sum(n) FILTER (bad_all = 1 AND bad = 1), 0) AS unique_fails,
                coalesce(sum(good) FILTER (bad_before = 0 AND bad = 1), 0) AS good_lost,
                coalesce(sum(toxic) FILTER (bad_before = 0 AND bad = 1), 0) AS toxic_lost
            FROM r GROUP BY ALL)
        SELECT part, array_to_string(list_transform(p, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INT AS step,
            kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
    """,
    "op12_turn_repair": f"""
        WITH RECURSIVE {_CRC},
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::UBIGINT)) AS bytes FROM conversations),
        crc AS (SELECT * EXCLUDE (bytes, tab), xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS k FROM raw, tab),
        dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE k <> 0),
        num AS (SELECT *, substr(role, 1, 1) AS ini,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dam),
        t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
            lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) || ini AS pair FROM num),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
            count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
        go(s, ini, e) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        ins(s, e, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
        edit AS (SELECT conv_id, rn, s, s AS e, 4 AS cost, 'D' AS audit FROM t, (SELECT unnest(range(4))::INT AS s)
            UNION ALL SELECT conv_id, rn, s, e, CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'K' FROM t JOIN go USING (ini) WHERE fault IN (0, 3)
            UNION ALL SELECT conv_id, rn, s, e, 3 + CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'R' FROM t, go WHERE fault IN (0, 3) AND go.ini <> 's'),
        move AS (SELECT conv_id, rn, edit.s, ins.e, edit.cost + ins.cost AS cost, edit.audit || ins.audit AS audit FROM edit JOIN ins ON edit.e = ins.s),
        way AS (SELECT conv_id, 0::BIGINT AS i, ins.e AS s, ins.cost AS cost, ins.audit AS audit FROM c, ins WHERE ins.s = 0
            UNION ALL SELECT conv_id, i, s, b.cost, b.audit FROM (SELECT w.conv_id, m.rn AS i, m.e AS s, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.audit}}) AS b
                FROM way w JOIN move m ON m.conv_id = w.conv_id AND m.rn = w.i + 1 AND m.s = w.s GROUP BY w.conv_id, m.rn, m.e)),
        best AS (SELECT conv_id, min({{'cost': cost, 'audit': audit}}) AS b FROM way JOIN c USING (conv_id) WHERE i = n AND s IN (0, 3) GROUP BY conv_id),
        el AS (SELECT conv_id, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS pos FROM best),
        ed AS (SELECT conv_id, pos, substr(audit, pos, 1) AS ed, (length(audit) - length(replace(audit, 'D', ''))) AS dels, length(audit) AS size,
            length(replace(substr(audit, 1, pos), 'I', '')) AS rn, length(replace(substr(audit, 1, pos), 'D', '')) AS place FROM el),
        line AS (SELECT e.conv_id, pos, CASE WHEN ed = 'K' THEN role WHEN (place - 1 - (size - dels) % 2) % 2 = 1 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN ed = 'I' THEN '' ELSE text END AS line
            FROM ed e LEFT JOIN t ON t.conv_id = e.conv_id AND t.rn = e.rn AND ed <> 'I' WHERE ed <> 'D'),
        whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM line GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(whole.text, '')) AS repaired_sha256
        FROM ids LEFT JOIN c USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN whole USING (conv_id)
    """,
}
