"""Registered queries of the numbered operators: thin forms that derive the contract's columns from each operator's results."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.llm import cascade, fim, licenses, lm, maintext, mixing, naming, packing, ranking, simhash, sketch, turns, warc
from barloom.llm.common import scratch, table


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(sf_dir, "documents", spark)))


def op2_warc_chunks(spark, sf_dir):
    at = scratch(spark, "warc")
    warc.write_archive(table(sf_dir, "pages", spark), at)
    return warc.read_records(spark, at)


def op3_main_text(spark, sf_dir):
    return maintext.main_texts(table(sf_dir, "pages", spark))


def op4_minhash_fingerprints(spark, sf_dir):
    return sketch.fingerprints(table(sf_dir, "documents", spark))


def op5_lm_scoring(spark, sf_dir):
    good = table(sf_dir, "labels", spark).filter("quality = 1")
    return lm.cross_entropy_difference(table(sf_dir, "documents", spark), good)


def op6_exact_dedup(spark, sf_dir):
    return naming.exact_groups(table(sf_dir, "documents", spark)).drop("_rk_h")


def op7_quality_ranking(spark, sf_dir):
    docs = table(sf_dir, "documents", spark)
    rated = ranking.scored(docs, ranking.learn(docs, table(sf_dir, "labels", spark)))
    return rated.select("doc_id", F.coalesce(ranking.fold() == 0, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= ranking.CUT).cast("int").alias("predicted"))


def op8_url_cascade(spark, sf_dir):
    return cascade.judge(table(sf_dir, "pages", spark)).drop("listed")


def op9_source_mixing(spark, sf_dir):
    return mixing.plan(table(sf_dir, "documents", spark)).taken()


def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_groups(table(sf_dir, "documents", spark), simhash.STRICT)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op11_conversation_repair(spark, sf_dir):
    return turns.Repair(table(sf_dir, "conversations", spark)).report()


def op12_fill_in_middle(spark, sf_dir):
    found = fim.transformed(table(sf_dir, "documents", spark))
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


def op13_license_scan(spark, sf_dir):
    return licenses.scanned(table(sf_dir, "documents", spark))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_warc_chunks, op3_main_text, op4_minhash_fingerprints, op5_lm_scoring, op6_exact_dedup, op7_quality_ranking, op8_url_cascade,
    op9_source_mixing, op10_simhash_near_dedup, op11_conversation_repair, op12_fill_in_middle, op13_license_scan)}

UPPER, LOWER = cascade.UPPER, cascade.LOWER
TEMPLATE_ROWS = ", ".join(f"({i}, '{t.label}', {t.exact}, '{' '.join(t.words)}')" for i, t in enumerate(licenses.TEMPLATES))

ORACLES = {
    "op2_warc_chunks": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
             r AS (SELECT *, max(page_id) OVER (PARTITION BY p) AS top, strlen(p) AS n FROM t)
        SELECT page_id, n AS payload_bytes, sha1(p) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM r""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
             r AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op8_url_cascade": f"""
        WITH t AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
             p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                          regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM t),
             r AS (SELECT *, CASE
                     WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
               WHEN regexp_matches(host, '{"|".join(cascade.LISTED_PARTS)}') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op11_conversation_repair": """
        WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
         n AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
         d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
                          lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw FROM n, k),
         e AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
                      CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
               FROM d WHERE draw <> 0),
         o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS rn,
                      NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM e),
         s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS late,
                      substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS bi FROM o),
         r AS (SELECT conv_id, rn, i, role, text, blank OR seen AS dead, CASE WHEN late THEN 3 ELSE 0 END AS kc FROM s),
         c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                      count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (late AND NOT seen AND NOT blank) AS truncated,
                      count(*) FILTER (bi || i NOT IN ('su', 'ua', 'au')) AS illegal, max(rn) AS n FROM s GROUP BY conv_id),
         f AS (SELECT conv_id, n + 1 AS rn, {'c': 0, 'a': '', 'r': ''} AS f0, {'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)} AS f1,
                      {'c': 3, 'a': 'I', 'r': 'assistant:' || chr(10)} AS f2, {'c': 0, 'a': '', 'r': ''} AS f3 FROM c
               UNION ALL
               SELECT conv_id, rn,
                      list_min([b0, {'c': b2.c + 3, 'a': 'I' || b2.a, 'r': 'user:' || chr(10) || b2.r}, {'c': b3.c + 6, 'a': 'II' || b3.a, 'r': 'user:' || chr(10) || 'assistant:' || chr(10) || b3.r}]),
                      list_min([b1, {'c': b2.c + 3, 'a': 'I' || b2.a, 'r': 'user:' || chr(10) || b2.r}, {'c': b3.c + 6, 'a': 'II' || b3.a, 'r': 'user:' || chr(10) || 'assistant:' || chr(10) || b3.r}]),
                      list_min([b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 'r': 'assistant:' || chr(10) || b3.r}]),
                      list_min([b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 'r': 'user:' || chr(10) || b2.r}])
               FROM (SELECT f.conv_id, r.rn,
                            list_min([{'c': f0.c + 4, 'a': 'D' || f0.a, 'r': f0.r},
                                      CASE WHEN NOT dead AND i = 's' THEN {'c': f1.c + kc, 'a': 'K' || f1.a, 'r': role || ':' || text || chr(10) || f1.r} END,
                                      CASE WHEN NOT dead AND i = 'u' THEN {'c': f2.c + kc, 'a': 'K' || f2.a, 'r': role || ':' || text || chr(10) || f2.r} END,
                                      CASE WHEN NOT dead THEN {'c': f2.c + kc + 3, 'a': 'R' || f2.a, 'r': 'user:' || text || chr(10) || f2.r} END]) AS b0,
                            list_min([{'c': f1.c + 4, 'a': 'D' || f1.a, 'r': f1.r},
                                      CASE WHEN NOT dead AND i = 'u' THEN {'c': f2.c + kc, 'a': 'K' || f2.a, 'r': role || ':' || text || chr(10) || f2.r} END,
                                      CASE WHEN NOT dead THEN {'c': f2.c + kc + 3, 'a': 'R' || f2.a, 'r': 'user:' || text || chr(10) || f2.r} END]) AS b1,
                            list_min([{'c': f2.c + 4, 'a': 'D' || f2.a, 'r': f2.r},
                                      CASE WHEN NOT dead AND i = 'a' THEN {'c': f3.c + kc, 'a': 'K' || f3.a, 'r': role || ':' || text || chr(10) || f3.r} END,
                                      CASE WHEN NOT dead THEN {'c': f3.c + kc + 3, 'a': 'R' || f3.a, 'r': 'assistant:' || text || chr(10) || f3.r} END]) AS b2,
                            list_min([{'c': f3.c + 4, 'a': 'D' || f3.a, 'r': f3.r},
                                      CASE WHEN NOT dead AND i = 'u' THEN {'c': f2.c + kc, 'a': 'K' || f2.a, 'r': role || ':' || text || chr(10) || f2.r} END,
                                      CASE WHEN NOT dead THEN {'c': f2.c + kc + 3, 'a': 'R' || f2.a, 'r': 'user:' || text || chr(10) || f2.r} END]) AS b3
                     FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.rn = f.rn - 1) x)
        SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
               coalesce(c.illegal, 0) AS illegal, coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(left(f0.r, -1), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND f.rn = 1""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
             h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3,
                          ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
             f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                          CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                               WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
             o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM o""",
    "op13_license_scan": f"""
        WITH t AS (SELECT n, label, exact, string_split(txt, ' ') AS tw, CASE WHEN exact THEN 2 ELSE 3 END AS k FROM (VALUES {TEMPLATE_ROWS}) v(n, label, exact, txt)),
             g AS (SELECT n, label, exact, k, len(tw) AS size, len(tw) - k + 1 AS grams, i, tw[i + 1] AS a, tw[i + 2] AS b, CASE WHEN NOT exact THEN tw[i + 3] END AS c
                   FROM (SELECT *, unnest(range(len(tw) - k + 1)) AS i FROM t)),
             d AS (SELECT row_number() OVER () AS rid, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
             p AS (SELECT rid, pos, w[pos + 1] AS a, w[pos + 2] AS b, w[pos + 3] AS c FROM (SELECT rid, w, unnest(range(len(w))) AS pos FROM d)),
             v AS (SELECT rid, n, label, exact, k, size, grams, pos - i AS diagonal, list(i) AS seen, min(pos) AS lo, max(pos) AS hi
                   FROM p JOIN g ON p.a = g.a AND p.b = g.b AND (g.exact OR p.c = g.c) GROUP BY ALL),
             b AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, n ORDER BY diagonal) > {licenses.SLACK}, true) THEN 1 ELSE 0 END AS fresh FROM v),
             m AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, n ORDER BY diagonal) AS span FROM b),
             s AS (SELECT rid, n, label, exact, size, len(list_distinct(flatten(list(seen)))) / grams AS cover, min(lo) AS start, max(hi) + k AS stop
                   FROM m GROUP BY rid, n, label, exact, size, grams, k, span),
             f AS (SELECT *, CASE WHEN exact THEN cover = 1 ELSE cover >= {licenses.LEAST} AND stop - start <= {licenses.STRETCH} * size END AS found FROM s),
             r AS (SELECT rid, count(*) FILTER (found AND exact) AS n_base, min(start) FILTER (found AND exact) AS first_word, max(start) FILTER (found AND exact) AS last_word,
                          coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found AND exact), '') AS base_labels,
                          coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found), '') AS labels, round(max(cover), 6) AS score FROM f GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0) AS score FROM d LEFT JOIN r USING (rid)""",
}
