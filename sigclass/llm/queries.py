"""The corpus operators' registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigclass.llm import (
    backoff_lm, exact_dedup, hyperminhash, lexical_search, mixing, packing, pii, prefix_trie, quality_rules, site_quality,
    suffix_dedup, token_orc, warc)
from sigclass.llm.common import table


def op1_source_mix(spark, sf_dir):
    frame = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.taken_words(frame, mixing.plan_mix(frame))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_hyperminhash(spark, sf_dir):
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op4_site_quality(spark, sf_dir):
    """Documents have no URL: their source stands for the host, their language for the path."""
    return site_quality.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                   F.col("source"), F.col("lang"))


def op5_weak_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    index = exact_dedup.new_index(spark)
    out = exact_dedup.decisions(table(spark, sf_dir, "documents"), index)
    index.close()
    return out


def op7_backoff_lm(spark, sf_dir):
    return backoff_lm.score(table(spark, sf_dir, "documents"), order=3)


def op8_curve_packing(spark, sf_dir):
    return packing.pack_along_curve(table(spark, sf_dir, "documents"))


def op9_token_orc(spark, sf_dir):
    return token_orc.round_trip(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_quality_rules, op3_hyperminhash, op4_site_quality, op5_weak_pii, op6_exact_dedup, op7_backoff_lm,
    op8_curve_packing, op9_token_orc, op10_warc, op11_suffix_dedup, op12_prefix_trie, op13_lexical_search)}

SQL = {
    "op6_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d
        JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
              FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.t""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        g AS (SELECT html, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY html)
        SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN largest <> page_id THEN largest END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html""",
    "op12_prefix_trie": r"""
        WITH RECURSIVE own AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id
                                    ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        crc(conv_id, s, step, v) AS (
          SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM own
          UNION ALL
          SELECT conv_id, s, step + 1, CASE WHEN step % 9 = 0 THEN xor(v, CAST(ascii(substr(s, step // 9 + 1, 1)) AS BIGINT))
                                            ELSE xor(v >> 1, 3988292384 * (v & 1)) END
          FROM crc WHERE step < 9 * length(s)),
        convs AS (SELECT conv_id, conv_id - conv_id % 20 AS first, xor(v, 4294967295) % 4 AS lent
                  FROM crc WHERE step = 9 * length(s)),
        turns AS (
          SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.first AND o.pos < c.lent
          UNION ALL
          SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.lent),
        placed AS (SELECT conv_id, row_number() OVER w AS depth, text,
                          string_agg(md5(role) || md5(text), '') OVER w AS path
                   FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
        prefixes AS (SELECT conv_id, depth, path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM placed
                     UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
        nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words
                  FROM prefixes GROUP BY depth, path),
        children AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
        subtrees AS (SELECT left(path, CAST(64 * e AS BIGINT)) AS path, sum((n_convs - 1) * words) AS saved,
                            sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
                     FROM (SELECT *, unnest(range(depth + 1)) AS e FROM full_nodes) GROUP BY 1),
        lasts AS (SELECT conv_id, max(depth) AS depth, max_by(path, depth) AS path FROM prefixes GROUP BY conv_id),
        ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM lasts GROUP BY path)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
               CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
               coalesce(e.h, sha256('')) AS ends_sha256
        FROM full_nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
        JOIN subtrees s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path""",
    "op13_lexical_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        b AS (
          SELECT item_id, unnest(regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        q AS (SELECT item_id, term, count(*) AS repeats FROM b GROUP BY ALL),
        totals AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d),
        tf AS (SELECT rid, doc_id, n, term, count(*) AS tf
               FROM (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (
          SELECT q.item_id, tf.rid, tf.doc_id,
                 CAST(sum(q.repeats * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                          * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
          FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term, totals GROUP BY q.item_id, tf.rid, tf.doc_id),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER)
                       AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 20""",
}
