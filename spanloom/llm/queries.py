"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import bpe_encode_decode
from .bytebpe import byte_bpe_encode_decode
from .hardneg import hard_negative_mining
from .html import html_extraction
from .langid import language_id
from .linededup import line_dedup
from .lmscore import lm_scoring
from .merkle import merkle_manifest
from .mixing import source_mixing
from .quality import quality_rules
from .simhash import simhash_near_dedup
from .topk import exact_topk
from .urlfilter import url_filters

QUERIES = {
    "op1_exact_topk": exact_topk,
    "op2_language_id": language_id,
    "op3_quality_rules": quality_rules,
    "op4_line_dedup": line_dedup,
    "op5_bpe_encode_decode": bpe_encode_decode,
    "op6_lm_scoring": lm_scoring,
    "op7_source_mixing": source_mixing,
    "op8_simhash_near_dedup": simhash_near_dedup,
    "op9_url_filters": url_filters,
    "op10_html_extraction": html_extraction,
    "op11_hard_negative_mining": hard_negative_mining,
    "op12_byte_bpe_encode_decode": byte_bpe_encode_decode,
    "op13_merkle_manifest": merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), held AS (
            SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) >= 2
        ), told AS (
            SELECT keyed.*, held.k IS NOT NULL AND doc_id <> first_doc AS gone FROM keyed LEFT JOIN held USING (k)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM told GROUP BY doc_id
    """,
    "op11_hard_negative_mining": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_dot_product(a.w, r.w)::BIGINT AS score
            FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), met AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM positive JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        )
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)
        ), told AS (
            SELECT doc_id, source, text,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 5 = 0 AS hit
            FROM documents, crc
        ), leaves AS (
            SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now
            FROM told
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM leaves
        ), low_tree AS (
            SELECT source, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM placed
            UNION ALL
            SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM low_tree WHERE n > 1 GROUP BY source, level, pos // 16
        ), subroots AS (
            SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM low_tree WHERE n = 1
        ), high_tree AS (
            SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM high_tree WHERE n > 1 GROUP BY level, pos // 16
        ), low_path AS (
            SELECT a.source, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
            FROM low_tree a JOIN low_tree b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
        ), high_path AS (
            SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
            FROM high_tree a JOIN high_tree b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
        ), steps AS (
            SELECT p.source, p.pos, 0 AS part, q.level, l, r FROM placed p JOIN low_path q ON p.source IS NOT DISTINCT FROM q.source AND q.pos = p.pos // (16 ** q.level)::BIGINT
            UNION ALL
            SELECT p.source, p.pos, 1, q.level, l, r FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN high_path q ON q.pos = s.pos // (16 ** q.level)::BIGINT
        ), paths AS (
            SELECT source, pos, string_agg(l || r, '' ORDER BY part, level) AS siblings, list({'l': l, 'r': r} ORDER BY part, level) AS path FROM steps GROUP BY source, pos
        ), folded AS (
            SELECT p.doc_id, leaf, subroot, (SELECT digest FROM high_tree WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
                   list_reduce(list_prepend({'l': now, 'r': ''}, coalesce(path, [])), lambda acc, x: {'l': sha256(x.l || acc.l || x.r), 'r': ''}).l AS folded_root
            FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN paths t ON p.source IS NOT DISTINCT FROM t.source AND p.pos = t.pos
        )
        SELECT *, folded_root = root AS verified FROM folded
    """,
}
