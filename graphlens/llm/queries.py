"""Contract queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from graphlens.llm import embed_dedup, language, line_dedup, media, packing, pii, sentence_pieces, simhash, token_counts, url_filter

#: All pairs by cosine in double precision, then reachability.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, COUNT(*) AS n FROM link GROUP BY a)
SELECT c.a AS vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept FROM comp c LEFT JOIN n ON n.a = c.a
"""


def queries() -> dict:
    """Name to ``(spark, sf_dir) -> DataFrame`` of every operator's contract query."""
    return {
        "op1_pii": pii.op1,
        "op2_url_filter": url_filter.op2,
        "op3_embedding_near_dedup": embed_dedup.op3,
        "op4_media_columns": media.op4,
        "op5_token_counts": token_counts.op5,
        "op6_language_id": language.op6,
        "op7_simhash_near_dedup": simhash.op7,
        "op8_packing": packing.op8,
        "op9_line_dedup": line_dedup.op9,
        "op10_sentence_pieces": sentence_pieces.op10,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the whole result on whole tables."""
    return {"op3_embedding_near_dedup": OP3_SQL}
