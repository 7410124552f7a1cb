"""DuckDB statements for those queries of this package that SQL can express on whole tables."""

from siftloom.functions.labels import canonical_source_sql, rating_sql, source_of_id_sql


def _source(source: str, index: str) -> str:
    return f"coalesce({canonical_source_sql(source)}, {canonical_source_sql(source_of_id_sql(index))}, 'unknown')"


_SCORED = f"""
scored AS (
    SELECT 'annotated' AS dataset, document_index AS record, {_source("source_domain", "document_index")} AS source,
           CAST({rating_sql("overall_score")} AS DOUBLE) AS score
    FROM annotated
    UNION ALL
    SELECT 'sft_stats', sample_index, {_source("source", "sample_index")},
           CASE WHEN overall_score >= 1 AND overall_score <= 5 AND NOT isnan(overall_score) THEN overall_score END
    FROM sft_stats
), wanted AS (
    SELECT {canonical_source_sql("source")} AS source, max(keep_fraction) AS keep_fraction FROM mix_targets GROUP BY 1
), goals AS (
    SELECT dataset, s.source, any_value(w.keep_fraction) AS keep_fraction, count(*) AS n_records, count(score) AS n_scored,
           CAST(coalesce(ceil(round(any_value(w.keep_fraction) * count(score), 6)), 0) AS BIGINT) AS target_kept
    FROM scored s LEFT JOIN wanted w ON s.source = w.source
    GROUP BY 1, 2
), ranked AS (
    SELECT dataset, source, score, row_number() OVER (PARTITION BY dataset, source ORDER BY score DESC) AS place
    FROM scored WHERE score IS NOT NULL
), cut AS (
    SELECT g.*, r.score AS cutoff
    FROM goals g LEFT JOIN ranked r ON r.dataset = g.dataset AND r.source = g.source AND r.place = g.target_kept
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_cutoffs": f"""WITH {_SCORED}
            SELECT c.dataset, c.source, c.keep_fraction, c.n_records, c.n_scored, c.target_kept, c.cutoff,
                   count(s.score) FILTER (WHERE s.score >= c.cutoff) AS kept, count(s.score) FILTER (WHERE s.score > c.cutoff) AS kept_above
            FROM cut c JOIN scored s ON s.dataset = c.dataset AND s.source = c.source
            GROUP BY ALL""",
        "p2_kept_records": f"""WITH {_SCORED}
            SELECT s.dataset, s.source, s.record, s.score, c.cutoff, c.target_kept,
                   count(*) OVER (PARTITION BY s.dataset, s.source) AS kept
            FROM scored s JOIN cut c ON s.dataset = c.dataset AND s.source = c.source
            WHERE s.score >= c.cutoff""",
    }
