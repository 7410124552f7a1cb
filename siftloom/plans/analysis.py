"""Distributions, rankings, correlations and comparisons over the rating and statistics tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions.labels import CRITERIA, METRICS, canonical_domain, canonical_domain_sql
from siftloom.operators import stats as op

from .registry import RATED, STATS, query, rated, rounded, stats, table

_UNPIVOT = ", ".join(METRICS)
_LONG = f"long AS (SELECT source, criterion, value FROM stats UNPIVOT (value FOR criterion IN ({_UNPIVOT})))"


@query(f"""WITH {RATED}, d AS (
        SELECT 'source_domain' AS dimension, source_domain AS value FROM rated UNION ALL SELECT 'application_domain', application_domain FROM rated
        UNION ALL SELECT 'overall_score', CAST(overall_score AS VARCHAR) FROM rated)
    SELECT dimension, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dimension), 6) AS share FROM d GROUP BY 1, 2""")
def distribution_counts(spark, d):
    return rounded(op.counts_by_dimension(rated(spark, d), ["source_domain", "application_domain", "overall_score"]))


@query(f"""WITH {RATED}, sizes AS (SELECT source_domain AS source, count(*) AS rows FROM rated GROUP BY 1),
    long AS (SELECT source_domain AS source, criterion, value FROM rated UNPIVOT (value FOR criterion IN ({", ".join(CRITERIA)})))
    SELECT l.source, criterion, value, count(*) AS n, round(count(*) / any_value(s.rows), 6) AS share
    FROM long l JOIN sizes s ON l.source IS NOT DISTINCT FROM s.source GROUP BY 1, 2, 3""")
def criteria_distribution(spark, d):
    return rounded(op.rating_distribution(rated(spark, d), "source_domain", CRITERIA))


@query(f"""WITH {STATS}, {_LONG}, m AS (SELECT criterion, count(*) AS n, avg(value) AS mean, var_samp(value) AS variance FROM long GROUP BY 1)
    SELECT criterion, n, round(mean, 6) AS mean, round(variance, 6) AS variance, row_number() OVER (ORDER BY round(mean, 9) DESC, criterion) AS place FROM m""")
def criteria_mean_variance(spark, d):
    return rounded(op.mean_and_variance(stats(spark, d), METRICS))


@query(f"""WITH {STATS} SELECT source, count(*) AS n, {", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)} FROM stats GROUP BY 1""")
def means_by_source(spark, d):
    return rounded(op.means_by(stats(spark, d), "source", METRICS))


def _rank_sql(by: str, sql_by: str) -> str:
    return f"""WITH {STATS}, k AS (SELECT * REPLACE ({sql_by} AS {by}) FROM stats), l AS (SELECT {by}, criterion, value FROM k UNPIVOT (value FOR criterion IN ({_UNPIVOT}))),
        m AS (SELECT {by}, criterion, avg(value) AS mean FROM l GROUP BY 1, 2)
        SELECT {by}, criterion, round(mean, 6) AS mean, row_number() OVER (PARTITION BY criterion ORDER BY round(mean, 9) DESC, {by} ASC NULLS FIRST) AS place_of_group,
               row_number() OVER (PARTITION BY {by} ORDER BY round(mean, 9) DESC, criterion) AS place_of_criterion FROM m"""


@query(_rank_sql("source", "source"))
def rank_sources(spark, d):
    return rounded(op.rank_groups(stats(spark, d), "source", METRICS))


@query(_rank_sql("category", canonical_domain_sql("category")))
def rank_domains(spark, d):
    return rounded(op.rank_groups(stats(spark, d).withColumn("category", canonical_domain(F.col("category"))), "category", METRICS))


@query(f"""WITH {STATS} SELECT source, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share
    FROM (SELECT * REPLACE ({canonical_domain_sql("category")} AS category) FROM stats) GROUP BY 1, 2""")
def category_share(spark, d):
    return rounded(op.share_within(stats(spark, d).withColumn("category", canonical_domain(F.col("category"))), "source", "category"))


@query(f"""WITH {STATS} SELECT source, score, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share
    FROM (SELECT source, floor(overall_score) AS score FROM stats) GROUP BY 1, 2""")
def score_histogram(spark, d):
    return rounded(op.share_within(stats(spark, d).withColumn("score", F.floor("overall_score").cast("double")), "source", "score"))


@query(f"""WITH {STATS}, g AS (SELECT source, count(*) AS n, avg(CASE WHEN overall_score >= 3 THEN 1.0 ELSE 0.0 END) AS good FROM stats WHERE overall_score IS NOT NULL GROUP BY 1)
    SELECT source, n, round(good, 6) AS good, round(1 - good, 6) AS bad, round(2 * good - 1, 6) AS gap,
           row_number() OVER (ORDER BY round(2 * good - 1, 9) DESC, source ASC NULLS FIRST) AS place FROM g""")
def good_bad_gap(spark, d):
    return rounded(op.good_bad_gap(stats(spark, d), "source", "overall_score"))



@query(f"""WITH {STATS}, k AS (SELECT * REPLACE ({canonical_domain_sql("category")} AS category), length(sample_index) % 2 AS half FROM stats),
    a AS (SELECT source, category, count(*) AS n_1, avg(overall_score) AS x, avg(accuracy) AS y FROM k WHERE half = 0 GROUP BY 1, 2),
    b AS (SELECT source, category, count(*) AS n_2, avg(overall_score) AS x, avg(accuracy) AS y FROM k WHERE half = 1 GROUP BY 1, 2)
    SELECT coalesce(a.source, b.source) AS source, coalesce(a.category, b.category) AS category, coalesce(n_1, 0) AS n_1, coalesce(n_2, 0) AS n_2,
           round(a.x - b.x, 6) AS overall_score_diff, round(a.y - b.y, 6) AS accuracy_diff
    FROM (SELECT * FROM a WHERE source IS NOT NULL) a FULL OUTER JOIN (SELECT * FROM b WHERE source IS NOT NULL) b ON a.source = b.source AND a.category = b.category""")
def two_sample_discrepancy(spark, d):
    rows = stats(spark, d).where("source is not null").withColumn("category", canonical_domain(F.col("category")))
    half = F.length("sample_index") % 2
    return rounded(op.discrepancy(rows.where(half == 0), rows.where(half == 1), ["source", "category"], ["overall_score", "accuracy"]))


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN NOT isnan(corr({a}, {b})) THEN round(corr({a}, {b}), 6) END AS pearson FROM stats"
    for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]
)


@query(f"WITH {STATS} {_PAIRS}")
def pearson_matrix(spark, d):
    return rounded(op.pearson_matrix(stats(spark, d), METRICS))


_LONG_PAIRS = f"""p AS (SELECT criterion, overall_score AS x, value AS y FROM stats UNPIVOT (value FOR criterion IN ({", ".join(CRITERIA)})) WHERE overall_score IS NOT NULL)"""


@query(f"""WITH {STATS}, {_LONG_PAIRS}, r AS (
        SELECT criterion, x, y, rank() OVER (PARTITION BY criterion ORDER BY x) + (count(*) OVER (PARTITION BY criterion, x) - 1) / 2 AS rx,
               rank() OVER (PARTITION BY criterion ORDER BY y) + (count(*) OVER (PARTITION BY criterion, y) - 1) / 2 AS ry FROM p)
    SELECT criterion, count(*) AS n, CASE WHEN NOT isnan(corr(x, y)) THEN round(corr(x, y), 6) END AS pearson, CASE WHEN NOT isnan(corr(rx, ry)) THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY 1""")
def correlations_overall(spark, d):
    return rounded(op.correlations(stats(spark, d), "overall_score", CRITERIA))


@query("""WITH l AS (SELECT coalesce(domain_type, 'unknown') AS domain, -n_chars / 2000.0 AS ll FROM documents)
    SELECT domain, count(*) AS n, round(avg(exp(-ll)), 3) AS perplexity FROM l GROUP BY 1
    UNION ALL SELECT 'all', count(*), round(avg(exp(-ll)), 3) FROM l""")
def mean_perplexity_by_domain(spark, d):
    docs = table(spark, d, "documents").withColumn("ll", -F.col("n_chars") / 2000.0)
    return rounded(op.mean_perplexity(docs, "domain_type", "ll"), 3)


@query("""WITH f AS (SELECT source AS file, count(*) AS n_docs, sum(coalesce(length(text), 0)) AS n_chars FROM documents GROUP BY 1)
    SELECT file, n_docs, CAST(n_chars AS BIGINT) AS n_chars, CAST(coalesce(sum(n_docs) OVER (ORDER BY file ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_doc FROM f""")
def corpus_statistics(spark, d):
    return op.corpus_statistics(table(spark, d, "documents"), "source", "text")


@query("""SELECT count(len) AS n, round(avg(len), 6) AS mean, max(len) AS longest, min(len) AS shortest, count(*) FILTER (WHERE len > 512) AS n_truncated
    FROM (SELECT len([x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> '']) AS len FROM documents)""")
def token_length_statistics(spark, d):
    from siftloom.functions.text import trimmed_word_count

    return rounded(op.length_statistics(table(spark, d, "documents"), trimmed_word_count(F.col("text")), 512))


@query(f"""SELECT {", ".join(f"round(avg(CASE WHEN NOT isnan({m}) THEN {m} END), 6) AS {m}, count(CASE WHEN NOT isnan({m}) THEN {m} END) AS n_{m}" for m in METRICS)} FROM sft_stats""")
def mean_ignoring_nan(spark, d):
    return rounded(op.mean_ignoring_nan(table(spark, d, "sft_stats"), METRICS))


@query(f"""SELECT document_index, loaded_at, round({" + ".join(f"coalesce(TRY_CAST({m} AS DOUBLE), 0)" for m in ["coherence", "topic_focus"])}, 6) AS total FROM annotated
    WHERE NOT regexp_matches(coalesce(coherence, ''), '[^ -~]') AND NOT regexp_matches(coalesce(topic_focus, ''), '[^ -~]')""")
def sum_of_fields(spark, d):
    rows = table(spark, d, "annotated").where(~F.coalesce("coherence", F.lit("")).rlike("[^ -~]") & ~F.coalesce("topic_focus", F.lit("")).rlike("[^ -~]"))
    return rounded(op.order_by_sum(rows, ["coherence", "topic_focus"]).select("document_index", "loaded_at", "total"))


@query(f"WITH {STATS} SELECT sample_index, round(overall_score, 6) AS overall_score FROM (SELECT DISTINCT sample_index, overall_score FROM stats WHERE overall_score IS NOT NULL) ORDER BY overall_score, sample_index LIMIT 20")
def least_scores(spark, d):
    return rounded(op.least_k(stats(spark, d).select("sample_index", "overall_score").distinct(), "overall_score", 20, "sample_index"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_event_counts(spark, d):
    from siftloom.streaming.annotate import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("""SELECT n_name AS nation, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (1, 2)""")
def order_rollup(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rolled = joined.rollup(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rolled


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
def top_lines(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    # Of equal prices the least order and line come first.
    return op.greatest_k(lines, F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n")), 100)
