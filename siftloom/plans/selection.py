"""Subset selection, sharding, sampling and splits over the rating table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions.labels import CRITERIA
from siftloom.functions.numeric import draw_sql
from siftloom.operators import sample, select

from .registry import RATED, query, rated, table

TOKENS = 2_000_000


def _attributes(spark, d, metrics, domains=()):
    return select.with_attributes(rated(spark, d), "document_index", "length", metrics, domains)


def _attr_sql(metric: str, domains: tuple = (), where: str = "TRUE") -> str:
    cols = "".join(f", coalesce({c}, '') AS domain_{i + 1}" for i, c in enumerate(domains))
    return f"""{RATED}, attr AS (SELECT * FROM (SELECT document_index AS row_id, CAST(length AS BIGINT) AS n_tokens, CAST({metric} AS DOUBLE) AS metric{cols} FROM rated)
        WHERE n_tokens > 0 AND metric IS NOT NULL AND ({where}))"""


def _top_sql(by: str, order: str, budget: str, cols: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""ranked AS (SELECT *, sum(n_tokens) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS reached, row_number() OVER ({part} ORDER BY {order}) AS place FROM attr)
        SELECT {cols}, 0 AS copy_no FROM ranked {budget} AND (reached - n_tokens < budget OR place = 1)"""


_WHOLE = f"JOIN (SELECT {TOKENS} AS budget) ON TRUE WHERE TRUE"
_PLAIN = "row_id, n_tokens, metric"


@query(f"WITH {_attr_sql('overall_score')}, {_top_sql('', 'metric DESC, row_id', _WHOLE, _PLAIN)}")
def budget_uniform(spark, d):
    return select.select_subset(_attributes(spark, d, ["overall_score"]), TOKENS, "uniform")


@query(f"WITH {_attr_sql('accuracy + coherence')}, {_top_sql('', 'metric ASC, row_id', _WHOLE, _PLAIN)}")
def budget_bottom(spark, d):
    return select.select_subset(_attributes(spark, d, ["accuracy", "coherence"]), TOKENS, "uniform", bottom=True)


_ORG = f"""JOIN (SELECT domain_1 AS g, CAST(CAST(sum(n_tokens) AS HUGEINT) * {TOKENS} // (SELECT sum(n_tokens) FROM attr) AS BIGINT) AS budget FROM attr GROUP BY 1) ON g = domain_1 WHERE TRUE"""


@query(f"WITH {_attr_sql('overall_score', ('source_domain',), 'metric IN (4, 5)')}, {_top_sql('domain_1', 'metric DESC, row_id', _ORG, _PLAIN + ', domain_1')}")
def budget_org_domain(spark, d):
    wanted = select.filter_scores(_attributes(spark, d, ["overall_score"], ["source_domain"]), [4, 5])
    return select.select_subset(wanted, TOKENS, "org_domain")


_EQUI = f"JOIN (SELECT {TOKENS} // count(DISTINCT domain_1) AS budget FROM attr) ON TRUE WHERE TRUE"


@query(f"WITH {_attr_sql('overall_score', ('application_domain',))}, {_top_sql('domain_1', 'metric DESC, row_id', _EQUI, _PLAIN + ', domain_1')}")
def budget_equi_domain(spark, d):
    return select.select_subset(_attributes(spark, d, ["overall_score"], ["application_domain"]), TOKENS, "equi_domain")


_MULTI = f"""JOIN (
    SELECT i.domain_1 AS g, i.domain_2 AS h, CAST(CAST(i.t AS HUGEINT) * o.budget // o.t AS BIGINT) AS budget
    FROM (SELECT domain_1, domain_2, sum(n_tokens) AS t FROM attr GROUP BY 1, 2) i
    JOIN (SELECT domain_1, sum(n_tokens) AS t, CAST(sum(n_tokens) AS HUGEINT) * {TOKENS} // (SELECT sum(n_tokens) FROM attr) AS budget FROM attr GROUP BY 1) o ON o.domain_1 = i.domain_1
) ON g = domain_1 AND h = domain_2 WHERE TRUE"""


@query(f"WITH {_attr_sql(' + '.join([*CRITERIA, 'overall_score']), ('source_domain', 'application_domain'))}, {_top_sql('domain_1, domain_2', 'metric DESC, row_id', _MULTI, _PLAIN + ', domain_1, domain_2')}")
def budget_multi_domain(spark, d):
    attributes = _attributes(spark, d, [*CRITERIA, "overall_score"], ["source_domain", "application_domain"])
    return select.select_subset(attributes, TOKENS, "multi_domain")


@query(f"WITH {_attr_sql('overall_score', ('application_domain',), 'metric IN (4, 5)')} SELECT row_id, n_tokens, metric, domain_1, 0 AS copy_no FROM attr WHERE domain_1 = 'A'")
def select_specific_domain(spark, d):
    attributes = select.filter_scores(_attributes(spark, d, ["overall_score"], ["application_domain"]), [4, 5])
    return select.select_subset(select.filter_domains(attributes, ["A"]), 0, None)


_UP = f"""WITH RECURSIVE {_attr_sql("overall_score", ("source_domain",), "metric = 5")},
    b AS (SELECT domain_1 AS g, sum(n_tokens) AS total, count(*) AS n, CAST(CAST(sum(n_tokens) AS HUGEINT) * {2 * TOKENS} // (SELECT sum(n_tokens) FROM attr) AS BIGINT) AS budget FROM attr GROUP BY 1),
    ranked AS (SELECT *, {draw_sql("42", "row_id")} AS h FROM attr),
    placed AS (SELECT row_id, n_tokens, metric, domain_1, sum(n_tokens) OVER w AS reached, row_number() OVER w AS place FROM ranked WINDOW w AS (PARTITION BY domain_1 ORDER BY h, row_id ROWS UNBOUNDED PRECEDING)),
    chosen AS (SELECT p.* FROM placed p JOIN b ON g = domain_1 WHERE (reached - n_tokens < budget OR place = 1) AND place <= ceil(n * (budget / total + 0.1))),
    base AS (SELECT domain_1 AS g, CAST(sum(n_tokens) AS BIGINT) AS have, count(*) AS rows FROM chosen GROUP BY 1),
    turns AS (
        SELECT g, budget, have, rows, CAST(0 AS BIGINT) AS drawn FROM base JOIN b USING (g)
        UNION ALL
        SELECT s.g, any_value(s.budget), CAST(any_value(s.have) + sum(c.n_tokens) AS BIGINT), any_value(s.rows), any_value(s.drawn) + count(*)
        FROM (SELECT g, budget, have, rows, drawn, unnest(range(drawn + 1, drawn + 1 + CAST(ceil((budget - have) / (have / (rows + drawn))) AS BIGINT))) AS copy_no FROM turns WHERE have < budget) s
        JOIN chosen c ON c.domain_1 = s.g AND c.place = {draw_sql("42", "s.g", "s.copy_no")} % s.rows + 1 GROUP BY s.g),
    draws AS (SELECT g, rows, unnest(range(1, max(drawn) + 1)) AS copy_no FROM turns GROUP BY g, rows)
    SELECT row_id, n_tokens, metric, domain_1, 0 AS copy_no FROM chosen
    UNION ALL SELECT c.row_id, c.n_tokens, c.metric, c.domain_1, CAST(d.copy_no AS INTEGER) FROM draws d JOIN chosen c ON c.domain_1 = d.g AND c.place = {draw_sql("42", "d.g", "d.copy_no")} % d.rows + 1"""


@query(_UP)
def budget_upsampled(spark, d):
    """Budget over what each source has at score 5: seeded draws with replacement fill it. A drawn row comes again."""
    wanted = select.filter_scores(_attributes(spark, d, ["overall_score"], ["source_domain"]), [5])
    return select.select_subset(wanted, 2 * TOKENS, "org_domain", margin=0.1, seed=42, upsample=True)


@query(f"""WITH {_attr_sql('overall_score', ('source_domain',), 'metric IN (4, 5)')}, {_top_sql('domain_1', 'metric DESC, row_id', _ORG, 'row_id, n_tokens').replace('SELECT row_id, n_tokens, 0 AS copy_no', ', chosen AS (SELECT row_id, 0 AS copy_no', 1)})
    SELECT a.document_index, a.source_domain, a.length, a.overall_score, c.copy_no FROM rated a JOIN chosen c ON a.document_index = c.row_id""")
def selected_rows(spark, d):
    """The wide rows of a selection, fetched by id after selecting on the narrow table."""
    wide = rated(spark, d).select("document_index", "source_domain", "length", "overall_score")
    return select.fetch(wide, budget_org_domain(spark, d), "document_index")


def _sized(spark, d):
    return rated(spark, d).where("length > 0").select(F.col("document_index").alias("row_id"), F.col("length").cast("long").alias("n_tokens"))


_SIZED = f"{RATED}, sized AS (SELECT document_index AS row_id, CAST(length AS BIGINT) AS n_tokens FROM rated WHERE length > 0)"


@query(f"WITH {_SIZED} SELECT row_id, n_tokens, CAST((sum(n_tokens) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) - n_tokens) // 500000 AS BIGINT) AS shard FROM sized")
def shard_by_tokens(spark, d):
    return select.shard_by_tokens(_sized(spark, d), 500_000)


@query(f"""WITH {_SIZED}, n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS place FROM sized), w AS (SELECT sum(n_tokens) AS t, count(*) AS n FROM sized),
    e AS (SELECT round_even(i * 500000 / t * n, 0) AS edge FROM w, range(1, CAST(greatest(1, ceil(t / 500000)) AS BIGINT) + 1) r(i))
    SELECT row_id, n_tokens, (SELECT count(*) FROM e WHERE e.edge < n.place) AS shard FROM n""")
def shard_by_rows(spark, d):
    return select.shard_by_rows(_sized(spark, d), 500_000)


@query(f"WITH {_SIZED} SELECT row_id, n_tokens, (row_number() OVER (ORDER BY row_id) - 1) % 7 AS shard FROM sized")
def shard_strided(spark, d):
    return select.shard_strided(_sized(spark, d), 7)


@query(f"WITH {_SIZED} SELECT row_id, n_tokens, ntile(7) OVER (ORDER BY row_id) - 1 AS shard FROM sized")
def shard_contiguous(spark, d):
    return select.shard_contiguous(_sized(spark, d), 7)


@query(f"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, CAST(n_chars AS DOUBLE) AS score FROM documents),
    r AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS hi, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) AS lo FROM docs)
    SELECT doc_id, source, score, hi AS place, 'top' AS tail FROM r WHERE hi <= greatest(floor(n * 0.01), 1)
    UNION ALL SELECT doc_id, source, score, lo, 'bottom' FROM r WHERE lo <= greatest(floor(n * 0.01), 1)""")
def tail_percentiles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("n_chars").cast("double").alias("score"))
    return select.tail_fraction(docs, ["source"], "score", "doc_id")


_SPLIT = f"""{RATED}, ranked AS (SELECT document_index, source_domain, overall_score, row_number() OVER (PARTITION BY source_domain ORDER BY document_index) AS n FROM rated WHERE overall_score IS NOT NULL),
    parts AS (SELECT document_index, source_domain, overall_score, CASE WHEN n <= 20 THEN 'test' WHEN n <= 40 THEN 'valid' WHEN n <= 340 THEN 'train' END AS split FROM ranked WHERE n <= 340)"""


def _split(spark, d):
    scored = rated(spark, d).where("overall_score is not null").select("document_index", "source_domain", "overall_score")
    return sample.split_exact(scored, ["source_domain"], 20, 20, 300, [F.col("document_index")])


@query(f"WITH {_SPLIT} SELECT * FROM parts")
def split_train_valid_test(spark, d):
    return _split(spark, d)


@query(f"""WITH {_SPLIT} SELECT source_domain, high, low, CAST(least(floor(abs(high - low) / 2), least(high, low)) * 2 AS BIGINT) AS draws
    FROM (SELECT source_domain, count(*) FILTER (WHERE overall_score >= 3) AS high, count(*) FILTER (WHERE overall_score < 3) AS low FROM parts WHERE split = 'train' GROUP BY 1)""")
def rebalance_sizes(spark, d):
    return sample.rebalance_sizes(_split(spark, d).where("split = 'train'"), "source_domain", "overall_score", 2, 2)


@query(f"""WITH {_SPLIT}, t AS (SELECT *, CAST(overall_score >= 3 AS INTEGER) AS c, row_number() OVER (PARTITION BY source_domain, overall_score >= 3 ORDER BY document_index) AS place FROM parts WHERE split = 'train'),
    g AS (SELECT source_domain, least(high, low) AS small, CAST(high < low AS INTEGER) AS c, CAST(least(floor(abs(high - low) / 2), least(high, low)) * 2 AS BIGINT) AS draws
          FROM (SELECT source_domain, count(*) FILTER (WHERE c = 1) AS high, count(*) FILTER (WHERE c = 0) AS low FROM t GROUP BY 1)),
    d AS (SELECT source_domain, small, c, unnest(range(1, draws + 1)) AS copy_no FROM g WHERE draws > 0)
    SELECT document_index, source_domain, overall_score, split, 0 AS copy_no FROM t
    UNION ALL SELECT t.document_index, t.source_domain, t.overall_score, t.split, CAST(d.copy_no AS INTEGER)
    FROM d JOIN t ON t.source_domain = d.source_domain AND t.c = d.c AND t.place = {draw_sql("0", "d.source_domain", "2", "d.copy_no")} % d.small + 1""")
def rebalanced_train(spark, d):
    return sample.rebalance(_split(spark, d).where("split = 'train'"), "source_domain", "overall_score", [F.col("document_index")], 2, 2)


@query(f"WITH {RATED} SELECT document_index, source_domain FROM (SELECT document_index, source_domain, row_number() OVER (PARTITION BY source_domain ORDER BY document_index DESC) AS n FROM rated) WHERE n <= 50")
def sample_per_source(spark, d):
    return sample.sample_per_group(rated(spark, d).select("document_index", "source_domain"), ["source_domain"], 50, [F.col("document_index").desc()])


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS rank FROM documents")
def rank_strided(spark, d):
    return sample.rank_strides(table(spark, d, "documents").select("doc_id"), "doc_id", 4)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS c FROM documents) WHERE n <= ceil(c * 0.05)")
def limit_fraction(spark, d):
    return sample.limit_fraction(table(spark, d, "documents").select("doc_id"), 0.05, "doc_id")


@query("""WITH p AS (SELECT task_name, item_id AS example, row_number() OVER (PARTITION BY task_name ORDER BY item_id) AS place FROM eval_items)
    SELECT doc AS item_id, shot, example FROM (
        SELECT e.item_id AS doc, p.example, row_number() OVER (PARTITION BY e.item_id ORDER BY p.place) AS shot FROM eval_items e JOIN p ON p.task_name = e.task_name AND p.example <> e.item_id)
    WHERE shot <= 3""")
def fewshot_examples(spark, d):
    items = table(spark, d, "eval_items")
    return sample.fewshot(items, items, "task_name", "item_id", 3, [F.col("example")])


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def length_order(spark, d):
    return sample.length_order(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id")
