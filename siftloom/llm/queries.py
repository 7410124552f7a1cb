"""The queries of this package: (spark, folder of tables) to DataFrame. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions.labels import rating
from siftloom.session import checkpointed

from . import budget, cutoff, leak, mix, pack, pairs, repeat, spans
from .common import read, resolved_source, sliced, token_sizes


def p1_found(spark, d):
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p1_leaks(spark, d):
    return leak.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p1_item_report(spark, d):
    return leak.item_report(read(spark, d, "eval_items"), p1_leaks(spark, d))


def _scored(spark, d):
    """Records of both rating tables: valid ratings as numbers, all else as null."""
    a, s = read(spark, d, "annotated"), read(spark, d, "sft_stats")
    score = F.when((F.col("overall_score") >= 1) & (F.col("overall_score") <= 5), F.col("overall_score"))
    return a.select(
        F.lit("annotated").alias("dataset"), F.col("document_index").alias("record"), resolved_source(a, "source_domain", "document_index").alias("source"),
        rating(F.col("overall_score")).cast("double").alias("score"),
    ).unionByName(
        s.select(F.lit("sft_stats").alias("dataset"), F.col("sample_index").alias("record"), resolved_source(s, "source", "sample_index").alias("source"), score.alias("score"))
    )


def p2_kept_records(spark, d):
    """What the cutoffs keep, each record with its source's cutoff and kept size; ``p2_cutoffs`` is the report alone."""
    records = _scored(spark, d)
    return cutoff.kept(records, cutoff.cutoffs(records, read(spark, d, "mix_targets")))


def p2_cutoffs(spark, d):
    return cutoff.cutoffs(_scored(spark, d), read(spark, d, "mix_targets"))


def p3_found(spark, d):
    return repeat.repetitive(read(spark, d, "documents"))


def p3_repetition(spark, d):
    return repeat.repetition(read(spark, d, "documents"))


def p4_found(spark, d):
    return pairs.defects(read(spark, d, "gpt_responses"))


def p4_clause_coverage(spark, d):
    return pairs.coverage(read(spark, d, "gpt_responses"))


def p5_token_budget(spark, d):
    return budget.token_budget(sliced(read(spark, d, "documents")))


def p5_token_rollup(spark, d):
    return budget.rollup(p5_token_budget(spark, d))


def _sizes(spark, d):
    """Token sizes are computed once: packing and mixing read them more than once."""
    return checkpointed(token_sizes(sliced(read(spark, d, "documents"))))


def p6_pack(spark, d):
    return pack.pack(_sizes(spark, d), capacity=2048)


def p6_fill_report(spark, d):
    return pack.fill_report(p6_pack(spark, d), capacity=2048)


def p7_mix(spark, d):
    return mix.mix(_sizes(spark, d), read(spark, d, "mix_targets"))


def p7_share_report(spark, d):
    sized, wanted = _sizes(spark, d), read(spark, d, "mix_targets")
    return mix.share_report(checkpointed(mix.mix(sized, wanted)), sized, wanted)


def p8_found(spark, d):
    return spans.shared_pairs(read(spark, d, "documents"))


def p8_links(spark, d):
    return spans.shared_links(read(spark, d, "documents"))


def p8_shared_share(spark, d):
    return spans.shared_share(read(spark, d, "documents"))


def p8_shared_spans(spark, d):
    return spans.shared_spans(read(spark, d, "documents"))


def queries():
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
