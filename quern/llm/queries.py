"""The queries over these operators, one for each, and their SQL."""

from __future__ import annotations

from . import line_dedup, mixing, near_dup, neighbours, packing, quality_classifier, quality_rules, secret_scan, token_counts, url_filter
from .common import table, tuned


def documents(spark, sf_dir):
    """The table of whole texts, in a session that sends few of them to Python at once."""
    return table(tuned(spark), sf_dir, "documents")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir))


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op4_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.selectExpr("doc_id", "_lines AS n_lines", "_dropped AS n_dropped", "text")


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_nearest_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir), quality_rules.SHIPPED)


def op10_minhash_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(documents(spark, sf_dir), n=4)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_classifier, op3_best_fit_packing, op4_line_dedup, op5_token_counts, op6_url_filter, op7_nearest_neighbours, op8_source_mixing, op9_quality_rules, op10_minhash_near_dedup)}
ORACLES = {"op8_source_mixing": mixing.SQL}
