"""The registered queries of this subpackage, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from tallyforge.llm import audit_filters, decontam, licenses, lines, lm, mixing, near, neighbours, pages, spelling, substrings, toxicity, warc
from tallyforge.llm.common import table

QUERIES = {
    "op1_lm_scoring": lambda spark, d: lm.lm_report(table(spark, d, "documents")),
    "op2_license_scan": lambda spark, d: licenses.license_report(table(spark, d, "documents")),
    "op3_line_dedup": lambda spark, d: lines.line_report(table(spark, d, "documents")),
    "op6_ngram_jaccard": lambda spark, d: near.near_report(table(spark, d, "documents")),
    "op4_toxicity": lambda spark, d: toxicity.toxicity_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_substring_dedup": lambda spark, d: substrings.substring_report(table(spark, d, "documents")),
    "op7_html_extraction": lambda spark, d: pages.main_texts(table(spark, d, "pages")),
    "op8_decontamination": lambda spark, d: decontam.decontamination_report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_mixing": lambda spark, d: mixing.mixing_report(table(spark, d, "documents")),
    "op10_nearest_neighbours": lambda spark, d: neighbours.nearest(table(spark, d, "embeddings")),
    "op11_warc": lambda spark, d: warc.warc_report(table(spark, d, "pages")),
    "op12_filter_interactions": lambda spark, d: audit_filters.filter_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op13_spelling_variants": lambda spark, d: spelling.variants(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": lines.ORACLE,
    "op5_substring_dedup": substrings.ORACLE,
    "op6_ngram_jaccard": near.ORACLE,
    "op9_mixing": mixing.oracle(),
    "op11_warc": warc.ORACLE,
    "op12_filter_interactions": audit_filters.ORACLE,
}
