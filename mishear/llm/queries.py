"""The queries of this subpackage, by the names that the driver calls."""

from __future__ import annotations

from mishear.llm import html_text, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, tiff, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_html_text": html_text.query,
    "op4_url_filters": url_filter.query,
    "op5_packing": packing.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_toxicity": toxicity.query,
    "op8_quality_rules": quality_rules.query,
    "op9_tiff": tiff.query,
    "op10_ngram_join": ngram_join.query,
}
SQL = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op4_url_filters": url_filter.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
