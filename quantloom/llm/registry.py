"""The queries of this subpackage and their SQL."""

from . import centroid_clusters, decontaminate, language_id, license_scan, ngram_join, packing, quality_classifier, quality_rules, spelling_variants, token_counts, token_output, url_filter, warc

MODULES = (
    token_output, url_filter, language_id, warc, packing, ngram_join, quality_rules, token_counts, quality_classifier, decontaminate,
    spelling_variants, centroid_clusters, license_scan,
)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
