"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from . import (bpe, centroids, embed_dedup, interpolation, language, minhash, packing, pii, quality, substring, toxicity,
               variants, warc)

QUERIES = {
    "op1_quality_rules": (quality.quality_query, None),
    "op2_embedding_links": (embed_dedup.embedding_query, embed_dedup.EMBEDDING_SQL),
    "op3_toxicity": (toxicity.toxicity_query, None),
    "op4_pii_surrogates": (pii.pii_query, None),
    "op5_language": (language.language_query, None),
    "op6_substring_dedup": (substring.substring_query, None),
    "op7_weighted_minhash": (minhash.dedup_query, None),
    "op8_best_fit_packing": (packing.packing_query, None),
    "op9_bpe_roundtrip": (bpe.bpe_query, None),
    "op10_warc_archive": (warc.archive_pages, warc.ARCHIVE_SQL),
    "op11_interpolated_lm": (interpolation.interpolation_query, None),
    "op12_spelling_variants": (variants.variants_query, variants.VARIANTS_SQL),
    "op13_centroid_search": (centroids.centroid_query, centroids.CENTROID_SQL),
}


def queries() -> dict:
    return {name: build for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
