"""The queries of the corpus operators and, where SQL can express one, its SQL for DuckDB."""

from . import hard_negatives, license_scan, media, mixing, packing, quality_classifier, quality_rules, secrets, simhash, token_codes, toxicity, urls, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality_classifier.op6_quality,
    "op7_simhash": simhash.op7_simhash,
    "op8_urls": urls.op8_urls,
    "op9_media": media.op9_media,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_codes": token_codes.op12_token_codes,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op8_urls": urls.OP8_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
