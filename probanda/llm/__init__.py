"""Operators for large training-data pipelines: fingerprints, personal data, toxicity, languages, quality, mixing, token files, segmentation, licences, near copies."""
