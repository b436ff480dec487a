"""Training-data operators: packing, decontamination, secret scans, token counts, language ID,
near-duplicate detection, WARC archives, PII surrogates, document fingerprints, HTML extraction.

Nothing outside this subpackage imports it.
"""
