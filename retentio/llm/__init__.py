"""Training-data operators: PII, near-duplicates, URL rules, quality, line
templates, decontamination, licences, packing and language ID.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
