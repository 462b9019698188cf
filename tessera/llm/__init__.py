"""Training-data operators: near-duplicates, tokens, archives, scans, classifier.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
