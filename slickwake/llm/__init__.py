"""Training-data operators: archives, privacy, deduplication, quality and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
