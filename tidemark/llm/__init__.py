"""Training-data operators: deduplication, filtering, counting, tokenising and packing of corpora.

Nothing outside this package (and corpus_pipeline.py) imports it.
"""
