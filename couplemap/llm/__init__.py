"""Operators for preparing language-model training data.

One module per operator; ``queries.py`` registers one query for each of
them.  Nothing outside this package (but the driver entry point and
``corpus_pipeline.py``) imports it.
"""
