"""Operators of a training-data pipeline, one module each, and their registered queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
