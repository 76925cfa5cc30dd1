"""Operators of a training-data pipeline.  Nothing outside this folder and ``corpus_pipeline.py`` imports it."""
