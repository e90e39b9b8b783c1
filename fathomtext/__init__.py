"""Corpus retrieval analytics as Spark DataFrame jobs.

Layers, bottom up: ``functions`` holds column expressions, ``operators`` the
relational steps (one module per family), ``sources`` the readers and the
published tables, ``plans`` the composed jobs and ``streaming`` the continuous
ingest.  Everything takes and returns DataFrames.
"""
