"""Bring tables from several vendors, waves and markets to one schema, on Spark.

Operators take and return DataFrames.  Operators that depend on the data come in
two halves: ``fit_*`` runs a few aggregate jobs and returns a small parameter
object, and the matching ``apply_*`` is a lazy, stateless projection, so the same
parameters serve a batch job and a Structured Streaming query.
"""

__version__ = "0.1.0"
