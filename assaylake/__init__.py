"""assaylake: assay, molecule and graph analytics as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – driver tables, derived stand-in tables, CSV/TSV/text scans, sinks
* ``functions`` – Column expressions (hashing, unit conversion, vector helpers)
* ``operators`` – DataFrame -> DataFrame operators (tokens, molecules, graphs,
                  splits, scaling, metrics, windows, joins, aggregates, ML)
* ``plans``     – the query registry used by ``__spark_entry__`` and ``bench.py``
* ``streaming`` – Structured Streaming jobs
"""

__all__ = ["session"]
