"""contrasta: corpus preparation and two-domain corpus comparison on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from native
Spark SQL expressions and keyed by a stable ``doc_id``.
"""

__version__ = "0.1.0"
