"""answerlake: question answering, retrieval and vote analytics as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregations and windows.  Python runs inside tasks only
where a step is sequential by nature (greedy packing) or a user hook is
plugged in (model calls), and then through Arrow batches.
"""

__version__ = "0.1.0"
