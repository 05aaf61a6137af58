"""tillwise: retail analytics as Spark jobs.

Load a flat sales file or parquet tables, audit them, run the store, customer and
product reports, and keep statistics and stock current from batches or a stream.
"""

from tillwise.sources.tables import RetailTables

__all__ = ["RetailTables"]
