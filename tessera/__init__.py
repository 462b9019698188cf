"""tessera: Spark-native profiling, cleaning, encoding and clustering of tables.

Every public function takes and returns DataFrames. Fitted state (column
statistics, centres, category lists) is small and bounded by the number of
columns or clusters, never by the number of rows.
"""

__version__ = "0.1.0"
