"""Spark-native analytics over append-only logs, snapshots, graphs and series.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans the physical work.
"""

__version__ = "0.1.0"
