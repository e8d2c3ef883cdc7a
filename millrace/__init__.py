"""millrace: a PySpark-native batch analytics engine.

Operators are plain functions from DataFrames to DataFrames that compose into
one Catalyst plan; ``millrace.plans`` holds the map/reduce-shaped programming
surface on top of them.
"""

__version__ = "0.1.0"
