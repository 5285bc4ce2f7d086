"""atoflow — Spark-native analytics over official-gazette appointment and dismissal acts.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and performs no action
unless its docstring says so; Catalyst plans, prunes and pushes filters down.
"""

__version__ = "0.1.0"
