"""Tabloom: table analysis and the tabular machine-learning lifecycle on Spark.

Every operator takes DataFrames and returns a tidy DataFrame (one row per
column, bin, group or point) that stays lazy until the caller runs an action.
"""

__version__ = "0.1.0"
