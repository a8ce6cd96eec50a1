"""Factloom: a Spark-native analytics engine for facts about compiled modules.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
imports the optional subpackage for training-data problems.
"""

__version__ = "0.1.0"
