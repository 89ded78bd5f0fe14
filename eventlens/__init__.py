"""eventlens: intraday event studies and recording feature scores on Spark.

Every operator is a function from DataFrames (and parameters) to a DataFrame.
"""

__version__ = "0.1.0"
