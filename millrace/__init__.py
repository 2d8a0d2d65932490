"""millrace: a Spark-first analytics and data-processing engine.

Every operator is a function from DataFrames to a DataFrame; the physical plan is
left to Catalyst and adaptive execution.
"""
