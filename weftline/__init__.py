"""weftline: a Spark-first analytics and data-processing library.

Everything is expressed with DataFrames, Spark SQL and Structured Streaming;
planning, shuffles and execution belong to Spark.
"""
