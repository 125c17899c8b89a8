"""vintage — point-in-time panels, document features and portfolio analytics on Spark.

Every operator is a DataFrame -> DataFrame function; entity, date and value
column names are parameters.
"""
__version__ = "0.1.0"
