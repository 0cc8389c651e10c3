"""tidemark: point-in-time analytics on Spark DataFrames.

Every fact carries the time it became known; every operator answers what could
have been computed at a given moment.  Operators take and return DataFrames (or
Columns) and never collect data to the driver.
"""
