"""Training-data operators: ten corpus-scale components built on Spark.

Nothing outside this subpackage imports it.  Operators take DataFrames and
return DataFrames; ``queries`` holds the thin contract queries over them.
"""
