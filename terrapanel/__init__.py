"""Daily grid-cell risk panels on Spark.

Operators are plain ``DataFrame -> DataFrame`` functions; expressions are plain
``Column`` builders.  NULL is the only missing marker inside the engine: sources
turn NaN into NULL on the way in.
"""
