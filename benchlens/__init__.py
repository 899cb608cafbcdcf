"""benchlens: Spark-native analytics for benchmark results and measurement logs.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from Spark's
built-in DataFrame/SQL expressions so Catalyst plans it and Tungsten runs it.
"""

__version__ = "0.1.0"
