"""tidemark: Spark-native operators for longitudinal event timelines.

Every operator is a plain function ``DataFrame -> DataFrame`` (or returns a
``Column``) built from Spark SQL expressions, windows and joins; nothing is
collected to the driver.
"""

__version__ = "0.1.0"
