"""panelkit: entity x period panel analytics on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, window functions and MLlib."""

__version__ = "0.1.0"
