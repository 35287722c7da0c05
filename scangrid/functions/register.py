"""Policy functions for SQL users, as temporary SQL scalar functions."""
from pyspark.sql import SparkSession

from . import text


def register_sql_functions(spark: SparkSession) -> None:
    """Create ``fovea_distance`` and ``semantic_split`` in the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fovea_distance("
              "x DOUBLE, y DOUBLE, v DOUBLE, h DOUBLE) RETURNS DOUBLE RETURN "
              + text.fovea_distance("x", "y", "v", "h"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION semantic_split("
              "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS BOOLEAN RETURN "
              + text.semantic_split("a", "b", "c", "d"))
