"""Schemas and fixed domain constants shared by all operators."""
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
CLASS_NAMES = ("drivable", "non-drivable-terrain", "static-obstacle", "dynamic-object")
UNKNOWN_CLASS = 255
POLICIES = ("uniform", "distance", "ground", "semantic", "adaptive")
BANDS_M = ((0, 10), (10, 25), (25, 60), (60, 100))
MAX_RANGE_M = 100.0
SAFETY_RADIUS_M = 3.0
BLEND_WIDTH_M = 2.0
HEIGHT_VARIANCE_LIMIT = 0.025 ** 2
LEAF_BYTES = 42
# chi-square quantile at 0.99 with 3 degrees of freedom
CHI2_99_DF3 = 11.344866730144373
FRAME_MIN_POINTS, FRAME_MAX_POINTS = 1, 2_000_000
INTERVAL_FRAMES = 4071
# ---------------------------------------------------------------------------

FRAME_KEYS = ("sequence", "frame_id")

# Edge length of every map tier, counted in 5 cm units. Every tier is a multiple
# of the finest one, so coarse cells are unions of 5 cm cells.
TIER_UNITS = (1, 2, 5, 10)
UNIT_M = 0.05

POINT_SCHEMA = T.StructType([
    T.StructField("sequence", T.StringType(), False),
    T.StructField("frame_id", T.LongType(), False),
    T.StructField("point_id", T.LongType(), False),
    T.StructField("x", T.DoubleType(), False),
    T.StructField("y", T.DoubleType(), False),
    T.StructField("z", T.DoubleType(), False),
    T.StructField("intensity", T.FloatType(), False),
])

LABEL_SCHEMA = T.StructType([
    T.StructField("sequence", T.StringType(), False),
    T.StructField("frame_id", T.LongType(), False),
    T.StructField("point_id", T.LongType(), False),
    T.StructField("raw", T.LongType(), False),
])

POSE_FIELDS = tuple(f"t{r}{c}" for r in range(3) for c in range(4))
