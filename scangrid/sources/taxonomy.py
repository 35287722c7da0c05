"""Label dimension tables (fixed, 34 rows) and their joins."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CLASS_NAMES, UNKNOWN_CLASS

# --- fixed values: raw id, name, learning id --------------------------------
RAW_LABELS = (
    (0, "unlabeled", 0), (1, "outlier", 0), (10, "car", 1), (11, "bicycle", 2), (13, "bus", 5),
    (15, "motorcycle", 3), (16, "on-rails", 5), (18, "truck", 4), (20, "other-vehicle", 5),
    (30, "person", 6), (31, "bicyclist", 7), (32, "motorcyclist", 8), (40, "road", 9),
    (44, "parking", 10), (48, "sidewalk", 11), (49, "other-ground", 12), (50, "building", 13),
    (51, "fence", 14), (52, "other-structure", 0), (60, "lane-marking", 9),
    (70, "vegetation", 15), (71, "trunk", 16), (72, "terrain", 17), (80, "pole", 18),
    (81, "traffic-sign", 19), (99, "other-object", 0), (252, "moving-car", 1),
    (253, "moving-bicyclist", 7), (254, "moving-person", 6), (255, "moving-motorcyclist", 8),
    (256, "moving-on-rails", 5), (257, "moving-bus", 5), (258, "moving-truck", 4),
    (259, "moving-other-vehicle", 5))
# learning ids of each macro class; id 0 is ignored
MACRO_MEMBERS = ((9, 10), (11, 12, 17), (13, 14, 15, 16, 18, 19), (1, 2, 3, 4, 5, 6, 7, 8))
SPLITS = {"train": (0, 1, 2, 3, 4, 5, 6, 7, 9, 10), "valid": (8,),
          "test": (11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21)}
# ---------------------------------------------------------------------------


def macro_of_learning(learning_id: int) -> int:
    if learning_id == 0:
        return UNKNOWN_CLASS
    for macro, members in enumerate(MACRO_MEMBERS):
        if learning_id in members:
            return macro
    raise ValueError(f"learning id {learning_id} has no macro class")


def class_mapping_table(spark: SparkSession) -> DataFrame:
    rows = []
    for raw, name, learning in RAW_LABELS:
        macro = macro_of_learning(learning)
        rows.append((raw, name, learning, macro,
                     "ignored" if macro == UNKNOWN_CLASS else CLASS_NAMES[macro]))
    return spark.createDataFrame(
        rows, "semantic long, label string, learning_id int, macro int, macro_name string")


def learning_table(spark: SparkSession) -> DataFrame:
    """Learning id -> representative raw id and macro class (20 rows)."""
    rep = {}
    for raw, _, learning in RAW_LABELS:
        rep.setdefault(learning, raw)
    return spark.createDataFrame([(k, rep[k], macro_of_learning(k)) for k in sorted(rep)],
                                 "learning_id int, semantic long, macro int")


def split_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, q) for s, qs in SPLITS.items() for q in qs],
                                 "split string, sequence_no long")


def decode_labels(df: DataFrame, raw="raw") -> DataFrame:
    """Semantic id, name and macro class of raw 32-bit labels.

    The taxonomy has 34 rows whatever the data size, so it is broadcast.
    """
    table = F.broadcast(class_mapping_table(df.sparkSession))
    out = df.withColumn("semantic", F.col(raw).bitwiseAND(0xFFFF)).join(table, "semantic", "left")
    return out.withColumn("macro", F.coalesce("macro", F.lit(UNKNOWN_CLASS)))


# name rule and least range of each challenge group
CHALLENGES = {
    "far pedestrian": ("label like '%person%' or label like '%bicyclist%'", 25.0),
    "thin pole / sign": ("label in ('pole', 'traffic-sign')", None),
    "curb / sidewalk boundary": ("label = 'sidewalk'", None),
}
