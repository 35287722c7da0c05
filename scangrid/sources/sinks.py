"""Table sinks and evidence readers."""
from pyspark.sql import DataFrame, SparkSession, functions as F

CURVE_SCHEMA = ("epoch int, train_loss double, val_miou double, elapsed_seconds double, "
                "steps long, complete_epoch boolean")


def write_frames(docs: DataFrame, path: str, fmt="json") -> None:
    """Frame documents, one folder per job; a rerun of a job replaces its documents."""
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("job_id").format(fmt).save(path))


def write_predictions(preds: DataFrame, path: str) -> None:
    """Predictions by model and sequence; writing a sequence again replaces it."""
    (preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model_sig", "sequence").parquet(path))


def read_predictions(spark: SparkSession, path: str, signature: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model_sig") == signature)


def write_blocks(tensors: DataFrame, path: str) -> None:
    """Training blocks by split; refuses to touch an existing cache."""
    tensors.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_blocks(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def block_inventory(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("split").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("sequence").alias("sequences"),
        F.count_distinct("sequence", "frame_id").alias("scans"))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CURVE_SCHEMA)


def read_evidence(spark: SparkSession, path: str, schema: str, default: str = None) -> DataFrame:
    """A JSON report without its ``per_frame`` part; ``default`` JSON when it is absent."""
    try:
        doc = spark.read.schema(schema).json(path, multiLine=True)
    except Exception as exc:
        if default is None or "PATH_NOT_FOUND" not in str(exc):
            raise
        doc = spark.createDataFrame([(default,)], "v string").select(
            F.from_json("v", schema).alias("d")).select("d.*")
    return doc.drop("per_frame")
