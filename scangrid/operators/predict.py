"""User predictors applied to point tables in Arrow batches."""
import hashlib
import json

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T


def model_signature(name: str, runtime: dict) -> str:
    """First 16 hex digits over a model name and its settings."""
    text = name + json.dumps(runtime, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def height_rules(batch):
    """Default predictor: low is road, slightly raised is terrain, higher is an obstacle."""
    import numpy as np
    z = batch["z"].to_numpy()
    pred = np.select([z < -1.66, z < -1.4, z < -0.6], [0, 1, 3], 2)
    return pred, np.where(np.abs(z + 1.4) < 0.05, 0.5, 0.9)


def apply_predictor(points: DataFrame, predictor=height_rules, signature="height-rules"):
    """Add ``pred``, ``conf`` and ``model_sig``; one predictor serves the whole run.

    ``predictor`` maps a pandas batch to (classes, confidences). A confidence of 0
    means unknown (255).
    """
    base = points.drop("pred", "conf")
    schema = T.StructType(base.schema.fields + [
        T.StructField("pred", T.IntegerType()), T.StructField("conf", T.DoubleType())])

    def run(batches):
        for batch in batches:
            pred, conf = predictor(batch)
            batch["pred"], batch["conf"] = pred, conf
            batch.loc[batch["conf"] == 0, "pred"] = 255
            batch["pred"] = batch["pred"].astype("int32")
            yield batch[[f.name for f in schema.fields]]
    return base.mapInPandas(run, schema).withColumn("model_sig", F.lit(signature))
