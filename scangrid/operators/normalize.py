"""Unit-ball normalisation and farthest-point sampling."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.groups import group_starts, whole_groups
from .spatial import XYZ


def normalize_cloud(points: DataFrame, keys, dims=XYZ) -> DataFrame:
    """Subtract the centroid and divide by the largest norm, per key."""
    keys = list(keys)
    mean = points.groupBy(*keys).agg(*[F.avg(d).alias(f"_m{d}") for d in dims])
    centred = points.join(mean, keys)
    for d in dims:
        centred = centred.withColumn(d, F.col(d) - F.col(f"_m{d}"))
    centred = centred.drop(*[f"_m{d}" for d in dims])
    norm = F.sqrt(sum((F.col(d) * F.col(d) for d in dims[1:]), F.col(dims[0]) * F.col(dims[0])))
    top = centred.groupBy(*keys).agg(F.max(norm).alias("_norm"))
    out = centred.join(top, keys)
    for d in dims:
        out = out.withColumn(d, F.when(F.col("_norm") > 0, F.col(d) / F.col("_norm")).otherwise(0.0))
    return out.drop("_norm")


def farthest_points(samples: DataFrame, keys, n, limit=4096, id_column="point_id") -> DataFrame:
    """Farthest-point order of ``n`` points per block, starting at the lowest id.

    Each choice depends on all earlier ones, so a block is handled whole, together with
    other blocks of its partition. Blocks come from the resampler and hold at most
    ``limit`` points; a larger group is an error.
    """
    keys = list(keys)

    def run(batches):
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            counts = np.diff(np.append(starts, table.num_rows))
            if counts.max() > limit:
                raise ValueError(f"block of {counts.max()} points exceeds {limit}; resample it first")
            block = np.repeat(np.arange(len(starts)), counts)
            xyz = np.stack([table.column(d).to_numpy().astype(float) for d in XYZ], 1)
            gap, at = np.full(len(xyz), np.inf), starts
            rows, picks = [], []
            for pick in range(min(n, counts.max())):
                rows.append(at[counts > pick])
                picks.append(np.full(len(rows[-1]), pick, np.int64))
                gap = np.minimum(gap, ((xyz - xyz[at][block]) ** 2).sum(1))
                far = np.maximum.reduceat(gap, starts)[block]
                hit = np.flatnonzero((gap == far) | np.isnan(gap))
                owner = block[hit]
                at = hit[np.append(True, owner[1:] != owner[:-1])]
            out = table.select([*keys, id_column]).take(pa.array(np.concatenate(rows)))
            yield from out.append_column("pick", pa.array(np.concatenate(picks))).combine_chunks().to_batches()
    fields = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, id_column]) + ", pick long"
    return (samples.select(*keys, id_column, *XYZ).repartition(*keys).sortWithinPartitions(*keys, id_column)
            .mapInArrow(run, schema))
