"""Frames written as point files and read back through the data source."""
from pyspark.sql import functions as F

from scangrid.sources import sweeps
from scangrid.streaming.frames import shared_folder

from . import views as V
from .maps import K
from .registry import register

#: Form of a frame's file by its number; those of ``BROKEN`` lose their last bytes.
FORMS = ("zip", "bin", "ply", "lzf.pcd", "text.pcd", "pcd", "big.ply")
BROKEN = (2, 3)


@register("sweep_files_round_trip", V.with_sql(V.POINTS_SQL, body=f"""
 select sequence, frame_id, case when frame_id % 7 in {BROKEN} then 0 else count(*) end as points,
  case when frame_id % 7 in {BROKEN} then null else cast(sum(x_mm + 3 * y_mm + 5 * z_mm) as bigint) end as checksum_mm,
  case when frame_id % 7 in {BROKEN} then 1 else 0 end as findings
 from points group by 1, 2"""))
def sweep_files_round_trip(spark, sf):
    """Every form of point file, some broken: counts and checksums of what is read back."""
    form = F.array(*map(F.lit, FORMS))[(F.col("frame_id") % len(FORMS)).cast("int")]
    form = F.when((F.col("frame_id") % len(FORMS)).isin(*BROKEN), F.concat(F.lit("broken "), form)).otherwise(form)
    points = V.points(spark, sf).select(*K, "point_id", "x", "y", "z",
                                        (F.col("intensity_u8") / 255).alias("intensity"), form.alias("form"))
    path = shared_folder(spark, "sweeps")
    sweeps.write_sweeps(points, path).write.format("noop").mode("overwrite").save()
    back = sweeps.read_sweeps(spark, path)
    mm = [F.floor(F.col(d) * 1000 + 0.5) * k for d, k in (("x", 1), ("y", 3), ("z", 5))]
    where = r"sequences/(\d+)/(\d+)\.\w+$"
    return back.groupBy(F.regexp_extract("path", where, 1).cast("long").alias("sequence"),
                        F.regexp_extract("path", where, 2).cast("long").alias("frame_id")).agg(
        F.count("x").alias("points"), F.sum(mm[0] + mm[1] + mm[2]).alias("checksum_mm"),
        F.count("finding").cast("int").alias("findings"))
