"""Frames streamed in any order against the batch operators."""
import numpy as np
from pyspark.sql import functions as F

from scangrid.operators import motion, spatial, tracks
from scangrid.schema import POSE_FIELDS
from scangrid.streaming import frames as SF, sequence as SQ


def turned(frame):
    a = .05 * frame * frame
    return [np.cos(a), -np.sin(a), 0, 1.5 * frame, np.sin(a), np.cos(a), 0, .1 * frame, 0, 0, 1, 0]


def tables(spark, sequences=2, frames=4, n=60):
    rng = np.random.default_rng(4)
    points = [(s, f, 1000 * f + i, *map(float, np.round(rng.uniform(-6, 6, 3), 3)))
              for s in range(sequences) for f in range(frames) for i in range(n if (s, f) != (1, 2) else 0)]
    boxes = [(s, f, int(i), 3, bool(i % 5 == 0), *map(float, rng.uniform(-6, 6, 3)))
             for s in range(sequences) for f in range(frames) for i in range(30)]
    poses = [(s, f, .1 * f, *map(float, turned(f))) for s in range(sequences) for f in range(frames)]
    return (spark.createDataFrame(points, "sequence long, frame_id long, point_id long, x double, y double, z double"),
            spark.createDataFrame(boxes, "sequence long, frame_id long, object_id long, class int, fallback boolean, "
                                         "center_x double, center_y double, center_z double"),
            spark.createDataFrame(poses, "sequence long, frame_id long, ts_s double, "
                                  + ", ".join(f"{f} double" for f in POSE_FIELDS)))


def streamed(spark, points, boxes, poses, tmp_path, files, per_trigger, late="1 hour"):
    parts = SQ.frame_parts(points, boxes, poses, F.timestamp_seconds(F.col("ts_s") + 1.7e9), part_points=40)
    end = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in parts.columns[3:]]
    last = spark.range(1).select(F.lit(-1).cast("long").alias("sequence"), F.lit(0).cast("long").alias("frame_id"),
                                 F.timestamp_seconds(F.lit(1.8e9)).alias("ts"), *end)
    path = str(tmp_path / f"parts-{files}")
    SQ.write_frames(parts, path, files)
    last.coalesce(1).write.mode("append").parquet(path)
    stream = SF.read_frames(spark, path, parts.schema, files_per_trigger=per_trigger)
    return SF.run_to_table(SQ.follow_frames(stream, late=late), "followed").where("sequence >= 0").collect()


def test_stream_equals_batch(spark, tmp_path):
    points, boxes, poses = tables(spark)
    ego = motion.ego_transforms(poses)
    want = {(r.sequence, r.frame_id): (r.speed, r.heading)
            for r in motion.frame_motion(poses, fixed_dt=None, speed_floor=None).collect()}
    residual = {(r.sequence, r.frame_id, r.point_id): r.residual
                for r in spatial.motion_residual(points, ego).where("residual is not null").collect()}
    track = {(r.sequence, r.frame_id, r.object_id): (r.previous_id, r.displacement_m, r.speed_mps)
             for r in tracks.attach_tracks(boxes, ego).where("previous_id is not null").collect()}
    assert len(track) > 10 and min(residual.values()) < 1
    rows = streamed(spark, points, boxes, poses, tmp_path, files=5, per_trigger=2)
    got = {(r.sequence, r.frame_id): (r.speed, r.heading) for r in rows if r.kind == "frame"}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    got = {(r.sequence, r.frame_id, r.id): r.distance for r in rows if r.kind == "point"}
    assert got.keys() == residual.keys()
    assert all(abs(got[k] - residual[k]) < 1e-9 for k in got)
    got = {(r.sequence, r.frame_id, r.id): (r.previous_id, r.distance, r.speed) for r in rows if r.kind == "box"}
    assert got.keys() == track.keys()
    assert all(np.allclose(got[k], track[k], atol=1e-9) for k in got)


def test_frames_without_pose_and_late_parts(spark, tmp_path):
    points, boxes, poses = tables(spark, sequences=1)
    poses = poses.withColumns({f: F.when(F.col("frame_id") != 1, F.col(f)) for f in POSE_FIELDS})
    parts = SQ.frame_parts(points, boxes, poses, F.timestamp_seconds(F.col("ts_s") + 1.7e9))
    path = str(tmp_path / "frames")
    parts.coalesce(1).write.parquet(path)
    end = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in parts.columns[3:]]
    spark.range(1).select(F.lit(-1).cast("long").alias("sequence"), F.lit(0).cast("long").alias("frame_id"),
                          F.timestamp_seconds(F.lit(1.8e9)).alias("ts"), *end).write.mode("append").parquet(path)
    stream = SF.read_frames(spark, path, parts.schema)
    rows = SF.run_to_table(SQ.follow_frames(stream), "unposed").where("sequence >= 0").collect()
    assert {r.frame_id for r in rows if r.kind == "frame"} == {0, 1, 2, 3}
    # Frame 1 has no pose: neither it nor the one after can be compared.
    assert {r.frame_id for r in rows if r.kind != "frame"} == {3}
