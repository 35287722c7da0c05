"""Frame streams: ingest, previous-frame state, windows, sessions, duplicates, grids."""
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import grid
from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder beside the session's checkpoints, reachable by all executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def read_frames(spark: SparkSession, path: str, schema, glob="*.parquet",
                files_per_trigger=1000, fmt="parquet") -> DataFrame:
    """Files of frame rows as a stream, a bounded number of files per micro-batch."""
    return (spark.readStream.schema(schema).format(fmt)
            .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
            .load(path))


def append_to(stream: DataFrame, path: str, checkpoint: str, once=True, fmt="parquet"):
    writer = (stream.writeStream.format(fmt).outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Drain what is available into a table and return it."""
    spark = stream.sparkSession
    path, checkpoint = shared_folder(spark, label), shared_folder(spark, label + "-progress")
    append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def once_per_frame(stream: DataFrame, keys=("sequence", "frame_id"), ts="ts", late="1 day"):
    """Drop re-sent frames; the watermark bounds how long ids are remembered."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling_stats(stream: DataFrame, by=("policy",), length="1 hour", late="1 hour", ts="ts",
                   value="latency_ms") -> DataFrame:
    return _window_stats(stream.withWatermark(ts, late), by, F.window(ts, length), value)


def sliding_stats(stream: DataFrame, by=("policy",), length="1 hour", slide="30 minutes",
                  late="1 hour", ts="ts", value="latency_ms") -> DataFrame:
    return _window_stats(stream.withWatermark(ts, late), by, F.window(ts, length, slide), value)


def clip_sessions(stream: DataFrame, by=("sequence",), gap="30 minutes", late="1 hour", ts="ts",
                  value="latency_ms") -> DataFrame:
    """Clips of frames with no gap longer than ``gap``."""
    return _window_stats(stream.withWatermark(ts, late), by, F.session_window(ts, gap), value)


def _window_stats(df, by, window, value):
    out = df.groupBy(*by, window.alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(value).alias("mean_ms"),
        F.max(value).alias("max_ms"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                      "frames", "mean_ms", "max_ms")


def progress(stream: DataFrame, by=("sequence",), ts="ts") -> DataFrame:
    """Completed frames, elapsed seconds and rate so far (an updating aggregate)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = (F.max(at) - F.min(at)) / 1e6
    n = F.count(F.lit(1))
    return stream.groupBy(*by).agg(n.alias("completed"), span.alias("elapsed_s"),
                                   F.when(span > 0, n / span).alias("fps"))


def latest_snapshot(aggregate: DataFrame, label: str) -> DataFrame:
    """Run an updating aggregate over what is available and return its final state."""
    spark = aggregate.sparkSession
    path = shared_folder(spark, label)

    def publish(batch, _):
        batch.write.mode("overwrite").parquet(path)
    (aggregate.writeStream.outputMode("complete").foreachBatch(publish)
     .option("checkpointLocation", shared_folder(spark, label + "-progress"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(aggregate.schema).parquet(path)


#: Rows of one table that a stateful step gives back; numbers that stand for no time and no frame.
ROWS_OUT, NO_TIME, NO_FRAME = 10_000, np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _motion(prior, at, px, py):
    """``dt, speed, heading`` of frames in order after ``prior`` (time and position, or None), and the next prior."""
    if prior is None and at[0] == NO_TIME:  # such frames come last, so there are no others
        return pd.DataFrame({"dt": np.full(len(at), np.nan), "speed": 0.0, "heading": 0.0}), None
    last = np.append(at[0] if prior is None else prior[0], at[:-1])
    # Only frames later than all before them move the state on.
    moves = at > np.maximum.accumulate(last)
    if prior is None:
        moves[0] = True
    begin = (at[0], px[0], py[0]) if prior is None else prior
    stops = [np.append(b, v[moves]) for b, v in zip(begin, (at, px, py))]
    base = np.cumsum(moves) - moves
    t, x, y = (s[base] for s in stops)
    dt, dx, dy = np.where(at == NO_TIME, np.nan, (at - t) / 1e6), px - x, py - y
    ahead = dt > 0
    speed = np.divide(np.hypot(dx, dy), dt, out=np.zeros(len(at)), where=ahead)
    out = pd.DataFrame({"dt": dt, "speed": speed, "heading": np.where(ahead, np.arctan2(dy, dx), 0.0)})
    if prior is None:
        out.loc[0, "dt"] = None
    # A frame without a position has no motion, nor has the one after it.
    out[["speed", "heading"]] = out[["speed", "heading"]].fillna(0.0)
    return out, (int(stops[0][-1]), float(stops[1][-1]), float(stops[2][-1]))


def follow_motion(key, chunks, state):
    """Motion of one sequence's frames of a micro-batch, in tables of ``ROWS_OUT`` rows."""
    prior = state.get if state.exists else None
    waiting = [bytearray() for _ in range(4)]  # they grow in place; lists of arrays take twice as much
    for chunk in chunks:
        columns = (chunk["ts"].to_numpy("datetime64[us]").astype(np.int64),
                   chunk["frame_id"].astype("Int64").fillna(NO_FRAME).to_numpy(np.int64),
                   chunk["px"].to_numpy(np.float64), chunk["py"].to_numpy(np.float64))
        for held, values in zip(waiting, columns):
            held += values.tobytes()
    at, frame_id, px, py = map(np.frombuffer, waiting, (np.int64, np.int64, np.float64, np.float64))
    order = np.lexsort((frame_id, at, at == NO_TIME))
    for k in range(0, len(order), ROWS_OUT):
        part = order[k:k + ROWS_OUT]
        out, prior = _motion(prior, at[part], px[part], py[part])
        ids = pd.Series(frame_id[part], dtype="Int64")
        out.insert(0, "frame_id", ids.mask(ids == NO_FRAME))
        out.insert(0, "sequence", key[0])
        yield out
    if prior is not None:
        state.update(prior)


MOTION_FIELDS = "sequence long, frame_id long, dt double, speed double, heading double"


def previous_frame_motion(stream: DataFrame, late="1 day") -> DataFrame:
    """Speed and heading against the previous frame, kept in state per sequence.

    ``stream`` has sequence, frame_id, ts, px, py (a position per frame). State is one
    position; a frame whose time does not advance gets no motion and leaves it alone.
    A sequence's frames of a micro-batch wait as four numbers each until they are sorted.
    """
    return (stream.withWatermark("ts", late).groupBy("sequence").applyInPandasWithState(
        follow_motion, MOTION_FIELDS, "at long, px double, py double", "append",
        GroupStateTimeout.NoTimeout))


def stream_grids(points: DataFrame, label: str, policies=("adaptive",), motion=None) -> DataFrame:
    """Leaves of every arriving frame. Frames must be whole within a micro-batch (a file each)."""
    spark = points.sparkSession
    path = shared_folder(spark, label)
    schema = grid.build_grid(points.sparkSession.createDataFrame([], points.schema),
                             policies, motion).schema

    def build(batch, batch_id):
        # One folder per batch, overwritten on a retry, so a replay adds nothing twice.
        grid.build_grid(batch, policies, motion).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")
    (points.writeStream.foreachBatch(build)
     .option("checkpointLocation", shared_folder(spark, label + "-progress"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(path)
