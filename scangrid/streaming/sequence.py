"""Frames of a sequence in order, against the state of the frame before.

Frames arrive in any order, whole or in parts. They wait in state until the watermark has
passed their time, then event-time timers release them in order; each is compared with the
previous frame's pose, boxes and points, which are state of the sequence.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.nearest import nearest_within

PARTS = ("sequence long, frame_id long, ts timestamp, pose array<double>, point_ids array<long>, "
         "points array<double>, box_ids array<long>, boxes array<double>")
RESULT = ("sequence long, frame_id long, kind string, id long, dt double, speed double, heading double, "
          "previous_id long, distance double")
WAITING = "frame_id long, pose binary, point_ids binary, points binary, box_ids binary, boxes binary"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Points of one piece of state; a frame has as many pieces as it needs.
PIECE = 200_000


def frame_parts(points: DataFrame, boxes: DataFrame, poses: DataFrame, ts, keys=("sequence", "frame_id"),
                part_points=100_000) -> DataFrame:
    """Rows of ``PARTS`` from tables of points, boxes and poses; a part holds so many points at most.

    Points are dealt to parts by id, so no list grows with the frame.
    """
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (part_points / 2)).alias("_parts"))
    dealt = points.join(size, keys).withColumn("_part", F.pmod(F.xxhash64("point_id"), "_parts"))
    rows = dealt.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(
        F.struct("point_id", "x", "y", "z"))).alias("_p"))
    tracked = boxes.where("class = 3 and not fallback").groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("object_id", "center_x", "center_y", "center_z"))).alias("_b"))
    pose = [F.col(f"t{r}{c}") for r in range(3) for c in range(4)]
    pose = F.when(F.concat(*[p.cast("string") for p in pose]).isNotNull(), F.array(*pose))
    first = poses.select(*keys, pose.alias("pose"), ts.alias("ts")).join(tracked, keys, "left")

    def flat(column, names):
        return F.flatten(F.transform(column, lambda p: F.array(*[p[n] for n in names])))
    out = first.join(rows, keys, "left").withColumn("_b", F.when(F.coalesce("_part", F.lit(0)) == 0, F.col("_b")))
    none = F.array().cast("array<double>")
    return out.select(
        *keys, "ts", "pose", F.coalesce(F.col("_p.point_id"), none.cast("array<long>")).alias("point_ids"),
        F.coalesce(flat("_p", "xyz"), none).alias("points"),
        F.coalesce(F.col("_b.object_id"), none.cast("array<long>")).alias("box_ids"),
        F.coalesce(flat("_b", ("center_x", "center_y", "center_z")), none).alias("boxes"))


def relative(reference: np.ndarray, other: np.ndarray):
    """Rotation and offset taking ``other``'s coordinates (3 x 4 pose) into ``reference``'s."""
    turn = reference[:, :3].T
    return turn @ other[:, :3], turn @ (other[:, 3] - reference[:, 3])


def moved_by(points, turn, offset):
    x, y, z = points.T
    return np.stack([turn[r, 0] * x + turn[r, 1] * y + turn[r, 2] * z + offset[r] for r in range(3)], 1)


def snapped(points):
    """To 0.1 mm, so that equal positions stay equal after a transform."""
    return np.floor(points * 10000 + 0.5) / 10000


def choose_tracks(ids, boxes, old_ids, old_boxes, reach):
    """Boxes in id order take the nearest old box that is still free: (index, old index, distance)."""
    free = np.ones(len(old_ids), bool)
    for i in np.argsort(ids, kind="stable"):
        gap = old_boxes - boxes[i]
        d2 = (gap * gap).sum(1)
        distance = np.sqrt(d2)
        at = np.flatnonzero(free & (d2 < reach * reach))
        if len(at):
            best = at[np.lexsort((old_ids[at], distance[at]))[0]]
            free[best] = False
            yield i, best, distance[best]


def _numbers(raw, kind=np.float64, width=None):
    out = np.frombuffer(bytes(raw), kind) if raw is not None else np.zeros(0, kind)
    return out.reshape(-1, width) if width else out


def _bytes(values, kind=np.float64):
    return b"" if values is None else np.ascontiguousarray(values, kind).tobytes()


class SequenceFrames(StatefulProcessor):
    """Motion, residuals and tracks of every frame against the one before.

    State: ``waiting`` (parts of frames by time and number), ``last`` (time and pose of the
    frame released last), ``points`` (its points, in pieces) and ``boxes`` (its boxes).
    """

    def __init__(self, cap=3.0, reach=2.0):
        self.cap, self.reach = cap, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, part long", WAITING)
        self.last = handle.getValueState("last", "at long, frame_id long, pose binary")
        self.points = handle.getListState("points", "points binary")
        self.boxes = handle.getListState("boxes", "id long, x double, y double, z double")

    def handleInputRows(self, key, rows, timerValues):
        number = 0
        taken = None
        for chunk in rows:
            for row in chunk.itertuples(index=False):
                at = row.ts.value // 1000
                if taken is None:  # parts that came before keep their numbers
                    taken = {k for k in self.waiting.keys()}
                while (at, number) in taken:
                    number += 1
                taken.add((at, number))
                self.waiting.updateValue((at, number), (
                    int(row.frame_id), None if row.pose is None else _bytes(row.pose),
                    _bytes(row.point_ids, np.int64), _bytes(row.points),
                    _bytes(row.box_ids, np.int64), _bytes(row.boxes)))
                self.handle.registerTimer(at // 1000 + 1)  # whole milliseconds, past the frame's time
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(k for k in self.waiting.keys() if k[0] < until)
        at = 0
        while at < len(due):
            end = at
            while end < len(due) and due[end][0] == due[at][0]:
                end += 1
            yield from self._release(key[0], due[at][0], due[at:end])
            at = end

    def _release(self, sequence, at, parts):
        values = [self.waiting.getValue(k) for k in parts]
        for k in parts:
            self.waiting.removeKey(k)
        for frame_id in sorted({v[0] for v in values}):
            own = [v for v in values if v[0] == frame_id]
            pose = next((_numbers(v[1]).reshape(3, 4) for v in own if v[1] is not None), None)
            yield self._frame(sequence, at, frame_id, pose,
                              np.concatenate([_numbers(v[2], np.int64) for v in own]),
                              np.concatenate([_numbers(v[3], width=3) for v in own]),
                              np.concatenate([_numbers(v[4], np.int64) for v in own]),
                              np.concatenate([_numbers(v[5], width=3) for v in own]))

    def _frame(self, sequence, at, frame_id, pose, point_ids, points, box_ids, boxes):
        before = self.last.get() if self.last.exists() else None
        cols = {c: [None] for c in ("id", "dt", "previous_id", "distance")}
        cols.update(kind=["frame"], speed=[0.0], heading=[0.0])
        out = [pd.DataFrame(cols)]
        dt = None if before is None else (at - before[0]) / 1e6
        old = None if before is None or before[2] is None else _numbers(before[2]).reshape(3, 4)
        if old is not None and pose is not None and dt > 0:
            _, moved = relative(old, pose)
            out[0]["dt"] = dt
            out[0]["speed"] = float(np.hypot(moved[0], moved[1])) / dt
            out[0]["heading"] = float(np.arctan2(moved[1], moved[0]))
        # Points and boxes are followed from one frame number to the next only.
        if old is not None and pose is not None and before[1] == frame_id - 1:
            turn, offset = relative(pose, old)
            source = [_numbers(p[0], width=3) for p in self.points.get()]
            source = np.concatenate(source) if source else np.zeros((0, 3))
            source = snapped(moved_by(source, turn, offset))
            d2, _ = nearest_within(points, source, np.arange(len(source)), self.cap)
            out.append(pd.DataFrame({"kind": "point", "id": point_ids,
                                     "distance": np.minimum(np.sqrt(d2), self.cap)}))
            rows = [*self.boxes.get()]
            if rows and len(box_ids):
                old_ids = np.array([r[0] for r in rows], np.int64)
                old_at = moved_by(np.array([r[1:] for r in rows], float), turn, offset)
                found = [*choose_tracks(box_ids, boxes, old_ids, old_at, self.reach)]
                out.append(pd.DataFrame({
                    "kind": "box", "id": [box_ids[i] for i, _, _ in found], "dt": dt,
                    "speed": [d / dt if dt > 0 else None for _, _, d in found],
                    "previous_id": [old_ids[j] for _, j, _ in found], "distance": [d for _, _, d in found]}))
        if before is None or at > before[0]:
            self.last.update((at, frame_id, None if pose is None else _bytes(pose)))
            self.points.clear()
            for k in range(0, len(points), PIECE):
                self.points.appendValue((_bytes(points[k:k + PIECE]),))
            self.boxes.clear()
            for i, b in zip(box_ids, boxes):
                self.boxes.appendValue((int(i), *map(float, b)))
        out = pd.concat([o for o in out if len(o)])
        out["sequence"], out["frame_id"] = sequence, frame_id
        for c in ("id", "previous_id"):
            out[c] = out[c].astype("Int64")
        for c in ("dt", "speed", "heading", "distance"):
            out[c] = out[c].astype("float64")
        return out[[f.split()[0] for f in RESULT.split(", ")]]

    def close(self) -> None:
        pass


def follow_frames(parts: DataFrame, late="10 seconds", cap=3.0, reach=2.0) -> DataFrame:
    """``RESULT`` rows of a stream of ``PARTS``: one of kind frame per frame, and those of its
    points (distance to the previous frame's points, at most ``cap``) and tracked boxes.

    A frame is released once ``late`` has passed in event time; later parts are left out.
    """
    spark = parts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return (parts.withWatermark("ts", late).groupBy("sequence").transformWithStateInPandas(
        SequenceFrames(cap, reach), RESULT, "append", "EventTime"))


def write_frames(parts: DataFrame, path: str, files: int) -> None:
    """Frame parts as files, a frame's parts in any of them."""
    parts.repartition(files, F.xxhash64("sequence", "frame_id")).write.parquet(path)
