"""Frame streams, drained from the given tables, and frame documents."""
from pyspark.sql import functions as F

from scangrid.operators import cluster, grid, metrics
from scangrid.plans.frames import frame_documents
from scangrid.streaming import frames as SF, sequence as SQ

from . import sqltext as S, views as V
from .maps import K, cells, frame_speed, r
from .neighbours import NEAR27, PROPOSAL_CTES, hash_sql, track_ctes
from .registry import register


def event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    raw = SF.read_frames(spark, sf, schema, glob="events.parquet")
    return V.frame_stats_of(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _window_out(df, by):
    return df.select(*by, _stamp("start"), _stamp("end"), "frames", r("mean_ms", 6), r("max_ms", 6))


CLOSED = "select max(ts) - interval 1 hour as closed from frame_stats"
STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


@register("stream_tumbling_stats", V.with_sql(V.STATS_SQL, body=f"""
 select policy, {STAMP.format(c='s')} as start, {STAMP.format(c="s + interval 1 hour")} as "end", frames, round(mean_ms, 6) as mean_ms, round(max_ms, 6) as max_ms from (
  select policy, date_trunc('hour', ts) as s, count(*) as frames, avg(latency_ms) as mean_ms, max(latency_ms) as max_ms from frame_stats group by 1, 2) q
 where s + interval 1 hour <= ({CLOSED})"""))
def stream_tumbling_stats(spark, sf):
    """Closed hours only: open windows wait for the watermark."""
    return _window_out(SF.run_to_table(SF.tumbling_stats(event_stream(spark, sf)), "tumbling"), ["policy"])


@register("stream_sliding_stats", V.with_sql(V.STATS_SQL, body=f"""
 select policy, {STAMP.format(c='s')} as start, {STAMP.format(c="s + interval 1 hour")} as "end", frames, round(mean_ms, 6) as mean_ms, round(max_ms, 6) as max_ms from (
  select policy, s, count(*) as frames, avg(latency_ms) as mean_ms, max(latency_ms) as max_ms from (
   select policy, latency_ms, unnest([h, h - interval 30 minutes]) as s from (select *, time_bucket(interval 30 minutes, ts) as h from frame_stats) e) w group by 1, 2) q
 where s + interval 1 hour <= ({CLOSED})"""))
def stream_sliding_stats(spark, sf):
    return _window_out(SF.run_to_table(SF.sliding_stats(event_stream(spark, sf)), "sliding"), ["policy"])


@register("stream_clip_sessions", V.with_sql(V.STATS_SQL, """
 gap as (select *, case when ts - lag(ts) over (partition by sequence order by ts) < interval 30 minutes then 0 else 1 end as starts from frame_stats),
 ses as (select *, sum(starts) over (partition by sequence order by ts rows unbounded preceding) as sid from gap)""", body=f"""
 select sequence, {STAMP.format(c='min(ts)')} as start, {STAMP.format(c="max(ts) + interval 30 minutes")} as "end", count(*) as frames,
  round(avg(latency_ms), 6) as mean_ms, round(max(latency_ms), 6) as max_ms from ses group by sequence, sid
 having max(ts) + interval 30 minutes <= ({CLOSED})"""))
def stream_clip_sessions(spark, sf):
    return _window_out(SF.run_to_table(SF.clip_sessions(event_stream(spark, sf)), "sessions"), ["sequence"])


@register("stream_progress", V.with_sql(V.STATS_SQL, body="""
 select sequence, count(*) as completed, round((epoch_us(max(ts))-epoch_us(min(ts)))/1e6, 6) as elapsed_s,
  round(count(*)/((epoch_us(max(ts))-epoch_us(min(ts)))/1e6), 9) as fps from frame_stats group by 1"""))
def stream_progress(spark, sf):
    return SF.latest_snapshot(SF.progress(event_stream(spark, sf)), "progress").select(
        "sequence", "completed", r("elapsed_s", 6), r("fps"))


@register("stream_once_per_frame", V.with_sql(V.STATS_SQL, body="""
 select distinct sequence, cast(floor(frame_id/2.0) as bigint) as frame_id from frame_stats"""))
def stream_once_per_frame(spark, sf):
    """Pairs of events stand for one frame sent twice."""
    s = event_stream(spark, sf).withColumn("frame_id", F.floor(F.col("frame_id") / 2))
    out = SF.once_per_frame(s.select("sequence", "frame_id", "ts"), late="60 days")
    return SF.run_to_table(out, "once").select("sequence", "frame_id")


@register("stream_previous_frame_motion", V.with_sql(V.STATS_SQL, """
 m as (select sequence, frame_id, (epoch_us(ts)-epoch_us(lag(ts) over w))/1e6 as dt, latency_ms - lag(latency_ms) over w as dx, stage - lag(stage) over w as dy
  from frame_stats window w as (partition by sequence order by ts, frame_id))""", body="""
 select sequence, frame_id, round(dt, 6) as dt, round(coalesce(sqrt(dx*dx+dy*dy)/dt, 0), 9) as speed, round(coalesce(atan2(dy, dx), 0), 9) as heading from m"""))
def stream_previous_frame_motion(spark, sf):
    s = event_stream(spark, sf).select("sequence", "frame_id", "ts", F.col("latency_ms").alias("px"),
                                       F.col("stage").cast("double").alias("py"))
    return SF.run_to_table(SF.previous_frame_motion(s), "motion").select(
        "sequence", "frame_id", r("dt", 6), r("speed"), r("heading"))


@register("stream_uniform_grid", V.with_sql(V.POINTS_SQL, V.POSES_SQL, S.MOTION_SQL,
                                            *S.grid_ctes(policies=["uniform"]), body="""
 select sequence, frame_id, lx, ly, n as point_count, zmin as min_z, zmax as max_z from agg1"""))
def stream_uniform_grid(spark, sf):
    raw = SF.read_frames(spark, sf, V.table(spark, sf, "lineitem").schema, glob="lineitem.parquet")
    return SF.stream_grids(V.points_of(raw), "grids", ("uniform",)).select(
        *K, "lx", "ly", "point_count", "min_z", "max_z")


@register("stream_sequence_frames", V.with_sql(
    *PROPOSAL_CTES, V.POSES_SQL, V.TURNED_SQL, *track_ctes("turned_ego", "e.r00*o.center_x+e.r01*o.center_y+e.ex",
                                                           "e.r10*o.center_x+e.r11*o.center_y+e.ey"), f"""
 warped as (select e.sequence, e.frame_id, floor((r00*p.x+r01*p.y+ex)*10000+0.5)/10000 as x, floor((r10*p.x+r11*p.y+ey)*10000+0.5)/10000 as y,
   floor(p.z*10000+0.5)/10000 as z from points p join turned_ego e on p.sequence=e.sequence and p.frame_id=e.previous_frame),
 w2 as materialized (select distinct *, {hash_sql('warped', 3)} from warped),
 q as materialized (select *, cx+ox as hx, cy+oy as hy, cz+oz as hz from (select *, {hash_sql('points', 3)} from points) p, {NEAR27}),
 best as materialized (select q.sequence, q.frame_id, q.point_id, min(sqrt((q.x-w.x)*(q.x-w.x)+(q.y-w.y)*(q.y-w.y)+(q.z-w.z)*(q.z-w.z))) as d
  from q join w2 w on q.sequence=w.sequence and q.frame_id=w.frame_id and q.hx=w.cx and q.hy=w.cy and q.hz=w.cz group by 1, 2, 3)""", body="""
 select sequence, frame_id, 'frame' as kind, null::bigint as id, null::bigint as previous_id, null::double as distance,
  round(coalesce(sqrt(mx*mx+my*my)/dt, 0), 6) as speed, round(coalesce(atan2(my, mx), 0), 6) as heading from turned_ego
 union all select sequence, frame_id, 'box', object_id, previous_id, round(distance, 6), round(distance/dt, 6), null from chosen
 union all select p.sequence, p.frame_id, 'point', p.point_id, null, round(least(coalesce(d, 3), 3), 6), null, null
  from points p join turned_ego e on p.sequence=e.sequence and p.frame_id=e.frame_id and e.previous_frame is not null
  left join best b on b.sequence=p.sequence and b.frame_id=p.frame_id and b.point_id=p.point_id""", recursive=True))
def stream_sequence_frames(spark, sf):
    """Frames in parts, shuffled over files and micro-batches; poses turn. Speeds, tracks and residuals."""
    p = V.points(spark, sf)
    boxes = cluster.object_proposals(p, rules=cluster.PROPOSAL_RULES[1:])
    start = F.lit(1_700_000_000.0)
    parts = SQ.frame_parts(p, boxes, V.turned_poses(spark, sf), F.timestamp_seconds(start + F.col("ts_s")),
                           part_points=4000)
    # A last empty frame of its own sequence moves the watermark past all others.
    last = parts.limit(0).unionByName(spark.range(1).select(
        F.lit(-1).cast("long").alias("sequence"), F.lit(0).cast("long").alias("frame_id"),
        F.timestamp_seconds(start + 86400).alias("ts"), *[
            F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in parts.columns[3:]]))
    path = SF.shared_folder(spark, "frame-parts")
    SQ.write_frames(parts, path, files=6)
    last.coalesce(1).write.mode("append").parquet(path)
    stream = SF.read_frames(spark, path, parts.schema, files_per_trigger=2)
    out = SF.run_to_table(SQ.follow_frames(stream, late="1 hour"), "sequence-frames")
    return out.where("sequence >= 0").select(
        *K, "kind", "id", "previous_id", r("distance", 6), r("speed", 6), r("heading", 6))


@register("frame_documents", V.with_sql(
    V.POINTS_SQL, V.POSES_SQL, S.MOTION_SQL, *S.grid_ctes(policies=["uniform", "adaptive"]), body="""
 select f.sequence, f.frame_id, point_count, a as adaptive_cells, u as uniform_cells, a*42 as adaptive_bytes, least(a, 2000) as drawn, round(speed, 9) as speed_mps
 from (select sequence, frame_id, count(*) as point_count from points group by 1, 2) f
 join (select sequence, frame_id, count(*) filter (where policy='adaptive') as a, count(*) filter (where policy='uniform') as u from leaf group by 1, 2) l using (sequence, frame_id)
 join motion using (sequence, frame_id)"""))
def frame_docs(spark, sf):
    """Figures read back out of the nested frame documents."""
    p = V.points(spark, sf)
    lv = grid.leaves(cells(spark, sf, ("uniform", "adaptive")))
    docs = frame_documents(p, lv, cluster.object_proposals(p, rules=cluster.PROPOSAL_RULES[1:]),
                           metrics.class_share(p, K), frame_speed(spark, sf), render_cells=2000)
    g = F.col("grids")
    return docs.select(*K, "point_count", g["adaptive"]["active_cells"].alias("adaptive_cells"),
                       g["uniform"]["active_cells"].alias("uniform_cells"),
                       g["adaptive"]["bytes"].alias("adaptive_bytes"),
                       F.size(g["adaptive"]["cells"]).cast("long").alias("drawn"),
                       F.round("speed", 9).alias("speed_mps"))
