"""LiDAR-shaped tables derived from the given tables, for Spark and as SQL text.

`points`: one return per lineitem row. `sequence` groups 15,000 order keys and
`frame_id` is the line number, so the number of frames grows with the data while
the number of returns per frame stays that of a real sweep.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

SEQ_ORDERS = 15000
ID_RANGE = 2147483648  # 2^31


def table(spark: SparkSession, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark, sf) -> DataFrame:
    return points_of(table(spark, sf, "lineitem"))


def points_of(li: DataFrame) -> DataFrame:
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    u = (pk * 7919) % 2001 - 1000
    v = (pk * 104729) % 2001 - 1000
    q = F.col("l_quantity").cast("long")
    disc = F.floor(F.col("l_discount") * 100 + 0.5)
    tax = F.floor(F.col("l_tax") * 100 + 0.5)
    frame = F.col("l_linenumber").cast("long")
    m = pk % 5
    x_mm = F.floor(u * F.abs(u) / 10.0) + (q - 25) * 6 - frame * 1500
    y_mm = F.floor(v * F.abs(v) / 10.0) + (disc - 5) * 24 + (sk % 10) * 3 - frame * 100
    z_mm = F.when(m.isin(0, 1, 4), (q % 7) * 10 - 1700).otherwise(q * 40 - 1700)
    truth = F.when(m == 4, 255).otherwise(m)
    pred = F.when(m == 4, 1).when(tax == 0, (m + 1) % 4).otherwise(m)
    return li.select(
        F.floor(F.col("l_orderkey") / SEQ_ORDERS).alias("sequence"),
        frame.alias("frame_id"),
        (F.col("l_orderkey") * ID_RANGE
         + ((pk * 1024 + sk % 1024) * 64 + q) % ID_RANGE).alias("point_id"),
        pk.alias("instance_id"),
        x_mm.alias("x_mm"), y_mm.alias("y_mm"), z_mm.alias("z_mm"),
        (x_mm / 1000.0).alias("x"), (y_mm / 1000.0).alias("y"), (z_mm / 1000.0).alias("z"),
        (sk % 256).alias("intensity_u8"),
        truth.cast("int").alias("truth"), pred.cast("int").alias("pred"),
        ((disc * 5 + 50) / 100.0).alias("conf"))


POINTS_SQL = """points as materialized (
 select *, cast(x_mm as double) / 1000 as x, cast(y_mm as double) / 1000 as y,
        cast(z_mm as double) / 1000 as z
 from (
  select cast(floor(l_orderkey / 15000.0) as bigint) as sequence, frame_id,
   l_orderkey * 2147483648 + ((pk * 1024 + sk % 1024) * 64 + q) % 2147483648 as point_id,
   pk as instance_id,
   cast(floor(u * abs(u) / 10.0) as bigint) + (q - 25) * 6 - 1500 * frame_id as x_mm,
   cast(floor(v * abs(v) / 10.0) as bigint) + (disc - 5) * 24 + (sk % 10) * 3 - 100 * frame_id as y_mm,
   case when pk % 5 in (0, 1, 4) then -1700 + (q % 7) * 10 else -1700 + q * 40 end as z_mm,
   sk % 256 as intensity_u8,
   cast(case when pk % 5 = 4 then 255 else pk % 5 end as integer) as truth,
   cast(case when pk % 5 = 4 then 1 when tax = 0 then (pk % 5 + 1) % 4 else pk % 5 end as integer) as pred,
   cast(50 + disc * 5 as double) / 100 as conf
  from (select l_orderkey, cast(l_linenumber as bigint) as frame_id,
    l_partkey as pk, l_suppkey as sk,
    ((l_partkey * 7919) % 2001) - 1000 as u, ((l_partkey * 104729) % 2001) - 1000 as v,
    cast(l_quantity as bigint) as q, cast(round(l_discount * 100) as bigint) as disc,
    cast(round(l_tax * 100) as bigint) as tax from lineitem) a) b)"""


def poses(spark, sf) -> DataFrame:
    """Sensor moves 1.5 m forward and 0.1 m left per frame, without rotation."""
    frames = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / SEQ_ORDERS).alias("sequence"),
        F.col("l_linenumber").cast("long").alias("frame_id")).distinct()
    cols = {f"t{r}{c}": F.lit(1.0 if r == c else 0.0) for r in range(3) for c in range(4)}
    cols["t03"] = F.col("frame_id") * 1.5
    cols["t13"] = F.col("frame_id") * 100 / 1000.0
    return frames.select("sequence", "frame_id", *[v.alias(k) for k, v in cols.items()],
                         (F.col("frame_id") / 10.0).alias("ts_s"))


POSES_SQL = """poses as (
 select distinct cast(floor(l_orderkey / 15000.0) as bigint) as sequence,
  cast(l_linenumber as bigint) as frame_id,
  1.5::double * l_linenumber as tx, cast(100 * l_linenumber as double) / 1000 as ty,
  cast(l_linenumber as double) / 10 as ts_s
 from lineitem)"""


def turned_poses(spark, sf) -> DataFrame:
    """Like ``poses``, but every other frame is turned left by the angle of sine 40/401."""
    odd = F.col("frame_id") % 2 == 1
    cos, sin = F.when(odd, 399 / 401).otherwise(1.0), F.when(odd, 40 / 401).otherwise(0.0)
    return poses(spark, sf).withColumns({"t00": cos, "t01": -sin, "t10": sin, "t11": cos})


TURNED_SQL = """turned as (select *, case when frame_id % 2 = 1 then 399::double/401 else 1 end as c,
  case when frame_id % 2 = 1 then 40::double/401 else 0 end as s from poses),
 turned_pairs as (select *, lag(frame_id) over w as pf, lag(c) over w as pc, lag(s) over w as ps,
  lag(tx) over w as ptx, lag(ty) over w as pty, lag(ts_s) over w as pts from turned
  window w as (partition by sequence order by frame_id)),
 turned_ego as materialized (select sequence, frame_id, pf as previous_frame, ts_s - pts as dt, c*pc+s*ps as r00, c*-ps+s*pc as r01,
  -s*pc+c*ps as r10, -s*-ps+c*pc as r11, c*(ptx-tx)+s*(pty-ty) as ex, -s*(ptx-tx)+c*(pty-ty) as ey,
  pc*(tx-ptx)+ps*(ty-pty) as mx, -ps*(tx-ptx)+pc*(ty-pty) as my from turned_pairs)"""


def raw_labels(spark, sf) -> DataFrame:
    p = points(spark, sf)
    i = F.col("instance_id")
    sem = (F.when(F.col("truth") == 0, F.when(i % 2 == 0, 40).otherwise(44))
           .when(F.col("truth") == 1, F.when(i % 2 == 0, 48).otherwise(72))
           .when(F.col("truth") == 2, F.when(i % 3 == 0, 50).when(i % 3 == 1, 80).otherwise(81))
           .when(F.col("truth") == 3, F.when(i % 3 == 0, 10).when(i % 3 == 1, 30).otherwise(31))
           .otherwise(0))
    return p.withColumn("raw", (i % 65536) * 65536 + sem)


RAW_SQL = """raw_labels as (
 select *, (instance_id % 65536) * 65536 + cast(case truth
   when 0 then (case when instance_id % 2 = 0 then 40 else 44 end)
   when 1 then (case when instance_id % 2 = 0 then 48 else 72 end)
   when 2 then (case instance_id % 3 when 0 then 50 when 1 then 80 else 81 end)
   when 3 then (case instance_id % 3 when 0 then 10 when 1 then 30 else 31 end)
   else 0 end as bigint) as raw from points)"""


def frame_stats(spark, sf) -> DataFrame:
    """Per-frame runtime rows from the event stream."""
    return frame_stats_of(table(spark, sf, "events"))


def frame_stats_of(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") % 11).alias("sequence"), F.col("event_id").alias("frame_id"), "ts",
        F.when(kind == "view", "uniform").when(kind == "click", "distance")
        .when(kind == "signup", "ground").when(kind == "error", "semantic")
        .when(kind == "purchase", "adaptive").alias("policy"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("stage"))


STATS_SQL = """frame_stats as (
 select user_id % 11 as sequence, event_id as frame_id, ts,
  case event_type when 'view' then 'uniform' when 'click' then 'distance'
   when 'signup' then 'ground' when 'error' then 'semantic'
   when 'purchase' then 'adaptive' end as policy,
  value as latency_ms, cast(json_extract_string(props, '$.k') as bigint) as stage
 from events)"""


def logits(spark, sf) -> DataFrame:
    """Four scores, position and class per embedding; `block` groups neighbours."""
    e = table(spark, sf, "embeddings")
    at = [F.col("embedding")[i].cast("double") for i in range(8)]
    return e.select(
        "vec_id", F.floor(F.col("vec_id") / 64).alias("block"),
        (F.col("label") % 4).alias("truth"),
        F.array(*at[:4]).alias("logits"),
        at[0].alias("x"), at[1].alias("y"), at[2].alias("z"), at[3].alias("feat"))


LOGITS_SQL = """logits as (
 select vec_id, cast(floor(vec_id / 64.0) as bigint) as block, label % 4 as truth,
  cast(embedding[1] as double) as x, cast(embedding[2] as double) as y,
  cast(embedding[3] as double) as z, cast(embedding[4] as double) as feat
 from embeddings)"""


def with_sql(*parts, body, recursive=False):
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
