"""Taxonomy, validation, selection, manifests and inventories."""
from pyspark.sql import functions as F

from scangrid.operators import checks, selection
from scangrid.sources import taxonomy as T

from . import views as V
from .maps import K, r
from .registry import register

MAP_VALUES = ", ".join(
    f"({raw}::bigint, '{name}', {lid}, {T.macro_of_learning(lid)}, "
    f"'{('ignored' if lid == 0 else T.CLASS_NAMES[T.macro_of_learning(lid)])}')"
    for raw, name, lid in T.RAW_LABELS)
MAP_SQL = f"mapping(semantic, label, learning_id, macro, macro_name) as (values {MAP_VALUES})"
DEC_SQL = """decoded as (select r.*, r.raw & 65535 as semantic, m.label, m.learning_id, coalesce(m.macro, 255) as macro, m.macro_name
 from raw_labels r left join mapping m on m.semantic = r.raw & 65535)"""


@register("decode_labels", V.with_sql(V.POINTS_SQL, V.RAW_SQL, MAP_SQL, DEC_SQL, body="""
 select sequence, frame_id, point_id, semantic, macro from decoded"""))
def decode_labels(spark, sf):
    return T.decode_labels(V.raw_labels(spark, sf)).select(*K, "point_id", "semantic", "macro")


@register("class_mapping_usage", V.with_sql(V.POINTS_SQL, V.RAW_SQL, MAP_SQL, DEC_SQL, body="""
 select m.semantic, m.label, m.learning_id, m.macro_name, count(d.raw) as points
 from mapping m left join decoded d on d.semantic = m.semantic group by 1, 2, 3, 4"""))
def class_mapping_usage(spark, sf):
    used = V.raw_labels(spark, sf).groupBy(F.col("raw").bitwiseAND(65535).alias("semantic")).agg(
        F.count(F.lit(1)).alias("n"))
    return T.class_mapping_table(spark).join(used, "semantic", "left").select(
        "semantic", "label", "learning_id", "macro_name",
        F.coalesce("n", F.lit(0)).alias("points"))


@register("learning_to_macro", V.with_sql(V.POINTS_SQL, V.RAW_SQL, MAP_SQL, DEC_SQL, body="""
 select sequence, learning_id, macro, count(*) as points from decoded group by 1, 2, 3"""))
def learning_to_macro(spark, sf):
    d = T.decode_labels(V.raw_labels(spark, sf)).drop("macro")
    table = F.broadcast(T.learning_table(spark).select("learning_id", "macro"))
    return d.join(table, "learning_id").groupBy("sequence", "learning_id", "macro").agg(
        F.count(F.lit(1)).alias("points"))


@register("equi_join_points_labels", V.with_sql(V.POINTS_SQL, V.RAW_SQL, body="""
 select p.sequence, p.frame_id, p.point_id, p.x_mm, r.raw from points p join raw_labels r
  on r.sequence=p.sequence and r.frame_id=p.frame_id and r.point_id=p.point_id"""))
def equi_join_points_labels(spark, sf):
    keys = [*K, "point_id"]
    return V.points(spark, sf).select(*keys, "x_mm").join(
        V.raw_labels(spark, sf).select(*keys, "raw"), keys)


@register("frames_with_poses", V.with_sql(V.POINTS_SQL, V.POSES_SQL, body="""
 select f.sequence, f.frame_id, n, round(tx, 6) as tx, round(ts_s, 6) as ts_s
 from (select sequence, frame_id, count(*) as n from points group by 1, 2) f join poses p using (sequence, frame_id)"""))
def frames_with_poses(spark, sf):
    f = V.points(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    return f.join(V.poses(spark, sf), list(K)).select(*K, "n", F.round("t03", 6).alias("tx"), r("ts_s", 6))


BROKEN = "case when instance_id % 997 = 0 then 'nan'::double else x end"


@register("frame_findings", V.with_sql(V.POINTS_SQL, body=f"""
 select sequence, frame_id, n, finding from (
  select sequence, frame_id, n, unnest([case when n not between 1 and 8500 then 'point count outside limits' end,
   case when bad > 0 then 'non-finite values' end]) as finding from (
   select sequence, frame_id, count(*) as n, count(*) filter (where isnan({BROKEN})) as bad from points group by 1, 2) f) q
 where finding is not null"""))
def frame_findings(spark, sf):
    p = V.points(spark, sf).withColumn(
        "x", F.when(F.col("instance_id") % 997 == 0, float("nan")).otherwise(F.col("x")))
    return checks.frame_findings(p, most=8500)


@register("grid_input_findings", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, point_id, finding from (
  select sequence, frame_id, point_id, unnest([case when not (conf2 between 0 and 1) then 'confidence outside [0, 1]' end,
   case when cls2 not in (0,1,2,3,255) then 'unknown class id' end]) as finding
  from (select *, conf + case when instance_id % 7 = 0 then 0.3 else 0 end as conf2, pred + case when instance_id % 11 = 0 then 2 else 0 end as cls2 from points) p) q
 where finding is not null"""))
def grid_input_findings(spark, sf):
    i = F.col("instance_id")
    p = (V.points(spark, sf).withColumn("conf", F.col("conf") + F.when(i % 7 == 0, 0.3).otherwise(0.0))
         .withColumn("pred", F.col("pred") + F.when(i % 11 == 0, 2).otherwise(0)))
    return checks.grid_input_findings(p, [*K, "point_id"])


LABELLED = "labelled as (select distinct sequence, frame_id from points where frame_id % 3 <> 0)"


def _labelled(spark, sf):
    return V.points(spark, sf).where("frame_id % 3 <> 0")


@register("paired_only", V.with_sql(V.POINTS_SQL, LABELLED, body="""
 select sequence, frame_id, count(*) as n from points semi join labelled using (sequence, frame_id) group by 1, 2"""))
def paired_only(spark, sf):
    return checks.paired_only(V.points(spark, sf), _labelled(spark, sf)).groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"))


@register("missing_labels", V.with_sql(V.POINTS_SQL, LABELLED, body="""
 select distinct sequence, frame_id from points anti join labelled using (sequence, frame_id)"""))
def missing_labels(spark, sf):
    return checks.missing_labels(V.points(spark, sf).select(*K).distinct(), _labelled(spark, sf))


@register("binary_findings", """
 select path, finding from (select path, unnest([case when s = 0 then 'empty scan' end, case when s % 16 <> 0 then 'scan length not a multiple of 16' end,
   case when l is null then 'missing label' end, case when l % 4 <> 0 then 'label length not a multiple of 4' end,
   case when floor(s/16.0) <> floor(l/4.0) then 'point and label counts differ' end]) as finding
  from (select doc_id as path, n_chars - n_chars % (case when doc_id % 3 = 0 then 16 else 1 end) as s,
   case when doc_id % 17 <> 0 then cast(floor(n_chars/16.0) as bigint)*4 + (case when doc_id % 13 = 0 then 4 when doc_id % 19 = 0 then 2 else 0 end) end as l from documents) f) q
 where finding is not null""")
def binary_findings(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    files = V.table(spark, sf, "documents").select(
        d.alias("path"), (n - n % F.when(d % 3 == 0, 16).otherwise(1)).alias("scan_bytes"),
        F.when(d % 17 != 0, F.floor(n / 16) * 4 + F.when(d % 13 == 0, 4).when(d % 19 == 0, 2)
               .otherwise(0)).alias("label_bytes"))
    return checks.binary_findings(files, ["path"])


@register("upload_findings", """
 select upload, finding from (select upload, unnest([case when odd > 0 then 'unsupported file type' end,
   case when zips > 0 and files > 1 then 'an archive must be the only file' end, case when files > 20 then 'too many files' end,
   case when total > 60000 then 'upload too large' end]) as finding
  from (select cast(floor(doc_id/16.0) as bigint) as upload, count(*) as files, sum(n_chars) as total, count(*) filter (where doc_id % 23 = 0) as zips,
   count(*) filter (where doc_id % 41 = 1 and doc_id % 23 <> 0) as odd from documents group by 1) f) q where finding is not null""")
def upload_findings(spark, sf):
    d = F.col("doc_id")
    suffix = F.when(d % 23 == 0, ".zip").when(d % 41 == 1, ".mp4").when(d % 2 == 0, ".bin").otherwise(".PLY")
    files = V.table(spark, sf, "documents").select(
        F.floor(d / 16).alias("upload"), F.concat(F.lit("scan"), d.cast("string"), suffix).alias("name"),
        F.col("n_chars").alias("bytes"))
    return checks.upload_findings(files, ["upload"], max_files=20, max_bytes=60000)


@register("split_overlap", V.with_sql(V.POINTS_SQL, body="""
 select sequence_no, count(distinct split) as splits from (
  select (sequence*7+frame_id) % 22 as sequence_no, case when (sequence*7+frame_id) % 22 = 8 then 'valid' when (sequence*7+frame_id) % 22 <= 10 then 'train' else 'test' end as split from points
  union all select frame_id, 'valid' from points where pred = 3 and frame_id > 5) s group by 1 having count(distinct split) > 1"""))
def split_overlap(spark, sf):
    p = V.points(spark, sf)
    frames = p.select(((F.col("sequence") * 7 + F.col("frame_id")) % 22).alias("sequence_no"))
    own = frames.join(F.broadcast(T.split_table(spark)), "sequence_no").select("sequence_no", "split")
    stray = p.where("pred = 3 and frame_id > 5").select(
        F.col("frame_id").alias("sequence_no"), F.lit("valid").alias("split"))
    return checks.split_overlap(own.unionByName(stray))


FILES_SQL = """files as (select user_id % 11 as upload, (case when event_type = 'view' then 'Scan' else 'scan' end) || cast((event_id*37) % 10007 as varchar)
  || '_' || cast(event_id as varchar) || '.bin' as name from events),
 keyed as (select *, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x:
  case when regexp_matches(x, '^[0-9]') then lpad(cast(length(regexp_replace(x, '^0+([0-9])', '\\1')) as varchar), 4, '0') || regexp_replace(x, '^0+([0-9])', '\\1') else x end), '') as k from files)"""


def _files(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select((F.col("user_id") % 11).alias("upload"), F.concat(
        F.when(F.col("event_type") == "view", "Scan").otherwise("scan"),
        (F.col("event_id") * 37 % 10007).cast("string"), F.lit("_"),
        F.col("event_id").cast("string"), F.lit(".bin")).alias("name"))


@register("natural_key", V.with_sql(FILES_SQL, body="select upload, name, k as key from keyed"))
def natural_key(spark, sf):
    return _files(spark, sf).withColumn("key", selection.natural_key("name"))


@register("number_frames", V.with_sql(FILES_SQL, body="""
 select upload, name, frame_id, round(frame_id*0.1::double, 6) as timestamp from (
  select upload, name, row_number() over (partition by upload order by k, name) - 1 as frame_id from keyed) q"""))
def number_frames(spark, sf):
    return selection.number_frames(_files(spark, sf), ["upload"]).select(
        "upload", "name", "frame_id", r("timestamp", 6))


RANKED = """ranked as (select user_id % 11 as sequence, event_id as frame_id, row_number() over (partition by user_id % 11 order by event_id) - 1 as rk,
 count(*) over (partition by user_id % 11) as total from events)"""


@register("evenly_spaced_frames", V.with_sql(RANKED, body="""
 select sequence, frame_id from ranked semi join (select sequence as s2, case when i = k - 1 then total - 1 else cast(floor(i*((total-1)/cast(k-1 as double))) as bigint) end as pos
  from (select sequence, max(total) as total, least(max(total), 64) as k from ranked group by 1) n, range(64) t(i) where i < k) p on s2=sequence and pos=rk"""))
def evenly_spaced_frames(spark, sf):
    f = V.frame_stats(spark, sf).select("sequence", "frame_id")
    return selection.spread_frames(f, ["sequence"], 64)


@register("strided_frames", V.with_sql(RANKED, body="""
 select sequence, frame_id from ranked semi join (select sequence as s2, cast(round_even(i*((total-1)/cast(k-1 as double)), 0) as bigint) as pos
  from (select sequence, max(total) as total, least(max(total), 50) as k from ranked group by 1) n, range(50) t(i) where i < k) p on s2=sequence and pos=rk"""))
def strided_frames(spark, sf):
    f = V.frame_stats(spark, sf).select("sequence", "frame_id")
    return selection.strided_frames(f, ["sequence"], 50)


@register("first_clip", """
 select seq as sequence, part, event_id as frame_id, pos as position from (
  select seq, part, event_id, row_number() over w - 1 as pos, event_id - min(event_id) over (partition by seq, part) as gap
  from (select user_id % 3 as seq, cast(floor(event_id/500.0) as bigint) as part, event_id from events) e window w as (partition by seq, part order by event_id)) q
 where pos = gap and pos < 8""")
def first_clip(spark, sf):
    f = V.table(spark, sf, "events").select(
        (F.col("user_id") % 3).alias("sequence"), F.floor(F.col("event_id") / 500).alias("part"),
        F.col("event_id").alias("frame_id"))
    return selection.first_clip(f, ["sequence", "part"])


CHALLENGE_SQL = """hits as (select sequence, frame_id, c as challenge, truth, pred from (
  select *, unnest([case when (label like '%person%' or label like '%bicyclist%') and sqrt(x*x+y*y) > 25 then 'far pedestrian' end,
   case when label in ('pole','traffic-sign') then 'thin pole / sign' end, case when label = 'sidewalk' then 'curb / sidewalk boundary' end]) as c
  from decoded where truth < 4 and sqrt(x*x+y*y) < 100) q where c is not null),
 errs as (select sequence, frame_id, challenge, count(*) as target_points, avg((pred<>truth)::int::double) as error_fraction from hits group by 1, 2, 3 having count(*) >= 2)"""


def _challenges(spark, sf):
    return selection.challenge_errors(T.decode_labels(V.raw_labels(spark, sf)), T.CHALLENGES)


@register("challenge_error", V.with_sql(V.POINTS_SQL, V.RAW_SQL, MAP_SQL, DEC_SQL, CHALLENGE_SQL, body="""
 select sequence, frame_id, challenge, target_points, round(error_fraction, 9) as error_fraction,
  round(error_fraction+least(target_points, 100)/1000.0::double, 9) as rank from errs"""))
def challenge_error(spark, sf):
    return _challenges(spark, sf).select(*K, "challenge", "target_points", r("error_fraction"), r("rank"))


@register("worst_case_per_challenge", V.with_sql(V.POINTS_SQL, V.RAW_SQL, MAP_SQL, DEC_SQL, CHALLENGE_SQL, body="""
 select challenge, sequence, frame_id, target_points, round(rk, 9) as rank from (
  select *, row_number() over (partition by challenge order by rk desc, sequence, frame_id) as o from (
   select *, error_fraction+least(target_points, 100)/1000.0::double as rk from errs) e) q where o = 1"""))
def worst_case_per_challenge(spark, sf):
    return selection.worst_case(_challenges(spark, sf)).select(
        "challenge", *K, "target_points", r("rank"))


@register("file_manifest", "select doc_id as path, n_chars as bytes, sha256(text) as digest from documents")
def file_manifest(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("digest"))


@register("manifest_mismatch", """
 select doc_id as path, sha256(text) as digest from documents where n_chars % 11 = 0 or n_chars % 7 = 0""")
def manifest_mismatch(spark, sf):
    d = V.table(spark, sf, "documents")
    actual = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    manifest = d.where("n_chars % 11 <> 0").select(
        F.col("doc_id").alias("path"),
        F.sha2(F.concat("text", F.when(F.col("n_chars") % 7 == 0, "x").otherwise("")), 256).alias("digest"))
    return checks.manifest_mismatch(actual, manifest)


@register("digest_agreement", """
 select source, count(distinct digest) = count(*) as all_distinct, bool_and(same) as current from (
  select source, sha256(text) as digest, sha256(text) = sha256(case when n_chars % 401 = 0 then 'changed' else text end) as same from documents) d group by 1""")
def digest_agreement(spark, sf):
    """Is every recorded digest still that of the file?"""
    d = V.table(spark, sf, "documents")
    now = d.select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    recorded = d.select("doc_id", F.sha2(F.when(F.col("n_chars") % 401 == 0, "changed")
                                         .otherwise(F.col("text")), 256).alias("recorded"))
    return now.join(recorded, "doc_id").groupBy("source").agg(
        (F.count_distinct("digest") == F.count(F.lit(1))).alias("all_distinct"),
        F.bool_and(F.col("digest") == F.col("recorded")).alias("current"))


@register("dataset_inventory", V.with_sql(V.POINTS_SQL, body="""
 select sequence, count(distinct frame_id) as scans, count(*) as points from points group by sequence union all
 select null, count(*), cast(sum(n) as bigint) from (select sequence, frame_id, count(*) as n from points group by 1, 2) f"""))
def dataset_inventory(spark, sf):
    f = V.points(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    return f.rollup("sequence").agg(F.count(F.lit(1)).alias("scans"), F.sum("n").alias("points"))
