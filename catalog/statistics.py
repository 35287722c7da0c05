"""Distributions, intervals, losses and report tables."""
from pyspark.sql import functions as F

from scangrid.functions.semantics import predicted_class, softmax
from scangrid.operators import losses, metrics as M, resample, summaries

from . import sqltext as S, views as V
from .maps import K, r
from .registry import register


@register("latency_distribution", V.with_sql(V.STATS_SQL, body="""
 select policy, count(*) as n, round(avg(latency_ms), 6) as mean, round(quantile_cont(latency_ms, 0.5), 6) as p50,
  round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99 from frame_stats group by 1"""))
def latency_distribution(spark, sf):
    d = M.distribution(V.frame_stats(spark, sf), ["policy"], "latency_ms")
    return d.select("policy", "n", *[r(c, 6) for c in ("mean", "p50", "p95", "p99")])


@register("height_percentiles_per_frame", V.with_sql(V.POINTS_SQL, body="""
 select sequence, frame_id, count(*) as n, round(avg(z), 6) as mean, round(quantile_cont(z, 0.5), 6) as p50,
  round(quantile_cont(z, 0.95), 6) as p95, round(quantile_cont(z, 0.99), 6) as p99 from points group by 1, 2"""))
def height_percentiles_per_frame(spark, sf):
    d = M.distribution(V.points(spark, sf), K, "z")
    return d.select(*K, "n", *[r(c, 6) for c in ("mean", "p50", "p95", "p99")])


@register("policy_summary", V.with_sql(V.STATS_SQL, body="""
 select policy, count(*) as frames, round(avg(latency_ms), 6) as mean_ms, round(1000/avg(latency_ms), 6) as fps,
  round(stddev_pop(latency_ms), 6) as spread from frame_stats group by 1"""))
def policy_summary(spark, sf):
    return summaries.policy_summary(V.frame_stats(spark, sf)).select(
        "policy", "frames", r("mean_ms", 6), r("fps", 6), r("spread", 6))


@register("scene_strata", V.with_sql(V.POINTS_SQL, f"""
 fr as (select sequence, frame_id, avg((truth=1)::int) as t, avg((truth=2)::int) as s, avg((truth=3)::int) as d from points group by 1, 2),
 conf_counts as (select sequence, frame_id, {S.band('sqrt(x*x+y*y)')} as band, truth, least(pred,4) as pred, count(*) as n
  from points where truth < 4 and sqrt(x*x+y*y) < 100 group by all)""", body=f"""
 select case when d > 0.12 then 'dense-object' when s > 0.5 then 'structure-dominant' when t > 0.3 then 'terrain-dominant' else 'mixed-road' end as scene_stratum,
  count(*) as frames, round(avg(m), 9) as mean_miou from fr left join (select sequence, frame_id, avg(miou) as m from (
  {S.scores_sql('conf_counts', ('sequence', 'frame_id', 'band'))}) s group by 1, 2) x using (sequence, frame_id) group by 1"""))
def scene_strata(spark, sf):
    from scangrid.functions import geom as G
    from scangrid.functions.semantics import distance_band
    p = V.points(spark, sf)
    by = [*K, "band"]
    banded = p.where(G.radius() < 100).withColumn("band", distance_band(G.radius()))
    sc = M.scores(M.confusion(banded, by), by).withColumn("miou", F.round("miou", 9))
    return summaries.strata_summary(sc, summaries.frame_strata(p)).select(
        "scene_stratum", "frames", r("mean_miou"))


@register("throughput", V.with_sql(V.STATS_SQL, body="""
 select sequence, count(*) as completed, round((epoch_us(max(ts))-epoch_us(min(ts)))/1e6, 6) as elapsed_s,
  round(count(*)/((epoch_us(max(ts))-epoch_us(min(ts)))/1e6), 9) as fps from frame_stats group by 1"""))
def throughput(spark, sf):
    return summaries.throughput(V.frame_stats(spark, sf), ["sequence"]).select(
        "sequence", "completed", r("elapsed_s", 6), r("fps"))


PAIRS_SQL = """pairs as (select sequence, stage, avg(latency_ms) filter (where policy='uniform') as a,
  avg(latency_ms) filter (where policy='adaptive') as b from frame_stats group by 1, 2),
 deltas as materialized (select sequence*1000+stage as frame, b-a as delta, row_number() over (order by sequence*1000+stage) - 1 as pos, count(*) over () as n
  from pairs where a is not null and b is not null)"""


def draw_sql(source, item, out, keep):
    """Position per draw and item in [0, n): the mixing of ``resample.with_draw`` as nested SQL."""
    p = 2147483647

    def fifth(x):
        return f"(({x}*{x}%{p})*({x}*{x}%{p})%{p}*{x}%{p})"
    first = ", ".join(f"(draw*{c}+{c + k})%{p} as d{k}" for k, c in enumerate((104729, 7919, 15485863, 32452843)))
    cols = ", ".join(keep)
    return f"""select {cols}, ({fifth('u')}*{p} + {fifth('v')}) % n as {out} from (
   select {cols}, n, (i*d0+d1)%{p} as u, (i*d2+d3)%{p} as v from (
    select {cols}, n, {', '.join(f"{fifth(c)} as {c}" for c in ('i', 'd0', 'd1', 'd2', 'd3'))} from (
     select {cols}, n, ({item}%{p} + {item}//{p}*69621 + 12345)%{p} as i, {first} from ({source}) q0) q1) q2) q3"""


def _deltas(spark, sf):
    s = V.frame_stats(spark, sf).groupBy("sequence", "stage", "policy").agg(
        F.avg("latency_ms").alias("latency_ms"))
    d = M.paired_delta(s, ["sequence", "stage"], "policy", "uniform", "adaptive", ["latency_ms"])
    return d.select(F.lit("all").alias("scope"), (F.col("sequence") * 1000 + F.col("stage")).alias("frame"),
                    F.col("delta_latency_ms").alias("delta"))


@register("paired_delta", V.with_sql(V.STATS_SQL, PAIRS_SQL, body="""
 select frame, round(delta, 9) as delta from deltas"""))
def paired_delta(spark, sf):
    return _deltas(spark, sf).select("frame", r("delta"))


BLOCK_PLAN = """select cast(d as bigint) as draw, cast(b as bigint) as block, last, n, n as size from (
  select max(n) as n, cast(ceil(max(n)/16.0) as bigint)-1 as last from deltas) s, range(1000) x(d), range(100000) y(b) where b <= last"""


@register("block_bootstrap_ci", V.with_sql(V.STATS_SQL, PAIRS_SQL, f"""
 plan as materialized (select draw, block, last, size as n, start from (
  {draw_sql(BLOCK_PLAN, 'block', 'start', ['draw', 'block', 'last', 'size'])}) p),
 picks as (select draw, (start+o) % n as pos from plan, range(16) t(o) where block < last or o < n-16*last),
 means as (select draw, sum(delta)/max(n) as m from picks join deltas using (pos) group by 1)""", body="""
 select 'all' as scope, (select round(avg(delta), 9) from deltas) as delta, (select count(*) from deltas) as n,
  round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from means"""))
def block_bootstrap_ci(spark, sf):
    return resample.block_bootstrap_ci(_deltas(spark, sf), ["scope"], "frame", "delta").select(
        "scope", r("delta"), "n", r("low"), r("high"))


@register("frame_bootstrap_ci", V.with_sql(V.STATS_SQL, PAIRS_SQL, f"""
 picks as ({draw_sql('select cast(d as bigint) as draw, pos as item, n from deltas, range(2000) x(d)', 'item', 'pos', ['draw'])}),
 means as (select draw, sum(delta)/max(n) as m from picks join deltas using (pos) group by 1)""", body="""
 select 'all' as scope, (select round(avg(delta), 9) from deltas) as delta, (select count(*) from deltas) as n,
  round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from means"""))
def frame_bootstrap_ci(spark, sf):
    return resample.frame_bootstrap_ci(_deltas(spark, sf), ["scope"], "frame", "delta").select(
        "scope", r("delta"), "n", r("low"), r("high"))


PROBS_SQL = """ex as (select *, exp(x-greatest(x,y,z,feat)) as e0, exp(y-greatest(x,y,z,feat)) as e1, exp(z-greatest(x,y,z,feat)) as e2, exp(feat-greatest(x,y,z,feat)) as e3 from logits),
 probs as materialized (select *, e0/(e0+e1+e2+e3) as p0, e1/(e0+e1+e2+e3) as p1, e2/(e0+e1+e2+e3) as p2, e3/(e0+e1+e2+e3) as p3 from ex)"""


def _probs(spark, sf):
    return V.logits(spark, sf).withColumn("probs", softmax("logits"))


@register("softmax_prediction", V.with_sql(V.LOGITS_SQL, PROBS_SQL, body="""
 select vec_id, case when p0 >= greatest(p1,p2,p3) then 0 when p1 >= greatest(p2,p3) then 1 when p2 >= p3 then 2 else 3 end as pred,
  round(greatest(p0,p1,p2,p3), 9) as confidence from probs"""))
def softmax_prediction(spark, sf):
    return _probs(spark, sf).select("vec_id", predicted_class("probs").alias("pred"),
                                    F.round(F.array_max("probs"), 9).alias("confidence"))


WEIGHTS_SQL = """w as (select truth, freq, 2+2*(1-freq) as gamma, 1/ln(1.02+freq) as omega from (
  select truth, count(*)/sum(count(*)) over ()::double as freq from logits group by 1) f)"""


@register("class_frequency_weights", V.with_sql(V.LOGITS_SQL, WEIGHTS_SQL, body="""
 select truth, round(freq, 9) as freq, round(gamma, 9) as gamma, round(omega, 9) as omega from w"""))
def class_frequency_weights(spark, sf):
    return losses.class_weights(V.logits(spark, sf)).select("truth", r("freq"), r("gamma"), r("omega"))


@register("ace_loss", V.with_sql(V.LOGITS_SQL, PROBS_SQL, WEIGHTS_SQL, body="""
 select round(avg(-omega*power(1-pt, gamma)*ln(pt)), 9) as ace_loss from (
  select omega, gamma, least(greatest(case truth when 0 then p0 when 1 then p1 when 2 then p2 else p3 end, 1e-7), 1-1e-7) as pt
  from probs join w using (truth)) q"""))
def ace_loss(spark, sf):
    return losses.ace_loss(_probs(spark, sf)).select(r("ace_loss"))


@register("lovasz_softmax", V.with_sql(V.LOGITS_SQL, PROBS_SQL, """
 er as (select vec_id, c, (truth=c)::bigint as fg, abs((truth=c)::int - case c when 0 then p0 when 1 then p1 when 2 then p2 else p3 end) as err from probs, range(4) t(c)),
 run as (select *, sum(fg) over (partition by c) as tot, sum(fg) over w as cf, sum(1-fg) over w as cb from er
  window w as (partition by c order by err desc, vec_id rows unbounded preceding)),
 j as (select *, 1-(tot-cf)/(tot+cb)::double as jac from run),
 g as (select c, err*(jac-coalesce(lag(jac) over (partition by c order by err desc, vec_id), 0)) as term, tot from j)""", body="""
 select round(avg(l), 9) as lovasz from (select c, sum(term) as l from g where tot > 0 group by 1) q"""))
def lovasz_softmax(spark, sf):
    return losses.lovasz_softmax(_probs(spark, sf)).select(r("lovasz"))


CURVE = "curve as (select o_custkey as run, o_orderkey as epoch, o_totalprice as val from orders)"


def _curve(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("val"))


@register("best_so_far", V.with_sql(CURVE, """
 a as (select *, row_number() over w as pos, max(val) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as prev,
  max(val) over w as best from curve window w as (partition by run order by epoch rows unbounded preceding)),
 b as (select *, prev is null or val > prev as improved from a)""", body="""
 select run, epoch, val, improved, best, pos - max(case when improved then pos end) over (partition by run order by epoch rows unbounded preceding) as bad_epochs from b"""))
def best_so_far(spark, sf):
    return M.best_so_far(_curve(spark, sf), ["run"], "epoch", "val").select(
        "run", "epoch", "val", "improved", "best", F.col("bad_epochs").cast("long").alias("bad_epochs"))


@register("next_epoch_index", V.with_sql(CURVE, body="""
 select c.run, greatest(c.epoch, coalesce(m, 0)) as next_epoch from (select run, min(epoch) + 5000 as epoch from curve group by 1) c
 left join (select run, max(epoch) as m from curve where val > 100000 group by 1) h on h.run=c.run"""))
def next_epoch_index(spark, sf):
    c = _curve(spark, sf)
    checkpoints = c.groupBy("run").agg((F.min("epoch") + 5000).alias("epoch"))
    return M.next_epoch_index(c.where("val > 100000"), checkpoints, ["run"])


@register("recommend_profile", V.with_sql(V.STATS_SQL, """
 prof as (select sequence, case policy when 'uniform' then 'reference' else policy end as profile, 0.8+avg(latency_ms)/100000 as miou,
  0.9+avg(latency_ms)/5000 as near, 1000/avg(latency_ms) as fps from frame_stats group by 1, 2)""", body="""
 select sequence, arg_max(profile, (fps, profile)) as recommended, round(max(fps), 9) as fps from (
  select p.* from prof p join prof q on q.sequence=p.sequence and q.profile='reference' where p.miou-q.miou >= -0.01 and p.near >= q.near-0.01) e group by 1"""))
def recommend_profile(spark, sf):
    avg = F.avg("latency_ms")
    prof = V.frame_stats(spark, sf).groupBy("sequence", F.when(F.col("policy") == "uniform", "reference")
                                            .otherwise(F.col("policy")).alias("profile")).agg(
        (0.8 + avg / 100000).alias("miou"), (0.9 + avg / 5000).alias("near"), (1000 / avg).alias("fps"))
    for k in range(4):
        prof = prof.withColumn(f"near_recall_{k}", F.col("near"))
    return M.recommend_profile(prof, ["sequence"]).select("sequence", "recommended", r("fps"))
