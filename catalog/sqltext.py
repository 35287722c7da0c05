"""SQL fragments shared by the reference queries."""
import math


def scores_sql(source, by, unknown_column=True):
    """Scores from a relation with columns by..., truth, pred, n."""
    keys = ", ".join(by)
    comma = keys + ", " if keys else ""
    group = f"group by {keys}" if keys else ""
    width = 5 if unknown_column else 4
    pivot = ", ".join(
        f"coalesce(sum(n) filter (where truth={t} and pred={p}), 0)::double as c{t}{p}"
        for t in range(4) for p in range(5))
    rows = {t: "(" + "+".join(f"c{t}{p}" for p in range(width)) + ")" for t in range(4)}
    cols = {p: "(" + "+".join(f"c{t}{p}" for t in range(4)) + ")" for p in range(4)}
    out = []
    for k in range(4):
        out.append(f"c{k}{k} / nullif({rows[k]} + {cols[k]} - c{k}{k}, 0) as iou_{k}")
        out.append(f"c{k}{k} / nullif({cols[k]}, 0) as precision_{k}")
        out.append(f"c{k}{k} / nullif({rows[k]}, 0) as recall_{k}")
    total = "+".join(rows[t] for t in range(4))
    f1 = ", ".join(
        f"round(case when precision_{k} = 0 or recall_{k} = 0 then 0.0 else "
        f"2*precision_{k}*recall_{k}/(precision_{k}+recall_{k}) end, 9) as f1_{k}" for k in range(4))
    pr = ", ".join(f"round({m}_{k}, 9) as {m}_{k}" for m in ("iou", "precision", "recall")
                   for k in range(4))
    miou = ("(select avg(v) from unnest([iou_0, iou_1, iou_2, iou_3]) as u(v))")
    return f"""
 select {comma}{pr}, {f1}, round(accuracy, 9) as accuracy, round({miou}, 9) as miou, labelled
 from (select {comma}{', '.join(out)},
   (c00+c11+c22+c33) / nullif({total}, 0) as accuracy, cast({total} as bigint) as labelled
  from (select {comma}{pivot} from {source} {group}) w) s"""


def band(r):
    return (f"(case when {r} < 10 then 0 when {r} < 25 then 1 when {r} < 60 then 2 "
            f"when {r} < 100 then 3 end)")


def argmax4(a, b, c, d):
    top = f"greatest({a},{b},{c},{d})"
    return (f"(case when {top} <= 0 then 255 when {a} = {top} then 0 when {b} = {top} then 1 "
            f"when {c} = {top} then 2 else 3 end)")


def semantic_split(a, b, c, d):
    cs = [f"cast({v} as double)" for v in (a, b, c, d)]
    n = "(" + "+".join(cs) + ")"
    ent = "+".join(f"(-({v}/greatest({n},1))*ln(greatest({v}/greatest({n},1),1e-15)))" for v in cs)
    top = f"greatest({','.join(cs)})"
    e = f"({n}*0.05/3)"
    stat = "+".join(f"power({v}-{e},2)/greatest({e},1e-12)" for v in cs)
    stat = (f"({stat}-power({top}-{e},2)/greatest({e},1e-12)"
            f"+power({top}-0.95*{n},2)/greatest(0.95*{n},1e-12))")
    return (f"(case when {e} >= 5 then {top} < 0.95*{n} and {stat} > 11.344866730144373 "
            f"else ({ent})/{math.log(4)!r} > 0.18 end)")


def fovea(x, y):
    s = "least(greatest(speed,0),80)"
    px = f"({x} - least(0.2*{s},5)*cos(heading))"
    py = f"({y} - least(0.2*{s},5)*sin(heading))"
    along = f"(({px}*cos(heading)+{py}*sin(heading))/least(1+0.033*{s},2))"
    across = f"({py}*cos(heading)-{px}*sin(heading))"
    return f"sqrt({along}*{along}+{across}*{across})"


def tier(d):
    return f"(case when {d} < 10 then 0.05 when {d} < 25 then 0.1 when {d} < 60 then 0.25 else 0.5 end)"


CEILING = ("cast(case when safety and corner <= 3 then 0.05 " + " ".join(
    f"when near >= {b} and near < {b}+2 and dither < 1-(near-{b})/2 then {f}"
    for b, f in ((10, 0.05), (25, 0.1), (60, 0.25))) + f" else {tier('near')} end as double)")


MOTION_SQL = """motion as (
 select sequence, frame_id, coalesce(sqrt(dx*dx+dy*dy)/dt, 0) as speed,
  case when sqrt(dx*dx+dy*dy)/dt > 0.1 then atan2(dy, dx) else 0 end as heading
 from (select sequence, frame_id, tx - lag(tx) over w as dx, ty - lag(ty) over w as dy, 0.1 as dt
  from poses window w as (partition by sequence order by frame_id)) m)"""


def grid_ctes(points="points", motion="motion", policies=None, variant=False):
    """CTEs `assigned` (point, policy, leaf), `leaf` (one row per leaf), `tiers`.

    Direct top-down form: every tier is aggregated from the points themselves.
    """
    rules = [("uniform", 0, 0, 0, 0), ("distance", 0, 0, 0, 0), ("ground", 0, 1, 1, 0),
             ("semantic", 0, 0, 0, 1), ("adaptive", 1, 1, 1, 1)]
    rules = [r for r in rules if policies is None or r[0] in policies]
    values = ", ".join(f"('{n}', {f}=1, {s}=1, {h}=1, {m}=1)" for n, f, s, h, m in rules)
    v = "variant, " if variant else ""
    ctes = [f"rules(policy, fovea, safety, height, mixture) as (values {values})",
            f"""valid as materialized (select p.*, cast(floor(x/0.05+1e-7) as bigint) as ix,
  cast(floor(y/0.05+1e-7) as bigint) as iy from {points} p where sqrt(x*x+y*y) < 100)"""]
    for u in (10, 5, 2, 1):
        size = {10: 0.5, 5: 0.25, 2: 0.1, 1: 0.05}[u]
        ctes.append(f"""agg{u} as materialized (select sequence, frame_id,
  cast(floor(ix/{u}.0) as bigint) as lx, cast(floor(iy/{u}.0) as bigint) as ly,
  count(*) as n, sum(z) as sz, sum(z*z) as szz, min(z) as zmin, max(z) as zmax,
  count(*) filter (where pred in (2,3)) as obst,
  {', '.join(f"count(*) filter (where pred={k}) as k{k}" for k in range(4))},
  {', '.join(f"coalesce(sum(cast(round(conf*1000000000) as bigint)) filter (where pred={k}), 0) as v{k}" for k in range(4))},
  {', '.join(f"count(*) filter (where truth={k}) as t{k}" for k in range(4))}
  from valid group by all)""")
        ox, oy = f"(lx*{size}::double)", f"(ly*{size}::double)"
        cx, cy = f"({ox}+{size}/2)", f"({oy}+{size}/2)"
        gx, gy = (f"greatest(greatest({o}, -({o}+{size})), 0)" for o in (ox, oy))
        wave = f"(sin({ox}*12.9898+{oy}*78.233)*43758.5453)"
        var = "greatest(0, szz/n - (sz/n)*(sz/n))"
        test = (f"({size} > ceil_m + 1e-6 or (height and cast(hv as float) > cast(0.0006250000000000001 as float))"
                " or (mixture and mixed_cell))")
        if u == 1:
            test = "false"
        ctes.append(f"""desc{u} as materialized (select *, {var} as hv,
   {semantic_split('k0', 'k1', 'k2', 'k3')} as mixed_cell,
   {wave} - floor({wave}) as dither, sqrt({gx}*{gx}+{gy}*{gy}) as corner,
   greatest(0, {fovea(cx, cy)} - {size}/sqrt(2)) as near_f,
   greatest(0, sqrt({cx}*{cx}+{cy}*{cy}) - {size}/sqrt(2)) as near_p
  from agg{u} left join {motion} using (sequence, frame_id))""")
        ctes.append(f"""node{u} as materialized (select *, {test} as split from (
   select *, {size}::double as size, {CEILING} as ceil_m from (
    select *, case when fovea then near_f else near_p end as near from desc{u} cross join rules) q1) q2)""")
    ctes.append("""placed as materialized (select *,
  cast(floor(ix/10.0) as bigint) as x10, cast(floor(iy/10.0) as bigint) as y10,
  cast(floor(ix/5.0) as bigint) as x5, cast(floor(iy/5.0) as bigint) as y5,
  cast(floor(ix/2.0) as bigint) as x2, cast(floor(iy/2.0) as bigint) as y2 from valid)""")
    ctes.append(f"""as10 as materialized (select p.*, n.policy, {'n.variant, ' if variant else ''}n.split as s10, n.ceil_m as ceil_m
  from placed p join node10 n on n.sequence=p.sequence and n.frame_id=p.frame_id and n.lx=p.x10 and n.ly=p.y10)""")
    vj = "and n.variant=p.variant " if variant else ""
    ctes.append(f"""as5 as materialized (select p.*, n.split as s5 from as10 p join node5 n on n.sequence=p.sequence
  and n.frame_id=p.frame_id and n.policy=p.policy {vj}and n.lx=p.x5 and n.ly=p.y5)""")
    ctes.append(f"""assigned as materialized (select p.*, case when p.policy = 'uniform' then 1 when not p.s10 then 10
   when p.ceil_m <= 0.100001 then (case when n.split then 1 else 2 end)
   else (case when p.s5 then 1 else 5 end) end as units
  from as5 p join node2 n on n.sequence=p.sequence
  and n.frame_id=p.frame_id and n.policy=p.policy {vj}and n.lx=p.x2 and n.ly=p.y2)""")
    ctes.append("""located as materialized (select *, cast(floor(ix/cast(units as double)) as bigint) as lx,
  cast(floor(iy/cast(units as double)) as bigint) as ly from assigned)""")
    ctes.append(f"used as materialized (select distinct sequence, frame_id, policy, {v}units, lx, ly from located)")
    union = " union all ".join(f"select *, {u} as units from node{u}" for u in (10, 5, 2, 1))
    using = f"sequence, frame_id, policy, {v}units, lx, ly"
    ctes.append(f"nodes as materialized ({union})")
    ctes.append(f"""leaf as materialized (select n.*, units*50 as size_mm, lx*size as x, ly*size as y,
   sz/n as mean_z, {argmax4('v0','v1','v2','v3')} as dominant_class,
   greatest(v0,v1,v2,v3)/1000000000.0::double/n as class_confidence,
   (obst/n::double)*(1-obst/n::double) as occupancy_variance,
   {argmax4('t0','t1','t2','t3')} as truth_class,
   (t0>0)::int+(t1>0)::int+(t2>0)::int+(t3>0)::int as truth_kinds
  from nodes n join used using ({using}))""")
    fine_using = f"sequence, frame_id, policy, {v}ix, iy, units, lx, ly"
    ctes.append(f"""shared as materialized (select c.sequence, c.frame_id, c.policy, {'c.variant, ' if variant else ''}c.ix, c.iy,
   l.size, l.dominant_class, l.mean_z, l.zmin as min_z, l.zmax as max_z, l.x, l.y, l.truth_kinds,
   f.sz/f.n as fine_mean_z, f.zmin as fine_min_z, f.zmax as fine_max_z,
   {argmax4('f.t0','f.t1','f.t2','f.t3')} as fine_truth,
   (cast(greatest(0, f.szz/f.n-(f.sz/f.n)*(f.sz/f.n)) as float) > cast(0.0006250000000000001 as float)
    or {semantic_split('f.t0','f.t1','f.t2','f.t3')}) as fine_complex
  from (select distinct {fine_using} from located) c
  join leaf l using ({using})
  join agg1 f on f.sequence=c.sequence and f.frame_id=c.frame_id and f.lx=c.ix and f.ly=c.iy)""")
    return ctes
