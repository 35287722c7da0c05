"""Spatial joins, clusters, tracks, ground and occupancy against literals and brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from scangrid.operators import (blocks, cluster, ground, motion, normalize, occupancy, spatial,
                                tracks, voxel)
from scangrid.schema import POSE_FIELDS


def poses_of(spark, offsets):
    rows = []
    for frame, (tx, ty) in enumerate(offsets):
        rows.append((0, frame, *[1.0, 0.0, 0.0, float(tx), 0.0, 1.0, 0.0, float(ty), 0.0, 0.0, 1.0, 0.0],
                     frame * .1))
    schema = "sequence long, frame_id long, " + ", ".join(f"{f} double" for f in POSE_FIELDS)
    return spark.createDataFrame(rows, schema + ", ts_s double")


def test_residual_vanishes_under_ego_motion(spark, cloud):
    p = cloud([(10, 2, 0, 0, 0, 0), (12, 3, 0, 0, 0, 0), (9, 2, 0, 0, 0, 1), (11, 3, 0, 0, 0, 1)])
    got = spatial.motion_residual(p, motion.ego_transforms(poses_of(spark, [(0, 0), (1, 0)])))
    rows = {(r.frame_id, r.point_id): r.residual for r in got.collect()}
    assert rows[0, 0] is None and rows[0, 1] is None
    assert max(rows[1, 2], rows[1, 3]) < 1e-6


def test_motion_with_a_rotated_pose(spark):
    c, s = np.cos(.3), np.sin(.3)
    rows = [(0, 0, c, -s, 0.0, 5.0, s, c, 0.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0),
            (0, 1, c, -s, 0.0, 5.0 + c, s, c, 0.0, 2.0 + s, 0.0, 0.0, 1.0, 0.0, .1)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "sequence double, frame_id double, "
                               + ", ".join(f"{f} double" for f in POSE_FIELDS) + ", ts_s double")
    r = motion.frame_motion(df).where("frame_id = 1").first()
    assert np.isclose(r.speed, 10) and abs(r.heading) < 1e-9


def brute_dbscan(p, eps, least):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= least
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += list(np.flatnonzero(core & (d[j] <= eps) & (label < 0)))
    for i in np.flatnonzero(~core):
        near = [(d[i, j], j) for j in np.flatnonzero(core) if d[i, j] < eps]
        if near:
            label[i] = label[min(near)[1]]
    return label


def test_dbscan_matches_brute_force(cloud):
    rng = np.random.default_rng(7)
    p = np.round(np.concatenate([rng.normal(0, .4, (60, 3)), rng.normal(4, .8, (60, 3)),
                                 rng.uniform(-6, 8, (60, 3)), np.tile([[9., 9., 9.]], (6, 1))]), 3)
    want = brute_dbscan(p, 1.0, 5)
    df = cloud([(*q, 2) for q in p]).select("sequence", "frame_id", "point_id", "x", "y", "z")
    got = {r.point_id: -1 if r.cluster is None else r.cluster for r in
           cluster.dbscan(df, ["sequence", "frame_id"], 1.0, 5).collect()}
    assert [got[i] for i in range(len(p))] == want.tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100) if i != 60], "a long, b long")
    got = cluster.connected_components(spark.range(101), edges)
    assert {r.id: r.label for r in got.collect()} == {i: 0 if i <= 60 else 61 for i in range(101)}


def test_sparse_objects_stay_as_fallback_boxes(cloud):
    got = cluster.object_proposals(cloud([(30, 0, 1, 3), (70, 2, 1, 3)])).collect()
    assert len(got) == 2 and all(r.fallback for r in got) and sum(r.points for r in got) == 2


def test_box_of_a_rotated_bar(cloud):
    t = np.linspace(-2, 2, 81)
    pts = [(10 + a * np.cos(.5), 5 + a * np.sin(.5), z, 2) for a in t for z in (0., .5)]
    r = cluster.object_proposals(cloud(pts)).first()
    assert np.isclose(r.yaw, .5, atol=1e-6) and np.isclose(r.size_u, 4, atol=1e-6)
    assert np.allclose([r.center_x, r.center_y, r.center_z], [10, 5, .25], atol=1e-6)


BOX = ("sequence long, frame_id long, object_id long, fallback boolean, class int, center_x double,"
       "center_y double, center_z double")


def test_tracks_need_a_pose_and_follow_it(spark):
    boxes = spark.createDataFrame([(0, 0, 1, False, 3, 10., 0., 0.), (0, 1, 2, False, 3, 9., 0., 0.)], BOX)
    got = tracks.attach_tracks(boxes, motion.ego_transforms(poses_of(spark, [(0, 0), (1, 0)])))
    rows = {r.object_id: r for r in got.collect()}
    assert rows[2].previous_id == 1 and rows[2].displacement_m == 0 and rows[1].previous_id is None
    none = motion.ego_transforms(poses_of(spark, [(0, 0)]))
    assert tracks.attach_tracks(boxes, none).where("previous_id is not null").count() == 0


def test_track_choice_matches_serial_greedy(spark):
    rng = np.random.default_rng(3)
    old, new = rng.uniform(0, 8, (40, 2)), rng.uniform(0, 8, (40, 2))
    rows = [(0, 0, i, False, 3, float(a), float(b), 0.) for i, (a, b) in enumerate(old)]
    rows += [(0, 1, 100 + i, False, 3, float(a), float(b), 0.) for i, (a, b) in enumerate(new)]
    got = tracks.attach_tracks(spark.createDataFrame(rows, BOX),
                               motion.ego_transforms(poses_of(spark, [(0, 0), (0, 0)])))
    used, want = set(), {}
    for i, q in enumerate(new):
        d = [(float(np.hypot(*(q - o))), j) for j, o in enumerate(old) if j not in used]
        best = min((c for c in d if c[0] < 2), default=None)
        if best:
            used.add(best[1])
            want[100 + i] = best[1]
    assert {r.object_id: r.previous_id for r in got.where("previous_id is not null").collect()} == want


def test_components_contract_edges_every_round(spark):
    rng = np.random.default_rng(11)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 400, (420, 2)) if a != b}
    edges |= {(1000 + i, 1001 + i) for i in range(100)} | {(2000, 2001 + i) for i in range(50)}
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    want = {i: i for e in edges for i in e}
    while True:
        new = {**want}
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == want:
            break
        want = new
    nodes = spark.createDataFrame([(i,) for i in [*want, 5000]], "id long")
    got = {r.id: r.label for r in cluster.connected_components(nodes, frame).collect()}
    assert got == {**want, 5000: 5000}
    live, sizes = frame, [len(edges)]
    while not live.isEmpty():
        pointers, live = cluster.contract(live, len(sizes))
        sizes.append(live.count())
    assert all(b < a for a, b in zip(sizes, sizes[1:])) and len(sizes) < 14
    none = spark.createDataFrame([], "a long, b long")
    assert cluster.connected_components(nodes.limit(3), none).where("id = label").count() == 3


def test_ribbon_follows_a_curve(cloud):
    u = np.linspace(0, 10, 120)
    p = cloud([(a, .02 * a * a, .1, 1) for a in u] + [(a, -.3, 0, 0) for a in u]).withColumn(
        "height", F.col("z"))
    rows = cluster.terrain_ribbons(p).orderBy("cluster", "i").collect()
    assert len(rows) % 24 == 0 and rows
    assert max(abs(r.y - .02 * r.x ** 2) for r in rows) < .05


def test_ground_plane_and_block_resampling(cloud):
    rng = random.Random(1)
    p = cloud([(rng.uniform(0, 30), rng.uniform(0, 30), -1.7, 0) for _ in range(400)]).cache()
    plane = ground.ground_plane(p)
    assert plane.first().valid
    assert ground.with_height(p, plane).agg(F.max(F.abs("height"))).first()[0] < 1e-5
    sizes = blocks.block_sizes(p, 256)
    assert sizes.agg(F.sum("original_count")).first()[0] == 400
    s = blocks.resample_blocks(p, 256).cache()
    per = s.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"))
    assert {(r.n, r.d) for r in per.collect()} == {(256, 256)}
    back = s.withColumnRenamed("x", "lx").withColumnRenamed("y", "ly").join(
        p.select("point_id", "x", "y"), "point_id")
    gap = F.greatest(F.abs(F.col("lx") + F.col("bx") * 10 - F.col("x")),
                     F.abs(F.col("ly") + F.col("by") * 10 - F.col("y")))
    assert back.agg(F.max(gap)).first()[0] < .02
    far = blocks.augment(s).join(s.select("point_id", "slot", F.col("x").alias("x0"), F.col("y").alias("y0")),
                                 ["point_id", "slot"])
    turn = F.abs(F.hypot(F.col("x") - 5, F.col("y") - 5) - F.hypot(F.col("x0") - 5, F.col("y0") - 5))
    assert far.agg(F.max(turn)).first()[0] < 1e-9


def test_too_few_points_for_a_plane(cloud):
    r = ground.ground_plane(cloud([(1, 1, 1, 0), (2, 1, 5, 0)])).first()
    assert (r.plane_a, r.plane_b, r.plane_c, r.valid) == (0, 0, 0, False)


def test_collinear_returns_fall_back_to_the_median_low_height(cloud):
    z = [-2.0, -1.9, -1.9, -1.5, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0]
    rows = [(i, i, v, 0) for i, v in enumerate(z)] + [(1, 1, float("nan"), 0), (float("inf"), 0, -9.0, 0)]
    r = ground.ground_plane(cloud(rows)).first()
    low = sorted(v for v in z if v <= np.quantile(z, .35))
    assert not r.valid and (r.plane_a, r.plane_b) == (0, 0)
    assert abs(r.plane_c - np.median(low)) < 1e-12


def test_few_near_returns_open_the_plane_to_far_ones(cloud):
    near = [(1, 1, 5, 0), (2, 1, 5, 0)]
    far = [(40 + i % 7, i % 5, -1.7 + .1 * (i % 7), 0) for i in range(60)]
    rows = [(*q, 0, f) for f, frame in enumerate((near + far, near, [(float("nan"), 0, 0, 0)])) for q in frame]
    got = {r.frame_id: r for r in ground.ground_plane(cloud([(*q[:4], 0, q[-1]) for q in rows])).collect()}
    assert len(got) == 3 and got[0].valid and abs(got[0].plane_a - .1) < .05
    assert not got[1].valid and not got[2].valid


def test_every_low_return_votes(cloud):
    """The plane most returns agree with wins, however many returns a frame has."""
    rng = np.random.default_rng(8)
    xy = rng.uniform(-20, 20, (9000, 2))
    rows = [(x, y, .02 * x - .01 * y - 1.7, 0) for x, y in xy[:6000]]
    rows += [(x, y, 4 + rng.uniform(0, 3), 0) for x, y in xy[6000:]]
    points = cloud(rows)
    low = points.where("z < 4")
    cut = np.quantile([q[2] for q in rows], .35)
    plane = ground.ground_plane(points).first()
    assert plane.valid and low.where(F.col("z") <= float(cut)).count() > 3000
    for got, want in zip((plane.plane_a, plane.plane_b, plane.plane_c), (.02, -.01, -1.7)):
        assert abs(got - want) < 1e-9


def test_geometric_stop_even_if_semantics_are_wrong(cloud):
    p = cloud([(4, 0, 0, 0), (4.1, 0, 1, 0), (2, 2, 0, 0)])
    cells = occupancy.occupancy_cells(p).cache()
    assert occupancy.corridor_status(p, cells).first().operator_status == "STOP"
    c = occupancy.occupancy_counts(cells, p).first()
    assert c.unknown > 0 and c.occupied >= 1


def test_voxel_crop_bounds(cloud):
    r = voxel.voxel_summary(cloud([(0, 0, 0, 0), (0, 0, .049, 0), (10, 0, 0, 0), (0, 0, 1, 0)])).first()
    assert (r.point_count, r.occupied, r.dense_bytes) == (2, 1, 12_800_000)


def test_farthest_points_match_brute_force(cloud):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 10, (50, 3))
    got = normalize.farthest_points(cloud([(*q, 0) for q in p]), ["sequence"], 8).orderBy("pick").collect()
    at, gap, want = 0, np.full(50, np.inf), []
    for _ in range(8):
        want.append(at)
        gap = np.minimum(gap, ((p - p[at]) ** 2).sum(1))
        at = int(gap.argmax())
    assert [r.point_id for r in got] == want


def test_dbscan_searches_agree_with_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(int(f), i, *map(float, p), int(w), int(i // 3)) for i, (f, p, w) in enumerate(zip(
        rng.integers(0, 2, 300), rng.uniform(-20, 20, (300, 3)) * (1, 1, .1), rng.integers(1, 4, 300)))]
    df = spark.createDataFrame(rows, "frame_id long, pid long, x double, y double, z double, w long, node long")
    near = {(a[1], b[1]) for a in rows for b in rows
            if a[0] == b[0] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= 4}
    total = {r.pid: r.total for r in cluster._weights_within(df, df, ["frame_id"], F.lit(2.0)).collect()}
    assert total == {a[1]: sum(b[5] for b in rows if (a[1], b[1]) in near) for a in rows}
    edges = {(r.a, r.b) for r in cluster._edges_within(df, ["frame_id"], 2.0).collect()}
    assert edges == {(rows[a][6], rows[b][6]) for a, b in near if rows[a][6] < rows[b][6]}


def test_dbscan_sends_no_position_to_27_cells(spark, cloud):
    pts = cloud([(i * .3, 0, 0, 2) for i in range(20)])
    found = cluster.dbscan(pts.select("sequence", "frame_id", "point_id", "x", "y", "z"), ["sequence", "frame_id"], 1.0, 3)
    assert found.select("cluster").distinct().count() == 1
    one = cluster._edges_within(pts.withColumn("node", F.col("point_id")), ["sequence", "frame_id"], 1.0)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_clusters_go_on_across_tiles(spark):
    rng = np.random.default_rng(29)
    blobs = [rng.normal((x, y, 0), (3, 3, .5), (60, 3)) for x in (-64, -32, 0, 31, 64) for y in (-33, 0, 32)]
    line = np.stack([np.arange(-90, 90, .7), np.arange(-90, 90, .7) / 3, np.zeros(258)], 1)
    edge = np.array([[32 + d, 48 + e, 0] for d in (-1, -.5, -.3, 0, .4, .5, 1, 1.4) for e in (-.9, 0, .6, 1)])
    frames = [np.round(np.concatenate(p)[rng.permutation(sum(map(len, p)))], 1)
              for p in ((*blobs, line, edge), (*blobs[::3], line[::2], edge), (line,))]
    eps, least = (1.0, .5, 2.0), (4, 3, 2)
    rows = [(f, i, *map(float, q), eps[f], least[f]) for f, p in enumerate(frames) for i, q in enumerate(p)]
    df = spark.createDataFrame(rows + [(None, 1, 0., 0., 0., 1., 1), (0, 5000, None, 0., 0., 1., 4), (0, 5001, float("nan"), 0., 0., 1., 4)],
                               "frame_id long, point_id long, x double, y double, z double, e double, m long")
    def of(values):
        out = F.lit(values[0])
        for f in (1, 2):
            out = F.when(F.col("frame_id") == f, values[f]).otherwise(out)
        return out
    want = {(f, i): None if c < 0 else c for f, p in enumerate(frames)
            for i, c in enumerate(brute_dbscan(p, eps[f], least[f]).tolist())}
    assert len(set(want.values())) > 20 and None in want.values()
    want.update({(None, 1): None, (0, 5000): None, (0, 5001): None})
    df = df.drop("e", "m")
    assert {(r.frame_id, r.point_id): r.cluster for r in cluster.dbscan(df, ["frame_id"], of(eps), of(least)).collect()} == want
    first = df.groupBy("frame_id", "x", "y", "z").agg(F.min("point_id").alias("point_id"), F.count("*").alias("note"))
    first = first.where("note = 1")
    alone = cluster.dbscan(first, ["frame_id"], of(eps), of(least), distinct=True)
    merged = cluster.dbscan(first, ["frame_id"], of(eps), of(least))
    assert alone.columns == [*first.columns, "cluster"] and alone.where("note is null").isEmpty()
    assert {(r.frame_id, r.point_id, r.cluster) for r in alone.collect()} == {
        (r.frame_id, r.point_id, r.cluster) for r in merged.collect()}


def test_object_proposals_shuffle_each_point_few_times(spark, cloud):
    def written():
        context = spark.sparkContext
        stages = context._jsc.sc().statusStore().stageList(
            None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
    rng = np.random.default_rng(31)
    pts = cloud([(*q, 2 + i % 2) for i, q in enumerate(np.round(rng.uniform((-90, -90, 0), (90, 90, 2), (20000, 3)), 3))])
    before = written()
    got = cluster.object_proposals(pts).collect()
    assert sum(r.points for r in got) == 20000
    assert written() - before < 5 * 20000


def test_boxes_of_single_points_are_those_of_groups_of_one(spark, cloud):
    rng = np.random.default_rng(37)
    pts = cloud([(*q, 2) for q in rng.uniform(-90, 90, (50, 3))]).withColumn("object_id", F.col("point_id")).withColumn(
        "conf", F.when(F.col("point_id") > 3, F.col("point_id") / 64))
    floor = [F.lit(.1)] * 3
    one = cluster.boxes_of_single_points(pts, ["object_id"], floor)
    many = cluster.oriented_boxes(pts, ["object_id"], floor)
    assert one.columns == many.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_mean_confidence_does_not_hang_on_order(spark):
    rows = [(g, x, 0., 0., c) for g, cs in enumerate(([.55, .6, .65, .7], [.7, .65, .6, .55], [None, .5], [None], [float("nan"), .5], [1e300]))
            for x, c in enumerate(map(lambda c: c, cs))]
    df = spark.createDataFrame([(g, float(x), y, z, c) for g, x, y, z, c in rows], "g long, x double, y double, z double, conf double")
    got = {r.g: r.confidence for r in cluster.oriented_boxes(df.coalesce(1), ["g"], [F.lit(.1)] * 3).collect()}
    assert got[0] == got[1] == .625 and got[2] == .5 and got[3] is None and np.isnan(got[4]) and got[5] == 1e300
