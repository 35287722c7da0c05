"""Literal cases and invariants of the map policies."""
import math
import random

import pytest
from pyspark.sql import functions as F

from scangrid.functions import geom as G
from scangrid.functions.semantics import semantic_split
from scangrid.operators import grid, metrics, quality
from scangrid.schema import POLICIES


def motion_of(spark, speed, heading):
    return spark.createDataFrame([(0, 0, float(speed), float(heading))],
                                 "sequence long, frame_id long, speed double, heading double")


def test_semantic_split_literals(spark):
    rows = [(10, 0, 0, 0, False), (4, 3, 3, 0, True), (1000, 0, 0, 0, False), (700, 100, 100, 100, True)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want boolean")
    assert df.where(semantic_split([F.col(c) for c in "abcd"]) != F.col("want")).count() == 0


def test_fovea_turns_with_heading(spark):
    df = spark.createDataFrame([(18.0, 0.0), (0.0, 18.0), (-18.0, 0.0)], "x double, y double")
    got = [[r[0] for r in df.select(G.resolution_ceiling("x", "y", 25.0, h)).collect()]
           for h in (0.0, math.pi / 2)]
    assert got == [[.05, .1, .1], [.1, .05, .1]]


def test_safety_floor_wins(spark, cloud):
    rng = random.Random(1)
    pts = [(rng.uniform(-3, 3), rng.uniform(-3, 3), 0, 0) for _ in range(800)]
    pts = [p for p in pts if math.hypot(p[0], p[1]) < 3]
    for speed, heading in ((0, 0), (80, math.pi), (15, -1.8)):
        lv = grid.build_grid(cloud(pts), ("adaptive",), motion_of(spark, speed, heading))
        assert {r.size_mm for r in lv.select("size_mm").distinct().collect()} == {50}


def test_ceilings_hold_and_leaves_are_disjoint(spark, cloud):
    rng = random.Random(3)
    pts = cloud([(rng.uniform(-80, 80), rng.uniform(-80, 80), 0, 0) for _ in range(3000)]).cache()
    cells = grid.grid_cells(pts, ("adaptive",), motion_of(spark, 15, .7))
    at = grid.assign_points(pts, cells, ("adaptive",)).where("size_mm > 0")
    over = at.where(F.col("size_mm") / 1000 > G.resolution_ceiling("x", "y", 15.0, .7) + 1e-6)
    assert over.count() == 0
    lv = grid.leaves(cells)
    assert grid.overlapping_cells(lv).count() == 0
    inside = pts.where(G.in_range()).count()
    assert lv.agg(F.sum("point_count")).first()[0] == inside


def test_height_variance_splits_and_flat_merges(cloud):
    xy = [(70.01 + .04 * i, 1.01 + .04 * j) for i in range(12) for j in range(12)]
    flat = cloud([(x, y, 0, 0) for x, y in xy])
    rough = cloud([(x, y, .5 * (i % 2), 0) for i, (x, y) in enumerate(xy)])
    one = grid.build_grid(flat, ("adaptive",)).collect()
    assert len(one) == 1 and one[0].point_count == len(xy)
    assert grid.build_grid(rough, ("adaptive",)).count() > 1


def test_elevation_unknown_and_out_of_range(cloud):
    pts = cloud([(1.001, 1.001, -1, 2), (1.002, 1.002, 2, 2), (101, 0, 0, 3), (float("nan"), 0, 0, 0)])
    cells = grid.grid_cells(pts, ("adaptive",)).cache()
    leaf = grid.leaves(cells).collect()
    assert len(leaf) == 1
    assert (leaf[0].min_z, leaf[0].max_z, leaf[0].mean_z) == (-1, 2, .5)
    got = grid.assign_points(pts, cells, ("adaptive",)).orderBy("point_id").collect()
    assert [r.cell_class for r in got] == [2, 2, 255, 255]
    assert [r.size_mm > 0 for r in got] == [True, True, False, False]


def test_empty_input(cloud):
    assert grid.build_grid(cloud([(1, 1, 1, 1)]).where("false"), POLICIES).count() == 0


def test_policies_differ(cloud):
    rng = random.Random(9)
    pts = cloud([(rng.uniform(70, 71), rng.uniform(0, 1), rng.uniform(0, 1), 2) for _ in range(500)])
    lv = grid.build_grid(pts, ("distance", "ground"))
    n = {r.policy: r["count"] for r in lv.groupBy("policy").count().collect()}
    assert n["ground"] > n["distance"]
    mixed = cloud([(40.02, .02, 0, 0), (40.12, .02, 0, 0), (40.22, .02, 0, 3)])
    n = {r.policy: r["count"] for r in
         grid.build_grid(mixed, ("semantic", "ground")).groupBy("policy").count().collect()}
    assert n["semantic"] > n["ground"]


def test_common_support(cloud):
    pts = cloud([(70.02, .02, 0, 0, 0), (70.12, .02, .2, 0, 0), (70.22, .02, 0, 0, 2)])
    cells = grid.grid_cells(pts, ("distance", "uniform"), truth="truth").cache()
    own = metrics.scores(quality.leaf_confusion(cells), [*quality.BY, "band"]).where(
        "policy = 'distance' and band = 3").first()
    shared = metrics.scores(quality.common_confusion(cells), [*quality.BY, "band"]).where(
        "policy = 'distance' and band = 3").first()
    assert (own.labelled, own.accuracy) == (1, 1)
    assert shared.labelled == 3 and math.isclose(shared.accuracy, 2 / 3)
    err = {(r.policy, r.statistic): r.mae for r in quality.elevation_errors(cells).collect()}
    assert err["distance", "mean"] > 0 and err["uniform", "mean"] == 0


def test_unknown_policy_is_rejected(cloud):
    with pytest.raises(ValueError):
        grid.build_grid(cloud([(1, 1, 1, 1)]), ("other",))


def test_overlaps_shuffle_leaves_not_cells(spark):
    rows = [(0, 0, "p", 500, 0, -1), (0, 0, "p", 100, 1, -5), (0, 0, "p", 50, -1, 3), (0, 0, "p", 250, 1, 0),
            (0, 0, "p", 50, 9, 4), (0, 0, "q", 500, 0, -1), (0, 0, "p", 350, 1, 0)]
    leaf_rows = spark.createDataFrame(rows, "sequence long, frame_id long, policy string, size_mm int, lx long, ly long")
    out = grid.overlapping_cells(leaf_rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = {}
    for _, _, policy, mm, lx, ly in rows:
        u = mm // 50
        for ix in range(lx * u, lx * u + u):
            for iy in range(ly * u, ly * u + u):
                want[policy, ix, iy] = want.get((policy, ix, iy), 0) + 1
    assert {(r.policy, r.ix, r.iy): r.covers for r in out.collect()} == {k: n for k, n in want.items() if n > 1}


def test_footprints_of_a_valid_map_list_no_cells(spark, monkeypatch):
    import __spark_entry__ as entries

    def listed(*_):
        raise AssertionError("cells are listed")
    monkeypatch.setattr(grid, "covered_cells", listed)
    got = entries.queries()["overlapping_footprints"](spark, entries.SMALL).collect()
    assert {r.policy for r in got} == set(POLICIES)
    assert all(r.overlapping == 0 and r.footprint_cells > 0 for r in got)


def test_footprint_counts_match_listed_cells(spark):
    rng = random.Random(13)
    rows = [(0, 0, "p", 500, 0, -1), (0, 0, "p", 100, 1, -5), (0, 0, "p", 50, -1, 3), (0, 0, "p", 250, 1, 0),
            (0, 0, "p", 350, 1, 0), (0, 0, "p", 1500, 3, -1), (0, 0, "q", 500, 0, -1), (0, None, "q", 50, 4, 4)]
    rows += [(1, 0, "p", rng.choice((50, 100, 250, 500)), rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(60)]
    rows += [(1, 1, "p", 50, 7, -7)] * 3 + [(1, None, "q", 100, 0, 0)] * 2
    leaf_rows = spark.createDataFrame(rows, "sequence long, frame_id long, policy string, size_mm int, lx long, ly long")
    want = {}
    for *key, mm, lx, ly in rows:
        u, cells = mm // 50, want.setdefault(tuple(key), {})
        for at in ((ix, iy) for ix in range(lx * u, lx * u + u) for iy in range(ly * u, ly * u + u)):
            cells[at] = cells.get(at, 0) + 1
    got = {tuple(r[:3]): tuple(r[3:]) for r in grid.footprint_counts(leaf_rows).collect()}
    assert got == {k: (len(c), sum(n > 1 for n in c.values())) for k, c in want.items()}


def test_leaf_places_are_those_of_the_map(spark, cloud):
    pts = cloud([(x * .31 - 20, 7 - x * .17, (x % 5) * .3, x % 4) for x in range(300)])
    turns = spark.createDataFrame([(0, 0, v, 16.0, v * .7) for v in range(3)],
                                  "sequence long, frame_id long, variant int, speed double, heading double")
    cols = ["sequence", "frame_id", "variant", "policy", "size_mm", "lx", "ly"]
    places = grid.leaf_places(pts, POLICIES, turns)
    want = grid.build_grid(pts, POLICIES, turns).select(*cols)
    assert places.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, want.collect()))


def test_numpy_policy_tests_agree_with_their_sql(spark):
    import numpy as np
    from scangrid.functions import cells as C, text
    rng = random.Random(5)
    rows = [(rng.randint(-200, 199) * .5, rng.randint(-200, 199) * .5, rng.uniform(0, 30), rng.uniform(-3, 3),
             *[rng.choice((0, 0, 1, 5, 400)) for _ in range(3)], 1) for _ in range(500)]
    names = ("x", "y", "v", "h", "a", "b", "c", "d")
    got = spark.createDataFrame(rows, "x double, y double, v double, h double, a int, b int, c int, d int").selectExpr(
        f"{text.ceiling(text.region_near('x', 'y', .5, 'v', 'h', True), text.dither('x', 'y'), text.corner_distance('x', 'y', .5))} as ceil",
        f"{text.semantic_split(*'abcd')} as mixed", f"{text.argmax4(*'abcd')} as top").collect()
    at = dict(zip(names, map(np.array, zip(*rows))))
    near = C.region_near(at["x"], at["y"], .5, at["v"], at["h"], True)
    ceil = C.ceiling(near, C.dither(at["x"], at["y"]), C.corner_distance(at["x"], at["y"], .5))
    counts = [at[k] for k in "abcd"]
    assert [tuple(r) for r in got] == list(zip(ceil, C.semantic_split(counts), C.argmax4(counts)))


def test_tiers_take_no_window_and_keep_settings_and_unknown_confidence(spark, cloud):
    pts = cloud([(x * .31 - 20, 7 - x * .17, (x % 5) * .3, x % 4) for x in range(300)])
    turns = spark.createDataFrame([(0, 0, v, 16.0, v * .7) for v in range(3)],
                                  "sequence long, frame_id long, variant int, speed double, heading double")
    many = grid.grid_cells(pts, ("adaptive",), turns)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    for v in range(3):
        one = grid.grid_cells(pts, ("adaptive",), turns.where(f"variant = {v}").drop("variant"))
        own = many.where(f"variant = {v}").drop("variant")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, one.collect()))
    blank = grid.build_grid(pts.withColumn("conf", F.lit(None).cast("double")), ("distance",)).first()
    assert blank.dominant_class is not None and blank.class_confidence == 0


def test_reports_from_sums_read_the_cells_once(spark, cloud):
    from scangrid.operators import reports
    pts = cloud([(x * .31 - 20, 7 - x * .17, (x % 5) * .3, x % 4) for x in range(300)]).withColumn(
        "truth", F.col("point_id") % 5)
    cells = grid.grid_cells(pts, ("uniform", "semantic"), truth="truth").cache()
    sums = reports.frame_sums(cells)
    by = ["sequence", "frame_id", "policy"]
    def sort(df):
        return sorted(map(str, df.collect()))
    want = quality.obstacle_iou(cells, by).drop("multi_height_cells")
    assert sort(reports.summed_obstacle_iou(sums, by)) == sort(want)
    assert sort(reports.labelled_counts(sums).select(*by, "band", "truth", "pred", "n")) == sort(
        quality.common_confusion(cells).select(*by, "band", "truth", "pred", "n"))
    storage = {r.policy: r.cells for r in grid.leaf_storage(grid.leaves(cells), by).collect()}
    assert {r.policy: r.c for r in sums.groupBy("policy").agg(F.sum("leaves").alias("c")).collect()} == storage
