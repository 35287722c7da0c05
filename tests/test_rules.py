"""Cases just above former limits, and groups that share ids."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from scangrid.operators import cluster, occupancy, resample, selection
from scangrid.sources import sinks


def test_clusters_stay_in_their_frame(spark):
    rows = []
    for frame in range(2):
        for i in range(18):
            rows.append((0, frame, i, (i % 9) * 0.3 + (50.0 if i >= 9 else 0.0) + frame * 0.1, 0.0, 0.0))
    points = spark.createDataFrame(rows, "sequence long, frame_id long, point_id long, x double, y double, z double")
    both = cluster.dbscan(points, ["sequence", "frame_id"], 1.0, 3).collect()
    found = {}
    for r in both:
        found.setdefault((r["frame_id"], r["cluster"]), set()).add(r["point_id"])
    low, high = set(range(9)), set(range(9, 18))
    assert found == {(0, 0): low, (0, 9): high, (1, 0): low, (1, 9): high}


def test_number_frames_keeps_all_names(spark):
    names = [f"sequence_08_frame_{i:06d}.bin" for i in range(450)]
    files = spark.createDataFrame([("a", n) for n in names], "archive string, name string")
    got = selection.number_frames(files, ["archive"]).collect()
    assert {r["name"]: r["frame_id"] for r in got} == {n: i for i, n in enumerate(names)}
    assert selection.number_frames(files, ["archive"], limit=7).count() == 7


def test_number_frames_works_out_a_key_once(spark):
    files = spark.createDataFrame([("a", f"f{i}") for i in range(90)] + [("a", None), ("a", "")], "archive string, name string")
    ranked = selection.number_frames(files, ["archive"])
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    got = {r["name"]: r["frame_id"] for r in ranked.collect()}
    assert got == {None: 0, "": 1, **{f"f{i}": i + 2 for i in range(90)}}


def test_natural_key_of_long_numbers(spark):
    names = ["a9", "a10", "a" + "1" + "0" * 24, "a" + "9" * 24, "a007", "b1", "a"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in df.orderBy(selection.natural_key("name")).collect()]
    assert got == ["a", "a007", "a9", "a10", "a" + "9" * 24, "a" + "1" + "0" * 24, "b1"]


@pytest.mark.parametrize("n", [1_000_003, 20_000_000])
def test_draws_do_not_collapse(spark, n):
    """Means over draws of positions spread as independent draws would."""
    draws, items = 200, 2000
    grid = spark.range(draws * items).select((F.col("id") % draws).alias("draw"),
                                             F.floor(F.col("id") / draws).alias("item"))
    rows = resample.with_draw(grid, "draw", "item", F.lit(n), "pos").groupBy("draw").agg(
        F.avg("pos").alias("m")).collect()
    width = np.std([r["m"] for r in rows]) / (n / np.sqrt(12 * items))
    assert 0.85 < width < 1.15


def test_frames_without_known_cells_are_kept(spark):
    points = spark.createDataFrame(
        [(0, 0, 1, 4.0, 0.0, -1.7, 0), (0, 1, 2, 90.0, 90.0, 0.0, 0)],
        "sequence long, frame_id long, point_id long, x double, y double, z double, pred int")
    cells = occupancy.occupancy_cells(points)
    counts = {r["frame_id"]: r for r in occupancy.occupancy_counts(cells, points).collect()}
    assert counts[1]["unknown"] == 10000 and counts[1]["free"] == 0
    assert counts[0]["unknown"] < 10000
    maps = {r["frame_id"]: r["data"] for r in occupancy.flatten_map(cells, points).collect()}
    assert len(maps[0]) == 10000 and set(maps[1]) == {-1}
    known = {r["iy"] * 100 + r["ix"]: r["value"] for r in cells.collect()}
    assert all(maps[0][i] == known.get(i, -1) for i in range(10000))


def test_rerun_replaces_predictions(spark, tmp_path):
    path = str(tmp_path / "preds")
    preds = spark.createDataFrame([("m", 0, 1, 3), ("m", 1, 1, 2)],
                                  "model_sig string, sequence long, frame_id long, pred int")
    sinks.write_predictions(preds, path)
    sinks.write_predictions(preds.where("sequence = 1"), path)
    assert sinks.read_predictions(spark, path, "m").count() == 2


def test_temporal_match_builds_its_map_once(spark):
    from scangrid.operators import spatial
    rows = [(0, f, 100, lx, 0, lx / 10, 0.0, 0.1, lx % 4, 0.0) for f in (0, 1) for lx in range(3)]
    leaves = spark.createDataFrame(rows, "sequence long, frame_id long, size_mm int, lx long, ly long, x double, y double, "
                                         "size double, dominant_class int, mean_z double")
    leaves = leaves.mapInArrow(lambda batches: batches, leaves.schema)
    still = {f"e_t{r}{c}": F.lit(float(r == c)) for r in range(3) for c in range(4)}
    ego = spark.createDataFrame([(0, 1, 0)], "sequence long, frame_id long, previous_frame long").withColumns(still)
    got = spatial.temporal_match(leaves, ego)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the search
    found = got.collect()
    assert len(found) == 3 and all(r.frame_id == 1 and r.leaf_id == r.nearest_id and r.distance == 0 for r in found)
