"""Work on many whole groups at a time."""
import numpy as np
import pyarrow as pa

from scangrid.functions.groups import group_starts, whole_groups
from scangrid.operators import normalize


def test_groups_stay_whole_across_batches():
    key = np.repeat(np.arange(40), np.arange(40) % 7 + 1)
    table = pa.table({"k": pa.array([None if k == 39 else int(k) for k in key]), "v": np.arange(len(key))})
    parts = list(whole_groups(table.to_batches(max_chunksize=3), ["k"], rows=10))
    assert pa.concat_tables(parts).column("v").to_pylist() == list(range(len(key)))
    owners = [set(p.column("k").to_pylist()) for p in parts]
    assert len(parts) > 5 and sum(map(len, owners)) == 40
    assert len(group_starts(table, ["k"])) == 40


def test_farthest_points_start_no_call_per_block(spark, monkeypatch):
    rows = [(b, 10 * b + i, float((i * i * 7 + b) % 11), float(i * b % 5), float(i)) for b in range(300) for i in range(b % 9 + 1)]
    df = spark.createDataFrame(rows, "block long, point_id long, x double, y double, z double")
    plan = normalize.farthest_points(df, ["block"], 4)
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    got = {}
    for r in plan.collect():
        got.setdefault(r.block, {})[r.pick] = r.point_id
    for b in range(300):
        own = sorted((r[1], np.array(r[2:])) for r in rows if r[0] == b)
        gap, at, want = np.full(len(own), np.inf), 0, []
        for _ in range(min(4, len(own))):
            want.append(own[at][0])
            gap = np.minimum(gap, [((p - own[at][1]) ** 2).sum() for _, p in own])
            at = int(gap.argmax())
        assert [got[b][i] for i in range(len(want))] == want and len(got[b]) == len(want)


def test_neighbour_counts_send_no_row_per_neighbouring_cell(spark):
    from scangrid.operators import spatial
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(-9, 9, (700, 3)) * [1, 1, .2], 1)
    df = spark.createDataFrame([(i % 3, *map(float, q)) for i, q in enumerate(p)], "k long, x double, y double, z double")
    plan = spatial.neighbour_counts(df, ["k"], 0.5)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.x, r.y, r.z): r.neighbours for r in plan.collect()}
    own = np.arange(700) % 3
    for i, q in enumerate(p):
        d = p - q
        near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= .25
        assert got[(i % 3, *map(float, q))] == int((near & (own == i % 3)).sum())


def test_nearest_ties_by_root_and_tiles_apart():
    from scangrid.functions.nearest import nearest_within
    q, s = np.zeros((2, 1)), np.array([[np.sqrt(3.0)], [-np.sqrt(3.0)], [.5]])
    d2, at = nearest_within(q, s, np.array([7, 5, 1]), 4.0, tiles=(np.array([0, 9]), np.array([0, 0, 1])))
    assert at.tolist() == [1, -1] and np.isinf(d2[1])
    a, b = np.array([[0.0, 0.0, 0.0]]), np.array([[1.0, 0.0, 0.0], [1.0, 1.5e-8, 0.0]])
    gap = (b * b).sum(1)
    assert gap[0] != gap[1] and np.sqrt(gap[0]) == np.sqrt(gap[1])
    ids = np.array([4, 2])
    assert nearest_within(a, b, ids, 9.0)[1].tolist() == [0]
    assert nearest_within(a, b, ids, 9.0, rooted=True)[1].tolist() == [1]


def test_transferred_labels_round_points_as_samples(spark):
    from scangrid.operators import blocks
    # 15.3 - 10 is a hair over 5.3, so unrounded the larger id would be nearer.
    points = spark.createDataFrame([(0, 0, 1, 15.3, 5.0, 0.0, 0)], "sequence long, frame_id long, point_id long, x double, y double, z double, truth int")
    samples = spark.createDataFrame([(0, 0, 1, 0, 1, 5.2, 5.0, 0.0, 1, 1.0), (0, 0, 1, 0, 2, 5.4, 5.0, 0.0, 2, 1.0)],
                                    "sequence long, frame_id long, bx long, by long, sample_id long, x double, y double, z double, pred int, conf double")
    assert (5.3 - 5.2) != (5.4 - 5.3)
    got = blocks.transfer_labels(points, samples, step=1e-4).first()
    want = 1 if np.sqrt((5.3 - 5.2) ** 2) <= np.sqrt((5.3 - 5.4) ** 2) else 2
    assert got.pred == want and got.x == 15.3
