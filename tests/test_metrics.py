"""Scores, exact percentiles, prefix sums and intervals."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scangrid.operators import losses, metrics, resample, scale


def scored(spark, truth, pred):
    df = spark.createDataFrame(list(zip(truth, pred)), "truth int, pred int")
    return metrics.scores(metrics.confusion(df)).first()


def test_unknown_prediction_is_an_error(spark):
    s = scored(spark, [0, 3, 255], [0, 255, 3])
    assert (s.iou_3, s.miou, s.labelled) == (0, .5, 2)


def test_recall_and_precision(spark):
    s = scored(spark, [0, 3, 3], [0, 0, 3])
    assert (s.recall_3, s.precision_3) == (.5, 1)


def test_exact_percentiles_match_numpy_with_ties_and_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot", rng.choice([1.25, rng.uniform(-5, 5)])) for _ in range(4000)]
    rows += [("cold", rng.gauss(0, 1)) for _ in range(37)] + [("one", 3.5), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in scale.exact_percentiles(df, ["k"], "v", (.15, .5, .99), .1,
                                                   count_name="n").collect()}
    for k in ("hot", "cold", "one"):
        v = np.array([x for key, x in rows if key == k and x == x])
        assert got[k].n == len(v)
        assert np.allclose([got[k].p15, got[k].p50, got[k].p99], np.percentile(v, [15, 50, 99]))


def test_prefix_sums_match_a_plain_running_sum(spark):
    rng = random.Random(5)
    rows = [(i % 2, rng.randrange(500), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, id int, m int")
    got = scale.prefix_sums(df, ["k"], ["v", "id"], F.floor(F.col("v") / 50), {"run": F.col("m")})
    want = {}
    for k in (0, 1):
        total = 0
        for r in sorted(r for r in rows if r[0] == k):
            total += r[3]
            want[r[2]] = total
    assert {r.id: r.run for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 7, 64, 500, 5000])
def test_evenly_spaced_matches_linspace(spark, n):
    df = spark.range(1731).withColumn("k", F.lit(1))
    got = scale.evenly_spaced(df, ["k"], ["id"], F.floor(F.col("id") / 100), n)
    want = sorted(set(np.linspace(0, 1730, min(n, 1731), dtype=int).tolist()))
    assert sorted(r.id for r in got.collect()) == want


def test_constant_difference_has_a_point_interval(spark):
    df = spark.createDataFrame([("s", i, 1.0) for i in range(40)], "k string, frame long, d double")
    for fn in (resample.block_bootstrap_ci, resample.frame_bootstrap_ci):
        r = fn(df, ["k"], "frame", "d", draws=50).first()
        assert np.allclose([r.low, r.high, r.delta], 1) and r.n == 40


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(4), 300)
    p[:40] = p[0]  # ties
    y = rng.integers(0, 4, 300)
    y[:5] = 255
    df = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(y, p)],
                               "truth int, probs array<double>")
    keep = y < 4
    q, t = p[keep], y[keep]
    terms = []
    for c in range(4):
        fg = (t == c).astype(float)
        e = np.abs(fg - q[:, c])
        o = np.argsort(-e, kind="stable")
        jac = 1 - (fg.sum() - fg[o].cumsum()) / (fg.sum() + (1 - fg[o]).cumsum())
        terms.append((e[o] * np.diff(jac, prepend=0)).sum())
    assert np.isclose(losses.lovasz_softmax(df).first().lovasz, np.mean(terms))
    f = np.bincount(t, minlength=4) / len(t)
    pt = np.clip(q[np.arange(len(t)), t], 1e-7, 1 - 1e-7)
    ace = (-(1 / np.log(1.02 + f))[t] * (1 - pt) ** (2 + 2 * (1 - f))[t] * np.log(pt)).mean()
    assert np.isclose(losses.ace_loss(df).first().ace_loss, ace)


def test_profile_choice_protects_near_recall(spark):
    rows = [("reference", .80, 1.0, .90, .80, .95, .89), ("foveated", .795, 1.8, .895, .80, .95, .90),
            ("compact", .794, 2.1, .90, .80, .95, .87)]
    df = spark.createDataFrame(rows, "profile string, miou double, fps double, near_recall_0 double,"
                               "near_recall_1 double, near_recall_2 double, near_recall_3 double")
    assert metrics.recommend_profile(df).first().recommended == "foveated"


def test_percentiles_do_not_depend_on_the_distribution(spark):
    """Nearly all distinct values lie within a millionth of the range."""
    rng = np.random.default_rng(6)
    crowd = 5 + rng.uniform(0, 1e-3, 20000)
    rows = [("a", float(v)) for v in [*crowd, *rng.uniform(-1e3, 1e3, 200)]]
    rows += [(None, float(v)) for v in range(101)] + [("none", float("nan")), ("none", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in metrics.distribution(df, ["k"], "v").collect()}
    for k in ("a", None, "one"):
        own = [v for key, v in rows if key == k]
        want = np.quantile(own, (.5, .95, .99))
        assert np.allclose((got[k].p50, got[k].p95, got[k].p99), want, rtol=0, atol=1e-12) and got[k].n == len(own)
    assert (got["none"].n, got["none"].mean, got["none"].p50) == (0, None, None)
    ranged = scale.even_ranges(df.where("k = 'a'").distinct(), ["k"], "v").groupBy("_range").count().collect()
    assert len(ranged) > 100 and max(r["count"] for r in ranged) < 2.5 * 20200 / scale.RANGES


def test_lovasz_with_errors_far_below_a_range(spark):
    rng = np.random.default_rng(9)
    p = rng.uniform(0, 1e-6, 500)
    truth = rng.integers(0, 2, 500)
    rows = [(int(t), [1 - a, a, 0.0, 0.0] if t == 0 else [a, 1 - a, 0.0, 0.0]) for t, a in zip(truth, p.tolist())]
    got = losses.lovasz_softmax(spark.createDataFrame(rows, "truth int, probs array<double>")).first().lovasz
    total = []
    for c in (0, 1):
        fg = truth == c
        err = np.where(fg, p, p)
        order = np.argsort(-err, kind="stable")
        f = fg[order].astype(float)
        jac = 1 - (f.sum() - f.cumsum()) / (f.sum() + (1 - f).cumsum())
        jac[1:] -= jac[:-1].copy()
        total.append((err[order] * jac).sum())
    assert abs(got - np.mean(total)) < 1e-12


def test_report_cube_sums_before_it_scores(spark):
    """Two frames of unlike size: a level's score comes from the summed confusion."""
    from scangrid.operators import reports
    rows = [(0, 0, "uniform", 1, 0, 0, 90), (0, 0, "uniform", 1, 1, 0, 10), (0, 1, "uniform", 1, 0, 1, 1),
            (0, 1, "uniform", 1, 1, 1, 1), (0, 0, "adaptive", 1, 0, 0, 100), (0, 1, "adaptive", 2, 1, 0, 5)]
    counts = spark.createDataFrame(rows, "sequence long, frame_id long, policy string, band int, truth int, pred int, n long")
    strata = spark.createDataFrame([(0, 0, "mixed-road"), (0, 1, None)], "sequence long, frame_id long, scene_stratum string")
    cube = reports.report_cube(counts, strata)
    got = {(r.policy, r.band): r for r in cube.where("level = 'band'").collect()}
    assert got["uniform", 1].labelled == 102 and abs(got["uniform", 1].miou - (90 / 101 + 1 / 12) / 2) < 1e-12
    assert got["uniform", 1].frame_id is None and got["adaptive", 2].miou == 0
    strata_rows = {(r.policy, r.scene_stratum): r.labelled for r in cube.where("level = 'stratum'").collect()}
    assert strata_rows == {("uniform", "mixed-road"): 100, ("uniform", None): 2, ("adaptive", "mixed-road"): 100,
                           ("adaptive", None): 5}
    per_frame = [r.miou for r in cube.where("level = 'frame' and policy = 'uniform'").collect()]
    own = spark.createDataFrame([], "sequence long, frame_id long, policy string, fine_truth int, dominant_class int, "
                                    "ix int, iy int, x double, y double, size double, min_z double, max_z double")
    bands = {(r.policy, r.band): r for r in reports.band_report(cube, own).collect()}
    assert abs(bands["uniform", 1].spread - np.std(per_frame)) < 1e-12 and bands["uniform", 1].frames == 2
    delta = {(r.time_interval, r.band): r.delta_miou for r in reports.interval_report(cube).collect()}
    assert abs(delta[0, 1] - (1 - got["uniform", 1].miou)) < 1e-12 and delta[0, 2] is None
    assert sorted(r.frames for r in reports.stratum_report(cube, strata).collect()) == [1, 1, 1, 1]
