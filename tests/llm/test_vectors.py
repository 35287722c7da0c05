"""Vector operators against brute force and on odd rows."""
import numpy as np
import pytest

from scangrid.llm import neighbours, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, copies string"


def odd_rows(dim, first):
    nan, inf = float("nan"), float("inf")
    return [(first, None), (first + 1, [0.0] * dim), (first + 2, [nan] * dim), (first + 3, [inf] + [1.0] * (dim - 1)),
            (first + 4, [None] + [1.0] * (dim - 1)), (first + 5, []), (first + 6, [1.0, 2.0])]


@pytest.fixture(scope="module")
def space(spark):
    """Scattered vectors, a tight group, many equal ones, scaled copies and unusable ones."""
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 16))
    v[500:560] = v[0] + 0.05 * rng.standard_normal((60, 16))
    v[560:640] = v[1]
    v[640:650] = 2 * v[2]
    v = v.astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + odd_rows(16, 700)
    df = spark.createDataFrame([(i, x, 0, "x", "y") for i, x in rows], SCHEMA)
    unit = v.astype(float)
    return df, unit / np.linalg.norm(unit, axis=1, keepdims=True)


def test_neighbours_recall_and_order(spark, space):
    df, unit = space
    got = neighbours.nearest(df, "vec_id % 5 = 0", shard_rows=100, leaf_rows=16, cells=4).collect()
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == set(range(0, 700, 5))
    hits = total = 0
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - sims[q, r["vec_id"]]) < 1e-12 for r in rows)
        keys = [(-r["score"], r["vec_id"]) for r in rows]
        assert keys == sorted(keys) and len({r["vec_id"] for r in rows}) == 5 and q not in {r["vec_id"] for r in rows}
        best = np.sort(sims[q])[-5]
        hits += sum(r["score"] >= best - 1e-9 for r in rows)
        total += 5
    assert hits / total >= 0.9
    # Of equal vectors the smallest ids come, whatever else the search meets.
    equal = [r["vec_id"] for r in sorted(found[600], key=lambda r: r["rank"])]
    assert equal == [1, 560, 561, 562, 563]


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "", ""), (50, [1.0, 1.0], 0, "", ""), (None, [1.0, 0.5], 0, "", ""),
                                (7, [0.0, 1.0], 0, "", ""), (7, [0.0, 1.0], 0, "", "")], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df, "vec_id % 50 = 0").collect())
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert neighbours.nearest(df.where("false"), "vec_id % 50 = 0").count() == 0


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.991) < 1e-3
    assert abs(neighbours.chi_square_quantile(0.97, 8) - 17.010) < 1e-2


@pytest.mark.parametrize("leaf, block", [(512, 1024), (40, 16)])
def test_forest_finds_all_links(spark, space, leaf, block):
    df, unit = space
    got = {r["vec_id"]: r for r in vector_dedup.linked(df, leaf_rows=leaf, block_rows=block).collect()}
    close = unit @ unit.T >= 0.95 - 1e-9
    np.fill_diagonal(close, False)
    label = np.arange(700)
    i, j = np.nonzero(close)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    assert len(got) == 707
    for v in range(700):
        assert (got[v]["n_links"], got[v]["component_id"]) == (close[v].sum(), label[v])
        assert got[v]["kept"] == (label[v] == v)
    for v in range(700, 707):
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (0, v, True)


def test_forest_of_equal_rows_and_none(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 0, "", ""), (3, [1.0, 0.0], 0, "", ""), (None, [2.0, 0.0], 0, "", ""),
                                (None, None, 0, "", "")], SCHEMA)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in vector_dedup.linked(df).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]
    assert vector_dedup.linked(df.where("false")).count() == 0
