"""Density clustering, object boxes and terrain ribbons over many frames at once."""
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geom as G
from ..functions.groups import group_starts, whole_groups
from ..functions.nearest import nearest_within, pairs_within
from ..session import cut_lineage, stored
from .grid import VOTE_SCALE
from .spatial import XYZ, search_tiles, within_radius


def first_of_voxel(points: DataFrame, keys, size, dims=XYZ, carry=(), count=None) -> DataFrame:
    """Lowest point id of every occupied voxel, with that point's coordinates and ``carry`` columns;
    ``count`` names a column for the voxel's points."""
    cols = [F.min_by(F.col(d), F.col("point_id")).alias(d) for d in (*dims, *carry)]
    cols += [F.count(F.lit(1)).alias(count)] if count else []
    return points.groupBy(*keys, *[G.voxel_index(d, size).alias(f"v{d}") for d in dims]).agg(
        F.min("point_id").alias("point_id"), *cols)


def contract(edges: DataFrame, turn=0):
    """One round over ``edges(a, b)``: ``(pointers(node, to), fewer edges)``.

    Every node points at that of itself and its neighbours which comes first in an order
    shuffled anew each ``turn``, then at what that one points at. Edges are moved to where
    their ends point; edges inside one place go, equal ones become one.
    """
    def order(node):
        return F.xxhash64(F.col(node), F.lit(turn))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("node")).agg(
        F.min_by("b", order("b")).alias("_near"), F.min(order("b")).alias("_order")).select(
        "node", F.when(F.col("_order") < order("node"), F.col("_near")).otherwise(F.col("node")).alias("to"))
    far = near.select(F.col("node").alias("to"), F.col("to").alias("_far"))
    pointers = cut_lineage(near.join(far, "to").select("node", F.col("_far").alias("to")))
    at_a, at_b = (pointers.select(F.col("node").alias(end), F.col("to").alias(f"_{end}")) for end in "ab")
    moved = edges.join(at_a, "a").join(at_b, "b").where("_a <> _b").select(
        F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    return pointers, cut_lineage(moved)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id reachable from each node.

    ``nodes(id)``, ``edges(a, b)``. Every round contracts the edges, so each reads less than
    the one before and their number grows with the logarithm of the nodes, whatever the
    shape of the graph. The rounds' pointers are then followed backwards. A round writes
    twice to the checkpoint folder.
    """
    live = cut_lineage(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not live.isEmpty():
        pointers, live = contract(live, len(rounds))
        rounds.append(pointers)
    root = None
    for pointers in reversed(rounds):
        if root is None:
            root = pointers.withColumnRenamed("to", "root")
        else:
            further = root.select(F.col("node").alias("to"), "root")
            root = pointers.join(further, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    ids = nodes.select("id").distinct()
    if root is None:
        return ids.withColumn("label", F.col("id"))
    root = cut_lineage(root)
    least = root.groupBy("root").agg(F.min("node").alias("label"))
    label = root.join(least, "root").select(F.col("node").alias("id"), "label")
    return ids.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _sums_within(queries, sources, weight, eps, tiles):
    """Summed ``weight`` of all sources within ``eps`` of each query, in its tile."""
    total = np.zeros(len(queries), np.int64)
    for query, source in pairs_within(queries, sources, eps, tiles):
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else query
        total[query[first]] += np.add.reduceat(weight[source], first) if len(first) else 0
    return total


def _weights_within(queries: DataFrame, sources: DataFrame, keys, eps) -> DataFrame:
    """Adds ``total``: the summed ``w`` of all sources within ``eps`` of each query row."""
    schema = T.StructType([*queries.schema.fields, T.StructField("total", T.LongType())])

    def search(left, own, own_tile, right, places, tile, reach):
        import pyarrow as pa
        total = _sums_within(own, places, right.column("w").to_numpy(), reach, (own_tile, tile))
        yield left.append_column("total", pa.array(total))
    return search_tiles(queries, sources.select(*keys, *XYZ, "w"), keys, eps, search, schema)


def _edges_within(core: DataFrame, keys, eps) -> DataFrame:
    """``(a, b)``, a < b: nodes with points within ``eps`` of each other, each pair once per search."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def search(left, own, own_tile, right, places, tile, reach):
        import pyarrow as pa
        mine, theirs = left.column("node").to_numpy(), right.column("node").to_numpy()
        for query, source in pairs_within(own, places, reach, (own_tile, tile)):
            a, b = mine[query], theirs[source]
            pairs = np.unique(np.stack([a[a < b], b[a < b]], 1), axis=0)
            yield pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return search_tiles(core, core, keys, eps, search, schema)


def _local_components(count, a, b):
    """Smallest node reachable from each of ``count`` nodes over edges ``a``, ``b``."""
    root = np.arange(count)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _cluster_tiles(places, tile, ring, edge, weight, ids, least, eps):
    """Density clusters of the points of many tiles, as far as each tile sees them.

    ``ring`` is 0 for a tile's own points, 1 for those within ``eps`` of it, 2 for those that
    only make the neighbours of ring 1 complete. Returns per point whether it is in a cluster,
    the smallest core id that its tile knows of it, and whether the cluster may go on in other
    tiles; and the points whose ids join clusters of different tiles.

    A cell of diagonal at most eps holding enough points is core as a whole, and all core
    points of one cell are one graph node, so dense cells are settled by counting.
    """
    label, found, open_ = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    kept = np.flatnonzero(np.isfinite(places).all(1))
    if not len(kept):
        return found, label, open_, kept
    cell = np.floor(places[kept] / (eps / 3 ** 0.5 * (1 - 1e-9)))
    order = np.lexsort((*cell.T, tile[kept]))
    fresh = np.append(True, (np.diff(cell[order], axis=0) != 0).any(1) | (np.diff(tile[kept][order]) != 0))
    home = np.empty(len(kept), np.int64)
    home[order] = np.cumsum(fresh) - 1
    crowd = np.zeros(fresh.sum(), np.int64)
    np.add.at(crowd, home, weight[kept])
    node = np.full(len(ids), -1)
    node[kept] = home
    known = kept[ring[kept] <= 1]
    core = np.zeros(len(ids), bool)
    core[known] = crowd[node[known]] >= least[known]
    sparse = known[~core[known]]
    total = _sums_within(places[sparse], places, weight, eps, (tile[sparse], tile))
    core[sparse] = total >= least[sparse]

    cores, own = np.flatnonzero(core), np.flatnonzero(core & (ring == 0))
    if not len(cores):
        return found, label, open_, cores
    node[cores] = np.unique(node[cores], return_inverse=True)[1]
    count = int(node[cores].max()) + 1
    # Whatever other tiles know a core point, its own tile tells where it belongs.
    linked = core & edge & (ring == 0)
    pairs = [np.empty(0, np.int64)]
    for query, source in pairs_within(places[own], places[cores], eps, (tile[own], tile[cores])):
        source = cores[source]
        linked[source[ring[source] > 0]] = True
        a, b = node[own[query]], node[source]
        pairs.append(np.unique(a[a != b] * count + b[a != b]))
    pairs = np.unique(np.concatenate(pairs))
    root = _local_components(count, pairs // count, pairs % count)
    lowest = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(lowest, root[node[cores]], ids[cores])
    rest = np.flatnonzero((ring == 0) & ~core)
    _, at = nearest_within(places[rest], places[cores], ids[cores], eps, True, (tile[rest], tile[cores]))
    rest, at = rest[at >= 0], cores[at[at >= 0]]
    linked[at[ring[at] > 0]] = True
    node[rest] = node[at]
    found[cores], found[rest] = True, True
    label[found] = lowest[root[node[found]]]
    goes_on = np.zeros(count, bool)
    goes_on[root[node[np.flatnonzero(linked)]]] = True
    open_[found] = goes_on[root[node[found]]]
    return found, label, open_, np.flatnonzero(linked)


def _clustered_tiles(places: DataFrame, keys, eps, min_samples, weight=None) -> DataFrame:
    """Each row of ``places`` with ``_label`` (null: noise) and ``_open``, by tiles of the ground plane.

    Rows are shuffled once, with copies for tiles within two radii, so that a tile can tell which
    points within one radius are core. Further rows have a ``_link``: a point id that is in the
    cluster ``_label``. A tile is part of one group of ``keys``; a task takes many at a time.
    """
    eps = eps if isinstance(eps, Column) else F.lit(float(eps))
    least = min_samples if isinstance(min_samples, Column) else F.lit(min_samples)
    tile = [*keys, "_tx", "_ty"]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = places.withColumns({"_eps": F.when(known, eps), "_least": least.cast("long")})
    side = F.greatest(F.coalesce("_eps", F.lit(0.0)) * 32, F.lit(8.0))
    margin, ring, several = F.coalesce("_eps", F.lit(0.0)) * (1 + 1e-9), [], []
    for d in "xy":
        at = F.coalesce(F.col(d).cast("double"), F.lit(0.0))
        low, near, home, far, high = (F.floor((at + margin * m) / side) for m in (-2, -1, 0, 1, 2))
        rows = rows.withColumn(f"_t{d}", F.explode(F.sequence(low, high)))
        t = F.col(f"_t{d}")
        ring.append(F.when(t == home, 0).when((t >= near) & (t <= far), 1).otherwise(2))
        several.append(near != far)
    rows = rows.withColumns({"_ring": F.greatest(*ring), "_edge": several[0] | several[1]})
    used = [*keys, *XYZ, "point_id", *([weight] if weight else [])]
    rest = [c for c in places.columns if c not in used]
    rows = rows.select(*tile, *XYZ, "point_id", *([weight] if weight else []), "_eps", "_least", "_ring", "_edge",
                       *[F.when(F.col("_ring") == 0, F.col(c)).alias(c) for c in rest])
    schema = T.StructType([*places.schema.fields, T.StructField("_label", T.LongType()),
                           T.StructField("_open", T.BooleanType()), T.StructField("_link", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    arrow, columns = to_arrow_schema(schema), places.columns

    def run(batches):
        import pyarrow as pa
        for table in whole_groups(batches, tile):
            starts = group_starts(table, tile)
            tiles = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            ring, reach, ids = (table.column(c).to_numpy() for c in ("_ring", "_eps", "point_id"))
            ids = ids.astype(np.int64)
            at = np.stack([table.column(d).to_numpy().astype(float) for d in XYZ], 1)
            n = table.column(weight).to_numpy() if weight else np.ones(len(ids), np.int64)
            edge, least = (table.column(c).to_numpy() for c in ("_edge", "_least"))
            found, label = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            open_, links = np.zeros(len(ids), bool), []
            for eps in np.unique(reach[np.isfinite(reach)]):
                rows = np.flatnonzero(reach == eps)
                found[rows], label[rows], open_[rows], linked = _cluster_tiles(
                    at[rows], tiles[rows], ring[rows], edge[rows], n[rows], ids[rows], least[rows], float(eps))
                links.append(rows[linked])
            own = pa.array(ring == 0)
            out = {c: table.column(c).filter(own) for c in columns}
            out.update(_label=pa.array(label, mask=~found).filter(own), _open=pa.array(open_).filter(own))
            yield from _filled(out, arrow).to_batches()
            links = np.concatenate(links) if links else np.empty(0, np.int64)
            links = pa.array(links[ids[links] != label[links]])
            out = {c: table.column(c).take(links) for c in keys}
            out.update(_label=pa.array(label).take(links), _link=pa.array(ids).take(links))
            yield from _filled(out, arrow).to_batches()
    rows = rows.repartition(*tile).withColumn("_hash", F.xxhash64(*tile))
    # Sorting by a hash first seldom looks at other columns; it is not shuffled.
    return rows.sortWithinPartitions("_hash", *tile).drop("_hash").mapInArrow(run, schema)


def _filled(columns, schema):
    """Table of ``schema``, null where there is no column."""
    import pyarrow as pa
    rows = len(columns["_label"])
    columns = [columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def dbscan(points: DataFrame, keys, eps, min_samples, distinct=False) -> DataFrame:
    """Adds ``cluster``: the smallest core point id of the cluster, NULL for noise.

    Clusters never cross groups of ``keys``; point ids need to be unique within one only.

    Positions are merged first, unless the caller knows that they are ``distinct``. Tiles of the
    ground plane are clustered alone and told to disk; only point ids at their edges are then
    joined across tiles. ``eps`` and ``min_samples`` may be Columns over the keys, so groups with
    different settings are clustered in one run.
    """
    keys = list(keys)
    at = [*keys, *XYZ]
    if distinct:
        told = stored(_clustered_tiles(points, keys, eps, min_samples))
    else:
        merged = points.groupBy(*at).agg(F.count(F.lit(1)).alias("_w"), F.min("point_id").alias("point_id"))
        told = stored(_clustered_tiles(merged, keys, eps, min_samples, "_w"))
    links = told.where("_link is not null").select(*keys, "_label", "_link").distinct()
    places = told.where("_link is null").drop("_link")
    # Point ids may restart in every group, so nodes get numbers of their own.
    ends = links.select(*keys, F.col("_label").alias("_id")).union(links.select(*keys, "_link")).distinct()
    node = cut_lineage(ends.withColumn("node", F.monotonically_increasing_id()))
    a, b = (node.select(*keys, F.col("_id").alias(i), F.col("node").alias(n)) for i, n in (("_label", "a"), ("_link", "b")))
    edges = links.join(a, [*keys, "_label"]).join(b, [*keys, "_link"]).select("a", "b")
    comp = connected_components(node.select(F.col("node").alias("id")), edges)
    named = node.join(comp.withColumnRenamed("id", "node"), "node")
    least = named.groupBy("label").agg(F.min("_id").alias("cluster"))
    whole = cut_lineage(named.join(least, "label").select(*keys, F.col("_id").alias("_label"), "cluster"))
    kind = points.schema["point_id"].dataType
    out = places.where("not _open").withColumn("cluster", F.col("_label")).unionByName(
        places.where("_open").join(whole, [*keys, "_label"], "left").withColumn(
            "cluster", F.coalesce("cluster", "_label"))).withColumn("cluster", F.col("cluster").cast(kind))
    if distinct:
        return out.select(*points.columns, "cluster")
    return points.join(out.where("cluster is not null").select(*at, "cluster"), at, "left")


# class, neighbourhood radius, minimum neighbours, smallest box
PROPOSAL_RULES = ((2, 1.0, 5, (0.15, 0.15, 0.15)), (3, 0.5, 3, (0.3, 0.3, 0.4)))


#: Units of a metre in which the main axis of a box is found.
UNITS = 100_000


def oriented_boxes(members: DataFrame, keys, floor) -> DataFrame:
    """Box of each group: heading of the main axis, extents in that frame.

    ``floor`` gives the least sizes as Columns over the keys. The heading is reported
    in (-90, 90] degrees; an axis has no sign. All sums are
    partial aggregates; the second pass only adds four extremes per group.
    """
    keys = list(keys)
    # Whole hundredths of a millimetre add up to the same sums in any order, so a heading that
    # hangs on equal spreads does not change from run to run. Sums of products outgrow a long.
    xi, yi = (F.floor(F.col(d) * UNITS + 0.5) for d in "xy")

    def products(a, b):
        return F.sum((a * b).cast("decimal(18,0)"))
    first = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.sum(xi).alias("sx"), F.sum(yi).alias("sy"),
        products(xi, yi).alias("sxy"), products(xi, xi).alias("sxx"), products(yi, yi).alias("syy"),
        F.min("z").alias("z0"), F.max("z").alias("z1"), _mean_conf().alias("confidence"))

    def spread_of(product, a, b):
        whole = [F.col(c).cast(kind) for c, kind in zip(
            ("points", product, a, b), ("decimal(10,0)", "decimal(28,0)", "decimal(19,0)", "decimal(19,0)"))]
        return (whole[0] * whole[1] - whole[2] * whole[3]).cast("double")
    cxy, cxx, cyy = spread_of("sxy", "sx", "sy"), spread_of("sxx", "sx", "sx"), spread_of("syy", "sy", "sy")
    yaw = F.when(F.col("points") > 2, F.atan2(2 * cxy, cxx - cyy) / 2).otherwise(0.0)
    first = first.select(*keys, "points", "z0", "z1", "confidence", yaw.alias("yaw"), *_centre())
    u, v = _turned()
    spread = (members.join(first.select(*keys, "mx", "my", "yaw"), keys)
              .groupBy(*keys).agg(F.min(u).alias("u0"), F.max(u).alias("u1"),
                                  F.min(v).alias("v0"), F.max(v).alias("v1")))
    return _boxes(first.join(spread, keys), keys, floor)


def _mean_conf():
    """Mean of whole billionths, whatever the order of its sum; of values as they are if some are too large."""
    whole = F.sum(F.floor(F.col("conf") * VOTE_SCALE + 0.5)) / F.count("conf") / VOTE_SCALE
    return F.when(F.max(F.abs("conf")) < 1000, whole).otherwise(F.avg("conf"))


def boxes_of_single_points(points: DataFrame, keys, floor) -> DataFrame:
    """What ``oriented_boxes`` gives for groups of one point each, without grouping."""
    keys = list(keys)
    sums = [F.floor(F.col(d) * UNITS + 0.5).alias(f"s{d}") for d in "xy"]
    rows = points.select(*keys, "x", "y", F.col("z").alias("z0"), F.col("z").alias("z1"), F.lit(0.0).alias("yaw"),
                         F.lit(1).cast("long").alias("points"), F.col("conf").cast("double").alias("confidence"), *sums)
    u, v = _turned()
    rows = rows.select("*", *_centre()).select("*", u.alias("u0"), u.alias("u1"), v.alias("v0"), v.alias("v1"))
    return _boxes(rows, keys, floor)


def _centre():
    return [(F.col(f"s{d}") / F.col("points") / UNITS).alias(f"m{d}") for d in "xy"]


def _turned():
    """A member's place in the frame of its group's box."""
    rx, ry = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return rx * F.cos("yaw") + ry * F.sin("yaw"), ry * F.cos("yaw") - rx * F.sin("yaw")


def _boxes(groups: DataFrame, keys, floor) -> DataFrame:
    mu, mv = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
    return groups.select(
        *keys,
        (F.col("mx") + mu * F.cos("yaw") - mv * F.sin("yaw")).alias("center_x"),
        (F.col("my") + mu * F.sin("yaw") + mv * F.cos("yaw")).alias("center_y"),
        ((F.col("z0") + F.col("z1")) / 2).alias("center_z"),
        F.greatest(F.col("u1") - F.col("u0"), floor[0]).alias("size_u"),
        F.greatest(F.col("v1") - F.col("v0"), floor[1]).alias("size_v"),
        F.greatest(F.col("z1") - F.col("z0"), floor[2]).alias("size_z"),
        "yaw", "confidence", "points")


def _per_class(rules, pick):
    out = F.when(F.lit(False), pick(rules[0]))
    for rule in rules:
        out = out.when(F.col("class") == rule[0], pick(rule))
    return out


def _obstacles(points: DataFrame, keys, rules) -> DataFrame:
    """Points of the rules' classes that have a group and a place."""
    return points.where(F.col("pred").isin([r[0] for r in rules])).withColumn("class", F.col("pred")).dropna(
        subset=[*keys, *XYZ])


def obstacle_voxels(points: DataFrame, keys, rules=PROPOSAL_RULES, voxel=0.2, carry=()) -> DataFrame:
    """The lowest point of every voxel of obstacle points, the voxel's number of points ``n`` and the
    voxel's group, a cluster or a lone voxel: ``object_id`` and ``fallback``.

    Only one point per occupied voxel is clustered, which bounds the density.
    """
    keys = [*keys, "class"]
    reps = first_of_voxel(_obstacles(points, keys[:-1], rules), keys, voxel, carry=carry, count="n")
    # The lowest point lies in the voxel, so the voxel's index need not travel.
    labelled = dbscan(reps.drop(*[f"v{d}" for d in XYZ]), keys, _per_class(rules, lambda r: r[1]),
                      _per_class(rules, lambda r: r[2]), distinct=True)
    return labelled.select(*keys, "point_id", *XYZ, *carry, "n", F.coalesce("cluster", "point_id").alias("object_id"),
                           F.col("cluster").isNull().alias("fallback"))


def _members(points: DataFrame, voxels: DataFrame, keys, rules, voxel) -> DataFrame:
    index = [G.voxel_index(d, voxel).alias(f"v{d}") for d in XYZ]
    at = [*keys, "class", "vx", "vy", "vz"]
    rep = voxels.select(*keys, "class", *index, "object_id", "fallback")
    return _obstacles(points, keys, rules).select("*", *index).join(rep, at).drop("vx", "vy", "vz")


def object_members(points: DataFrame, keys, rules=PROPOSAL_RULES, voxel=0.2) -> DataFrame:
    """Full-resolution obstacle points with their group: a cluster, or a lone voxel."""
    return _members(points, obstacle_voxels(points, keys, rules, voxel), list(keys), rules, voxel)


def object_proposals(points: DataFrame, keys=("sequence", "frame_id"), rules=PROPOSAL_RULES, voxel=0.2):
    """Boxes of obstacle classes; lone voxels become their own fallback boxes.

    A voxel of one point needs no second look at the points, and a lone one is a box already.
    """
    floor = [_per_class(rules, lambda r, i=i: r[3][i]) for i in range(3)]
    keys = list(keys)
    by = [*keys, "object_id", "fallback", "class"]
    voxels = obstacle_voxels(points, keys, rules, voxel, carry=["conf"])
    single = F.col("n") == 1
    cols = [*by, *XYZ, "conf"]
    members = voxels.where(single & ~F.col("fallback")).select(*cols).unionByName(
        _members(points, voxels.where(~single), keys, rules, voxel).select(*cols))
    return boxes_of_single_points(voxels.where(single & F.col("fallback")), by, floor).unionByName(
        oriented_boxes(stored(members), by, floor))


def fit_ribbons(members: DataFrame, keys, samples=24, tolerance=0.2, least=5) -> DataFrame:
    """Quadratic curve along the main axis of each group, refitted once on inliers.

    Sums of powers are enough for the normal equations, so a group of any size is
    fitted by partial aggregation.
    """
    keys = list(keys)
    base = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.avg("z").alias("mz"), F.covar_samp("x", "y").alias("cxy"),
        F.var_samp("x").alias("cxx"), F.var_samp("y").alias("cyy"))
    base = base.where(F.col("n") >= least).select(
        *keys, "mx", "my", "mz",
        (F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2).alias("yaw"))
    rx, ry = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    rows = members.join(base, keys).select(
        *keys, (rx * F.cos("yaw") + ry * F.sin("yaw")).alias("u"),
        (ry * F.cos("yaw") - rx * F.sin("yaw")).alias("v"))
    rows = rows.withColumn("keep", F.lit(True))
    for _ in range(2):
        u, v = F.col("u"), F.col("v")
        power = {1: u, 2: u * u, 3: u * u * u, 4: u * u * u * u}
        kept = rows.where("keep").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("s0"), *[F.sum(e).alias(f"s{i}") for i, e in power.items()],
            F.sum(v).alias("r0"), F.sum(u * v).alias("r1"), F.sum(u * u * v).alias("r2"))
        s = {i: F.col(f"s{i}") for i in range(5)}
        r = {i: F.col(f"r{i}") for i in range(3)}

        def det(m):
            return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
                    - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
                    + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))
        matrix = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
        whole = det(matrix)
        coef = []
        for c in range(3):
            swapped = [[r[i] if j == c else matrix[i][j] for j in range(3)] for i in range(3)]
            coef.append(F.when(F.abs(whole) > 1e-12, det(swapped) / whole).alias(f"q{c}"))
        curve = kept.where(F.col("s0") >= 3).select(*keys, *coef)
        rows = rows.select(*keys, "u", "v").join(curve, keys)
        slope = F.col("q1") + 2 * F.col("q2") * F.col("u")
        gap = F.abs(F.col("v") - (F.col("q0") + F.col("q1") * F.col("u")
                                  + F.col("q2") * F.col("u") * F.col("u")))
        rows = rows.withColumn("keep", F.coalesce(gap / F.sqrt(1 + slope * slope) < tolerance,
                                                  F.lit(False)))
        # A group that loses too many inliers yields no ribbon.
        enough = rows.groupBy(*keys).agg(F.count_if("keep").alias("_k")).where(
            F.col("_k") >= least).select(*keys)
        rows = rows.join(enough, keys, "left_semi")
    ends = rows.where("keep").groupBy(*keys).agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.count(F.lit(1)).alias("points"),
        *[F.first(f"q{c}").alias(f"q{c}") for c in range(3)])
    step = F.col("u0") + (F.col("u1") - F.col("u0")) * F.col("i") / (samples - 1)
    line = (ends.join(base, keys)
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
            .withColumn("u", step)
            .withColumn("v", F.col("q0") + F.col("q1") * F.col("u")
                        + F.col("q2") * F.col("u") * F.col("u")))
    return line.select(
        *keys, "points", "i",
        (F.col("mx") + F.col("u") * F.cos("yaw") - F.col("v") * F.sin("yaw")).alias("x"),
        (F.col("my") + F.col("u") * F.sin("yaw") + F.col("v") * F.cos("yaw")).alias("y"),
        F.col("mz").alias("z"))


def terrain_candidates(points: DataFrame, keys, reach=0.8) -> DataFrame:
    """Low terrain points next to the road (needs a ``height`` column)."""
    low = points.where((F.col("pred") == 1) & (F.col("height") > 0.03) & (F.col("height") < 0.5))
    return within_radius(low, points.where("pred = 0"), keys, reach)


def terrain_ribbons(points: DataFrame, keys=("sequence", "frame_id")) -> DataFrame:
    keys = list(keys)
    thin = first_of_voxel(terrain_candidates(points, keys), keys, 0.12)
    grouped = dbscan(thin.select(*keys, "point_id", *XYZ), keys, 1.0, 5, distinct=True).where(
        "cluster is not null")
    return fit_ribbons(grouped, [*keys, "cluster"])
