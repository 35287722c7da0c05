"""Distance-bounded joins: nearest neighbours by tiles, the others as equi-joins on hash cells.

In an equi-join the query side visits the cells around it, candidates meet in one cell,
and an exact distance test follows. Equal coordinates are merged on both sides first,
so a pile of copies costs one row; candidates stream into a map-side aggregate
and are never kept per group.
"""
import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.groups import group_starts, whole_groups
from ..functions.nearest import nearest_within, pairs_within
from ..session import cut_lineage
from .scale import small

XYZ, XY = ("x", "y", "z"), ("x", "y")


def square_distance(dims=XYZ, a="", b="s_") -> Column:
    terms = [(F.col(f"{a}{d}") - F.col(f"{b}{d}")) * (F.col(f"{a}{d}") - F.col(f"{b}{d}"))
             for d in dims]
    return sum(terms[1:], terms[0])


def _cells(dims, size):
    return [F.floor(F.col(d) / size).alias(f"_c{d}") for d in dims]


def around(df: DataFrame, dims, size) -> DataFrame:
    """One row per neighbouring cell (3 per axis) of each row."""
    out = df
    for d in dims:
        at = F.floor(F.col(d) / size)
        out = out.withColumn(f"_c{d}", F.explode(F.sequence(at - 1, at + 1)))
    return out


def _sources(sources, keys, dims, size, extra=()):
    return sources.select(*keys, *[F.col(d).alias(f"s_{d}") for d in dims],
                          *_cells(dims, size), *extra)


def search_tiles(queries: DataFrame, sources: DataFrame, keys, reach, search, schema, dims=XYZ,
                 least=8.0) -> DataFrame:
    """Meet queries and the sources around them in tiles of the ground plane.

    Both sides are shuffled once, together; a source also goes to the tiles within ``reach``
    of it. A tile belongs to one group of ``keys``, so it holds a part of a frame at most,
    and a task takes many tiles at a time. ``search(q, q_places, q_tile, s, s_places,
    s_tile, reach)`` gets Arrow tables and numpy arrays and yields tables of ``schema``.
    ``reach`` may be a Column over the keys; rows of different reach are searched apart.
    """
    keys, dims = list(keys), list(dims)
    reach = reach if isinstance(reach, Column) else F.lit(float(reach))
    side = F.greatest(reach * 16, F.lit(float(least)))
    tile = [f"_k{i}" for i in range(len(keys))] + [f"_t{d}" for d in dims[:2]]

    def side_of(df, own):
        # New names for all columns: queries and sources often come from one table.
        out = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                        *[F.col(d).cast("double").alias(f"_p{d}") for d in dims], reach.alias("_reach"),
                        side.alias("_side"), F.struct(*df.columns).alias("_row"))
        margin = F.col("_reach") * (1 + 1e-9)
        for d in dims[:2]:
            low, high = (F.floor((F.col(f"_p{d}") + m) / F.col("_side")) for m in (-margin, margin))
            out = out.withColumn(f"_t{d}", F.floor(F.col(f"_p{d}") / F.col("_side")) if own
                                 else F.explode(F.sequence(low, high)))
        none = F.lit(None).cast(T.StructType((sources if own else queries).schema.fields))
        pair = (F.col("_row"), none) if own else (none, F.col("_row"))
        return out.select(*tile, "_reach", *[f"_p{d}" for d in dims], F.lit(own).alias("_own"),
                          pair[0].alias("_q"), pair[1].alias("_s"))

    def part(table, tiles, own, column):
        import pyarrow as pa
        mask = table.column("_own").to_numpy() == own
        rows = table.filter(pa.array(mask))
        struct = rows.column(column).combine_chunks()
        struct = struct if isinstance(struct, pa.StructArray) else pa.concat_arrays(struct.chunks)
        places = np.stack([rows.column(f"_p{d}").to_numpy().astype(float) for d in dims], 1)
        return pa.Table.from_arrays(struct.flatten(), names=[f.name for f in struct.type]), places, tiles[mask]

    def run(batches):
        for table in whole_groups(batches, ["_reach", *tile]):
            starts = group_starts(table, ["_reach", *tile])
            tiles = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            reaches = table.column("_reach").to_numpy()
            edges = np.flatnonzero(np.append(True, reaches[1:] != reaches[:-1]))
            for at, stop in zip(edges, np.append(edges[1:], table.num_rows)):
                one = table.slice(at, stop - at)
                own = part(one, tiles[at:stop], True, "_q")
                if own[0].num_rows:
                    for out in search(*own, *part(one, tiles[at:stop], False, "_s"), float(reaches[at])):
                        yield from out.combine_chunks().to_batches()
    rows = side_of(queries, True).unionByName(side_of(sources, False))
    return rows.repartition(*tile).sortWithinPartitions("_reach", *tile).mapInArrow(run, schema)


def nearest_capped(queries: DataFrame, sources: DataFrame, keys, cap, dims=XYZ,
                   source_id="point_id", strict=False, carry=(), rooted=False) -> DataFrame:
    """Nearest source of each query row within ``cap``: adds ``distance``, ``nearest_id``
    and the source's ``carry`` columns, null where nothing is within the cap.

    Inside a tile radii grow on a sorted grid. Ties go to the smaller id; with ``rooted``
    distances tie, else their squares. ``cap`` may be a Column over the keys.
    """
    keys, carry = list(keys), list(carry)
    s = sources.select(*dict.fromkeys([*keys, *dims, source_id, *carry]))
    names = [*queries.columns, "distance", "nearest_id", *carry]
    schema = T.StructType([*queries.schema.fields, T.StructField("distance", T.DoubleType()),
                           T.StructField("nearest_id", sources.schema[source_id].dataType),
                           *[T.StructField(c, sources.schema[c].dataType) for c in carry]])

    def search(left, own, own_tile, right, places, tile, reach):
        import pyarrow as pa
        ids = right.column(source_id).to_numpy()
        d2, at = nearest_within(own, places, ids, reach, strict, (own_tile, tile), rooted)
        take = pa.array(at, mask=at < 0)
        found = [pa.array(np.sqrt(d2), mask=at < 0), *[right.column(c).take(take) for c in (source_id, *carry)]]
        yield pa.table([*left.columns, *found], names=names)
    return search_tiles(queries, s, keys, cap, search, schema, dims, least=25.0)


def motion_residual(points: DataFrame, ego: DataFrame, keys=("sequence",), cap=3.0) -> DataFrame:
    """Distance of each point to the nearest ego-compensated point of the previous frame.

    Capped at 3 m; NULL in frames without a previous pose.
    """
    from ..functions.geom import rigid, rigid_apply
    ego = small(cut_lineage(ego))  # one row per frame
    previous = points.select(*keys, F.col("frame_id").alias("previous_frame"), "point_id",
                             "x", "y", "z")
    warped = previous.join(ego, [*keys, "previous_frame"])
    wx, wy, wz = rigid_apply(rigid("e_t"), "x", "y", "z")
    # 0.1 mm, far below sensor noise, makes equal warped positions compare equal.
    warped = warped.select(*keys, "frame_id", "point_id", *[
        (F.floor(v * 10000 + 0.5) / 10000).alias(d) for v, d in ((wx, "x"), (wy, "y"), (wz, "z"))])
    posed = points.join(ego.select(*keys, "frame_id", F.lit(True).alias("_posed")), [*keys, "frame_id"], "left")
    out = nearest_capped(posed, warped, [*keys, "frame_id"], cap)
    return out.withColumn("residual", F.when(F.col("_posed"), F.coalesce("distance", F.lit(float(cap))))).drop(
        "distance", "nearest_id", "_posed")


def within_radius(queries: DataFrame, sources: DataFrame, keys, r, dims=XY) -> DataFrame:
    """Query rows with any source closer than ``r``.

    A cell whose diagonal is under ``r`` settles its queries by key alone; only the
    other queries look at neighbouring cells.
    """
    keys = list(keys)
    inner = r / (len(dims) ** 0.5) * 0.99
    small = [f"_c{d}" for d in dims]
    at = [*keys, *dims]
    q = queries.select(*at).distinct()
    occupied = sources.select(*keys, *_cells(dims, inner)).distinct().withColumn("_hit", F.lit(True))
    tagged = q.select("*", *_cells(dims, inner)).join(occupied, [*keys, *small], "left").drop(*small)
    sure = tagged.where("_hit").select(*at)
    rest = around(tagged.where("_hit is null").select(*at), dims, r)
    cand = _sources(sources.select(*at).distinct(), keys, dims, r)
    cond = [rest[c] == cand[c] for c in [*keys, *small]]
    d2 = sum(((rest[d] - cand[f"s_{d}"]) * (rest[d] - cand[f"s_{d}"]) for d in dims[1:]),
             (rest[dims[0]] - cand[f"s_{dims[0]}"]) * (rest[dims[0]] - cand[f"s_{dims[0]}"]))
    match = cond[0]
    for c in cond[1:]:
        match = match & c
    close = rest.join(cand, match & (d2 < r * r), "left_semi").select(*at).distinct()
    return queries.join(sure.unionByName(close), at, "left_semi")


def neighbour_counts(points: DataFrame, keys, eps, dims=XYZ) -> DataFrame:
    """Points within ``eps`` of each distinct position, itself included.

    Positions without a finite place, or of a null key, have no row.
    """
    keys = list(keys)
    at = [*keys, *dims]
    merged = points.groupBy(*at).agg(F.count(F.lit(1)).alias("_w"))
    schema = T.StructType([*[f for f in merged.schema.fields if f.name != "_w"], T.StructField("neighbours", T.LongType())])

    def search(left, own, own_tile, right, places, tile, reach):
        import pyarrow as pa
        weight, total = right.column("_w").to_numpy(), np.zeros(len(own), np.int64)
        for query, source in pairs_within(own, places, reach, (own_tile, tile)):
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else query
            total[query[first]] += np.add.reduceat(weight[source], first) if len(first) else 0
        # A position finds itself, unless it has no place.
        out = left.drop(["_w"]).append_column("neighbours", pa.array(total))
        yield out.filter(pa.array(total > 0))
    known = merged.dropna(subset=at)
    return search_tiles(known, known, keys, eps, search, schema, dims)


def crop_around(points: DataFrame, anchors: DataFrame, keys, r=4.0) -> DataFrame:
    """Points within ``r`` (ground plane) of an anchor of the same frame."""
    keys = list(keys)
    cand = anchors.select(*keys, "anchor", F.col("x").alias("s_x"), F.col("y").alias("s_y"))
    cand = cand.withColumn("_cx", F.floor(F.col("s_x") / r)).withColumn(
        "_cy", F.floor(F.col("s_y") / r))
    for c in ("_cx", "_cy"):  # few anchors, many points: the anchors do the visiting
        cand = cand.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    p = points.select("*", *_cells(XY, r))
    return (p.join(cand, [*keys, "_cx", "_cy"]).where(square_distance(XY) < r * r)
            .drop("_cx", "_cy", "s_x", "s_y"))


# --- k nearest neighbours inside a block -------------------------------------

def knn(queries: DataFrame, sources: DataFrame, keys, k, radii, query_id="q_id",
        source_id="s_id", dims=XYZ) -> DataFrame:
    """The ``k`` nearest sources of each query, ranked by (squared distance, id).

    Radii grow. Neighbouring cells of size ``r`` answer every query whose k-th hit
    lies within ``r``; only queries left after the last radius, such as those of
    blocks with fewer than ``k`` sources, look at their whole block, which the
    resampler bounds to a few thousand points.
    """
    keys = list(keys)
    cand = sources.select(*keys, source_id, *[F.col(d).alias(f"s_{d}") for d in dims])
    rest = queries.select(*keys, query_id, *dims)
    w = W.partitionBy(*keys, query_id).orderBy("d2", source_id)

    def top(joined):
        return (joined.withColumn("d2", square_distance(dims))
                .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select(*keys, query_id, source_id, "d2", "rank"))
    out = None
    for r in radii:
        hashed = cand.select("*", *[F.floor(F.col(f"s_{d}") / r).alias(f"_c{d}") for d in dims])
        near = top(around(rest, dims, r).join(hashed, [*keys, *[f"_c{d}" for d in dims]]))
        done = near.where((F.col("rank") == k) & (F.col("d2") <= r * r)).select(*keys, query_id)
        settled = near.join(done, [*keys, query_id], "left_semi")
        out = settled if out is None else out.unionByName(settled)
        rest = rest.join(done, [*keys, query_id], "left_anti")
    return out.unionByName(top(rest.join(cand, keys)))


def radius_knn(neighbours: DataFrame, keys, r, query_id="q_id", source_id="s_id") -> DataFrame:
    """Neighbours farther than ``r`` are replaced by the nearest one."""
    first = F.min(F.when(F.col("rank") == 1, F.col(source_id))).over(
        W.partitionBy(*keys, query_id))
    return neighbours.withColumn(source_id, F.when(F.col("d2") <= r * r, F.col(source_id))
                                 .otherwise(first))


def ball_query(queries, sources, keys, r, k, query_id="q_id", source_id="s_id",
               dims=XYZ) -> DataFrame:
    """First ``k`` sources by id within ``r``; short lists repeat their first entry."""
    keys = list(keys)
    cand = sources.select(*keys, source_id, *[F.col(d).alias(f"s_{d}") for d in dims])
    hashed = cand.select("*", *[F.floor(F.col(f"s_{d}") / r).alias(f"_c{d}") for d in dims])
    q = queries.select(*keys, query_id, *dims)
    w = W.partitionBy(*keys, query_id).orderBy(source_id)
    hits = (around(q, dims, r).join(hashed, [*keys, *[f"_c{d}" for d in dims]])
            .where(square_distance(dims) <= r * r)
            .withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k))
    short = hits.groupBy(*keys, query_id).agg(F.min(source_id).alias(source_id),
                                              F.max("slot").alias("_have"))
    pad = (short.where(F.col("_have") < k)
           .withColumn("slot", F.explode(F.sequence(F.col("_have") + 1, F.lit(k)))))
    return hits.select(*keys, query_id, "slot", source_id).unionByName(
        pad.select(*keys, query_id, "slot", source_id))


def idw_interpolate(neighbours: DataFrame, features: DataFrame, keys, value="feat",
                    query_id="q_id", source_id="s_id") -> DataFrame:
    """Inverse squared distance weighted mean of the neighbours' values."""
    weight = 1.0 / (F.col("d2") + 1e-8)
    rows = neighbours.join(features.select(*keys, source_id, value), [*keys, source_id])
    return rows.groupBy(*keys, query_id).agg(
        (F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))


def group_features(groups: DataFrame, centres: DataFrame, sources: DataFrame, keys,
                   feature="feat", query_id="q_id", source_id="s_id", dims=XYZ) -> DataFrame:
    """Centre-relative coordinates and features of every grouped source."""
    c = centres.select(*keys, query_id, *[F.col(d).alias(f"c_{d}") for d in dims])
    s = sources.select(*keys, source_id, feature, *dims)
    rows = groups.join(s, [*keys, source_id]).join(c, [*keys, query_id])
    return rows.select(*keys, query_id, "slot", source_id, feature,
                       *[(F.col(d) - F.col(f"c_{d}")).alias(f"d{d}") for d in dims])


def max_pool(grouped: DataFrame, keys, columns, query_id="q_id") -> DataFrame:
    return grouped.groupBy(*keys, query_id).agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def temporal_match(leaf_rows: DataFrame, ego: DataFrame, keys=("sequence",), r=0.15) -> DataFrame:
    """Each leaf centre with the nearest ego-compensated leaf centre of the previous frame."""
    from ..functions.geom import rigid, rigid_apply
    half = F.col("size") / 2
    centres = leaf_rows.withColumn("cx", F.col("x") + half).withColumn("cy", F.col("y") + half)
    centres = centres.withColumn("leaf_id", (F.col("size_mm").cast("long") * 67108864
                                             + (F.col("lx") + 4096) * 8192 + F.col("ly") + 4096))
    # Both sides are leaves of one map, which is built and written once.
    centres = cut_lineage(centres.select(*keys, "frame_id", "leaf_id", "size_mm", "dominant_class", "cx", "cy", "mean_z"))
    old = centres.select(*keys, F.col("frame_id").alias("previous_frame"), "leaf_id",
                         F.col("dominant_class").alias("old_class"),
                         F.col("size_mm").alias("old_size_mm"), "cx", "cy", "mean_z")
    ego = small(cut_lineage(ego))  # one row per frame
    old = old.join(ego, [*keys, "previous_frame"])
    wx, wy, wz = rigid_apply(rigid("e_t"), "cx", "cy", "mean_z")
    # Averages may differ in their last bits between two evaluations of a plan, so
    # positions are snapped to 0.1 mm (off-centre, as short decimals sit on ties).
    def snap(v):
        return F.floor(v * 10000 + 0.500001) / 10000
    old = old.select(*keys, "frame_id", "leaf_id", "old_class", "old_size_mm",
                     *[snap(v).alias(d) for v, d in ((wx, "x"), (wy, "y"), (wz, "z"))])
    new = centres.join(ego.select(*keys, "frame_id"), [*keys, "frame_id"]).select(
        *keys, "frame_id", "size_mm", "dominant_class", "leaf_id",
        *[snap(F.col(c)).alias(d) for c, d in (("cx", "x"), ("cy", "y"), ("mean_z", "z"))])
    at = [*keys, "frame_id"]
    return nearest_capped(new, old.withColumn("old_z", F.col("z")), at, r, source_id="leaf_id", strict=True,
                          rooted=True, carry=("old_class", "old_size_mm", "old_z"))


def temporal_summary(matches: DataFrame, keys=("sequence", "frame_id")) -> DataFrame:
    hit = F.col("nearest_id").isNotNull()
    return matches.groupBy(*keys).agg(
        F.avg(hit.cast("double")).alias("overlap_fraction"),
        F.avg(F.when(hit, (F.col("dominant_class") != F.col("old_class")).cast("double")))
        .alias("semantic_flicker_rate"),
        F.avg(F.when(hit, (F.col("size_mm") != F.col("old_size_mm")).cast("double")))
        .alias("resolution_change_rate"),
        F.avg(F.when(hit, F.abs(F.col("z") - F.col("old_z")))).alias("height_stability_mae_m"))
