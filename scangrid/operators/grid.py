"""Elevation-map policies over many frames at once.

Points are aggregated once into 5 cm cells; every coarser tier is a sum over
those cells inside their 0.5 m parent (at most 100 cells), so points are
shuffled once, hot cells are combined map-side, and no tier rescans the points.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import cells as C, geom as G, text
from ..functions.groups import group_starts, whole_groups
from ..schema import (FRAME_KEYS, HEIGHT_VARIANCE_LIMIT, LEAF_BYTES, POLICIES, SAFETY_RADIUS_M,
                      UNIT_M, UNKNOWN_CLASS)
from ..session import cut_lineage
from .scale import null_safe_join

# What each policy looks at: stretched distance, near-field floor, height spread,
# class mixture. `uniform` never leaves the finest tier.
POLICY_RULES = {
    "distance": dict(fovea=False, safety=False, height=False, mixture=False),
    "ground": dict(fovea=False, safety=True, height=True, mixture=False),
    "semantic": dict(fovea=False, safety=False, height=False, mixture=True),
    "adaptive": dict(fovea=True, safety=True, height=True, mixture=True),
}
# Confidence votes are summed as whole billionths: integer sums do not depend on
# the order tasks finish in, so equal votes stay equal.
VOTE_SCALE = 1_000_000_000

_LOWS, _HIGHS = ["zmin"], ["zmax"]


def _sum_names(columns):
    wanted = ["n", "sz", "szz"] + [f"{p}{k}" for p in "kvt" for k in range(4)]
    return [c for c in wanted if c in columns]


def _measure_names(columns):
    return _sum_names(columns) + [c for c in _LOWS + _HIGHS if c in columns]


def fine_cells(points: DataFrame, keys=FRAME_KEYS, cls="pred", conf="conf", truth=None,
               size=UNIT_M, tested=False) -> DataFrame:
    """Statistics of every occupied cell of one size (finite points under 100 m).

    ``tested`` leaves out all that no policy looks at.
    """
    conf = G.as_col(conf) if conf is not None else F.lit(1.0)
    cls = G.as_col(cls)
    vote = F.floor(conf * VOTE_SCALE + 0.5)
    one, none = F.lit(1), F.lit(0)
    aggs = [F.count(one).alias("n"), F.sum("z").alias("sz"),
            F.sum(F.col("z") * F.col("z")).alias("szz")]
    if not tested:
        aggs += [F.min("z").alias("zmin"), F.max("z").alias("zmax")]
    for k in range(4):
        aggs.append(F.sum(F.when(cls == k, one).otherwise(none)).alias(f"k{k}"))
        if tested:
            continue
        aggs.append(F.sum(F.when(cls == k, vote).otherwise(F.lit(0).cast("long"))).alias(f"v{k}"))
        if truth is not None:
            aggs.append(F.sum(F.when(F.col(truth) == k, one).otherwise(none)).alias(f"t{k}"))
    return (points.where(G.in_range())
            .groupBy(*keys, G.cell_index("x", size).alias("ix"),
                     G.cell_index("y", size).alias("iy"))
            .agg(*aggs))


def describe(size, ix, iy, m, mixed) -> dict:
    """SQL text of the leaf attributes, from the text of its cell sums ``m``."""
    votes = [m[f"v{k}"] for k in range(4)]
    share = f"(({m['k2']} + {m['k3']}) / {m['n']})"
    out = {
        "size_mm": f"cast(floor({size} * 1000D + 0.5D) as int)", "lx": ix, "ly": iy,
        "x": f"{ix} * {size}", "y": f"{iy} * {size}", "size": size,
        "min_z": m["zmin"], "max_z": m["zmax"], "mean_z": f"{m['sz']} / {m['n']}",
        "point_count": m["n"], "dominant_class": text.argmax4(*votes),
        "class_confidence": f"greatest({', '.join(votes)}) / {VOTE_SCALE}D / {m['n']}",
        "occupancy_variance": f"{share} * (1D - {share})",
        "height_variance": text.variance(m["n"], m["sz"], m["szz"]),
        "semantic_complexity": mixed,
    }
    if "t0" in m:
        truth = [m[f"t{k}"] for k in range(4)]
        out["truth_class"] = text.argmax4(*truth)
        out["truth_kinds"] = " + ".join(f"cast({t} > 0 as int)" for t in truth)
    return out


def _named(attrs: dict):
    return [f"{v} as {k}" for k, v in attrs.items()]


def _mixture(prefix):
    return text.semantic_split(*[f"{prefix}k{k}" for k in range(4)])


def cell_aggregate(points: DataFrame, size=UNIT_M, **options) -> DataFrame:
    """One row per occupied cell of a single size, fully described."""
    keys = options.get("keys", FRAME_KEYS)
    cells = fine_cells(points, size=size, **options)
    m = {name: name for name in _measure_names(cells.columns)}
    return cells.selectExpr(*keys, *_named(describe(f"{float(size)}D", "ix", "iy", m, _mixture(""))))


def _group_sums(values, starts, merge):
    """``values`` of one column merged per group; null only where a whole group is null."""
    raw = pc.fill_null(values, 0) if values.null_count else values
    out = merge.reduceat(raw.to_numpy(zero_copy_only=False), starts)
    if not values.null_count:
        return pa.array(out, values.type)
    known = np.add.reduceat(values.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts)
    return pa.array(out, values.type, mask=known == 0)


def _rough(n, sz, szz):
    # Leaves store 32-bit heights; the limit is tested at that precision.
    return C.variance(n, sz, szz).astype(np.float32) > np.float32(HEIGHT_VARIANCE_LIMIT)


class _Tier:
    """One tier's cells of a batch of whole 0.5 m cells: sums, and the tests that policies use."""

    def __init__(self, units, parent, column, measures):
        ix, iy = (column[c].to_numpy() for c in ("ix", "iy"))
        cell = ix * 8192 + iy
        # A 0.5 m cell holds at most 5 x 5 cells of a tier.
        place = parent * 25 + (ix // units) % (10 // units) * 5 + (iy // units) % (10 // units)
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(place[order]) > 0))
        #: Row of the first 5 cm cell of every cell of the tier, and the tier's cell of every row.
        self.row, self.number = order[starts], np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        merges = {**{c: np.minimum for c in _LOWS}, **{c: np.maximum for c in _HIGHS}}
        self.sums = {c: _group_sums(column[c].take(pa.array(order)), starts, merges.get(c, np.add))
                     for c in measures}
        self.first = np.minimum.reduceat(cell[order], starts)[self.number] == cell
        self.size = units * UNIT_M
        self.x, self.y = ix[self.row] // units * self.size, iy[self.row] // units * self.size
        self.dither = C.dither(self.x, self.y)
        self.corner = C.corner_distance(self.x, self.y, self.size)
        self.rough = _rough(*(self.sums[c].to_numpy() for c in ("n", "sz", "szz")))
        self.mixed = C.semantic_split([self.sums[f"k{k}"].to_numpy() for k in range(4)])

    def split(self, rule, speed, heading):
        """Whether every row's cell of this tier is split, and its ceiling of resolution."""
        near = C.region_near(self.x, self.y, self.size, speed[self.row], heading[self.row], rule["fovea"])
        ceiling = C.ceiling(near, self.dither, self.corner if rule["safety"] else None, SAFETY_RADIUS_M)
        out = ceiling < self.size - 1e-6
        out = out | self.rough if rule["height"] else out
        out = out | self.mixed if rule["mixture"] else out
        return out[self.number], ceiling[self.number]


def _choose(policy, tiers, speed, heading):
    """Leaf tier of every 5 cm cell under one policy, and the splits first seen at it."""
    if policy == "uniform":
        return np.ones(len(speed), np.int32), np.zeros(len(speed), np.int32)
    split = {u: tier.split(POLICY_RULES[policy], speed, heading) for u, tier in tiers.items()}
    top, tenth = split[10][0], split[10][1] <= 0.100001
    units = np.where(~top, 10, np.where(tenth, np.where(split[2][0], 1, 2), np.where(split[5][0], 1, 5)))
    splits = ((top & tiers[10].first).astype(np.int32) + (top & tenth & split[2][0] & tiers[2].first)
              + (top & ~tenth & split[5][0] & tiers[5].first))
    return units.astype(np.int32), splits.astype(np.int32)


def _policy_batches(keys, extra, measures, policies, schema, places=False):
    """Task side of ``_with_policies``: many 0.5 m cells at a time, out of batches sorted by them.

    With ``places`` there is one row per leaf instead of one per 5 cm cell, and no sums.
    """
    def table_of(out):
        return pa.table([pa.array(out[f.name], f.type) if isinstance(out[f.name], np.ndarray)
                         else out[f.name] for f in schema], names=[f.name for f in schema])

    def run(batches):
        for table in whole_groups(batches, ["parent", *keys]):
            column = {c: table.column(c).combine_chunks() for c in table.column_names}
            rows = table.num_rows
            fresh = np.zeros(rows, np.int64)
            fresh[group_starts(table, ["parent", *keys])] = 1
            parent = np.cumsum(fresh) - 1
            tiers = {u: _Tier(u, parent, column, measures) for u in (10, 5, 2)}
            if not places:
                own = {c: column[c].to_numpy(zero_copy_only=False) for c in ("n", "sz", "szz")}
                mixed = C.semantic_split([column[f"k{k}"].to_numpy() for k in range(4)])
                # All tiers' sums behind each other, so a leaf is one number.
                behind = dict(zip((1, 10, 5, 2), np.cumsum([0, rows, *[len(tiers[u].row) for u in (10, 5)]])))
                sums = {c: pa.concat_arrays([column[c], *[t.sums[c] for t in tiers.values()]]) for c in measures}
                mixtures = np.concatenate([mixed, *[t.mixed for t in tiers.values()]])
                base = {c: column[c] for c in (*keys, "ix", "iy")}
                base.update(fine_mean_z=own["sz"] / own["n"], fine_min_z=column["zmin"], fine_max_z=column["zmax"])
            if "t0" in measures:
                truth = [column[f"t{k}"].to_numpy() for k in range(4)]
                base.update(fine_truth=C.argmax4(truth), fine_complex=_rough(**own) | C.semantic_split(truth))
            motions = column["motions"]
            begin = motions.offsets.to_numpy()[:-1] - motions.offsets[0].as_py()
            several, flat = pc.list_value_length(motions).to_numpy(), motions.flatten()
            for turn in range(int(several.max())):
                held = several > turn
                at = pa.array(np.where(held, begin + turn, begin))
                told = {c: flat.field(c).take(at) for c in (*extra, "speed", "heading")}
                speed, heading = (told.pop(c).to_numpy() for c in ("speed", "heading"))
                for number, policy in enumerate(policies):
                    units, splits = _choose(policy, tiers, speed, heading)
                    is_leaf = units == 1
                    for u, tier in tiers.items():
                        is_leaf = is_leaf | ((units == u) & tier.first)
                    if places:
                        chosen = np.flatnonzero(is_leaf & held)
                        units, kept = units[chosen], pa.array(chosen)
                        out = {c: v.take(kept) for c, v in ({c: column[c] for c in keys} | told).items()}
                        out.update({f"l{a}": column[f"i{a}"].to_numpy()[chosen] // units for a in "xy"},
                                   policy_number=np.full(len(chosen), number, np.int32), units=units)
                        yield from table_of(out).to_batches()
                        continue
                    leaf = np.arange(rows)
                    for u, tier in tiers.items():
                        leaf = np.where(units == u, behind[u] + tier.number, leaf)
                    out = table_of({
                        **base, **told, "policy_number": np.full(rows, number, np.int32), "units": units,
                        "splits": splits, "is_leaf": is_leaf, "leaf_mixed": mixtures[leaf],
                        **{f"leaf_{c}": sums[c].take(pa.array(leaf)) for c in measures}})
                    yield from (out if held.all() else out.filter(pa.array(held))).to_batches()
    return run


def _with_policies(cells: DataFrame, keys, policies, motion, extra, places=False) -> DataFrame:
    """Every 5 cm cell once per motion and policy, with its leaf's tier and sums; with
    ``places`` every leaf once, with its tier and index only.

    Whole 0.5 m cells are dealt to the tasks, which sum the tiers of many of them at once.
    """
    measures = _measure_names(cells.columns)
    # The parent's number comes first, so that sorting seldom looks beyond it.
    top = ["parent", *keys]
    cells = cells.selectExpr("*", "floor(ix / 10D) * 1024 + floor(iy / 10D) as parent")
    still = [F.lit(0.0).alias("speed"), F.lit(0.0).alias("heading")]
    if motion is None:
        cells = cells.withColumn("motions", F.array(F.struct(*still)))
    else:
        # Settings of one frame travel with its cells, which are not copied for each.
        told = motion.groupBy(*keys).agg(F.collect_list(F.struct(
            *extra, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("speed", "heading")])).alias("motions"))
        none = F.array(F.struct(*[F.lit(None).cast(motion.schema[c].dataType).alias(c) for c in extra], *still))
        cells = cells.join(told, keys, "left").withColumn("motions", F.coalesce("motions", none))
    schema = T.StructType([cells.schema[c] for c in keys])
    for a in "xy":
        schema = schema.add(f"l{a}" if places else f"i{a}", cells.schema[f"i{a}"].dataType)
    for c in extra:
        schema = schema.add(c, motion.schema[c].dataType)
    schema = schema.add("policy_number", "integer").add("units", "integer")
    if not places:
        schema = schema.add("splits", "integer").add("is_leaf", "boolean").add("leaf_mixed", "boolean")
        for c in measures:
            schema = schema.add(f"leaf_{c}", cells.schema[c].dataType)
        for c in ("fine_mean_z", "fine_min_z", "fine_max_z"):
            schema = schema.add(c, "double")
        if "t0" in measures:
            schema = schema.add("fine_truth", "integer").add("fine_complex", "boolean")
    run = _policy_batches(list(keys), extra, measures, list(policies), to_arrow_schema(schema), places)
    return cells.repartition(*top).sortWithinPartitions(*top).mapInArrow(run, schema)


def _check_policies(policies):
    bad = [p for p in policies if p not in POLICIES]
    if bad:
        raise ValueError(f"unknown policies {bad}")


def _extra_columns(motion, keys):
    return [] if motion is None else [c for c in motion.columns if c not in (*keys, "speed", "heading")]


def _policy_name(policies):
    names = ", ".join(f"'{p}'" for p in policies)
    return f"array({names})[policy_number] as policy"


def grid_cells(points: DataFrame, policies=("adaptive",), motion: DataFrame = None,
               keys=FRAME_KEYS, **options) -> DataFrame:
    """5 cm cells with the leaf that covers each one, per policy.

    ``motion`` has the frame keys, ``speed`` and ``heading``, optionally more
    columns (a ``variant`` for parameter sweeps) that become part of the output.
    Column ``is_leaf`` marks one cell per leaf, so leaves are a filter away.
    """
    keys = list(keys)
    _check_policies(policies)
    cells = fine_cells(points, keys=keys, **options)
    measures = _measure_names(cells.columns)
    extra = _extra_columns(motion, keys)
    if set(policies) != {"uniform"}:
        cells = _with_policies(cells, keys, policies, motion, extra)
    else:
        if motion is not None:
            cells = cells.join(motion.drop("speed", "heading"), keys, "left")
        fine = {"fine_mean_z": "sz / n", "fine_min_z": "zmin", "fine_max_z": "zmax"}
        if "t0" in measures:
            fine["fine_truth"] = text.argmax4("t0", "t1", "t2", "t3")
            fine["fine_complex"] = (
                f"cast({text.variance('n', 'sz', 'szz')} as float) > "
                f"cast({HEIGHT_VARIANCE_LIMIT!r}D as float) OR "
                f"({text.semantic_split('t0', 't1', 't2', 't3')})")
        cells = cells.selectExpr(
            *keys, *extra, "ix", "iy", "0 as policy_number", "1 as units", "0 as splits", "true as is_leaf",
            f"{_mixture('')} as leaf_mixed", *[f"{c} as leaf_{c}" for c in measures], *_named(fine))
    cells = cells.selectExpr("*", _policy_name(policies), f"units * {UNIT_M}D as leaf_size",
                             "floor(ix / units) as leaf_ix", "floor(iy / units) as leaf_iy")
    attrs = describe("leaf_size", "leaf_ix", "leaf_iy", {c: f"leaf_{c}" for c in measures}, "leaf_mixed")
    return cells.selectExpr(*keys, *extra, "policy", "ix", "iy", "splits", "is_leaf", *_named(attrs),
                            *[c for c in cells.columns if c.startswith("fine_")])


def leaves(cells: DataFrame) -> DataFrame:
    """One row per map leaf."""
    fine = [c for c in cells.columns if c.startswith("fine_")]
    return cells.where("is_leaf").drop("ix", "iy", "splits", "is_leaf", *fine)


def build_grid(points, policies=("adaptive",), motion=None, **options) -> DataFrame:
    return leaves(grid_cells(points, policies, motion, **options))


def leaf_places(points: DataFrame, policies=("adaptive",), motion: DataFrame = None, keys=FRAME_KEYS,
                cls="pred") -> DataFrame:
    """Which leaves a map has: the keys, columns of ``motion``, ``policy``, ``size_mm``, ``lx`` and ``ly``
    of ``build_grid``. Only what the policies test goes into the tasks, and only leaves come out.
    """
    keys = list(keys)
    _check_policies(policies)
    extra = _extra_columns(motion, keys)
    cells = fine_cells(points, keys, cls, tested=True)
    rows = _with_policies(cells, keys, policies, motion, extra, places=True)
    return rows.selectExpr(*keys, *extra, _policy_name(policies),
                           f"units * {round(UNIT_M * 1000)} as size_mm", "lx", "ly")


def uniform_grid(points, **options) -> DataFrame:
    return build_grid(points, ("uniform",), **options)


def refinement_count(cells: DataFrame, by) -> DataFrame:
    return cells.groupBy(*by).agg(F.sum("splits").alias("refined_nodes"))


def leaf_storage(leaf_rows: DataFrame, by) -> DataFrame:
    n = F.count(F.lit(1))
    return leaf_rows.groupBy(*by).agg(
        n.alias("cells"), (n * LEAF_BYTES).alias("bytes"),
        (n * LEAF_BYTES / 1048576).alias("mib"))


def storage_reduction(storage: DataFrame, frame_keys=(), reference="uniform") -> DataFrame:
    """Cell count of every policy relative to the reference policy, in percent saved."""
    keys = list(frame_keys)
    totals = F.max(F.when(F.col("policy") == reference, F.col("cells")))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return storage.withColumn(
        "reduction_pct", (1 - F.col("cells") / totals.over(w)) * 100)


def assign_points(points: DataFrame, cells: DataFrame, policies, keys=FRAME_KEYS) -> DataFrame:
    """Leaf of every point per policy. Points outside the map get class 255, no leaf.

    Outside points never enter the join, so they cannot pile up on a NULL key.
    """
    keys = list(keys)
    lookup = cells.select(*keys, "policy", "ix", "iy", "lx", "ly", "size_mm",
                          F.col("dominant_class").alias("cell_class"))
    inside = (points.where(G.in_range())
              .withColumn("ix", G.cell_index("x")).withColumn("iy", G.cell_index("y"))
              .join(lookup, [*keys, "ix", "iy"]).drop("ix", "iy"))
    outside = (points.where(~F.coalesce(G.in_range(), F.lit(False)))
               .withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
               .withColumn("lx", F.lit(None).cast("long"))
               .withColumn("ly", F.lit(None).cast("long"))
               .withColumn("size_mm", F.lit(-1))
               .withColumn("cell_class", F.lit(UNKNOWN_CLASS)))
    return inside.unionByName(outside)


def cell_footprint(leaf_rows: DataFrame) -> DataFrame:
    """Every 5 cm cell covered by each leaf."""
    units = (F.col("size_mm") / 50).cast("int")
    return (leaf_rows.withColumn("_dx", F.explode(F.sequence(F.lit(0), units - 1)))
            .withColumn("_dy", F.explode(F.sequence(F.lit(0), units - 1)))
            .withColumn("ix", F.col("lx") * units + F.col("_dx"))
            .withColumn("iy", F.col("ly") * units + F.col("_dy")).drop("_dx", "_dy"))


def covered_cells(leaf_rows: DataFrame, keys=(*FRAME_KEYS, "policy")) -> DataFrame:
    """Every 5 cm cell covered by a leaf, and by how many.

    Leaves are dealt out by the 0.5 m cells they reach, and their own cells are listed there,
    so the shuffle sees leaves and not up to a hundred cells of each.
    """
    keys = list(keys)
    rows = _reached(leaf_rows, keys).repartition(*keys, "_px", "_py")
    for a in "xy":
        rows = rows.withColumn(f"i{a}", F.explode(F.sequence(
            F.greatest(F.col(f"_{a}"), F.col(f"_p{a}") * 10),
            F.least(F.col(f"_{a}") + F.col("_u") - 1, F.col(f"_p{a}") * 10 + 9))))
    return (rows.groupBy(*keys, "_px", "_py", "ix", "iy").agg(F.count(F.lit(1)).alias("covers"))
            .drop("_px", "_py"))


def _reached(leaf_rows: DataFrame, keys) -> DataFrame:
    """Leaves with their size ``_u`` and origin in 5 cm cells, once per 0.5 m cell that they reach."""
    units = (F.col("size_mm") / 50).cast("int")
    rows = leaf_rows.select(*keys, units.alias("_u"), *[(F.col(f"l{a}") * units).alias(f"_{a}") for a in "xy"])
    for a in "xy":
        rows = rows.withColumn(f"_p{a}", F.explode(F.sequence(
            F.floor(F.col(f"_{a}") / 10), F.floor((F.col(f"_{a}") + F.col("_u") - 1) / 10))))
    return rows


#: Bits that begin the first n of five lines of ten cells.
_LINES = [sum(1 << 10 * i for i in range(n)) for n in range(6)]


def footprint_counts(leaf_rows: DataFrame, keys=(*FRAME_KEYS, "policy")) -> DataFrame:
    """Per group of ``keys``, how many 5 cm cells its leaves cover (``covered``) and how many of these
    lie under more than one leaf (``overlapping``).

    The cells of a 0.5 m cell are a hundred bits in two numbers, which are merged in the leaves' own
    tasks. Where the leaves' areas add up to what they cover, none overlap. Only groups in which
    they do not have their cells listed; a group is a row of a checkpoint.
    """
    keys = list(keys)
    rows = _reached(leaf_rows, keys)
    first = {a: F.greatest(F.col(f"_{a}") - F.col(f"_p{a}") * 10, F.lit(0)) for a in "xy"}
    last = {a: F.least(F.col(f"_{a}") + F.col("_u") - 1 - F.col(f"_p{a}") * 10, F.lit(9)) for a in "xy"}

    def lines(n):
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in _LINES]),
                            (F.least(F.greatest(n, F.lit(0)), F.lit(5)) + 1).cast("int"))
    line = (F.pow(F.lit(2.0), last["y"] + 1) - F.pow(F.lit(2.0), first["y"])).cast("long")
    halves = [(line * (lines(last["x"] + 1 - low) - lines(first["x"] - low))).alias(f"_h{low}") for low in (0, 5)]
    area = (last["x"] - first["x"] + 1) * (last["y"] - first["y"] + 1)
    cells = rows.groupBy(*keys, "_px", "_py").agg(*[F.bit_or(half).alias(f"_h{low}") for half, low in zip(halves, (0, 5))],
                                                  F.sum(area).alias("_area"))
    covered = F.bit_count("_h0").cast("long") + F.bit_count("_h5")
    sums = cut_lineage(cells.groupBy(*keys).agg(F.sum(covered).alias("covered"), F.sum("_area").alias("_area")))
    unsure = sums.where("_area <> covered").select(*keys)
    if unsure.isEmpty():
        return sums.select(*keys, "covered", F.lit(0).cast("long").alias("overlapping"))
    several = (covered_cells(null_safe_join(leaf_rows, unsure, keys), keys).where("covers > 1")
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("overlapping")))
    out = null_safe_join(sums.drop("_area"), several, keys, "left")
    return out.select(*keys, "covered", F.coalesce("overlapping", F.lit(0).cast("long")).alias("overlapping"))


def overlapping_cells(leaf_rows: DataFrame, keys=(*FRAME_KEYS, "policy")) -> DataFrame:
    """5 cm cells covered more than once (empty for a valid map)."""
    return covered_cells(leaf_rows, keys).where("covers > 1")


def changed_leaves(left: DataFrame, right: DataFrame, keys=FRAME_KEYS) -> DataFrame:
    """Leaves present in exactly one of two maps."""
    cols = [*keys, "size_mm", "lx", "ly"]
    a = left.select(*cols).withColumn("in_left", F.lit(1)).withColumn("in_right", F.lit(0))
    b = right.select(*cols).withColumn("in_left", F.lit(0)).withColumn("in_right", F.lit(1))
    return (a.unionByName(b).groupBy(*cols)
            .agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))
            .where("in_left <> in_right"))
