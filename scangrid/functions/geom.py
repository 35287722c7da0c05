"""Geometry and map-policy scalar functions, all as Column expressions."""
import math

from pyspark.sql import Column, functions as F

from ..schema import BLEND_WIDTH_M, MAX_RANGE_M, SAFETY_RADIUS_M, UNIT_M


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def radius(x="x", y="y") -> Column:
    x, y = as_col(x), as_col(y)
    return F.sqrt(x * x + y * y)


def is_finite(v) -> Column:
    v = as_col(v)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def in_range(x="x", y="y", z="z", max_range=MAX_RANGE_M) -> Column:
    """Finite and closer than the limit. NaN sorts above every number, so two
    comparisons reject NaN and infinities as well."""
    return (radius(x, y) < max_range) & (F.abs(as_col(z)) < float("inf"))


def fovea_distance(x, y, speed=0.0, heading=0.0) -> Column:
    """Distance in a frame pushed forward and stretched along the heading."""
    x, y, heading = as_col(x), as_col(y), as_col(heading)
    speed = F.least(F.greatest(as_col(speed), F.lit(0.0)), F.lit(80.0))
    ahead = F.least(speed * 0.2, F.lit(5.0))
    hx, hy = F.cos(heading), F.sin(heading)
    px, py = x - ahead * hx, y - ahead * hy
    along = (px * hx + py * hy) / F.least(speed * 0.033 + 1.0, F.lit(2.0))
    across = py * hx - px * hy
    return F.sqrt(along * along + across * across)


def tier_for_distance(d: Column) -> Column:
    return (F.when(d < 10, 0.05).when(d < 25, 0.1).when(d < 60, 0.25).otherwise(0.5))


def resolution_ceiling(x, y, speed=0.0, heading=0.0, fovea=True) -> Column:
    return tier_for_distance(fovea_distance(x, y, speed, heading) if fovea else radius(x, y))


def region_near(ox, oy, size, speed=0.0, heading=0.0, fovea=True) -> Column:
    """Lower bound of the distance over a whole cell, from its centre."""
    ox, oy = as_col(ox), as_col(oy)
    cx, cy = ox + size / 2, oy + size / 2
    d = fovea_distance(cx, cy, speed, heading) if fovea else radius(cx, cy)
    return F.greatest(F.lit(0.0), d - size / math.sqrt(2))


def spatial_dither(x, y) -> Column:
    """Repeatable pseudo-random number in [0, 1) tied to a location."""
    raw = F.sin(as_col(x) * 12.9898 + as_col(y) * 78.233) * 43758.5453
    return raw - F.floor(raw)


def transition_blend(near: Column, dither: Column) -> Column:
    """Tier for a distance, refined at random just beyond each tier boundary."""
    out = F.when(F.lit(False), 0.0)
    for edge, finer in ((10, 0.05), (25, 0.1), (60, 0.25)):
        inside = (near >= edge) & (near < edge + BLEND_WIDTH_M)
        out = out.when(inside & (dither < 1 - (near - edge) / BLEND_WIDTH_M), finer)
    return out.otherwise(tier_for_distance(near))


def closest_corner_distance(ox, oy, size) -> Column:
    """Distance from the origin to the closest point of a square."""
    def gap(o):
        return F.greatest(o, -(o + size), F.lit(0.0))
    gx, gy = gap(as_col(ox)), gap(as_col(oy))
    return F.sqrt(gx * gx + gy * gy)


def region_ceiling(ox, oy, size, speed=0.0, heading=0.0, fovea=True, safety=True) -> Column:
    blended = transition_blend(region_near(ox, oy, size, speed, heading, fovea),
                               spatial_dither(ox, oy))
    if not safety:
        return blended
    return F.when(closest_corner_distance(ox, oy, size) <= SAFETY_RADIUS_M,
                  0.05).otherwise(blended)


def cell_index(v, size=UNIT_M) -> Column:
    return F.floor(as_col(v) / size + 1e-7)


def parent_index(index, units) -> Column:
    """Index of the enclosing cell that is ``units`` times as wide."""
    return F.floor(as_col(index) / units)


def cell_key(ix, iy) -> Column:
    return (as_col(ix) + 4096) * 8192 + as_col(iy) + 4096


def cell_from_key(key):
    key = as_col(key)
    return F.floor(key / 8192) - 4096, F.pmod(key, F.lit(8192)) - 4096


def voxel_index(v, size, origin=0.0) -> Column:
    return F.floor((as_col(v) - origin) / size)


def block_index(v) -> Column:
    return F.floor(as_col(v) / 10)


def block_key(bx, by) -> Column:
    return (as_col(bx) + 16) * 64 + as_col(by) + 16


def near_block_distance(bx, by) -> Column:
    return closest_corner_distance(as_col(bx) * 10.0, as_col(by) * 10.0, 10.0)


def azimuth_bin(x, y, bins=720) -> Column:
    turn = F.atan2(as_col(y), as_col(x)) + math.pi
    wrapped = turn - F.floor(turn / (2 * math.pi)) * (2 * math.pi)
    return F.floor(wrapped / (2 * math.pi) * bins)


def edge_distance(x, y, ox, oy, size) -> Column:
    x, y, ox, oy, size = map(as_col, (x, y, ox, oy, size))
    return F.least(F.abs(x - ox), F.abs(x - ox - size), F.abs(y - oy), F.abs(y - oy - size))


def rotate_block(x, y, theta):
    """Rotate about the centre (5, 5) of a 10 m block."""
    x, y, theta = as_col(x) - 5.0, as_col(y) - 5.0, as_col(theta)
    return (x * F.cos(theta) + y * F.sin(theta) + 5.0,
            y * F.cos(theta) - x * F.sin(theta) + 5.0)


def height_above_plane(x, y, z, a, b, c) -> Column:
    return as_col(z) - (as_col(x) * as_col(a) + as_col(y) * as_col(b) + as_col(c))


# --- rigid transforms: dicts of 12 Columns keyed (row, col) ------------------

def rigid(prefix="t"):
    return {(r, c): F.col(f"{prefix}{r}{c}") for r in range(3) for c in range(4)}


def rigid_apply(t, x, y, z):
    x, y, z = as_col(x), as_col(y), as_col(z)
    return tuple(t[r, 0] * x + t[r, 1] * y + t[r, 2] * z + t[r, 3] for r in range(3))


def rigid_inverse(t):
    """Inverse of a rotation-translation: transpose, then rotate the offset back."""
    out = {(r, c): t[c, r] for r in range(3) for c in range(3)}
    for r in range(3):
        out[r, 3] = -(t[0, r] * t[0, 3] + t[1, r] * t[1, 3] + t[2, r] * t[2, 3])
    return out


def rigid_compose(a, b):
    out = {}
    for r in range(3):
        for c in range(4):
            term = a[r, 0] * b[0, c] + a[r, 1] * b[1, c] + a[r, 2] * b[2, c]
            out[r, c] = term + a[r, 3] if c == 3 else term
    return out


def relative_transform(reference, other):
    """Transform taking ``other``'s frame into ``reference``'s frame."""
    return rigid_compose(rigid_inverse(reference), other)


def planar_motion(t, dt, speed_floor=None):
    """(speed, heading) of a relative transform; heading 0 at or below the floor."""
    dx, dy = t[0, 3], t[1, 3]
    speed = F.sqrt(dx * dx + dy * dy) / as_col(dt)
    heading = F.atan2(dy, dx)
    if speed_floor is not None:
        heading = F.when(speed > speed_floor, heading).otherwise(0.0)
    return speed, heading


def kmh_to_mps(v) -> Column:
    return as_col(v) / 3.6
