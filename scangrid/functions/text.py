"""The map-policy expressions as Spark SQL text.

The grid plan repeats these for every tier; one parsed string per expression is far
cheaper to build than hundreds of Column calls, and SQL users get the same text.
"""
import math

from ..schema import BLEND_WIDTH_M, CHI2_99_DF3


def radius(x, y):
    return f"sqrt({x} * {x} + {y} * {y})"


def fovea_distance(x, y, v, h):
    speed = f"least(greatest({v}, 0D), 80D)"
    px = f"({x} - least(0.2D * {speed}, 5D) * cos({h}))"
    py = f"({y} - least(0.2D * {speed}, 5D) * sin({h}))"
    along = f"(({px} * cos({h}) + {py} * sin({h})) / least(1D + 0.033D * {speed}, 2D))"
    return radius(along, f"({py} * cos({h}) - {px} * sin({h}))")


def semantic_split(a, b, c, d):
    counts = [f"cast({k} as double)" for k in (a, b, c, d)]
    n, top = f"({' + '.join(counts)})", f"greatest({', '.join(counts)})"
    logs = " + ".join(f"{k} * ln(greatest({k}, 1D))" for k in counts)
    rare, main = f"({n} * {0.05 / 3!r}D)", f"({n} * 0.95D)"
    squares = f"({' + '.join(f'{k} * {k}' for k in counts)} - {top} * {top})"
    statistic = (f"(({squares} - 2D * {rare} * ({n} - {top})) / {rare} + 3D * {rare}"
                 f" + ({top} - {main}) * ({top} - {main}) / {main})")
    return (f"CASE WHEN {rare} >= 5D THEN {top} < {main} AND {statistic} > {CHI2_99_DF3}D "
            f"ELSE ln(greatest({n}, 1D)) - ({logs}) / greatest({n}, 1D) > "
            f"{0.18 * math.log(4)!r}D END")


def argmax4(a, b, c, d):
    top = f"greatest({a}, {b}, {c}, {d})"
    return (f"CASE WHEN {top} <= 0 THEN 255 WHEN {a} = {top} THEN 0 WHEN {b} = {top} THEN 1 "
            f"WHEN {c} = {top} THEN 2 ELSE 3 END")


def variance(n, s, ss):
    return f"greatest(0D, {ss} / {n} - ({s} / {n}) * ({s} / {n}))"


def dither(x, y):
    wave = f"(sin({x} * 12.9898D + {y} * 78.233D) * 43758.5453D)"
    return f"({wave} - floor({wave}))"


def corner_distance(x, y, size):
    gx, gy = (f"greatest({o}, -({o} + {size}D), 0D)" for o in (x, y))
    return radius(gx, gy)


def region_near(x, y, size, v, h, fovea):
    cx, cy = f"({x} + {size / 2}D)", f"({y} + {size / 2}D)"
    d = fovea_distance(cx, cy, v, h) if fovea else radius(cx, cy)
    return f"greatest(0D, {d} - {size / math.sqrt(2)!r}D)"


def ceiling(near, dithered, corner=None, safety_radius=3.0):
    floor = f"WHEN {corner} <= {safety_radius}D THEN 0.05D " if corner else ""
    w = f"{BLEND_WIDTH_M}D"
    blend = " ".join(
        f"WHEN {near} >= {b}D AND {near} < {b}D + {w} AND {dithered} < 1D - ({near} - {b}D) / {w} "
        f"THEN {fine}D" for b, fine in ((10, 0.05), (25, 0.1), (60, 0.25)))
    return (f"CASE {floor}{blend} WHEN {near} < 10 THEN 0.05D WHEN {near} < 25 THEN 0.1D "
            f"WHEN {near} < 60 THEN 0.25D ELSE 0.5D END")
