"""The map-policy tests on numpy arrays, one entry per cell; ``text`` has the same rules as SQL."""
import math

import numpy as np

from ..schema import BLEND_WIDTH_M, CHI2_99_DF3


def fovea_distance(x, y, speed, heading):
    speed = np.minimum(np.maximum(speed, 0.0), 80.0)
    ahead, cos, sin = np.minimum(0.2 * speed, 5.0), np.cos(heading), np.sin(heading)
    px, py = x - ahead * cos, y - ahead * sin
    along = (px * cos + py * sin) / np.minimum(1.0 + 0.033 * speed, 2.0)
    across = py * cos - px * sin
    return np.sqrt(along * along + across * across)


def region_near(x, y, size, speed, heading, fovea):
    cx, cy = x + size / 2, y + size / 2
    d = fovea_distance(cx, cy, speed, heading) if fovea else np.sqrt(cx * cx + cy * cy)
    return np.maximum(0.0, d - size / math.sqrt(2))


def dither(x, y):
    wave = np.sin(x * 12.9898 + y * 78.233) * 43758.5453
    return wave - np.floor(wave)


def corner_distance(x, y, size):
    gx, gy = (np.maximum(np.maximum(o, -(o + size)), 0.0) for o in (x, y))
    return np.sqrt(gx * gx + gy * gy)


def ceiling(near, dithered, corner=None, safety_radius=3.0):
    cases = [] if corner is None else [(corner <= safety_radius, 0.05)]
    cases += [((near >= b) & (near < b + BLEND_WIDTH_M) & (dithered < 1.0 - (near - b) / BLEND_WIDTH_M), fine)
              for b, fine in ((10, 0.05), (25, 0.1), (60, 0.25))]
    cases += [(near < 10, 0.05), (near < 25, 0.1), (near < 60, 0.25)]
    return np.select([c for c, _ in cases], [v for _, v in cases], 0.5)


def variance(n, s, ss):
    return np.maximum(0.0, ss / n - (s / n) * (s / n))


def semantic_split(counts):
    counts = [k.astype(np.float64) for k in counts]
    n, top = sum(counts[1:], counts[0]), np.maximum.reduce(counts)
    logs = sum((k * np.log(np.maximum(k, 1.0)) for k in counts[1:]), counts[0] * np.log(np.maximum(counts[0], 1.0)))
    rare, main = n * (0.05 / 3), n * 0.95
    squares = sum((k * k for k in counts[1:]), counts[0] * counts[0]) - top * top
    with np.errstate(divide="ignore", invalid="ignore"):
        statistic = ((squares - 2.0 * rare * (n - top)) / rare + 3.0 * rare
                     + (top - main) * (top - main) / main)
    entropy = np.log(np.maximum(n, 1.0)) - logs / np.maximum(n, 1.0)
    return np.where(rare >= 5.0, (top < main) & (statistic > CHI2_99_DF3), entropy > 0.18 * math.log(4))


def argmax4(counts):
    """Class of the largest count, the lowest of equal ones; 255 without any."""
    return np.where(np.maximum.reduce(counts) <= 0, 255, np.argmax(np.stack(counts), axis=0))
