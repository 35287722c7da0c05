"""Neighbours within tiles, by a sorted grid over many tiles at once."""
from itertools import product

import numpy as np

#: The first radius is so small that no cell holds more sources, unless they are that close.
CROWD, STEP, LEVELS = 24, 3.0, 12
#: Pairs of points looked at together.
PAIRS = 1 << 20


class _Grid:
    """Cells of one size over the sources of all tiles, numbered tile by tile.

    Cells that differ in the last coordinate only have neighbouring numbers. ``fits`` is
    false where cells are so small that numbers could meet.
    """

    def __init__(self, places, tile, size):
        cell = np.floor(places / size)
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        self.size, self.low = size, np.minimum.reduceat(cell, first) - 2
        self.span = (np.maximum.reduceat(cell, first) - self.low).max(0) + 3
        self.fits = float(np.prod(self.span)) * len(first) < 2.0 ** 62
        if self.fits:
            self.span = self.span.astype(np.int64)
            self.number = self._numbers((cell - self.low[tile]).astype(np.int64), tile)
            self.order = np.argsort(self.number, kind="stable")
            self.ranked = self.number[self.order]

    def _numbers(self, cell, tile):
        out = tile
        for d in range(cell.shape[1]):
            out = out * self.span[d] + cell[:, d]
        return out

    def crowd(self):
        edge = np.flatnonzero(np.append(True, self.ranked[1:] != self.ranked[:-1]))
        return np.diff(np.append(edge, len(self.ranked))).max()

    def ranges(self, queries, tile):
        """Which queries lie on the grid, then per row of cells around them where sources begin and end."""
        # Far-away queries are outside the grid whatever their cell's number would be.
        cell = np.clip(np.floor(queries / self.size) - self.low[tile], 0, self.span - 1).astype(np.int64)
        inside = np.flatnonzero(((cell >= 1) & (cell < self.span - 1)).all(1))
        cell, tile = cell[inside], tile[inside]
        for shift in product((-1, 0, 1), repeat=cell.shape[1] - 1):
            base = self._numbers(cell + np.array([*shift, 0]), tile)
            yield inside, np.searchsorted(self.ranked, base - 1, "left"), np.searchsorted(self.ranked, base + 1, "right")


def _grids(places, tile, cap):
    """Grids of growing cells, the last of size ``cap``."""
    out = [_Grid(places, tile, cap)]
    if not out[0].fits:
        raise ValueError(f"tiles are too wide for a radius of {cap}")
    while len(out) < LEVELS and out[-1].crowd() > CROWD:
        finer = _Grid(places, tile, out[-1].size / STEP)
        if not finer.fits:
            break
        out.append(finer)
    return out[::-1]


def _square(gap):
    out = gap[:, 0] * gap[:, 0]
    for d in range(1, gap.shape[1]):
        out = out + gap[:, d] * gap[:, d]
    return out


def _ranked_tiles(queries, query_tile, source_tile):
    """Tiles counted without gaps in order of the sources', and the queries that have sources."""
    names, source_tile = np.unique(source_tile, return_inverse=True)
    at = np.minimum(np.searchsorted(names, query_tile), len(names) - 1)
    return at, source_tile, np.flatnonzero((names[at] == query_tile) & np.isfinite(queries).all(1))


def nearest_within(queries, sources, ids, cap, strict=False, tiles=None, rooted=False):
    """Squared distance (inf: none) and source index (-1: none) of each query's nearest source.

    A source counts within ``cap`` (``strict``: closer than it); ties go to the smaller id.
    ``tiles`` gives the tile numbers of queries and of sources, which only meet inside a
    tile. With ``rooted`` sources tie when the distances agree, not only their squares.
    Radii grow, and a query is settled by the first one that finds anything, because
    nothing closer can lie outside it.
    """
    best, index = np.full(len(queries), np.inf), np.full(len(queries), -1)
    kept = np.flatnonzero(np.isfinite(sources).all(1))
    if not len(kept) or not len(queries):
        return best, index
    mine, theirs = tiles or (np.zeros(len(queries), np.int64), np.zeros(len(sources), np.int64))
    # Of sources at one place only the smallest id can be the nearest.
    kept = kept[np.lexsort((ids[kept], *sources[kept].T[::-1], theirs[kept]))]
    fresh = (sources[kept[1:]] != sources[kept[:-1]]).any(1) | (theirs[kept[1:]] != theirs[kept[:-1]])
    kept = kept[np.append(True, fresh)]
    places, names = sources[kept], ids[kept]
    mine, theirs, open_ = _ranked_tiles(queries, mine, theirs[kept])
    limit = float(cap) * float(cap)
    for grid in _grids(places, theirs, float(cap)):
        gap, gap2, found = (np.full(len(open_), v) for v in (np.inf, np.inf, -1))
        for inside, start, end in grid.ranges(queries[open_], mine[open_]):
            live, step = np.flatnonzero(start < end), 0
            while len(live):
                own, source = inside[live], grid.order[start[live] + step]
                d2 = _square(places[source] - queries[open_[own]])
                d = np.sqrt(d2) if rooted else d2
                ok = d2 < limit if strict else d2 <= limit
                closer = ok & (d < gap[own])
                same = np.flatnonzero(ok & (d == gap[own]))
                closer[same] = names[source[same]] < names[found[own[same]]]
                gap[own[closer]], gap2[own[closer]], found[own[closer]] = d[closer], d2[closer], source[closer]
                step += 1
                live = live[start[live] + step < end[live]]
        r = grid.size
        # Sources whose distance rounds to the same root may lie a hair further.
        hit = found >= 0 if r == float(cap) else gap2 <= r * r * (1 - 1e-12 if rooted else 1)
        best[open_[hit]], index[open_[hit]] = gap2[hit], kept[found[hit]]
        open_ = open_[~hit]
        if not len(open_):
            break
    return best, index


def pairs_within(queries, sources, eps, tiles):
    """Indexes ``(query, source)`` of all pairs within ``eps`` in one tile, some at a time.

    All pairs of a query with one row of cells come together.
    """
    kept = np.flatnonzero(np.isfinite(sources).all(1))
    if not len(kept) or not len(queries):
        return
    kept = kept[np.argsort(tiles[1][kept], kind="stable")]
    mine, theirs, usable = _ranked_tiles(queries, tiles[0], tiles[1][kept])
    places = sources[kept]
    grid = _Grid(places, theirs, float(eps))
    if not grid.fits:
        raise ValueError(f"tiles are too wide for a radius of {eps}")
    for inside, start, end in grid.ranges(queries[usable], mine[usable]):
        count = end - start
        total = np.append(0, np.cumsum(count))
        at = 0
        while at < len(count):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            n = count[at:stop]
            own = np.repeat(np.arange(at, stop), n)
            source = grid.order[np.arange(total[at], total[stop]) - np.repeat(total[at:stop] - start[at:stop], n)]
            query = usable[inside[own]]
            near = _square(queries[query] - places[source]) <= eps * eps
            yield query[near], kept[source[near]]
            at = stop
