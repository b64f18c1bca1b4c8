"""Bilinear warp of tiles' mosaic squares to the Albers grid, many tiles at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.geo_arrays import albers_inverse, albers_xy, utm_inverse, utm_xy

#: Target pixels that are worked on at once.
TARGETS = 1 << 17
PARTS = ("prediction", "uncertainty")


class Squares:
    """Squares of many groups; the numbers of a square are found by its group, row and column."""

    def __init__(self, group: np.ndarray, row: np.ndarray, col: np.ndarray, values: dict[str, np.ndarray], known: dict[str, np.ndarray], groups: int):
        self.values, self.known = values, known
        self.row, self.col, self.height, self.width, self.start = (np.zeros(groups, np.int64) for _ in range(5))
        if not len(group):
            self.place = np.full(1, -1)
            return
        # Rows are sorted by group; each has a table over the rectangle that its squares span.
        first = np.flatnonzero(np.diff(group, prepend=-1))
        g = group[first]
        self.row[g], self.col[g] = np.minimum.reduceat(row, first), np.minimum.reduceat(col, first)
        self.height[g] = np.maximum.reduceat(row, first) - self.row[g] + 1
        self.width[g] = np.maximum.reduceat(col, first) - self.col[g] + 1
        size = self.height * self.width
        self.start = np.cumsum(size) - size
        # The last place is that of all squares outside.
        self.place = np.full(int(size.sum()) + 1, -1)
        self.place[self.start[group] + (row - self.row[group]) * self.width[group] + col - self.col[group]] = np.arange(len(group))

    def find(self, group: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Position of each square, -1 where there is none."""
        y, x, w = row - self.row[group], col - self.col[group], self.width[group]
        on = (y >= 0) & (y < self.height[group]) & (x >= 0) & (x < w)
        return self.place[np.where(on, self.start[group] + y * w + x, -1)]


def bounds(tiles: dict[str, np.ndarray], res: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last column and row of the target grid over each tile's projected corners, and whether there are any."""
    xs, ys = [], []
    for r in (0, tiles["height"]):
        for c in (0, tiles["width"]):
            at = tiles["x0"] + c * tiles["px_size"], tiles["y0"] - r * tiles["px_size"]
            ax, ay = albers_xy(*utm_inverse(*at, tiles["zone"], tiles["north"]))
            xs.append(np.floor(ax / res))
            ys.append(np.floor(ay / res))
    x1, x2, y1, y2 = np.min(xs, 0), np.max(xs, 0), np.min(ys, 0), np.max(ys, 0)
    ok = np.isfinite(x1 + x2 + y1 + y2)
    return *(np.where(ok, v, 0).astype(np.int64) for v in (x1, x2, y1, y2)), ok


def warp(tiles: dict[str, np.ndarray], squares: Squares, cell: int, res: float) -> Iterator[dict[str, np.ndarray]]:
    """Target pixels with a valid neighbour: the tile's position, `gx`, `gy`, the weight, and for each part its weighted sum and
    whether it has any term; TARGETS candidates at a time."""
    x1, x2, y1, y2, ok = bounds(tiles, res)
    # A part of a tile has every target row whose number leaves the part's own when divided by the number of parts.
    step = tiles["parts"]
    y1 = y1 + (tiles["part"] - y1) % step
    nx = x2 - x1 + 1
    n = np.where(ok & (y1 <= y2), nx * ((y2 - y1) // step + 1), 0)
    ends = np.cumsum(n)
    starts = ends - n
    for a in range(0, int(ends[-1]) if len(ends) else 0, TARGETS):
        b = min(a + TARGETS, int(ends[-1]))
        f, l = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right") + 1
        i = np.repeat(np.arange(f, l), np.minimum(ends[f:l], b) - np.maximum(starts[f:l], a))
        k = np.arange(a, b) - starts[i]
        gx, gy = x1[i] + k % nx[i], y1[i] + k // nx[i] * step[i]
        lat, lon = albers_inverse((gx + 0.5) * res, (gy + 0.5) * res)
        ux, uy = utm_xy(lat, lon, tiles["zone"][i], tiles["north"][i])
        with np.errstate(divide="raise"):
            u, v = (ux - tiles["x0"][i]) / tiles["px_size"][i] - 0.5, (tiles["y0"][i] - uy) / tiles["px_size"][i] - 0.5
        on = (u >= -1) & (v >= -1) & (u < tiles["width"][i]) & (v < tiles["height"][i])
        i, gx, gy, u, v = (z[on] for z in (i, gx, gy, u, v))
        group, height, width = (tiles[z][i] for z in ("group", "height", "width"))
        u0, v0 = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        weight, sums, known = np.zeros(len(i)), {p: np.zeros(len(i)) for p in PARTS}, {p: np.zeros(len(i), bool) for p in PARTS}
        for y in (0, 1):
            for x in (0, 1):
                r, c = v0 + y, u0 + x
                w = (1.0 - np.abs(u - c)) * (1.0 - np.abs(v - r))
                at = squares.find(group, r // cell, c // cell)
                there = (w > 0) & (r >= 0) & (c >= 0) & (r < height) & (c < width) & (at >= 0)
                weight += np.where(there, w, 0.0)
                for p in PARTS:
                    has = there & squares.known[p][at]
                    sums[p] += np.where(has, w * squares.values[p][at], 0.0)
                    known[p] |= has
        on = weight > 0
        yield {"tile": i[on], "gx": gx[on], "gy": gy[on], "weight": weight[on]} | {p: sums[p][on] for p in PARTS} | {f"{p}_known": known[p][on] for p in PARTS}


def added(d: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row for each target pixel, weights and sums added up."""
    _, first, same = np.unique(np.stack([d["gy"], d["gx"]], 1), axis=0, return_index=True, return_inverse=True)
    out = {k: d[k][first] for k in ("tile", "gx", "gy")}
    return out | {k: np.bincount(same.ravel(), d[k], len(first)) for k in ("weight", *PARTS)} | {f"{p}_known": np.bincount(same.ravel(), d[f"{p}_known"], len(first)) > 0 for p in PARTS}


def warp_table(t: pa.Table, cell: int, res: float) -> Iterator[pa.RecordBatch]:
    """Warped pixels of all tiles of a table that is sorted by `tile_id`, `_part`, `cell_row`, `cell_col` and holds two kinds
    of rows: tiles (`_tile` is known) and squares. Of squares at one place the last counts. Tiles of one id with
    different sizes or places add up."""
    ids, part, info = t.column("tile_id").to_numpy(), t.column("_part").to_numpy(), t.column("_tile").combine_chunks()
    group = np.cumsum(np.append(True, (ids[1:] != ids[:-1]) | (part[1:] != part[:-1]))) - 1
    tile_rows = info.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(tile_rows)
    info = info.take(pa.array(at))
    tiles = {f.name: info.field(f.name).to_numpy(zero_copy_only=False) for f in info.type}
    tiles |= {"group": group[at], "part": part[at], "parts": t.column("_parts").to_numpy()[at]}
    # Only squares within a tile's size can be met.
    rows, cols = (np.zeros(int(group[-1]) + 1, np.int64) for _ in range(2))
    np.maximum.at(rows, group[at], -(-tiles["height"] // cell))
    np.maximum.at(cols, group[at], -(-tiles["width"] // cell))
    own = np.flatnonzero(~tile_rows)
    row, col = (t.column(c).to_numpy()[own].astype(np.int64) for c in ("cell_row", "cell_col"))
    on = (row >= 0) & (col >= 0) & (row < rows[group[own]]) & (col < cols[group[own]])
    own, row, col = own[on], row[on], col[on]
    parts = {p: t.column(p).combine_chunks().take(pa.array(own)) for p in PARTS}
    values = {p: v.fill_null(0.0).to_numpy(zero_copy_only=False) for p, v in parts.items()}
    squares = Squares(group[own], row, col, values, {p: v.is_valid().to_numpy(zero_copy_only=False) for p, v in parts.items()}, len(rows))
    names = t.column("tile_id").combine_chunks()

    def batch(d: dict[str, np.ndarray], where: np.ndarray) -> pa.RecordBatch:
        out = [pa.array(d[p] / d["weight"], mask=~d[f"{p}_known"]) for p in PARTS]
        return pa.RecordBatch.from_arrays([names.take(pa.array(where[d["tile"]])), pa.array(d["gx"]), pa.array(d["gy"]), *out], ["tile_id", "gx", "gy", *PARTS])

    met = squares.height[tiles["group"]] > 0
    many = np.bincount(tiles["group"], minlength=len(rows))[tiles["group"]] > 1
    # What lies outside a projection's domain is no number and meets no square.
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        one = np.flatnonzero(met & ~many)
        for d in warp({k: v[one] for k, v in tiles.items()}, squares, cell, res):
            yield batch(d, at[one])
        for g in np.unique(tiles["group"][met & many]):
            k = np.flatnonzero(tiles["group"] == g)
            d = [*warp({n: v[k] for n, v in tiles.items()}, squares, cell, res)]
            if d:
                yield batch(added({n: np.concatenate([x[n] for x in d]) for n in d[0]}), at[k])
