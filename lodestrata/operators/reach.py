"""Sums, nearest distances and lists of the places within reach of points, for points and places that lie sorted by part of a square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Metres by which bounds of strips are moved, so that rounding decides nothing; pairs, and cells of a grid, that are held at a time.
EPS, PAIRS, GRID = 1e-6, 1 << 20, 1 << 20


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """The places of a part (_home false) with each batch of its points, of rows sorted by _l, _sx, _sy and _home."""
    last, held, places = None, [], None
    for batch in batches:
        keys = np.stack([batch[c].cast(pa.int64()).fill_null(-(1 << 40)).to_numpy(zero_copy_only=False) for c in ("_l", "_sx", "_sy")] + [batch["_home"].to_numpy(zero_copy_only=False).astype("int64")])
        at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if a == b:
                continue
            key, piece = tuple(keys[:3, a].tolist()), batch.slice(a, b - a)
            if key != last:
                last, held, places = key, [], None
            if not keys[3, a]:
                held.append(piece)
                continue
            if places is None:
                places = pa.Table.from_batches(held, batch.schema)
            yield places, piece


def _column(rows, name: str) -> np.ndarray:
    """Numbers of a column, nan for null."""
    column = rows[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


class Grid:
    """Places of positive weight in strips of y, each cut into cells of x; exact sums of weights and nearest distances for points."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, radius: float):
        self.radius, self.n = radius, len(x)
        if not self.n:
            return
        self.x0, self.y0 = x.min(), y.min()
        wide, high = x.max() - self.x0, y.max() - self.y0
        # A point looks up each strip and tries the places at both ends of it: about as many of the one as of the other.
        self.h = min(max(np.sqrt(0.5 * max(wide, 1.0) * max(high, 1.0) / self.n), radius / 128), radius / 4)
        self.h = max(self.h, high / 4096)
        self.c = max(self.h / 2, wide * (high / self.h + 1) / GRID)
        self.nx, self.ny = int(wide / self.c) + 1, int(high / self.h) + 1
        cell = ((y - self.y0) / self.h).astype("int64") * self.nx + ((x - self.x0) / self.c).astype("int64")
        order = np.argsort(cell, kind="stable")
        self.x, self.y, self.weight = x[order], y[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=self.nx * self.ny))])
        self.sums = np.concatenate([[0.0], np.cumsum(self.weight)])

    def _strips(self, y: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the strips within r of each point, whether they are there, and the least and greatest distance along y."""
        strip = np.floor((y - r - self.y0) / self.h).astype("int64")[:, None] - 1 + np.arange(int(np.ceil(2 * r / self.h)) + 4)
        low = self.y0 + strip * self.h - y[:, None]
        least, most = np.maximum(0.0, np.maximum(low, -low - self.h)), np.maximum(np.abs(low), np.abs(low + self.h))
        return strip, (strip >= 0) & (strip < self.ny) & (least <= r + EPS), least, most

    def _cell(self, x: np.ndarray, up: int) -> np.ndarray:
        return np.clip(np.floor((x - self.x0) / self.c) + up, 0, self.nx).astype("int64")

    def _pairs(self, x: np.ndarray, y: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Point, place and distance of ranges of places (a row a point), some points at a time, in the order of points."""
        size = np.maximum(ends - begins, 0)
        each = size.sum(axis=1)
        upto, a = np.cumsum(each), 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            n, first = size[a:b].ravel(), begins[a:b].ravel()
            place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            point = np.repeat(np.arange(a, b), each[a:b])
            dx, dy = x[point] - self.x[place], y[point] - self.y[place]
            yield point, place, np.sqrt(dx * dx + dy * dy)
            a = b

    def total(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of the weights of places within the radius: differences of running sums where a strip is inside the circle, tried one by one at its edge."""
        out = np.zeros(len(x))
        if not self.n:
            return out
        block = max(1, PAIRS // 4 // (int(2 * self.radius / self.h) + 4))
        for at in range(0, len(x), block):
            px, py = x[at : at + block], y[at : at + block]
            strip, there, least, most = self._strips(py, self.radius)
            square = lambda d: self.radius**2 - d * d
            outer, inner = np.sqrt(np.maximum(square(np.maximum(least - EPS, 0)), 0)) + EPS, np.sqrt(np.maximum(square(most + EPS), 0)) - EPS
            middle = px[:, None]
            begin, end = self._cell(middle - outer, 0), self._cell(middle + outer, 1)
            left, right = self._cell(middle - inner, 1), self._cell(middle + inner, 0)
            none = (right <= left) | (inner <= 0)
            left, right = np.where(none, begin, left), np.where(none, begin, right)
            base = np.where(there, strip, 0) * self.nx
            begin, left, right, end = (np.where(there, self.start[base + c], 0) for c in (begin, left, right, end))
            sums = (self.sums[right] - self.sums[left]).sum(axis=1)
            for point, place, far in self._pairs(px, py, np.concatenate([begin, right], axis=1), np.concatenate([left, end], axis=1)):
                sums += np.bincount(point, np.where(far <= self.radius, self.weight[place], 0.0), len(px))
            out[at : at + block] = sums
        return out

    def nearest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance of the nearest place, nan if none is within the radius: squares around the points are widened until their circle holds one."""
        out = np.full(len(x), np.inf)
        if not self.n:
            return out * np.nan
        open_, r = np.arange(len(x)), min(2 * self.h, self.radius)
        while len(open_):
            block = max(1, PAIRS // 4 // (int(2 * r / self.h) + 4))
            for at in range(0, len(open_), block):
                mine = open_[at : at + block]
                px, py = x[mine], y[mine]
                strip, there, _, _ = self._strips(py, r)
                base = np.where(there, strip, 0) * self.nx
                begin, end = (np.where(there, self.start[base + c[:, None]], 0) for c in (self._cell(px - r - EPS, 0), self._cell(px + r + EPS, 1)))
                for point, _, far in self._pairs(px, py, begin, end):
                    if len(point):
                        first = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
                        out[mine[point[first]]] = np.minimum.reduceat(far, first)
            open_ = open_[out[open_] > r] if r < self.radius else open_[:0]
            r = min(2 * r, self.radius)
        return np.where(out <= self.radius, out, np.nan)


def sums(batches: Iterator[pa.RecordBatch], totals: dict[str, float], nearest: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """x and y of points, and for the columns of ``totals`` and ``nearest`` the sum, and the nearest place of a positive value, within the column's radius."""
    seen, grids = None, {}
    for places, points in by_part(batches):
        if places is not seen:
            seen, (x, y) = places, (_column(places, "x"), _column(places, "y"))
            grids = {}
            for name, radius in {**totals, **nearest}.items():
                value = np.nan_to_num(_column(places, name))
                grids[name] = Grid(x[value > 0], y[value > 0], value[value > 0], radius)
        x, y = _column(points, "x"), _column(points, "y")
        found = [pa.array(np.rint(grids[c].total(x, y)).astype("int64")) for c in totals] + [pa.array(grids[c].nearest(x, y), from_pandas=True) for c in nearest]
        yield pa.RecordBatch.from_arrays([points["x"], points["y"], *found], ["x", "y", *totals, *(f"near_{c}" for c in nearest)])


def lists(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Points with the columns ``kept``, n (places) and found: names of places by cd and label, joined in the order of whole metres, facility_id and name.

    Places have facility_id, row (of those of one id), cd, label, name and reach, the greatest distance that counts; a row that is reached from
    several of its id's points at the same whole metres counts once.
    """
    seen = None
    for places, points in by_part(batches):
        if places is not seen:
            seen, (fx, fy, reach) = places, (_column(places, c) for c in ("x", "y", "reach"))
            order = pc.sort_indices(places, sort_keys=[(c, "ascending") for c in ("facility_id", "name", "row")], null_placement="at_start")
            ordered = places.select(["facility_id", "row", "name"]).take(order).combine_chunks()
            changes = np.any([pc.not_equal(ordered[c][1:], ordered[c][:-1]).to_numpy() for c in ("facility_id", "row")], axis=0) if places.num_rows else np.array([], dtype=bool)
            first = np.concatenate([[True], changes])[: places.num_rows].astype(bool)
            rank = np.empty(places.num_rows, "int64")
            rank[order.to_numpy()] = np.cumsum(first) - 1
            names = np.array([*ordered["name"].to_pylist(), None], dtype=object)[:-1][first]
            blank = np.array([v is None for v in names], dtype=bool)
            code, label = places["cd"].to_pylist(), places["label"].to_pylist()
            kinds = sorted(set(zip(code, label, strict=True)), key=str)
            kind = np.array([kinds.index(k) for k in zip(code, label, strict=True)], dtype="int64")
            bits, far = max(1, len(names).bit_length()), int(np.nanmax(reach, initial=0)) + 2
        hx, hy = _column(points, "x"), _column(points, "y")
        block = max(1, PAIRS // 2 // max(1, len(fx)))
        for at in range(0, points.num_rows, block):
            piece = points.slice(at, block)
            dx, dy = hx[at : at + block, None] - fx, hy[at : at + block, None] - fy
            d = np.sqrt(dx * dx + dy * dy)
            home, place = np.nonzero(d <= reach)
            d = d[home, place]
            metres = np.floor(d).astype("int64")
            metres += d - metres >= 0.5
            key = np.sort((((home * max(1, len(kinds)) + kind[place]) * far + metres) << bits) + rank[place]) if len(home) else np.array([], "int64")
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            group, row = (key >> bits) // far, key & ((1 << bits) - 1)
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(key) else np.array([], "int64")
            text, empty = names[row].tolist(), blank[row]
            joined = [", ".join(text[a:b]) if not empty[a:b].any() else ", ".join(t for t in text[a:b] if t is not None) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False)]
            owner, which = group[starts] // max(1, len(kinds)), group[starts] % max(1, len(kinds)) if len(key) else starts
            labels = pa.array([kinds[k][1] for k in which.tolist()], pa.string())
            offsets = np.searchsorted(owner, np.arange(piece.num_rows + 1))
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([labels, pa.array(joined, pa.string())], ["key", "value"]))
            n = np.bincount(group // max(1, len(kinds)), minlength=piece.num_rows).astype("int64")
            yield pa.RecordBatch.from_arrays([*(piece[c] for c in kept), pa.array(n), found], [*kept, "n", "found"])
