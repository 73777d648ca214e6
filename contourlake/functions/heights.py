"""NumPy kernels over one height field; NaN is an absent sample.

Operators run these on executors, one field (a row) at a time: a field is a bounded array, and a
table of any number of them needs no shuffle.
"""

from __future__ import annotations

import math

import numpy as np

from ..errors import Refusal
from .sliding import medians_and_deviations

#: Half amplitude at the cutoff: the Gaussian's constant, sqrt(ln 2 / pi).
ALPHA = math.sqrt(math.log(2.0) / math.pi)
#: Standard deviations of a normal sample for one median absolute deviation.
MAD_SCALE = 1.4826
#: Samples of a rectangle from which sorting each one costs more than keeping order while it slides.
LARGE = 900


def axes(shape, spacing_y: float, spacing_x: float) -> tuple[np.ndarray, np.ndarray]:
    """Centred coordinates: a column of y, a row of x."""
    y = (np.arange(shape[0]) - (shape[0] - 1) / 2.0) * spacing_y
    x = (np.arange(shape[1]) - (shape[1] - 1) / 2.0) * spacing_x
    return y[:, None], x[None, :]


def samples_within(width: float, spacing: float, name: str = "width") -> int:
    """A length in whole samples, halves to even; less than one is refused."""
    n = int(np.rint(width / spacing))
    if n < 1:
        raise Refusal("narrower-than-a-sample", f"{name} of {width} at a spacing of {spacing}")
    return n


def frame_mask(shape, down: int, across: int) -> np.ndarray:
    mask = np.zeros(shape, bool)
    mask[:down] = mask[max(0, shape[0] - down) :] = True
    mask[:, :across] = mask[:, max(0, shape[1] - across) :] = True
    return mask


def _box_any(mask: np.ndarray, down: int, across: int) -> np.ndarray:
    """Whether a rectangle around each sample holds a set one; outside the field nothing is set."""
    sums = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    sums[1:, 1:] = np.cumsum(np.cumsum(mask, 0), 1)
    top, left = (np.maximum(np.arange(n) - d, 0) for n, d in zip(mask.shape, (down, across), strict=True))
    low, right = (np.minimum(np.arange(n) + d + 1, n) for n, d in zip(mask.shape, (down, across), strict=True))
    return sums[np.ix_(low, right)] - sums[np.ix_(top, right)] - sums[np.ix_(low, left)] + sums[np.ix_(top, left)] > 0


def grown_mask(h: np.ndarray, down: int, across: int) -> np.ndarray:
    return _box_any(np.isnan(h), down, across)


def band_mask(y, x, width: float, position: float, angle_deg: float) -> np.ndarray:
    a = math.radians(angle_deg)
    return np.abs(y * math.cos(a) - x * math.sin(a) - position) <= width / 2.0


def disc_mask(y, x, centre_y: float, centre_x: float, radius: float) -> np.ndarray:
    return np.hypot(y - centre_y, x - centre_x) <= radius


def labelled(mask: np.ndarray) -> np.ndarray:
    """Four-connected components, numbered from 1 in raster order of their first sample; 0 elsewhere.

    Horizontal runs are joined with the runs they touch above, by union-find.
    """
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    parent = list(range(len(row)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    bounds = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for r in range(1, mask.shape[0]):
        above, here = bounds[r - 1], bounds[r]
        while above < bounds[r] and here < bounds[r + 1]:
            if start[above] < end[here] and start[here] < end[above]:
                a, b = find(int(above)), find(int(here))
                parent[max(a, b)] = min(a, b)
            if end[above] < end[here]:
                above += 1
            else:
                here += 1
    roots = np.array([find(k) for k in range(len(parent))], np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros(mask.shape, np.int64)
    for k, (r, a, b) in enumerate(zip(row, start, end, strict=True)):
        out[r, a:b] = number[k]
    return out


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with enclosed holes set: what is not set and does not reach the border."""
    outside = labelled(np.pad(~mask, 1, constant_values=True))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def detected_pin(h, y, x, threshold: float, spacing_y: float, spacing_x: float) -> tuple[float, float, float]:
    """Centre and equal-area radius of the largest region deeper than the median by ``threshold``."""
    deep = filled(np.nan_to_num(h, nan=np.inf) < np.nanmedian(h) - threshold)
    label = labelled(deep)
    if not label.any():
        raise Refusal("no-depression", f"nothing lies {threshold} below the median")
    size = np.bincount(label.ravel())[1:]
    inside = label == 1 + int(np.argmax(size))
    centre_y, centre_x = float(np.mean(np.broadcast_to(y, h.shape)[inside])), float(np.mean(np.broadcast_to(x, h.shape)[inside]))
    radius = math.sqrt(float(size.max()) * spacing_y * spacing_x / math.pi)
    if math.hypot(centre_y, centre_x) > radius:
        raise Refusal("depression-off-centre", f"({centre_y}, {centre_x}) with radius {radius}")
    return centre_y, centre_x, radius


def _windows(h: np.ndarray, down: int, across: int, rows: slice) -> np.ndarray:
    padded = np.pad(h, ((down, down), (across, across)), constant_values=np.nan)
    view = np.lib.stride_tricks.sliding_window_view(padded, (2 * down + 1, 2 * across + 1))[rows]
    return view.reshape(*view.shape[:2], -1)


def windowed(h: np.ndarray, down: int, across: int, of) -> np.ndarray:
    """``of(measured values)`` over the rectangle around each sample; NaN where nothing is measured."""
    out = np.full(h.shape, np.nan)
    for r in range(h.shape[0]):
        for c, w in enumerate(_windows(h, down, across, slice(r, r + 1))[0]):
            seen = w[~np.isnan(w)]
            if len(seen):
                out[r, c] = of(seen)
    return out


def centre_and_spread(h, criterion: str, reach: tuple[int, int] | None = None):
    """Centre and spread over all samples, or over the rectangle of ``reach`` around each one.

    Median with the unscaled median absolute deviation, or mean with the population deviation. A
    rectangle without a measured sample gives NaN for both.
    """
    mad = criterion == "median-absolute-deviation"
    if reach is None:
        if mad:
            centre = np.nanmedian(h)
            return centre, np.nanmedian(np.abs(h - centre))
        return np.nanmean(h), np.nanstd(h)
    if mad and (2 * reach[0] + 1) * (2 * reach[1] + 1) >= LARGE:
        return medians_and_deviations(h, *reach)
    centre, spread = np.full(h.shape, np.nan), np.full(h.shape, np.nan)
    size = (2 * reach[0] + 1) * (2 * reach[1] + 1) * h.shape[1]
    step = max(1, (1 << 22) // size)
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            for low in range(0, h.shape[0], step):
                rows = slice(low, low + step)
                w = _windows(h, *reach, rows)
                c = np.nanmedian(w, axis=2) if mad else np.nanmean(w, axis=2)
                centre[rows] = c
                spread[rows] = np.nanmedian(np.abs(w - c[..., None]), axis=2) if mad else np.nanstd(w, axis=2)
    return centre, spread


def _fit(design: np.ndarray, values: np.ndarray) -> np.ndarray:
    solution, _, rank, _ = np.linalg.lstsq(design, values, rcond=None)
    if rank < design.shape[1]:
        raise Refusal("rank-deficient", "the measured samples do not determine the form")
    return solution


def _robust_fit(design, values, tuning: float | None, passes: int | None) -> np.ndarray:
    """Least squares, then Huber reweighting ``passes`` times; stops when the residuals have no spread."""
    solution = _fit(design, values)
    for _ in range(passes or 0):
        residual = values - design @ solution
        limit = tuning * MAD_SCALE * float(np.median(np.abs(residual - np.median(residual))))
        if limit == 0.0:
            break
        size = np.abs(residual)
        root = np.sqrt(np.where(size <= limit, 1.0, limit / np.maximum(size, limit)))
        solution = _fit(design * root[:, None], values * root)
    return solution


def polynomial_form(h, y, x, degree: int, tuning: float | None = None, passes: int | None = None) -> np.ndarray:
    """The fitted polynomial of total degree ``degree`` at every sample. Coordinates are divided by the extent."""
    extent = float(max(np.abs(y).max(), np.abs(x).max())) or 1.0
    v, u = np.broadcast_to(y / extent, h.shape), np.broadcast_to(x / extent, h.shape)
    terms = np.stack([v**k * u ** (total - k) for total in range(degree + 1) for k in range(total + 1)], axis=-1)
    seen = ~np.isnan(h)
    return terms @ _robust_fit(terms[seen], h[seen], tuning, passes)


def sphere_form(h, y, x, tuning: float | None = None, passes: int | None = None) -> np.ndarray:
    """The sphere y2+x2+z2 = 2ay+2bx+2cz+k by algebraic least squares, on the branch that fits better."""
    extent = float(max(np.abs(y).max(), np.abs(x).max())) or 1.0
    v, u, z = np.broadcast_to(y / extent, h.shape), np.broadcast_to(x / extent, h.shape), h / extent
    seen = ~np.isnan(h)
    design = np.stack([2 * v[seen], 2 * u[seen], 2 * z[seen], np.ones(int(seen.sum()))], axis=-1)
    a, b, c, k = _robust_fit(design, v[seen] ** 2 + u[seen] ** 2 + z[seen] ** 2, tuning, passes)
    inner = k + a * a + b * b + c * c - (v - a) ** 2 - (u - b) ** 2
    if (inner < 0).any():
        raise Refusal("sphere-too-small", "the fitted sphere does not span the field")
    branches = [(c - np.sqrt(inner)) * extent, (c + np.sqrt(inner)) * extent]
    errors = [float(np.sum((h[seen] - f[seen]) ** 2)) for f in branches]
    return branches[1] if errors[1] < errors[0] else branches[0]


def gaussian_kernel(cutoff: float, spacing: float) -> np.ndarray:
    """Weights out to where they fall under the rounding unit; a half-width under one sample is refused."""
    half = int(ALPHA * cutoff * math.sqrt(math.log(1.0 / np.finfo(float).eps) / math.pi) / spacing)
    if half < 1:
        raise Refusal("cutoff-under-a-sample", f"{cutoff} at a spacing of {spacing}")
    x = np.arange(-half, half + 1) * spacing
    return np.exp(-math.pi * (x / (ALPHA * cutoff)) ** 2)


def _convolved(values: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Zero outside the field. Short kernels are summed directly, long ones as a banded matrix product."""
    n, half = values.shape[axis], len(kernel) // 2
    offset = np.arange(n)[:, None] - np.arange(n)[None, :] + half
    matrix = np.where((offset >= 0) & (offset < len(kernel)), kernel[np.clip(offset, 0, len(kernel) - 1)], 0.0)
    return matrix @ values if axis == 0 else values @ matrix.T


def smoothed(h, weight, cutoff: float, spacing_y: float, spacing_x: float) -> np.ndarray:
    """Gaussian mean of the weighted samples within reach; NaN where there is none."""
    down, across = gaussian_kernel(cutoff, spacing_y), gaussian_kernel(cutoff, spacing_x)
    top = _convolved(_convolved(np.where(weight > 0, np.nan_to_num(h), 0.0) * weight, down, 0), across, 1)
    below = _convolved(_convolved(weight, down, 0), across, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(below > 0, top / below, np.nan)


def bandpassed(h, short: float, long: float, spacing_y: float, spacing_x: float, tuning: float | None = None, passes: int | None = None) -> np.ndarray:
    """Smooth at ``short`` less smooth at ``long``, with Tukey weights from ``passes`` robust passes."""
    seen = (~np.isnan(h)).astype(float)
    weight = seen
    for _ in range(passes or 0):
        residual = h - smoothed(h, weight, short, spacing_y, spacing_x)
        known = residual[~np.isnan(residual)]
        scale = tuning * MAD_SCALE * float(np.median(np.abs(known - np.median(known)))) if len(known) else 0.0
        if scale == 0.0:
            weight = seen
            continue
        u = np.nan_to_num(residual / scale, nan=np.inf)
        weight = seen * np.where(np.abs(u) < 1, (1 - np.minimum(np.abs(u), 1) ** 2) ** 2, 0.0)
    out = smoothed(h, weight, short, spacing_y, spacing_x) - smoothed(h, weight, long, spacing_y, spacing_x)
    return np.where(np.isnan(h), np.nan, out)


def transmission(cutoff: float, wavelength: float) -> float:
    return math.exp(-math.pi * (ALPHA * cutoff / wavelength) ** 2)


def turned_from(r, c, shape: tuple[int, int], degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """Where samples (``r``, ``c``) of a field turned about its centre lie in the field. Rounding keeps the order along rows and columns."""
    a = math.radians(degrees)
    rows, cols = shape
    r, c = r - (rows - 1) / 2.0, c - (cols - 1) / 2.0
    return math.cos(a) * r - math.sin(a) * c + (rows - 1) / 2.0, math.sin(a) * r + math.cos(a) * c + (cols - 1) / 2.0


def gathered(h: np.ndarray, source_r: np.ndarray, source_c: np.ndarray, top: int = 0, left: int = 0) -> np.ndarray:
    """Bilinear values at positions of a field, of which ``h`` is the part that begins at ``top``, ``left``; what lies outside is absent.

    A sample counts only if all the weight of its interpolation came from measured samples.
    """
    rows, cols = h.shape
    above, before = np.floor(source_r).astype(int), np.floor(source_c).astype(int)
    fr, fc = source_r - above, source_c - before
    seen = ~np.isnan(h)
    value, weight = np.zeros(fr.shape), np.zeros(fr.shape)
    if not h.size:
        return np.full(fr.shape, np.nan)
    for dr, wr in ((0, 1 - fr), (1, fr)):
        for dc, wc in ((0, 1 - fc), (1, fc)):
            i, j = above + dr - top, before + dc - left
            within = (i >= 0) & (i < rows) & (j >= 0) & (j < cols)
            i, j = np.clip(i, 0, rows - 1), np.clip(j, 0, cols - 1)
            w = np.where(within & seen[i, j], wr * wc, 0.0)
            value += w * np.where(seen[i, j], h[i, j], 0.0)
            weight += w
    return np.where(weight >= 1.0 - 1e-9, value / np.maximum(weight, 1e-300), np.nan)


def rotated(h: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre by bilinear interpolation, in the same shape."""
    if degrees == 0:
        return h.copy()
    return gathered(h, *turned_from(np.arange(h.shape[0])[:, None], np.arange(h.shape[1])[None, :], h.shape, degrees))


def cell_bounds(n: int, grid: int) -> np.ndarray:
    """Where ``grid`` nearly equal parts of n samples begin, and n; the first n mod grid are one longer."""
    size, longer = divmod(n, grid)
    return np.cumsum([0] + [size + (k < longer) for k in range(grid)])


#: A variance at or under this share of the mean square is none at all.
FLAT = 1e-12


def _correlations(sums, mean_x: float = 0.0, mean_y: float = 0.0) -> np.ndarray:
    """Correlations from six sums over values less ``mean_x`` and ``mean_y``; whether there is variance is asked of the values as measured."""
    n, sx, sy, sxx, syy, sxy = sums
    measured_xx, measured_yy = sxx + mean_x * (2 * sx + n * mean_x), syy + mean_y * (2 * sy + n * mean_y)
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        out = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    out[(n < 1) | (vx <= FLAT * measured_xx) | (vy <= FLAT * measured_yy)] = np.nan
    return np.clip(out, -1.0, 1.0)


class Searched:
    """A reference field of which tiles are sought: sums over overlaps, by direct products or by FFT.

    With few displacements a tile is compared by a product of its samples with all shifted windows (one
    matrix product for the six sums); with many, by FFT of the tile's surroundings.
    """

    def __init__(self, reference: np.ndarray, limit: int):
        self.limit = limit
        padded = np.pad(reference, limit, constant_values=np.nan)
        self.seen = (~np.isnan(padded)).astype(float)
        self.mean = float(np.nanmean(reference)) if self.seen.any() else 0.0
        self.value = np.where(self.seen > 0, np.nan_to_num(padded) - self.mean, 0.0)

    def place(self, tile: np.ndarray, top: int, left: int, least: int) -> tuple[int, int, float, int] | None:
        """Best (down, across, correlation, overlap) of the tile within the limit; ties go to the first in raster order."""
        rows, cols = tile.shape
        side = 2 * self.limit + 1
        seen = (~np.isnan(tile)).astype(float)
        mean = float(np.nanmean(tile))
        value = np.where(seen > 0, np.nan_to_num(tile) - mean, 0.0)
        area = slice(top, top + rows + 2 * self.limit), slice(left, left + cols + 2 * self.limit)
        over_seen, over = self.seen[area], self.value[area]
        tiles = np.stack([seen, value, value * value])
        others = np.stack([over_seen, over, over * over])
        if side * side * tile.size <= 1 << 21:
            view = np.lib.stride_tricks.sliding_window_view(others, (rows, cols), axis=(1, 2)).reshape(3, side * side, -1)
            products = np.einsum("pdk,qk->pqd", view, tiles.reshape(3, -1), optimize=True)
        else:
            shape = over.shape
            f = np.fft.rfft2(others)
            g = np.conj(np.fft.rfft2(tiles, shape))
            products = np.fft.irfft2(f[:, None] * g[None, :], shape)[:, :, :side, :side].reshape(3, 3, -1)
        n = np.rint(products[0, 0])
        out = _correlations((n, products[0, 1], products[1, 0], products[0, 2], products[2, 0], products[1, 1]), mean, self.mean)
        out[n < least] = np.nan
        if np.isnan(out).all():
            return None
        best = int(np.nanargmax(np.round(out, 12)))
        return best // side - self.limit, best % side - self.limit, float(out[best]), int(n[best])


def angles(reach: float, step: float) -> list[float]:
    k = round(reach / step) if reach else 0
    return [i * step for i in range(-k, k + 1)]


def tiles(subject: np.ndarray, grid: int, minimum_valid: float):
    """(cell row, cell column, top, left, tile) of the tiles with enough measured samples."""
    down, across = cell_bounds(subject.shape[0], grid), cell_bounds(subject.shape[1], grid)
    for i in range(grid):
        for j in range(grid):
            tile = subject[down[i] : down[i + 1], across[j] : across[j + 1]]
            if np.count_nonzero(~np.isnan(tile)) >= minimum_valid * tile.size:
                yield i, j, int(down[i]), int(across[j]), tile


def placements(subject, reference, degrees: float, grid: int, minimum_valid: float, limit: int):
    """Best placement of each usable tile on the reference turned by ``degrees``: (i, j, down, across, correlation, overlap)."""
    searched = Searched(rotated(reference, degrees), limit)
    for i, j, top, left, tile in tiles(subject, grid, minimum_valid):
        found = searched.place(tile, top, left, max(1, math.ceil(minimum_valid * tile.size)))
        if found is not None:
            yield i, j, *found


def compared(subject, reference, grid: int, minimum_valid: float):
    """Best placement of each tile anywhere on the reference that holds it whole, in one orientation."""
    rows, cols = reference.shape
    seen = (~np.isnan(reference)).astype(float)
    mean = float(np.nanmean(reference))
    value = np.where(seen > 0, np.nan_to_num(reference) - mean, 0.0)
    f = np.fft.rfft2(np.stack([seen, value, value * value]))
    for i, j, top, left, tile in tiles(subject, grid, minimum_valid):
        own = (~np.isnan(tile)).astype(float)
        mean_here = float(np.nanmean(tile))
        centred = np.where(own > 0, np.nan_to_num(tile) - mean_here, 0.0)
        g = np.conj(np.fft.rfft2(np.stack([own, centred, centred * centred]), (rows, cols)))
        p = np.fft.irfft2(f[:, None] * g[None, :], (rows, cols))[:, :, : rows - tile.shape[0] + 1, : cols - tile.shape[1] + 1]
        n = np.rint(p[0, 0])
        out = _correlations((n, p[0, 1], p[1, 0], p[0, 2], p[2, 0], p[1, 1]), mean_here, mean)
        out[n < max(1, math.ceil(minimum_valid * tile.size))] = np.nan
        if not np.isnan(out).all():
            r, c = np.unravel_index(int(np.nanargmax(np.round(out, 12))), out.shape)
            yield i, j, int(r) - top, int(c) - left, float(out[r, c]), int(n[r, c])
