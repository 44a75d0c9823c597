"""Image kernels in numpy, from the published definitions: Canny, Hough, chamfer distances, components, Otsu, BRISQUE-like score.

All take a gray image (two-dimensional, 8 bits). They aim at the documented algorithms and not at any library's last bit.
"""

from __future__ import annotations

import numpy as np

#: Pairs of a centre and an edge pixel that are looked at together.
CELLS = 1 << 16


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Gray image from BGR(A) or gray bytes; None if there is no image."""
    if height <= 0 or width <= 0 or len(data) < height * width * channels:
        return None
    x = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    return np.rint(x[:, :, 2] * 0.299 + x[:, :, 1] * 0.587 + x[:, :, 0] * 0.114).astype(np.uint8)


def _mirrored(x: np.ndarray, n: int) -> np.ndarray:
    return np.pad(x, n, mode="reflect" if min(x.shape) > n else "edge")


def laplacian_variance(g: np.ndarray) -> float:
    p = _mirrored(g.astype(np.float64), 1)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def canny(g: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: Sobel gradients, suppression of what is no maximum across the edge, then hysteresis."""
    return _edges(np.pad(g.astype(np.int32), 1, mode="edge"), None, low, high)


def _edges(p: np.ndarray, inside: np.ndarray | None, low: float, high: float) -> np.ndarray:
    """Edges of an image with a border of one; there are no gradients but ``inside``."""
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    if inside is not None:
        size *= inside
    m = np.pad(size, 1)
    # neighbours are looked up only where a gradient is large enough
    at = np.flatnonzero(size > low)
    dx, dy, size = dx.ravel()[at], dy.ravel()[at], size.ravel()[at]
    wide, here = m.shape[1], at + 2 * (at // p[1:-1, 1:-1].shape[1]) + m.shape[1] + 1
    flat, steep = np.abs(dy) <= np.abs(dx) * 0.41421356, np.abs(dy) >= np.abs(dx) * 2.41421356
    step = np.where(flat, 1, np.where(steep, wide, np.where(dx.astype(np.int64) * dy > 0, wide + 1, wide - 1)))
    m = m.ravel()
    thin = (size > m[here - step]) & (size >= m[here + step])
    weak = np.zeros((p.shape[0] - 2, p.shape[1] - 2), bool)
    weak.ravel()[at[thin]] = True
    labels, count = components(weak)
    keep = np.zeros(count + 1, bool)
    keep[labels.ravel()[at[thin & (size > high)]]] = True
    return keep[labels]


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Eight-connected components, numbered from 1 by their first pixels, by joining runs of neighbouring rows."""
    h, w = mask.shape
    labels = np.zeros(h * w, np.int64)
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    # places of runs in one line of all rows, with a gap of two
    turn = np.diff(padded.ravel(), prepend=np.int8(0))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    wide = w + 2
    first, past = np.searchsorted(ends, starts - wide), np.searchsorted(starts, ends - wide, side="right")
    touching = np.maximum(past - first, 0)
    below = np.repeat(np.arange(len(starts)), touching)
    above = np.arange(len(below)) - np.repeat(np.cumsum(touching) - touching - first, touching)
    # the least run that a run hangs together with: roots of both sides take the lesser one, then paths are halved
    root = np.arange(len(starts))
    while len(below):
        a, b = root[below], root[above]
        apart = a != b
        if not apart.any():
            break
        below, above, a, b = below[apart], above[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    top = root == np.arange(len(root))
    number = np.cumsum(top)[root]
    labels[np.flatnonzero(mask)] = np.repeat(number, ends - starts)
    return labels.reshape(h, w), int(top.sum())


def dilate(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return _box(mask, height, width, np.maximum, 0)


def erode(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    return _box(mask, height, width, np.minimum, 1)


def _box(mask: np.ndarray, height: int, width: int, pick, outside: int) -> np.ndarray:
    out = mask.astype(np.uint8)
    for axis, n in ((0, height), (1, width)):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (n // 2, n - 1 - n // 2)
        p = np.pad(out, pad, constant_values=outside)
        rows = [p[k : k + out.shape[0]] if axis == 0 else p[:, k : k + out.shape[1]] for k in range(n)]
        out = pick.reduce(rows)
    return out.astype(bool)


def otsu(g: np.ndarray) -> int:
    """Threshold with the greatest variance between classes."""
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below))
    return int(np.nan_to_num(between, nan=0.0, posinf=0.0).argmax())


def distance(mask: np.ndarray, five: bool, outside: np.ndarray | None = None) -> np.ndarray:
    """Chamfer distance of set pixels to the nearest unset one: 3x3 steps (0.955, 1.3693) or 5x5 steps (1, 1.4, 2.1969). No way leads over what is ``outside``."""
    steps = [(0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.4), (1, -1, 1.4), (1, 2, 2.1969), (2, 1, 2.1969), (1, -2, 2.1969), (2, -1, 2.1969)] if five else [(0, 1, 0.955), (1, 0, 0.955), (1, 1, 1.3693), (1, -1, 1.3693)]
    # set pixels alone change; a border as wide as a step is far from all unset ones
    n = 2 if five else 1
    wide = mask.shape[1] + 2 * n
    d = np.pad(np.where(mask if outside is None else mask | outside, 1e9, 0.0), n, constant_values=1e9)
    flat = d.ravel()
    own = np.flatnonzero(np.pad(mask, n))
    ways = [(sign * (dy * wide + dx), cost) for dy, dx, cost in steps for sign in (1, -1)]
    open_ = own
    while len(open_):
        best = np.minimum.reduce([flat[open_ + way] + cost for way, cost in ways])
        nearer = best < flat[open_]
        flat[open_[nearer]] = best[nearer]
        if not nearer.any():
            break
        # nothing is nearer than a straight step
        open_ = open_[flat[open_] > steps[0][2]]
    d = d[n : n + mask.shape[0], n : n + mask.shape[1]]
    return np.where(d >= 1e8, 0.0, d)


def _cv(x: np.ndarray, eps: float = 0.0) -> float:
    return float(x.std() / (x.mean() + eps) * 100) if len(x) and x.mean() + eps else 0.0


def edge_features(g: np.ndarray) -> dict:
    e = canny(g, 50, 150)
    return edge_mass(e) | {"skew": skew(e)}


def edge_mass(e: np.ndarray) -> dict:
    rows, columns = e.sum(axis=1) * 255.0, e.sum(axis=0) * 255.0
    return {"edge_density": float(e.mean() * 100), "thick": float(dilate(e, 5, 5).mean() * 100), "irregularity": float((rows.var() + columns.var()) / 1e6)}


def skew(edges: np.ndarray, votes: int = 200, lines: int = 20) -> float:
    """Mean angle of the strongest straight lines, in degrees, brought into -45 to 45 after averaging; 0 without any line."""
    ys, xs = (z.astype(np.float64) for z in np.nonzero(edges))
    if len(ys) <= votes:
        return 0.0
    reach = edges.shape[0] + edges.shape[1] + 1
    table = np.zeros((182, 2 * reach + 3), np.int64)
    for k in range(180):
        t = np.deg2rad(k)
        across = xs * np.cos(t)
        across += ys * np.sin(t)
        np.rint(across, out=across)
        across += reach + 1
        table[k + 1] = np.bincount(across.astype(np.int64), minlength=2 * reach + 3)
    # neighbours are looked up only where there are votes enough
    k, r = np.nonzero(table > votes)
    n = table[k, r]
    peak = (n > table[k, r - 1]) & (n >= table[k, r + 1]) & (n > table[k - 1, r]) & (n >= table[k + 1, r])
    at, n = k[peak] - 1, n[peak]
    if not len(at):
        return 0.0
    best = at[np.argsort(-n, kind="stable")][:lines]
    angle = float((best - 90.0).mean())
    return angle - 90 if angle > 45 else angle + 90 if angle < -45 else angle


def stroke_score(g: np.ndarray) -> float:
    d = distance(canny(g, 50, 150), True)
    return _cv(d[d > 0])


def baseline_score(g: np.ndarray) -> float:
    n = (g < 128).sum(axis=1)
    gaps = np.diff(np.flatnonzero(n > 0.3 * n.max()))
    return min(_cv(gaps) * 1.5, 60.0) if len(gaps) else 0.0


def spacing_score(g: np.ndarray) -> float:
    n = (g < 128).sum(axis=0)
    gaps = np.diff(np.flatnonzero(n < 0.1 * n.max()))
    gaps = gaps[gaps > 5]
    return min(_cv(gaps), 100.0) if len(gaps) else 0.0


def component_score(g: np.ndarray) -> float:
    labels, count = components(g <= otsu(g))
    if not count:
        return 0.0
    at = np.flatnonzero(labels)
    k = labels.ravel()[at]
    size = lambda v: _span(k, v, count)
    return float(min((size(at % g.shape[1]) / (size(at // g.shape[1]) + 1e-5)).var() * 10, 100.0))


def _span(k: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    low, high = np.full(count + 1, 1 << 40), np.full(count + 1, -1)
    np.minimum.at(low, k, v)
    np.maximum.at(high, k, v)
    return (high - low + 1)[1:].astype(np.float64)


def hot_cells(g: np.ndarray, grid: int = 4) -> int:
    """Cells of the grid whose stroke widths vary by more than 20 per cent; the last row and column take the remainder."""
    # all cells at once: in one image, each with a border of its own
    (rows, top, y), (columns, left, x) = (_cut(n, grid) for n in g.shape)
    if not len(rows) or not len(columns):
        return 0
    inside = (y >= 0)[:, None] & (x >= 0)
    e = np.zeros(inside.shape, bool)
    e[1:-1, 1:-1] = _edges(g[np.ix_(rows, columns)].astype(np.int32), inside[1:-1, 1:-1], 50, 150)
    d = distance(e, False, ~inside)
    hot = 0
    for a, b in top:
        for l, r in left:
            cell = d[a:b, l:r][e[a:b, l:r]]
            cell = cell[cell > 0]
            hot += len(cell) > 10 and _cv(cell, 1e-5) > 20
    return int(hot)


def _cut(n: int, grid: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Lines of cells with their first and last ones repeated; where each cell is among them; the number of the line, -1 for what is repeated."""
    ends = [*(k * (n // grid) for k in range(grid)), n]
    cells = [(a, b) for a, b in zip(ends, ends[1:]) if b > a]
    lines = np.concatenate([np.zeros(0, np.int64), *([a, *range(a, b), b - 1] for a, b in cells)]).astype(np.int64)
    own = np.concatenate([np.zeros(0, np.int64), *([-1, *range(a, b), -1] for a, b in cells)]).astype(np.int64)
    start = np.cumsum([1, *(b - a + 2 for a, b in cells)])
    return lines, [(int(s), int(s + b - a)) for s, (a, b) in zip(start, cells)], own


def brisque(g: np.ndarray) -> float:
    """Score from products of neighbouring contrast-normalised values, 0 (natural) to 100."""
    x = g.astype(np.float32) / np.float32(255)
    r = np.arange(-3, 4)
    k = np.exp(-(r**2) / (2 * (7 / 6) ** 2))
    k = (k / k.sum()).astype(np.float32)

    def blur(z):
        p = _mirrored(z, 3)
        p = sum(k[i] * p[i : i + z.shape[0], :] for i in range(7))
        return sum(k[i] * p[:, i : i + z.shape[1]] for i in range(7))

    mean = blur(x)
    m = (x - mean) / np.sqrt(np.abs(blur(x * x) - mean * mean) + np.float32(1e-10))
    across, down = m[:, :-1] * m[:, 1:], m[:-1] * m[1:]
    if not across.size or not down.size:
        return 0.0
    return float(min((abs(across.mean()) + abs(down.mean()) + across.std() + down.std()) * 20, 100.0))


def barcode_peaks(g: np.ndarray) -> int:
    """Columns with outstanding edge counts in the top 15 per cent of the page."""
    top = g[: max(1, int(g.shape[0] * 0.15))]
    sums = canny(top, 30, 100).sum(axis=0) * 255.0
    return int((sums > sums.mean() + 2 * sums.std()).sum())


def validator_barcode(g: np.ndarray) -> bool:
    top = g[: max(1, int(g.shape[0] * 0.2))]
    sums = canny(top, 50, 150).sum(axis=0) * 255.0
    return bool(sums.std() > 20 and sums.max() > 0.1 * g.shape[0])


def line_mass(g: np.ndarray) -> tuple[float, float]:
    """Pixels left of the inverted binary image after opening with a horizontal and a vertical bar of forty pixels."""
    ink = g <= otsu(g)
    out = []
    for h, w in ((1, 40), (40, 1)):
        x = ink
        for f in (erode, erode, dilate, dilate):
            x = f(x, h, w)
        out.append(float(x.sum()))
    return out[0], out[1]


def circles(g: np.ndarray, least: int = 40, most: int = 150, apart: int = 100, share: float = 0.5) -> int:
    """Round seals: edge pixels vote along their gradient for centres, for all radii at once; a local maximum of the votes
    counts if ``share`` of a circle around it are edge pixels whose gradient points to or from it."""
    return sum(1 for _ in _seals(g.shape, _slopes(g), least, most, apart, share))


def _slopes(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and direction of the gradient of each edge pixel of the smoothed page."""
    r = np.arange(-4, 5)
    k = np.exp(-(r**2) / 8)
    k /= k.sum()
    p = np.pad(g.astype(np.float64), 4, mode="edge")
    p = sum(k[i] * p[i : i + g.shape[0], :] for i in range(9))
    soft = sum(k[i] * p[:, i : i + g.shape[1]] for i in range(9))
    if min(g.shape) < 2:
        return (np.zeros(0),) * 4
    ys, xs = np.nonzero(canny(np.rint(soft).astype(np.uint8), 50, 100))
    gy, gx = (z[ys, xs] for z in np.gradient(soft))
    size = np.hypot(gx, gy)
    some = size > 0
    return ys[some], xs[some], gx[some] / size[some], gy[some] / size[some]


def _seals(shape: tuple[int, int], slopes: tuple, least: int, most: int, apart: int, share: float):
    """Centres of seals one after the other, those with most votes first."""
    h, w = shape
    ys, xs, ux, uy = slopes
    radii = np.arange(least, min(most, max(h, w) // 2) + 1)
    if not len(ys) or not len(radii):
        return
    votes = np.zeros(h * w)
    for radius in radii[::2].tolist():
        for sign in (-radius, radius):
            cy, cx = np.rint(ys + sign * uy).astype(np.int64), np.rint(xs + sign * ux).astype(np.int64)
            ok = (cy >= 0) & (cy < h) & (cx >= 0) & (cx < w)
            votes += np.bincount(cy[ok] * w + cx[ok], minlength=h * w) / (2 * np.pi * radius)
    p = np.pad(votes.reshape(h, w), 2)
    near = sum(p[a : a + h, b : b + w] for a in range(5) for b in range(5))
    p = np.pad(near, 1)
    p = np.maximum(np.maximum(p[:-2], p[1:-1]), p[2:])
    peak = (near >= share) & (near == np.maximum(np.maximum(p[:, :-2], p[:, 1:-1]), p[:, 2:]))
    centres = np.argwhere(peak)
    centres = centres[np.argsort(-near[peak], kind="stable")]

    size = int(radii[-1]) + 2

    def around(place: np.ndarray, n: int) -> np.ndarray:
        """For each of n centres, the largest share of a circle that pixels make up; their places are distances, plus ``size`` for each centre before."""
        rings = np.bincount(place, minlength=n * size).reshape(n, size)
        return ((rings[:, radii - 1] + rings[:, radii] + rings[:, radii + 1]) / (2 * np.pi * radii)).max(axis=1)

    # many centres at once, with products of matrices; what passes with a slack is looked at again in double precision
    kind = np.float32 if 4 * (h * h + w * w) < 1 << 24 else np.float64
    py, px, dy, dx = (z.astype(kind) for z in (ys, xs, uy, ux))
    own, along = py * py + px * px, py * dy + px * dx
    spots, slope = np.stack([py, px]), np.stack([dy, dx])
    reach = (size - 0.5) ** 2
    kept: list[tuple[int, int]] = []
    step, at = max(1, CELLS // len(ys)), 0
    while at < len(centres):
        part = centres[at : at + step]
        at += len(part)
        for a, b in kept:
            part = part[np.hypot(part[:, 0] - a, part[:, 1] - b) >= apart]
        if not len(part):
            continue
        c = part.astype(kind)
        squares = -2 * c @ spots
        squares += own
        squares += (c * c).sum(axis=1)[:, None]
        radial = along - c @ slope
        radial *= radial
        radial -= kind(0.809) * squares
        good = np.flatnonzero((radial >= 0) & (squares < kind(reach)))
        place = np.sqrt(squares, out=squares)
        np.rint(place, out=place)
        place += (np.arange(len(part), dtype=kind) * size)[:, None]
        best = around(place.ravel().take(good).astype(np.int64), len(part))
        for y, x in part[best >= share].tolist():
            if any(np.hypot(y - a, x - b) < apart for a, b in kept):
                continue
            far = np.hypot(ys - y, xs - x)
            radial = np.abs((ys - y) * uy + (xs - x) * ux) >= 0.9 * far
            place = np.rint(far[radial]).astype(np.int64)
            if around(place[place < size], 1)[0] >= share:
                kept.append((y, x))
                yield y, x


def validator_seal(g: np.ndarray) -> bool:
    return _any_seal(g, _slopes(g))


def _any_seal(g: np.ndarray, slopes: tuple) -> bool:
    return next(_seals(g.shape, slopes, 30, 150, 50, 0.5), None) is not None


def seals(g: np.ndarray) -> dict:
    slopes = _slopes(g)
    return {"seal_count": sum(1 for _ in _seals(g.shape, slopes, 40, 150, 100, 0.5)), "has_seal": _any_seal(g, slopes)}


def validator_table(g: np.ndarray) -> bool:
    """Whether horizontal bars of forty pixels leave more than a thousandth of the page's size, counted in units of gray."""
    return line_mass(g)[0] * 255 > g.shape[0] * g.shape[1] * 0.001


KERNELS = {
    "basic": lambda g: {"blur": laplacian_variance(g), "brightness": float(g.mean()), "contrast": float(g.std()), "white_space": float((g > 240).mean() * 100)},
    "edges": edge_features,
    "hand": lambda g: _hand(stroke_score(g), baseline_score(g), spacing_score(g), component_score(g)),
    "grid": lambda g: {"hot_regions": hot_cells(g)},
    "brisque": lambda g: {"brisque": brisque(g)},
    "barcode": lambda g: {"peak_count": barcode_peaks(g), "has_barcode": validator_barcode(g)},
    "seals": seals,
    "tables": lambda g: dict(zip(("h_lines", "v_lines"), line_mass(g))) | {"has_table": validator_table(g)},
}


#: Figures out of one of the above, for those who want no others.
PARTS = {
    "edge_mass": lambda g: edge_mass(canny(g, 50, 150)),
    "skew": lambda g: {"skew": skew(canny(g, 50, 150))},
    "component": lambda g: {"component": component_score(g)},
}


def _hand(stroke: float, base: float, space: float, comp: float) -> dict:
    return {"stroke": stroke, "baseline": base, "spacing": space, "component": comp, "hw": float(np.rint((0.35 * stroke + 0.15 * base + 0.30 * space + 0.20 * comp) * 100) / 100)}


def features(g: np.ndarray, kernels: list[str] | None = None) -> dict:
    """The figures of a page in one pass: all, or those of some ``KERNELS`` or ``PARTS``."""
    out: dict = {}
    for name, kernel in (KERNELS if kernels is None else KERNELS | PARTS).items():
        if kernels is None or name in kernels:
            out |= kernel(g)
    return out
