"""Pixel algorithms over numpy arrays: resizing, warping, morphology and regions, dense flow, corners and tracking, JPEG
round trips. Each is a function of one frame or a pair; palisade.operators.pixels applies them to batches in tasks.

Grey frames are 2-d arrays, colour frames (height, width, 3) of blue, green, red. Borders are said for each. What flow and
tracking need of one frame (Look) is made once and serves both pairs that the frame is in."""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

# ------------------------------------------------------------------------------------------------- geometry


@lru_cache(64)
def area_weights(source: int, target: int) -> np.ndarray:
    """(target, source) weights of an area filter: overlaps of target cells with source pixels when shrinking; when growing, a
    linear blend between the two nearest source pixels where a target cell reaches over their edge."""
    scale = source / target
    out = np.zeros((target, source))
    if scale >= 1:
        edges = np.arange(target + 1) * scale
        for k in range(target):
            lo, hi = edges[k], edges[k + 1]
            first, last = int(lo), min(int(np.ceil(hi - 1e-9)), source)
            cells = np.arange(first, last)
            out[k, first:last] = np.minimum(cells + 1, hi) - np.maximum(cells, lo)
        return out / out.sum(axis=1, keepdims=True)
    k = np.arange(target)
    at = np.minimum(np.floor(k * scale).astype(int), source - 1)
    part = (k + 1) - (at + 1) / scale
    part = np.where(part <= 0, 0.0, part - np.floor(part))
    out[k, at] += 1 - part
    out[k, np.minimum(at + 1, source - 1)] += part
    return out


def area_resize(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """A frame at another size by its area filter, grey or colour, as doubles."""
    if frame.shape[:2] == (height, width):
        return frame.astype(np.float64)
    rows, columns = area_weights(frame.shape[0], height), area_weights(frame.shape[1], width)
    out = np.tensordot(rows, frame.astype(np.float64), axes=(1, 0))
    return np.moveaxis(np.tensordot(columns, out, axes=(1, 1)), 0, 1)


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Indices reflected at the borders, border pixels twice."""
    if at.size and at.min() >= 0 and at.max() < size:
        return at
    at = np.mod(at, 2 * size)
    return np.where(at >= size, 2 * size - 1 - at, at)


@lru_cache(16)
def _grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """y and x of each pixel."""
    y, x = np.mgrid[:h, :w].astype(np.float64)
    return y, x


def warp(image: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """image (or a field) read at each pixel's place plus its flow (x, y), bilinear, reflected at the borders."""
    h, w = flow.shape[:2]
    y, x = _grid(h, w)
    x, y = x + flow[..., 0].astype(np.float64), y + flow[..., 1].astype(np.float64)
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    rows, columns = ([mirrored(v, n) for v in (v0, v0 + 1)] for v0, n in ((y0, h), (x0, w)))
    places = [r * w + c for r in rows for c in columns]
    gx, gy = 1 - fx, 1 - fy

    def read(plane: np.ndarray) -> np.ndarray:
        a, b, c, d = (plane.ravel().take(k, mode="clip") for k in places)
        return (a * gx + b * fx) * gy + (c * gx + d * fx) * fy

    return read(image) if image.ndim == 2 else np.stack([read(image[..., k]) for k in range(image.shape[2])], axis=-1)


@lru_cache(64)
def _beyond(n: int, r: int, mode: str) -> np.ndarray:
    """Places of n pixels and of r more at both ends, by numpy's name of what borders do."""
    return np.pad(np.arange(n), r, mode=mode)


def correlate(image: np.ndarray, kernel: np.ndarray, axis: int, mode: str = "reflect") -> np.ndarray:
    """One axis with a kernel of odd length; borders by numpy's name of the mode."""
    n = image.shape[axis]
    wide = image.take(_beyond(n, len(kernel) // 2, mode), axis=axis)
    out = np.zeros(image.shape, dtype=np.result_type(image.dtype, np.float32))
    part = np.empty_like(out)
    at = [slice(None)] * image.ndim
    for k, v in enumerate(kernel):
        if v:
            at[axis] = slice(k, k + n)
            out += np.multiply(wide[tuple(at)], out.dtype.type(v), out=part)
    return out


def gauss(sigma: float, radius: int) -> np.ndarray:
    k = np.arange(-radius, radius + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    return w / w.sum()


def sobel(image: np.ndarray, axis: int, side: tuple[int, ...] = (1, 2, 1)) -> np.ndarray:
    """Differences along an axis (0: y, 1: x), smoothed across it, borders reflected without their pixel."""
    return correlate(correlate(image, np.array([-1, 0, 1]), axis), np.array(side), 1 - axis)


# ------------------------------------------------------------------------------------------------- regions


def hsv(frame: np.ndarray) -> np.ndarray:
    """Hue (0 to 179, halves of degrees), saturation and value (0 to 255), whole numbers, of a colour frame of bytes."""
    b, g, r = (frame[..., k].astype(np.float64) for k in range(3))
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = high - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    hue = np.where(span == 0, 0, np.where(hue < 0, hue + 180, hue))
    return np.stack([np.rint(hue) % 180, np.rint(255 * span / np.where(high == 0, 1, high)), high], axis=-1)


def _shifts(mask: np.ndarray, outside: bool) -> list[np.ndarray]:
    wide = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    return [wide[y : y + h, x : x + w] for y in range(3) for x in range(3)]


def eroded(mask: np.ndarray) -> np.ndarray:
    """3 x 3; what lies outside doesn't erode."""
    return np.logical_and.reduce(_shifts(mask, True))


def dilated(mask: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce(_shifts(mask, False))


def cleaned(mask: np.ndarray) -> np.ndarray:
    """Opened, then closed, 3 x 3."""
    return eroded(dilated(dilated(eroded(mask))))


def regions(mask: np.ndarray) -> dict[str, np.ndarray]:
    """8-connected regions in the order of their first pixels: x, y, width, height, area, centre_x, centre_y.

    Runs of a row are joined to the runs of the row above that they touch; labels then flow to the smallest run of a
    region by pointer jumping."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), dtype=np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1] - 1
    n = len(row)
    # runs in order of row and column: those of the row above that reach from begin - 1 to end + 1
    width = w + 2
    first = np.searchsorted(row * width + end, (row - 1) * width + begin - 1)
    last = np.searchsorted(row * width + begin, (row - 1) * width + end + 1, side="right")
    counts = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), counts)
    b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    roots, of = np.unique(label, return_inverse=True)
    size = end - begin + 1
    area = np.bincount(of, size, len(roots))
    out = {"x": np.full(len(roots), w), "y": np.full(len(roots), h)}
    right, bottom = np.full(len(roots), -1), np.full(len(roots), -1)
    np.minimum.at(out["x"], of, begin)
    np.minimum.at(out["y"], of, row)
    np.maximum.at(right, of, end)
    np.maximum.at(bottom, of, row)
    out |= {"width": right - out["x"] + 1, "height": bottom - out["y"] + 1, "area": area.astype(np.int64)}
    safe = np.maximum(area, 1)
    out |= {"centre_x": np.bincount(of, size * (begin + end) / 2, len(roots)) / safe, "centre_y": np.bincount(of, size * row, len(roots)) / safe}
    return out


#: Hue, saturation and value of skin-like colours; what an admissible region must have.
SKIN_LOW, SKIN_HIGH = (0, 25, 45), (25, 220, 255)
LEAST_AREA, LEAST_SHARE, LEAST_SIDE, RATIOS, LEAST_FILL = 120, 0.004, 16, (0.45, 1.8), 0.18


def skin_regions(frame: np.ndarray) -> tuple[int, list[float] | None]:
    """How many admissible skin-like regions a colour frame has, and the largest of them (of equals the last): centre
    x and y, width and height, as shares of the frame."""
    h, w = frame.shape[:2]
    colour = hsv(frame)
    found = regions(cleaned(np.logical_and.reduce([(colour[..., k] >= SKIN_LOW[k]) & (colour[..., k] <= SKIN_HIGH[k]) for k in range(3)])))
    ratio = found["width"] / np.maximum(found["height"], 1)
    fill = found["area"] / np.maximum(found["width"] * found["height"], 1)
    ok = (found["area"] >= max(LEAST_AREA, w * h * LEAST_SHARE)) & (ratio >= RATIOS[0]) & (ratio <= RATIOS[1])
    ok &= (found["width"] >= LEAST_SIDE) & (found["height"] >= LEAST_SIDE) & (fill >= LEAST_FILL)
    at = np.nonzero(ok)[0]
    if not len(at):
        return 0, None
    k = at[len(at) - 1 - found["area"][at][::-1].argmax()]
    return len(at), [found["centre_x"][k] / w, found["centre_y"][k] / h, found["width"][k] / w, found["height"][k] / h]


# ------------------------------------------------------------------------------------------------- dense flow

#: Reach and deviation of the polynomial neighbourhood, window, rounds, weights of the five border pixels.
REACH, DEVIATION, WINDOW, ROUNDS = 5, 1.2, 15, 3
BORDER = (0.14, 0.14, 0.4472, 0.4472, 0.4472)


def expansion(image: np.ndarray) -> np.ndarray:
    """At each pixel, the quadratic that fits its neighbourhood best under Gaussian weights: coefficients of x, y, x squared,
    y squared and xy (first axis)."""
    g = gauss(DEVIATION, REACH)
    k = np.arange(-REACH, REACH + 1)
    second, fourth = float((g * k**2).sum()), float((g * k**4).sum())
    lines = [correlate(image, g * k**py, 0, "edge") for py in range(3)]
    moment = lambda px, py: correlate(lines[py], g * k**px, 1, "edge")
    flat, xx, yy = moment(0, 0), moment(2, 0), moment(0, 2)
    # the constant and both squares are coupled; all else stands alone
    inverse = np.linalg.inv(np.array([[1, second, second], [second, fourth, second**2], [second, second**2, fourth]]))
    square = lambda row: sum(np.float32(v) * m for v, m in zip(row, (flat, xx, yy)))
    one = np.float32(1 / second)
    return np.stack([moment(1, 0) * one, moment(0, 1) * one, square(inverse[1]), square(inverse[2]), moment(1, 1) * one * one])


def _box(a: np.ndarray, size: int) -> np.ndarray:
    """Means of square windows (sides odd) of a plane, borders repeated."""
    for _ in range(2):
        n = len(a)
        # sums of 1, 2, 4, ... rows; those that the size is made of are added up
        part, at, total, long = a.take(_beyond(n, size // 2, "edge"), axis=0), 0, np.zeros(a.shape), 1
        while long <= size:
            if size & long:
                total += part[at : at + n]
                at += long
            if 2 * long <= size:
                part = part[:-long] + part[long:]
            long *= 2
        total /= size
        a = np.ascontiguousarray(total.T)
    return a


@lru_cache(16)
def _edges(h: int, w: int) -> np.ndarray:
    """Weights of pixels by their distance from the border."""
    weight = np.ones((h, w))
    for k, v in enumerate(BORDER[: min(h, w) // 2]):
        for line in (weight[k], weight[-1 - k], weight[:, k], weight[:, -1 - k]):
            line *= v
    return weight


def _moved(flow: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A better flow (x and y on the first axis): displacements that bring the quadratics of a window of `one` to those of
    `two`."""
    h, w = flow.shape[1:]
    y, x = _grid(h, w)
    px, py = x + flow[0], y + flow[1]
    x0, y0 = np.floor(px), np.floor(py)
    fx, fy = px - x0, py - y0
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < w - 1) & (y0 < h - 1)
    u, v = np.clip(x0, 0, max(w - 2, 0)).astype(np.int64), np.clip(y0, 0, max(h - 2, 0)).astype(np.int64)
    at, right, down = v * w + u, int(w > 1), w * int(h > 1)
    reads = [(at, (1 - fx) * (1 - fy)), (at + right, fx * (1 - fy)), (at + down, (1 - fx) * fy), (at + (right + down), fx * fy)]
    # where a place lies outside, the quadratic of `one` stands in, with no change to explain
    half = inside * 0.5

    def change(k: int) -> np.ndarray:
        """Half of what two's coefficient there has over one's here."""
        plane, out = two[k].ravel(), -one[k]
        for places, share in reads:
            part = plane.take(places, mode="clip")
            part *= share
            out += part
        out *= half
        return out

    bx, by = -change(0), -change(1)
    xx, yy, xy = (one[k] + change(k) for k in (2, 3, 4))
    xy = xy / 2
    bx = (bx + xx * flow[0] + xy * flow[1]) * weight
    by = (by + xy * flow[0] + yy * flow[1]) * weight
    xx, yy, xy = xx * weight, yy * weight, xy * weight
    square = xy * xy
    g11, g12, g22, h1, h2 = (_box(x, WINDOW) for x in (xx * xx + square, xy * (xx + yy), yy * yy + square, xx * bx + xy * by, xy * bx + yy * by))
    scale = 1 / (g11 * g22 - g12 * g12 + 1e-3)
    return np.stack([(g22 * h1 - g12 * h2) * scale, (g11 * h2 - g12 * h1) * scale])


def expansions(image: np.ndarray, levels: int = 3) -> list[np.ndarray]:
    """A grey frame's quadratics at halved sizes, the smallest first."""
    h, w = image.shape
    # no level is smaller than 32 pixels
    while levels > 0 and min(h, w) * 0.5**levels < 32:
        levels -= 1
    out = []
    for level in range(levels, -1, -1):
        small = image.astype(np.float32)
        if level:
            sigma = (2**level - 1) * 0.5
            g = gauss(sigma, max(round(sigma * 5) | 1, 3) // 2)
            small = linear_resize(correlate(correlate(small, g, 0), g, 1), round(h * 0.5**level), round(w * 0.5**level))
        out.append(expansion(small.astype(np.float32)).astype(np.float64))
    return out


def dense_flow(one: np.ndarray | Look, two: np.ndarray | Look) -> np.ndarray:
    """Flow (x, y on the last axis) from one grey frame to the next by quadratic expansion, from coarse to fine."""
    flow = None
    for a, b in zip(seen(one).quadratics, seen(two).quadratics):
        size = a.shape[1:]
        flow = np.zeros((2, *size)) if flow is None else np.stack([linear_resize(f, *size) for f in flow]) * 2
        for _ in range(ROUNDS):
            flow = _moved(flow, a, b, _edges(*size))
    return np.moveaxis(flow, 0, -1)


def linear_resize(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey frame at another size by bilinear reading at the centres of its pixels."""
    for axis, n in ((0, height), (1, width)):
        size = frame.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), max(size - 2, 0))
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        frame = np.take(frame, low, axis=axis) * (1 - part) + np.take(frame, np.minimum(low + 1, size - 1), axis=axis) * part
    return frame


# ------------------------------------------------------------------------------------------------- corners and tracking

#: Corners at most, their quality against the best, pixels between them; the tracker's window, levels,
#: rounds, smallest step, and least eigenvalue of the mean gradient products.
CORNERS, QUALITY, APART = 120, 0.01, 5
SIDE, LEVELS, STEPS, STILL, LEAST = 21, 3, 30, 0.01, 0.1024


def corners(image: np.ndarray) -> np.ndarray:
    """(n, 2) x and y of corners: local maxima of the smaller eigenvalue of 3 x 3 gradient products, the strongest first, at
    least APART pixels from each other."""
    image = image.astype(np.float64)
    dx, dy = sobel(image, 1), sobel(image, 0)
    box = lambda a: correlate(correlate(a, np.ones(3), 0), np.ones(3), 1)
    xx, yy, xy = box(dx * dx), box(dy * dy), box(dx * dy)
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    h, w = strength.shape
    most = strength.max(initial=0.0)
    if most <= 0 or min(h, w) < 3:
        return np.zeros((0, 2))
    wide = np.pad(strength, 1, constant_values=-np.inf)
    peak = np.maximum.reduce([wide[y : y + h, x : x + w] for y in range(3) for x in range(3)])
    ok = (strength == peak) & (strength > most * QUALITY)
    ok[[0, -1]] = ok[:, [0, -1]] = False
    y, x = np.nonzero(ok)
    order = np.lexsort((x, y, -strength[y, x]))
    taken: list[tuple[int, int]] = []
    free = np.ones((h, w), dtype=bool)
    gy, gx = np.mgrid[-APART : APART + 1, -APART : APART + 1]
    near = gx * gx + gy * gy < APART * APART
    for i, j in zip(y[order].tolist(), x[order].tolist()):
        if not free[i, j]:
            continue
        taken.append((j, i))
        if len(taken) == CORNERS:
            break
        a, b, c, d = max(i - APART, 0), min(i + APART + 1, h), max(j - APART, 0), min(j + APART + 1, w)
        free[a:b, c:d] &= ~near[a - i + APART : b - i + APART, c - j + APART : d - j + APART]
    return np.array(taken, dtype=np.float64).reshape(-1, 2)


def _wide(image: np.ndarray) -> np.ndarray:
    """A frame with its borders reflected (without their pixel) as far as windows reach."""
    h, w = image.shape
    return image.take(_beyond(h, SIDE, "reflect"), axis=0).take(_beyond(w, SIDE, "reflect"), axis=1)


class _Stack:
    """Frames of one size, with their borders, for bilinear reading of windows."""

    def __init__(self, wide: list[np.ndarray]) -> None:
        self.wide = np.stack(wide)
        self.height, self.width = (n - 2 * SIDE for n in self.wide.shape[1:])
        self.patches = np.lib.stride_tricks.sliding_window_view(self.wide, (SIDE + 1, SIDE + 1), axis=(1, 2))

    def read(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(n, SIDE * SIDE) values of windows about places (x, y) of the frames `of`; further out than the border reaches, those
        of its end."""
        _, height, width = self.wide.shape
        x, y = np.clip(at[:, :1] + OFFSETS[0] + SIDE, 0, width - 1.001), np.clip(at[:, 1:] + OFFSETS[1] + SIDE, 0, height - 1.001)
        x0, y0 = x.astype(np.int64), y.astype(np.int64)
        fx, fy, k, flat = x - x0, y - y0, (of[:, None] * height + y0) * width + x0, self.wide.ravel()
        top = flat[k] * (1 - fx) + flat[k + 1] * fx
        k += width
        return top * (1 - fy) + (flat[k] * (1 - fx) + flat[k + 1] * fx) * fy

    def holds(self, cell: np.ndarray) -> np.ndarray:
        """Whether windows about these whole places (x, y) lie within what the border reaches."""
        r, (x, y) = SIDE // 2, cell.T
        return (x >= -r - 1) & (y >= -r - 1) & (x < self.width + r - 1) & (y < self.height + r - 1)

    def cut(self, of: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(n, SIDE + 1, SIDE + 1) pixels of windows about whole places, with the row and column that follow."""
        low = cell.astype(np.int64) + SIDE - SIDE // 2
        return self.patches[of, low[:, 1], low[:, 0]]

    def windows(self, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """read(), by whole windows where the border reaches far enough."""
        cell = np.floor(at)
        inner = self.holds(cell)
        out = np.empty((len(at), SIDE * SIDE))
        fx, fy = ((at - cell)[inner, k][:, None, None] for k in (0, 1))
        p = self.cut(of[inner], cell[inner])
        p = p[..., :-1] * (1 - fx) + p[..., 1:] * fx
        out[inner] = (p[:, :-1] * (1 - fy) + p[:, 1:] * fy).reshape(-1, SIDE * SIDE)
        if not inner.all():
            out[~inner] = self.read(of[~inner], at[~inner])
        return out


#: x and y of a window's pixels from its middle.
OFFSETS = np.tile(np.arange(SIDE) - SIDE // 2, SIDE), np.repeat(np.arange(SIDE) - SIDE // 2, SIDE)


def pyramid(image: np.ndarray, levels: int) -> list[np.ndarray]:
    """A frame and its halves, blurred by 1 4 6 4 1."""
    out, g = [image.astype(np.float64)], np.array([1, 4, 6, 4, 1]) / 16
    while len(out) <= levels and min(out[-1].shape) > SIDE:
        out.append(correlate(correlate(out[-1], g, 0), g, 1)[::2, ::2])
    return out


class Look:
    """What flow and tracking take of a grey frame, each made when it is first asked for."""

    def __init__(self, image: np.ndarray) -> None:
        self.image, self.shape = image, image.shape

    @cached_property
    def quadratics(self) -> list[np.ndarray]:
        return expansions(self.image)

    @cached_property
    def corners(self) -> np.ndarray:
        return corners(self.image)

    @cached_property
    def levels(self) -> list[np.ndarray]:
        return pyramid(self.image, LEVELS)

    @cached_property
    def wide(self) -> list[tuple[np.ndarray, ...]]:
        """The levels and their smoothed differences by x and y, in grey values a pixel, with borders."""
        return [(_wide(x), *(_wide(sobel(x, axis, (3, 10, 3)) / 32) for axis in (1, 0))) for x in self.levels]


def seen(frame: np.ndarray | Look) -> Look:
    return frame if isinstance(frame, Look) else Look(frame)


def track(one: np.ndarray | Look, two: np.ndarray | Look, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where points (n, 2) of one grey frame are in the next, by iterated least squares over windows, from coarse to
    fine; and which are found: neither without texture nor gone out of the frame."""
    return tracked([(seen(one), seen(two))], np.zeros(len(points), dtype=np.int64), points)


def tracked(pairs: list[tuple[Look, Look]], of: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """track() for the points of several pairs at once, all of one size; of: each point's pair."""
    r, n = SIDE // 2, len(points)
    found = np.ones(n, dtype=bool)
    move = np.zeros_like(points, dtype=np.float64)
    for level in range(len(pairs[0][0].wide) - 1, -1, -1):
        other = _Stack([b.wide[level][0] for _, b in pairs])
        at = points / 2**level
        value, dx, dy = (_Stack([a.wide[level][k] for a, _ in pairs]).windows(of, at) for k in range(3))
        mean = lambda a, b: np.einsum("ij,ij->i", a, b) / SIDE**2
        xx, xy, yy = mean(dx, dx), mean(dx, dy), mean(dy, dy)
        small = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        det = xx * yy - xy * xy
        ok = (small >= LEAST) & (det > 1e-12)
        if level == 0:
            found &= ok
        move *= 2
        # a window's products with the slopes are linear in the four whole windows about it, so they are made anew
        # only when a point goes on to another pixel
        own = np.stack([mean(value, dx), mean(value, dy)], axis=1)
        slopes = np.stack([dx, dy], axis=1).reshape(n, 2, SIDE, SIDE)
        cells, held = np.full((n, 2), np.nan), np.zeros((n, 4, 2))
        going = np.nonzero(ok)[0]
        for _ in range(STEPS):
            if not len(going):
                break
            now = at[going] + move[going]
            cell = np.floor(now)
            inner = other.holds(cell)
            new = inner & (cell != cells[going]).any(axis=1)
            if new.any():
                k = going[new]
                patch, slope, cells[k] = other.cut(of[k], cell[new]), slopes[k], cell[new]
                for c, (v, u) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                    held[k, c] = np.einsum("nij,naij->na", patch[:, v : v + SIDE, u : u + SIDE], slope) / SIDE**2
            fx, fy = (now - cell).T
            parts = np.stack([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy], axis=1)
            off = own[going] - np.einsum("nc,nca->na", parts, held[going])
            if not inner.all():
                k = going[~inner]
                far = value[k] - other.read(of[k], now[~inner])
                off[~inner] = np.stack([mean(far, dx[k]), mean(far, dy[k])], axis=1)
            bx, by = off.T
            step = np.stack([yy[going] * bx - xy[going] * by, xx[going] * by - xy[going] * bx], axis=1) / det[going][:, None]
            move[going] += step
            going = going[(step * step).sum(axis=1) > STILL * STILL]
    out = points + move
    h, w = pairs[0][0].shape
    # a window's corner that lies outside by more than the window is lost
    found &= (out[:, 0] >= -r) & (out[:, 1] >= -r) & (out[:, 0] < w + r) & (out[:, 1] < h + r)
    return out, found


def round_trips(one: np.ndarray | Look, two: np.ndarray | Look) -> np.ndarray:
    """Distances between corners of a frame and where tracking to the next frame and back leads; none if fewer than two
    are found both ways."""
    return trips([(seen(one), seen(two))])[0]


def trips(pairs: list[tuple[Look, Look]]) -> list[np.ndarray]:
    """round_trips() of several pairs at once, all of one size: points are few in a pair, and steps many."""
    counts = [len(a.corners) if len(a.corners) >= 2 else 0 for a, _ in pairs]
    of = np.repeat(np.arange(len(pairs)), counts)
    if not len(of):
        return [np.zeros(0)] * len(pairs)
    points = np.concatenate([a.corners for (a, _), n in zip(pairs, counts) if n])
    there, ok = tracked(pairs, of, points)
    ok &= (np.bincount(of[ok], minlength=len(pairs)) >= 2)[of]
    of, points = of[ok], points[ok]
    back, again = tracked([(b, a) for a, b in pairs], of, there[ok])
    apart, of = np.hypot(*(points[again] - back[again]).T), of[again]
    found = [apart[of == k] for k in range(len(pairs))]
    return [x if len(x) >= 2 else np.zeros(0) for x in found]


# ------------------------------------------------------------------------------------------------- JPEG round trip

#: The standard quantisation tables of brightness and of colour, row by row.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def quantisation(table: tuple[int, ...], quality: int) -> np.ndarray:
    """A standard table scaled to a quality of 1 to 100."""
    quality = min(max(quality, 1), 100)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table).reshape(8, 8) * scale + 50) // 100, 1, 255)


def dct_matrix(n: int = 8) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane (sides divisible by 8) after its cosine coefficients were rounded to the table."""
    m = dct_matrix()
    h, w = plane.shape
    blocks = (plane - 128).reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)
    kept = np.rint(m @ blocks @ m.T / table) * table
    return np.clip(np.rint((m.T @ kept @ m).swapaxes(1, 2).reshape(h, w) + 128), 0, 255)


def _doubled(plane: np.ndarray) -> np.ndarray:
    """Twice the size: three parts of the nearest pixel and one of the next, on each axis."""
    for axis in (0, 1):
        wide = np.pad(plane, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = plane.shape[axis]
        before, here, after = (np.take(wide, np.arange(k, k + n), axis=axis) for k in range(3))
        out = np.stack([(3 * here + before) / 4, (3 * here + after) / 4], axis=axis + 1)
        plane = out.reshape([2 * n if k == axis else s for k, s in enumerate(plane.shape)])
    return plane


def jpeg_round_trip(frame: np.ndarray, quality: int = 75) -> np.ndarray:
    """A colour frame of bytes as JPEG gives it back: colour halved on both axes, coefficients rounded to the tables of a
    quality. Entropy coding loses nothing, so it is left out."""
    h, w = frame.shape[:2]
    wide = np.pad(frame, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge").astype(np.float64)
    b, g, r = (wide[..., k] for k in range(3))
    y = np.rint(0.299 * r + 0.587 * g + 0.114 * b)
    halves = []
    for plane in (-0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128):
        plane = np.clip(np.rint(plane), 0, 255)
        halves.append(np.rint(plane.reshape(plane.shape[0] // 2, 2, plane.shape[1] // 2, 2).mean(axis=(1, 3))))
    y = _coded(y, quantisation(BRIGHTNESS, quality))
    cb, cr = (_doubled(_coded(p, quantisation(COLOUR, quality))) - 128 for p in halves)
    out = np.stack([y + 1.772 * cb, y - 0.344136 * cb - 0.714136 * cr, y + 1.402 * cr], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[:h, :w]
