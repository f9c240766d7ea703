"""Pixel and sound kernels that need array arithmetic: Arrow-batched UDFs over numpy, each a small function.

A frame is a row-major array of grey values of a given width."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palisade.functions import vision


def gaussian(sigma: float) -> np.ndarray:
    k = np.arange(-(round(8 * sigma + 1) | 1) // 2 + 1, (round(8 * sigma + 1) | 1) // 2 + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    return w / w.sum()


def high_pass(frame: np.ndarray, sigma: float) -> np.ndarray:
    """The frame less its Gaussian blur, borders reflected without their pixel."""
    w = gaussian(sigma)
    r = len(w) // 2
    out = frame.astype(np.float64)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="reflect")
        n = frame.shape[axis]
        out = sum(v * (wide[i : i + n] if axis == 0 else wide[:, i : i + n]) for i, v in enumerate(w))
    return frame - out


def radial_ratio(frame: np.ndarray) -> float:
    """Mean spectrum beyond 0.55 of the way to the edge, over the mean of all of it."""
    spectrum = np.fft.fftshift(np.abs(np.fft.fft2(frame - frame.mean())))
    return float(spectrum[_outer(*spectrum.shape)].mean() / (spectrum.mean() + 1e-9))


@lru_cache(16)
def _outer(h: int, w: int) -> np.ndarray:
    y, x = np.ogrid[:h, :w]
    return np.hypot((y - h / 2) / (h / 2), (x - w / 2) / (w / 2)) > 0.55


def dct_energy(frame: np.ndarray, block: int = 8) -> float:
    """Median over blocks of the mean size of DCT coefficients from the third row and column on."""
    k = np.arange(block)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * block)) * np.sqrt(2 / block)
    m[0] /= np.sqrt(2)
    h, w = (s // block * block for s in frame.shape)
    blocks = frame[:h, :w].reshape(h // block, block, w // block, block).swapaxes(1, 2).reshape(-1, block, block)
    return float(np.median(np.abs(m @ blocks @ m.T)[:, 2:, 2:].mean(axis=(1, 2))))


def blockiness(frame: np.ndarray) -> float:
    """Gradients across 8-pixel boundaries over those within blocks: of both the sum of the means by direction. 1 where a
    direction has no boundary."""
    rows, columns = np.abs(np.diff(frame, axis=0)), np.abs(np.diff(frame, axis=1))
    edge, inner = (rows[7::8], columns[:, 7::8]), (rows[3::8], columns[:, 3::8])
    if not all(x.size for x in (*edge, *inner)):
        return 1.0
    return float(sum(x.mean() for x in edge) / (sum(x.mean() for x in inner) + 1e-6))


#: A border is dark below this, its frame lighter by so much; how far a row or column is over the border,
#: how much of it, and how many are needed.
DARK, LIGHTER, OVER, LIT, NEEDED = 12.0, 5.0, 3.0, 0.08, 8


def content(frame: np.ndarray, size: tuple[int, int] = (144, 256)) -> np.ndarray:
    """The frame (grey or colour) without dark bars, if its border is dark and its middle lighter, cut about its centre to
    the aspect of `size` (height, width) and resized."""
    grey = np.rint(gray(frame)) if frame.ndim == 3 else frame
    border = np.concatenate([grey[0], grey[-1], grey[:, 0], grey[:, -1]])
    if np.median(border) < DARK and np.median(grey) > np.median(border) + LIGHTER:
        lit = grey > max(8.0, np.percentile(border, 90) + OVER)
        rows, columns = np.nonzero(lit.mean(axis=1) > LIT)[0], np.nonzero(lit.mean(axis=0) > LIT)[0]
        if min(len(rows), len(columns)) >= NEEDED:
            frame = frame[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    (h, w), aspect = frame.shape[:2], size[1] / size[0]
    if w / h > aspect:
        keep = max(1, round(h * aspect))
        frame = frame[:, (w - keep) // 2 : (w - keep) // 2 + keep]
    elif w / h < aspect:
        keep = max(1, round(w / aspect))
        frame = frame[(h - keep) // 2 : (h - keep) // 2 + keep]
    return vision.area_resize(frame, *size)


def gray(pixels: np.ndarray) -> np.ndarray:
    """Grey values of blue-green-red pixels (last axis)."""
    return pixels.astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def divergence(flow: np.ndarray) -> float:
    """Median size of the divergence of a flow field (height, width, 2), by Sobel differences."""
    def sobel(a: np.ndarray, axis: int) -> np.ndarray:
        wide = np.pad(a, 1, mode="reflect")
        smooth = np.take(wide, range(a.shape[1 - axis]), axis=1 - axis) + 2 * np.take(wide, range(1, a.shape[1 - axis] + 1), axis=1 - axis) + np.take(wide, range(2, a.shape[1 - axis] + 2), axis=1 - axis)
        return np.take(smooth, range(2, a.shape[axis] + 2), axis=axis) - np.take(smooth, range(a.shape[axis]), axis=axis)

    return float(np.median(np.abs(sobel(flow[..., 0], 1) + sobel(flow[..., 1], 0))))


def occlusion(forward: np.ndarray, backward: np.ndarray, bound: float = 1.5) -> float:
    """Share of pixels whose flow there, and back from where that leads, don't cancel out."""
    both = forward + vision.warp(backward, forward)
    return float((np.hypot(both[..., 0], both[..., 1]) > bound).mean())


def hue_saturation(pixels: np.ndarray) -> np.ndarray:
    """A 16 x 8 histogram of hue and saturation, in whole numbers of bytes, of (n, 3) blue-green-red values; it sums to one."""
    colour = vision.hsv(pixels)
    out = np.histogram2d(colour[:, 0], colour[:, 1], bins=(16, 8), range=((0, 180), (0, 256)))[0].ravel()
    return out / max(out.sum(), 1)


def sound(chunk: np.ndarray, rate: float) -> list[float]:
    """Root mean square, spectral centroid over the rate, and share of clipped samples of a window."""
    spectrum = np.abs(np.fft.rfft(chunk * np.hanning(len(chunk))))
    frequency = np.fft.rfftfreq(len(chunk), 1 / rate)
    centroid = (frequency * spectrum).sum() / (spectrum.sum() + 1e-9) / max(1.0, rate)
    return [float(np.sqrt((chunk * chunk).mean() + 1e-12)), float(centroid), float((np.abs(chunk) >= 0.995).mean())]


def frame_udf(f: Callable[[np.ndarray], float], width: int):
    """A function of a frame as a column function of its pixels."""

    @F.pandas_udf("double")
    def run(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: None if p is None or not len(p) else f(np.asarray(p, dtype=np.float64).reshape(-1, width)))

    return run


def sound_udf(rate: float):
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: None if s is None or not len(s) else sound(np.asarray(s, dtype=np.float64), rate))

    return run
