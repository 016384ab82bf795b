"""Images as numpy arrays: sizes from headers, sharpness and contrast, and filters before a second reading."""

from __future__ import annotations

import struct

import numpy as np

BLURRED, FADED = 300.0, 160  # Laplacian variance, spread of grey values
SMALL = 250_000  # pixels that a page has at least


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of PNG, GIF, BMP or JPEG bytes; nothing where the header tells none."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + length
    return None


def too_small(data: bytes) -> bool:
    """Whether an image is no page; one that cannot be read passes."""
    found = size(data)
    return found is not None and found[0] * found[1] < SMALL


def sharpness(grey: np.ndarray) -> float:
    """Variance of the Laplacian."""
    g = grey.astype(np.float64)
    if min(g.shape) < 3:
        return 0.0
    return float((4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]).var())


def contrast(grey: np.ndarray) -> int:
    """Grey values between the first and the last hundredth of the pixels."""
    counts = np.cumsum(np.bincount(grey.reshape(-1).astype(np.uint8), minlength=256))
    n = counts[-1]
    return int(np.searchsorted(counts, 0.99 * n) - np.searchsorted(counts, 0.01 * n))


def faults(grey: np.ndarray) -> list[str]:
    return [name for name, bad in (("blurred", sharpness(grey) < BLURRED), ("faded", contrast(grey) < FADED)) if bad]


def _blurred(grey: np.ndarray) -> np.ndarray:
    p = np.pad(grey.astype(np.float64), 1, mode="edge")
    rows = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 4


def sharpened(grey: np.ndarray, amount: float = 1.0) -> np.ndarray:
    """Unsharp mask: what a small blur takes away is added."""
    g = grey.astype(np.float64)
    return np.clip(np.rint(g + amount * (g - _blurred(g))), 0, 255).astype(np.uint8)


def equalised(grey: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalisation: a clipped histogram for each tile, maps blended between tile centres."""
    h, w = grey.shape
    rows, columns = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, rows + 1).astype(int), np.linspace(0, w, columns + 1).astype(int)
    maps = np.empty((rows, columns, 256))
    for i in range(rows):
        for j in range(columns):
            tile = grey[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(tile.reshape(-1), minlength=256).astype(np.float64)
            most = max(1.0, clip * tile.size / 256)
            spare = np.maximum(counts - most, 0).sum()
            counts = np.minimum(counts, most) + spare / 256
            maps[i, j] = np.cumsum(counts) / counts.sum() * 255
    cy, cx = (ys[:-1] + ys[1:]) / 2, (xs[:-1] + xs[1:]) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(rows)), np.interp(np.arange(w), cx, np.arange(columns))
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, columns - 1)
    ty, tx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], grey]
    top = at(y0, x0) * (1 - tx) + at(y0, x1) * tx
    low = at(y1, x0) * (1 - tx) + at(y1, x1) * tx
    return np.clip(np.rint(top * (1 - ty) + low * ty), 0, 255).astype(np.uint8)


def cropped(image: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """The part under a rectangle in shares of the page."""
    high, wide = image.shape[:2]
    return image[int(y * high) : max(int(y * high) + 1, int((y + h) * high)), int(x * wide) : max(int(x * wide) + 1, int((x + w) * wide))]


def rotated(image: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a right angle or several."""
    if degrees % 90:
        raise ValueError("only right angles")
    return np.rot90(image, -(degrees // 90) % 4)
