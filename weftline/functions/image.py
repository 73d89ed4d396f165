"""Image kernels in NumPy, for Arrow batches: (h, w, c) byte arrays in, byte arrays out unless said otherwise.

Arithmetic is float32; results are cut to bytes by clamping and truncation.
"""

from __future__ import annotations

import math

import numpy as np

F32 = np.float32


def to_byte(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


# ---- resizing


def _separable(image: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """rows: (out_h, h) weights, columns: (out_w, w)."""
    return np.tensordot(columns, np.tensordot(rows, image.astype(F32), (1, 0)), (1, 1)).swapaxes(0, 1)


def _matrix(n: int, m: int, kernel, support: float, widen: bool = False) -> np.ndarray:
    """(m, n): normalized weights of a kernel around half-pixel centres; taps outside are left out."""
    out = np.zeros((m, n), F32)
    ratio = n / m
    stretch = max(1.0, ratio) if widen else 1.0
    for t in range(m):
        centre = (t + 0.5) * ratio - 0.5
        low, high = math.floor(centre - support * stretch) + 1, math.floor(centre + support * stretch)
        taps = np.arange(max(0, low), min(n - 1, high) + 1)
        weights = np.array([kernel((centre - s) / stretch) for s in taps], F32)
        total = weights.sum()
        if len(taps) and total:
            out[t, taps] = weights / total
    return out


def _cubic(x: float, a: float = -0.5) -> float:
    x = abs(x)
    if x < 1:
        return (a + 2) * x**3 - (a + 3) * x**2 + 1
    return a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0.0


def _lanczos(x: float, a: int = 3) -> float:
    return 1.0 if abs(x) < 1e-9 else 0.0 if abs(x) >= a else a * math.sin(math.pi * x) * math.sin(math.pi * x / a) / (math.pi * x) ** 2


def resize(image: np.ndarray, w: int, h: int, mode: str = "bilinear") -> np.ndarray:
    """nearest, bilinear, bicubic, lanczos or antialias. The same size is a copy."""
    height, width = image.shape[:2]
    if (width, height) == (w, h):
        return image.copy()
    if mode == "nearest":
        ys, xs = np.minimum(np.arange(h) * height // h, height - 1), np.minimum(np.arange(w) * width // w, width - 1)
        return image[ys[:, None], xs]
    if mode == "bilinear":
        return to_byte(sample_bilinear(image, *np.meshgrid(_half_pixel(width, w), _half_pixel(height, h))))
    kernels = {"bicubic": (_cubic, 2.0, False), "lanczos": (_lanczos, 3.0, False), "antialias": (lambda x: max(0.0, 1 - abs(x)), 1.0, True)}
    if mode not in kernels:
        raise ValueError(f"unknown interpolation: {mode}")
    rows, columns = (_matrix(n, m, *kernels[mode]) for n, m in ((height, h), (width, w)))
    return to_byte(_separable(image, rows, columns) + F32(1e-3))


def _half_pixel(n: int, m: int) -> np.ndarray:
    return np.clip((np.arange(m, dtype=F32) + F32(0.5)) * F32(n / m) - F32(0.5), 0, n - 1)


def sample_bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0).astype(F32)[..., None], (y - y0).astype(F32)[..., None]
    x0, y0 = np.clip(x0, 0, w - 1), np.clip(y0, 0, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    p = image.astype(F32)
    top, bottom = p[y0, x0] * (1 - fx) + p[y0, x1] * fx, p[y1, x0] * (1 - fx) + p[y1, x1] * fx
    return top * (1 - fy) + bottom * fy


def warp(image: np.ndarray, inverse, fill: int = 0, size: tuple[int, int] | None = None) -> np.ndarray:
    """Each target (x, y) takes the source at inverse(x, y), bilinear; outside is ``fill``."""
    h, w = image.shape[:2]
    out_w, out_h = size or (w, h)
    x, y = np.meshgrid(np.arange(out_w, dtype=F32), np.arange(out_h, dtype=F32))
    sx, sy = inverse(x, y)
    inside = (sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1)
    return np.where(inside[..., None], to_byte(sample_bilinear(image, np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1))), np.uint8(fill))


# ---- geometry


def rotate(image: np.ndarray, degrees: float, expand: bool = False, fill: int = 0) -> np.ndarray:
    h, w = image.shape[:2]
    a = math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    out_w, out_h = (math.ceil(abs(w * cos) + abs(h * sin)), math.ceil(abs(w * sin) + abs(h * cos))) if expand else (w, h)
    return warp(image, lambda x, y: (cos * (x - out_w / 2) + sin * (y - out_h / 2) + w / 2, -sin * (x - out_w / 2) + cos * (y - out_h / 2) + h / 2), fill, (out_w, out_h))


def affine(image: np.ndarray, degrees: float = 0, tx: float = 0, ty: float = 0, scale: float = 1, shear: float = 0, fill: int = 0) -> np.ndarray:
    h, w = image.shape[:2]
    a, s = math.radians(degrees), math.radians(shear)
    m = np.array([[scale * math.cos(a), scale * math.sin(s - a)], [scale * math.sin(a), scale * math.cos(a - s)]])
    (ia, ib), (ic, id_) = np.linalg.inv(m)
    cx, cy = w / 2, h / 2
    return warp(image, lambda x, y: (ia * (x - cx - tx) + ib * (y - cy - ty) + cx, ic * (x - cx - tx) + id_ * (y - cy - ty) + cy), fill)


def perspective(image: np.ndarray, corners: np.ndarray, fill: int = 0) -> np.ndarray:
    """corners: where the four corners (clockwise from the top left) go.

    Scale and shift come from the left and top edges, two small terms from how far the last corner
    departs from a parallelogram, and the map is used as its own inverse: an approximation by contract.
    """
    h, w = image.shape[:2]
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    sx, sy = (x1 - x0) / max(1, w - 1), (y3 - y0) / max(1, h - 1)
    px, py = (x2 - x1 - x3 + x0) * 1e-4, (y2 - y1 - y3 + y0) * 1e-4

    def inverse(x, y):
        d = px * x + py * y + 1
        d = np.where(np.abs(d) < 1e-6, np.inf, d)
        return (sx * x + x0) / d, (sy * y + y0) / d

    return warp(image, inverse, fill)


def shear_x(image: np.ndarray, by: float) -> np.ndarray:
    return warp(image, lambda x, y: (x - by * y, y))


def shear_y(image: np.ndarray, by: float) -> np.ndarray:
    return warp(image, lambda x, y: (x, y - by * x))


def translate_x(image: np.ndarray, share: float) -> np.ndarray:
    return warp(image, lambda x, y: (x - share * image.shape[1], y))


def translate_y(image: np.ndarray, share: float) -> np.ndarray:
    return warp(image, lambda x, y: (x, y - share * image.shape[0]))


# ---- values


def gray(image: np.ndarray) -> np.ndarray:
    return image[..., 0] * F32(0.299) + image[..., 1] * F32(0.587) + image[..., 2] * F32(0.114)


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def brightness(image: np.ndarray, factor: float) -> np.ndarray:
    return to_byte(image * F32(factor))


def color(image: np.ndarray, factor: float) -> np.ndarray:
    g = gray(image)[..., None]
    return to_byte(g + F32(factor) * (image - g))


def contrast(image: np.ndarray, factor: float, mean: float | None = None, per_channel: bool = False) -> np.ndarray:
    m = F32(mean) if mean is not None else image.mean((0, 1) if per_channel else None, dtype=np.float64).astype(F32)
    return to_byte(m + F32(factor) * (image - m))


def sharpness(image: np.ndarray, factor: float) -> np.ndarray:
    h, w = image.shape[:2]
    padded = np.pad(image.astype(F32), ((1, 1), (1, 1), (0, 0)))
    ones = np.pad(np.ones((h, w, 1), F32), ((1, 1), (1, 1), (0, 0)))
    total, count = (sum(p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)) for p in (padded, ones))
    mean = total / count
    return to_byte(mean + F32(factor) * (image - mean))


def posterize(image: np.ndarray, bits: int) -> np.ndarray:
    if not 1 <= bits <= 8:
        raise ValueError("bits go from 1 to 8")
    return image & np.uint8(256 - (1 << (8 - bits)) & 255)


def solarize(image: np.ndarray, threshold: int, inclusive: bool = False) -> np.ndarray:
    return np.where(image >= threshold if inclusive else image > threshold, 255 - image, image)


def autocontrast(image: np.ndarray, flat_stays: bool = False) -> np.ndarray:
    low, high = image.min((0, 1)).astype(F32), image.max((0, 1)).astype(F32)
    out = to_byte((image - low) * (F32(255) / np.maximum(high - low, 1)))
    return np.where(high == low, image if flat_stays else 0, out).astype(np.uint8)


def equalize(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    for c in range(image.shape[2]):
        cdf = np.bincount(image[..., c].ravel(), minlength=256).cumsum()
        low, n = cdf[cdf > 0][0], cdf[-1]
        if n > low:
            out[..., c] = ((np.maximum(cdf - low, 0)) * 255 // (n - low)).astype(np.uint8)[image[..., c]]
    return out


def gaussian_kernel(k: int, sigma: float = 0) -> np.ndarray:
    if k % 2 == 0 or k < 1:
        raise ValueError("the kernel has odd length")
    sigma = sigma if sigma > 0 else 0.3 * ((k - 1) / 2 - 1) + 0.8
    x = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma**2))
    return (x / x.sum()).astype(F32)


def blur(image: np.ndarray, k: int, sigma: float = 0) -> np.ndarray:
    """Separable, edges clamped, cut to bytes between the passes."""
    kernel, r = gaussian_kernel(k, sigma), k // 2
    for axis in (1, 0):
        n = image.shape[axis]
        image = to_byte(sum(f * np.take(image, np.clip(np.arange(n) + j - r, 0, n - 1), axis).astype(F32) for j, f in enumerate(kernel)) + F32(1e-3))
    return image


def rgb_to_hsv(image: np.ndarray) -> np.ndarray:
    p = image.astype(F32) / F32(255)
    high, low = p.max(-1), p.min(-1)
    d = high - low
    safe = np.where(d > 1e-5, d, 1)
    r, g, b = p[..., 0], p[..., 1], p[..., 2]
    h = np.select([r >= high, g >= high], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe) * 60
    h = np.where(d > 1e-5, np.where(h < 0, h + 360, h), 0)
    return np.stack([h, np.where(d > 1e-5, d / np.maximum(high, 1e-9), 0), high], -1)


def hsv_to_rgb(x: np.ndarray) -> np.ndarray:
    h, s, v = x[..., 0], x[..., 1], x[..., 2]
    i = np.floor(np.where(h >= 360, 0, h) / 60)
    f = np.where(h >= 360, 0, h) / 60 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = [i == k for k in range(5)]
    rgb = [np.select(pick, c[:5], c[5]) for c in ([v, q, p, p, t, v], [t, v, v, q, p, p], [p, p, t, v, v, q])]
    return to_byte(np.stack([np.where(s <= 0, v, c) for c in rgb], -1) * F32(255) + F32(1e-3))


def saturate(image: np.ndarray, factor: float) -> np.ndarray:
    x = rgb_to_hsv(image)
    x[..., 1] = np.clip(x[..., 1] * F32(factor), 0, 1)
    return hsv_to_rgb(x)


def shift_hue(image: np.ndarray, degrees: float) -> np.ndarray:
    x = rgb_to_hsv(image)
    x[..., 0] = (x[..., 0] + F32(degrees)) % 360
    return hsv_to_rgb(x)


def normalize(image: np.ndarray, mean, std) -> np.ndarray:
    if len(mean) != image.shape[2] or len(std) != len(mean) or min(std) <= 0:
        raise ValueError("mean and std have one positive entry a channel")
    return (image.astype(F32) / F32(255) - np.array(mean, F32)) / np.array(std, F32)


def to_chw(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image.transpose(2, 0, 1))


def yuv420_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, matrix: str = "bt709") -> np.ndarray:
    """Video range; chroma of half size, repeated."""
    kr, kb = {"bt709": (0.2126, 0.0722), "bt601": (0.299, 0.114)}[matrix]
    up = lambda c: (c.repeat(2, 0).repeat(2, 1)[: y.shape[0], : y.shape[1]].astype(F32) - 128) / 112
    luma, cb, cr = (y.astype(F32) - 16) / 219, up(u), up(v)
    r, b = luma + (1 - kr) * cr, luma + (1 - kb) * cb
    g = (luma - kr * r - kb * b) / (1 - kr - kb)
    return to_byte(np.stack([r, g, b], -1) * 255)


def mosaic(images: list[np.ndarray], size: int, cx: float, cy: float) -> np.ndarray:
    """Four images around (cx, cy), each fitted into its quarter, nearest, on grey 114."""
    out = np.full((size, size, 3), 114, np.uint8)
    x, y = int(cx * size), int(cy * size)
    for image, (x0, y0, x1, y1) in zip(images, ((0, 0, x, y), (x, 0, size, y), (0, y, x, size), (x, y, size, size)), strict=False):
        h, w = image.shape[:2]
        rw, rh = x1 - x0, y1 - y0
        if rw <= 0 or rh <= 0:
            continue
        k = max(w / rw, h / rh)
        fw, fh = max(1, min(rw, int(w / k))), max(1, min(rh, int(h / k)))
        ox, oy = x0 + (rw - fw) // 2, y0 + (rh - fh) // 2
        out[oy : oy + fh, ox : ox + fw] = resize(image, fw, fh, "nearest")
    return out
