"""Image functions over arrays of pixels, as vectorised functions of Arrow batches (numpy).

Images are gray (rows x columns) or colour (rows x columns x 3) arrays of 0..255.
"""

from __future__ import annotations

import base64
import re

import numpy as np

GRAY = 128


def blend_quality(variance: float, width: int, height: int) -> float:
    return 0.7 * min(variance / 500.0, 1.0) + 0.3 * min(width * height / 65536.0, 1.0)


def _laplacian(gray: np.ndarray) -> np.ndarray:
    return gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * gray[1:-1, 1:-1]


def as_gray(image: np.ndarray) -> np.ndarray:
    x = np.asarray(image, np.float64)
    return x @ np.array([0.299, 0.587, 0.114]) if x.ndim == 3 else x


def quality(image: np.ndarray | None, border: bool = False) -> float:
    """Sharpness and size in 0..1: variance of the 4-neighbour Laplacian, of the interior or with mirrored borders; .5 for no
    image or under three pixels a side."""
    if image is None:
        return 0.5
    gray = as_gray(image)
    if gray.ndim != 2 or min(gray.shape) < 3:
        return 0.5
    return blend_quality(float(np.var(_laplacian(np.pad(gray, 1, mode="reflect") if border else gray))), gray.shape[1], gray.shape[0])


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    x = np.asarray(image, np.float64)
    x = x[:, :, None] if x.ndim == 2 else x
    at = [np.clip((np.arange(n) + 0.5) * s / n - 0.5, 0, s - 1) for n, s in ((height, x.shape[0]), (width, x.shape[1]))]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(l + 1, s - 1) for l, s in zip(low, x.shape)]
    fy, fx = (at[0] - low[0])[:, None, None], (at[1] - low[1])[None, :, None]
    top = x[low[0]][:, low[1]] * (1 - fx) + x[low[0]][:, high[1]] * fx
    bottom = x[high[0]][:, low[1]] * (1 - fx) + x[high[0]][:, high[1]] * fx
    out = top * (1 - fy) + bottom * fy
    return out[:, :, 0] if np.asarray(image).ndim == 2 else out


def to_input(image: np.ndarray, size: int) -> np.ndarray:
    """Channels first, -1..1, ``size`` x ``size``."""
    x = resize(image, size, size)
    x = np.repeat(x[:, :, None], 3, axis=2) if x.ndim == 2 else x
    return ((x / 255 - 0.5) / 0.5).transpose(2, 0, 1)


def jitter(image: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """Factors of 1 leave the image."""
    x = np.asarray(image, np.float64) * brightness
    x = (x - as_gray(x).mean()) * contrast + as_gray(x).mean()
    if x.ndim == 3:
        gray = as_gray(x)[:, :, None]
        x = gray + (x - gray) * saturation
    return np.clip(x, 0, 255)


def compress(image: np.ndarray, quality_level: int) -> np.ndarray:
    """The loss of block-transform coding at a quality of 1 to 100: 8 x 8 cosine transforms of each channel, rounded to steps
    that grow with frequency, and back. No codec is needed."""
    x = np.asarray(image, np.float64)
    planes = x[:, :, None] if x.ndim == 2 else x
    h, w, c = planes.shape
    padded = np.pad(planes, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge") - 128
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos(np.pi * (2 * n + 1) * k / 16) * np.where(k == 0, np.sqrt(1 / 8), np.sqrt(2 / 8))
    scale = (5000 / quality_level if quality_level < 50 else 200 - 2 * quality_level) / 100
    step = np.maximum(1, (16 + 6 * (k + n)) * scale)
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, c).transpose(0, 2, 4, 1, 3)
    coded = np.round(basis @ blocks @ basis.T / step) * step
    out = (basis.T @ coded @ basis).transpose(0, 3, 1, 4, 2).reshape(padded.shape) + 128
    out = np.clip(out[:h, :w], 0, 255)
    return out[:, :, 0] if x.ndim == 2 else out


def noise(image: np.ndarray, rng: np.random.Generator, sigma: float = 12.0) -> np.ndarray:
    return np.clip(np.asarray(image, np.float64) + rng.normal(0, sigma, np.shape(image)), 0, 255)


def cutout(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rectangle of 10 to 25 % of each side becomes black, gray or light."""
    out = np.array(image, np.float64)
    h, w = out.shape[:2]
    ch, cw = (max(1, int(s * rng.uniform(0.10, 0.25))) for s in (h, w))
    y, x = int(rng.integers(0, h - ch + 1)), int(rng.integers(0, w - cw + 1))
    out[y : y + ch, x : x + cw] = rng.choice([0.0, 128.0, 240.0])
    return out


def augment(image: np.ndarray, seed: int, size: int = 256, train: bool = True) -> np.ndarray:
    """Flip, jitter, compression, noise and cutout by chance, then resize; only the resize when not training."""
    rng, x = np.random.default_rng(seed), np.asarray(image, np.float64)
    if train:
        x = x[:, ::-1] if rng.random() < 0.5 else x
        x = jitter(x, *rng.uniform(0.8, 1.2, 3)) if rng.random() < 0.5 else x
        x = compress(x, int(rng.integers(40, 81))) if rng.random() < 0.3 else x
        x = noise(x, rng) if rng.random() < 0.25 else x
        x = cutout(x, rng) if rng.random() < 0.3 else x
    return resize(x, size, size)


def decode_base64(data: str | None) -> bytes:
    """Bytes of base64 with or without a data-URI prefix and padding; none for what is not base64."""
    text = re.sub(r"\s", "", (data or "").split(",", 1)[-1])
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except ValueError:
        return b""
