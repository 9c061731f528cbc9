"""PCM and YUV kernels in numpy (inventory X6, V1, V2, A12, A13)."""

from __future__ import annotations

import numpy as np


def clamped(samples: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(samples, -32768), 32767).astype("<i2")


def from_float(samples: np.ndarray) -> bytes:
    """Floats of -1..1 as 16-bit little-endian, rounded half away from zero."""
    x = np.asarray(samples, float) * 32767
    return clamped(np.trunc(x + np.copysign(0.5, x))).tobytes()


def to_float(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm, "<i2") / 32768.0


def downmixed(pcm: bytes) -> bytes:
    """Stereo to mono: the halved sum, rounded towards zero."""
    x = np.frombuffer(pcm, "<i2").astype(np.int32).reshape(-1, 2)
    return clamped(np.trunc((x[:, 0] + x[:, 1]) / 2)).tobytes()


def interleaved(planes: list[bytes]) -> bytes:
    found = [np.frombuffer(p, "<i2") for p in planes]
    out = np.empty((len(found[0]), len(found)), "<i2")
    for i, p in enumerate(found):
        if len(p) != len(out):
            raise ValueError("planes differ in length")
        out[:, i] = p
    return out.tobytes()


def _plane(p: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = p.shape
    p = p.astype(np.int64)
    if (w, h) == (2 * width, 2 * height):  # box of four
        return ((p[0::2, 0::2] + p[0::2, 1::2] + p[1::2, 0::2] + p[1::2, 1::2] + 2) >> 2).astype(np.uint8)
    # Bilinear with 16.16 positions; the last row and column repeat.
    x, y = (np.arange(width) * ((w << 16) // width)), (np.arange(height) * ((h << 16) // height))
    x0, y0 = np.minimum(x >> 16, w - 1), np.minimum(y >> 16, h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x & 0xFFFF)[None, :], (y & 0xFFFF)[:, None]
    top = p[y0][:, x0] * (65536 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (65536 - fx) + p[y1][:, x1] * fx
    return (((top >> 16) * (65536 - fy) + (low >> 16) * fy) >> 16).astype(np.uint8)


def planes(frame: bytes, width: int, height: int) -> list[np.ndarray]:
    """The three planes of a yuv420p frame with even sides."""
    y, c = width * height, (width // 2) * (height // 2)
    if len(frame) != y + 2 * c:
        raise ValueError("frame size does not match its sides")
    a = np.frombuffer(frame, np.uint8)
    return [a[:y].reshape(height, width), a[y : y + c].reshape(height // 2, width // 2), a[y + c :].reshape(height // 2, width // 2)]


def scaled(frame: bytes, width: int, height: int, to_width: int, to_height: int) -> bytes:
    """A yuv420p frame in another size."""
    if (width, height) == (to_width, to_height):
        return frame
    sizes = [(to_width, to_height)] + [(to_width // 2, to_height // 2)] * 2
    return b"".join(_plane(p, *s).tobytes() for p, s in zip(planes(frame, width, height), sizes, strict=True))


def watermarked(frame: bytes, width: int, height: int, mark: bytes, mark_width: int, mark_height: int) -> bytes:
    """The mark written over the frame's top left corner; a mark larger than
    the frame raises."""
    if mark_width > width or mark_height > height:
        raise ValueError("mark is larger than the frame")
    out = [p.copy() for p in planes(frame, width, height)]
    for p, m in zip(out, planes(mark, mark_width, mark_height), strict=True):
        p[: m.shape[0], : m.shape[1]] = m
    return b"".join(p.tobytes() for p in out)


#: Weights of red, green and blue, and what is added, for each plane.
WEIGHTS = ((0.299, 0.587, 0.114, 0), (-0.14713, -0.28886, 0.436, 128), (0.615, -0.51499, -0.10001, 128))


def from_rgb(pixels: bytes, width: int, height: int) -> bytes:
    """V3: a yuv420p frame (even sides) of RGB pixels, three bytes each; values
    are cut to whole numbers, chroma is the mean of four."""
    red, green, blue = np.moveaxis(np.frombuffer(pixels, np.uint8).reshape(height, width, 3).astype(float), 2, 0)
    y, u, v = (np.trunc(a * red + b * green + c * blue + d).clip(0, 255).astype(np.int64) for a, b, c, d in WEIGHTS)
    fours = [(p[0::2, 0::2] + p[0::2, 1::2] + p[1::2, 0::2] + p[1::2, 1::2]) // 4 for p in (u, v)]
    return b"".join(p.astype(np.uint8).tobytes() for p in (y, *fours))


def psnr(a: bytes, b: bytes) -> float:
    d = np.frombuffer(a, np.uint8).astype(np.int64) - np.frombuffer(b, np.uint8)
    mse = (d * d).mean()
    return float("inf") if mse == 0 else float(10 * np.log10(65025 / mse))
