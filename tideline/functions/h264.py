"""H.264 with PCM macroblocks only (a lossless corner of D1, D2, E1, E4).

Every frame is an IDR picture whose macroblocks carry their samples as they
are.  Any H.264 decoder reads such streams; this decoder reads only them, and
says so for others.  Prediction, transforms and entropy coding are not built.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tideline.functions import nal
from tideline.functions.bits import Bits, BitsOut
from tideline.functions.pcm import planes

#: ue(25), the PCM macroblock type, and its alignment bits, from a byte's edge.
PCM = b"\x0d\x00"


@lru_cache(maxsize=256)
def parameter_sets(width: int, height: int, fps: tuple[int, int] | None = None) -> tuple[bytes, bytes]:
    pps = BitsOut().ue(0).ue(0).u(0, 2).ue(0).ue(0).ue(0).u(0, 3).se(0).se(0).se(0).u(0, 3).trailing().bytes()
    return nal.sps_unit(width, height, 66, 40, fps), b"\x68" + nal.with_prevention(pps)


def _blocks(plane: np.ndarray, side: int) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side * side)


def encode(frame: bytes, width: int, height: int, number: int = 0) -> bytes:
    """The IDR unit of a yuv420p frame; sides are filled up to whole macroblocks
    by repeating the last row and column."""
    y, u, v = planes(frame, width, height)
    wide, high = -(-width // 16) * 16, -(-height // 16) * 16
    pad = lambda p, w, h: p if p.shape == (h, w) else np.pad(p, ((0, h - p.shape[0]), (0, w - p.shape[1])), "edge")
    # Each block behind a macroblock type, but for the first, which the slice header holds.
    rows = np.empty((wide * high // 256, len(PCM) + 384), np.uint8)
    rows[:, : len(PCM)] = tuple(PCM)
    for p, at, side in ((pad(y, wide, high), 0, 16), (pad(u, wide // 2, high // 2), 256, 8), (pad(v, wide // 2, high // 2), 320, 8)):
        rows[:, len(PCM) + at : len(PCM) + at + side * side] = _blocks(p, side)
    return b"\x65" + nal.with_prevention(_head(number % 2) + rows.tobytes()[len(PCM) :] + b"\x80")


@lru_cache(maxsize=2)
def _head(number: int) -> bytes:
    return BitsOut().ue(0).ue(7).ue(0).u(0, 4).ue(number).u(0, 2).se(0).ue(25).bytes()


def decode(unit: bytes, sps: dict) -> bytes:
    """The frame of an IDR unit that ``encode`` could have made."""
    try:
        return _decoded(unit, sps)
    except EOFError:
        raise ValueError("picture is cut") from None


def _decoded(unit: bytes, sps: dict) -> bytes:
    data = nal.without_prevention(unit)
    b = Bits(data[1:65])
    first, kind, _ = b.ue(), b.ue(), b.ue()
    b.u(sps["frame_num_bits"])
    if unit[0] & 31 == 5:
        b.ue()
    if first or kind % 5 != 2 or sps["poc_type"] != 2 or not sps["frame_only"] or sps["chroma_format"] != 1:
        raise ValueError("only whole progressive 4:2:0 I pictures are read")
    if unit[0] >> 5 & 3:
        b.u(2 if unit[0] & 31 == 5 else 1)
    b.se()
    if b.ue() != 25:
        raise ValueError("only PCM macroblocks are read")
    at = 1 + -(-b.at // 8)
    wide, high = -(-sps["width"] // 16), -(-sps["height"] // 16)
    raw = np.frombuffer(data, np.uint8)
    n = wide * high
    if at + 384 * n + 2 * (n - 1) > len(raw):
        raise ValueError("picture is cut")
    starts = at + np.arange(n) * 386
    if not all(data[s - 2 : s] == PCM for s in starts[1:].tolist()):
        raise ValueError("only PCM macroblocks are read")
    rows = raw[starts[:, None] + np.arange(384)]

    def plane(block: np.ndarray, side: int) -> np.ndarray:
        return block.reshape(high, wide, side, side).swapaxes(1, 2).reshape(high * side, wide * side)

    y, u, v = plane(rows[:, :256], 16), plane(rows[:, 256:320], 8), plane(rows[:, 320:], 8)
    w, h = sps["width"], sps["height"]
    return y[:h, :w].tobytes() + u[: h // 2, : w // 2].tobytes() + v[: h // 2, : w // 2].tobytes()
