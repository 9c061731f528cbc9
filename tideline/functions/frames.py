"""Frame order and frame measures (inventory T2, O3, E5, W23)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


def display_order(frames: Iterable[tuple[int, bool, object]], depth: int = 4) -> Iterator[object]:
    """Frames (picture order, is_idr, frame) by picture order; an IDR starts
    a new epoch and lets the one before it out, else a frame leaves once more
    than ``depth`` wait."""
    held: list[tuple[int, int, object]] = []
    for n, (poc, idr, f) in enumerate(frames):
        if idr:
            yield from (x for _, _, x in sorted(held, key=lambda h: h[:2]))
            held = []
        held.append((poc, n, f))
        if len(held) > depth:
            held.sort(key=lambda h: h[:2])
            yield held.pop(0)[2]
    yield from (x for _, _, x in sorted(held, key=lambda h: h[:2]))


def coding_order(kinds: str) -> list[tuple[int, str, int]]:
    """E5: (display index, kind, decode time) for an anchor and two B frames at
    a time: each anchor is coded before the B frames that it closes; trailing B
    frames without an anchor become P frames.  ``kinds`` is I, P, B in display order."""
    out, waiting = [], []
    for i, k in enumerate(kinds):
        if k == "B":
            waiting.append(i)
            continue
        out.append((i, k))
        out += [(j, "B") for j in waiting]
        waiting = []
    out += [(j, "P") for j in waiting]
    return [(i, k, t) for t, (i, k) in enumerate(out)]


def scene_change(before: np.ndarray, now: np.ndarray, block: int = 16) -> dict:
    """Mean absolute luma difference, and the share of blocks that differ
    more than twice as much as they vary inside."""
    h, w = (s // block * block for s in now.shape)
    a, b = (x[:h, :w].astype(np.int64).reshape(h // block, block, w // block, block).swapaxes(1, 2) for x in (before, now))
    sad = np.abs(a - b).mean(axis=(2, 3))
    inside = np.abs(b - b.mean(axis=(2, 3), keepdims=True)).mean(axis=(2, 3))
    return {"difference": float(sad.mean()), "changed": float((sad > 2 * inside + 1).mean())}


def sad(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of absolute differences of two blocks."""
    return int(np.abs(a.astype(np.int64) - b).sum())
