"""Bit fields and Exp-Golomb codes, and fixed-width reads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Bits:
    """Reads bits from the front of ``data``; past the end raises EOFError."""

    def __init__(self, data: bytes):
        self.value = int.from_bytes(data, "big")
        self.size = 8 * len(data)
        self.at = 0

    def u(self, n: int) -> int:
        if self.at + n > self.size:
            raise EOFError("out of bits")
        self.at += n
        return (self.value >> (self.size - self.at)) & ((1 << n) - 1)

    def flag(self) -> bool:
        return bool(self.u(1))

    def left(self) -> int:
        return self.size - self.at

    def ue(self) -> int:
        """Unsigned Exp-Golomb code."""
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("Exp-Golomb code too long")
        return (1 << zeros) - 1 + (self.u(zeros) if zeros else 0)

    def se(self) -> int:
        """Signed Exp-Golomb code: 1, -1, 2, -2, ..."""
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


class BitsOut:
    """Collects bits; ``bytes`` pads the last byte with zeros."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def u(self, x: int, n: int) -> BitsOut:
        self.value, self.size = (self.value << n) | (x & ((1 << n) - 1)), self.size + n
        return self

    def ue(self, x: int) -> BitsOut:
        n = (x + 1).bit_length()
        return self.u(0, n - 1).u(x + 1, n)

    def se(self, x: int) -> BitsOut:
        return self.ue(2 * x - 1 if x > 0 else -2 * x)

    def trailing(self) -> BitsOut:
        """A one, then zeros up to a whole byte."""
        self.u(1, 1)
        return self.u(0, -self.size % 8)

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")


def u_be(data: Column, at: int, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes (7 at most) from byte ``at``
    (from 0) of a binary column; null if the bytes are not all there."""
    part = F.substring(data, at + 1, n)
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def i24(data: Column, at: int) -> Column:
    """Signed 24-bit big-endian integer."""
    x = u_be(data, at, 3)
    return F.when(x >= 0x800000, x - 0x1000000).otherwise(x)


def flv_timestamp(data: Column, at: int) -> Column:
    """The 32-bit time of a tag header: three low bytes, then the high one."""
    return u_be(data, at + 3, 1) * (1 << 24) + u_be(data, at, 3)
