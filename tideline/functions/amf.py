"""AMF0 and AMF3 values (inventory S20, K2, R17, R18).

Objects decode to dicts; a typed object carries its class under ``__class__``;
dates decode to ("date", ms); undefined and null are both None; byte arrays are
bytes.  Encoding a decoded value gives it back.
"""

from __future__ import annotations

import struct
from typing import Any


class Reader0:
    """AMF0 values one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.objects = data, at, []

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError("AMF value is cut")
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def text(self, n: int = 2) -> str:
        return self.take(self.u(n)).decode("utf-8", "replace")

    def double(self) -> float:
        return struct.unpack(">d", self.take(8))[0]

    def fields(self, out: dict) -> dict:
        while True:
            name = self.text()
            if not name and self.data[self.at : self.at + 1] == b"\x09":
                self.at += 1
                return out
            if not name and self.at >= len(self.data):
                return out
            out[name] = self.value()

    def value(self) -> Any:
        kind = self.u(1)
        if kind == 0:
            return self.double()
        if kind == 1:
            return bool(self.u(1))
        if kind == 2:
            return self.text()
        if kind in (3, 8, 16):
            own: dict = {"__class__": self.text()} if kind == 16 else {}
            if kind == 8:
                self.u(4)
            self.objects.append(own)
            return self.fields(own)
        if kind in (5, 6, 13):
            return None
        if kind == 7:
            return self.objects[self.u(2)]
        if kind == 10:
            items: list = []
            self.objects.append(items)
            items.extend(self.value() for _ in range(self.u(4)))
            return items
        if kind == 11:
            ms = self.double()
            self.u(2)
            return ("date", ms)
        if kind in (12, 15):
            return self.text(4)
        if kind == 17:
            inner = Reader3(self.data, self.at)
            out = inner.value()
            self.at = inner.at
            return out
        raise ValueError(f"AMF0 marker {kind}")

    def all(self) -> list:
        out = []
        while self.at < len(self.data):
            out.append(self.value())
        return out


def write0(v: Any) -> bytes:
    if v is None:
        return b"\x05"
    if isinstance(v, bool):
        return bytes([1, v])
    if isinstance(v, int | float):
        return b"\x00" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return b"\x02" + struct.pack(">H", len(raw)) + raw if len(raw) < 65536 else b"\x0c" + struct.pack(">I", len(raw)) + raw
    if isinstance(v, tuple):
        return b"\x0b" + struct.pack(">dh", v[1], 0)
    if isinstance(v, list):
        return b"\x0a" + struct.pack(">I", len(v)) + b"".join(map(write0, v))
    if isinstance(v, dict):
        name = v.get("__class__")
        head = b"\x10" + _short(name) if name else b"\x03"
        return head + b"".join(_short(k) + write0(x) for k, x in v.items() if k != "__class__") + b"\x00\x00\x09"
    raise TypeError(f"no AMF0 form of {type(v).__name__}")


def _short(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">H", len(raw)) + raw


def mixed_array(v: dict) -> bytes:
    """A dict as an AMF0 mixed array, as metadata tags use."""
    return b"\x08" + struct.pack(">I", len(v)) + b"".join(_short(k) + write0(x) for k, x in v.items()) + b"\x00\x00\x09"


def metadata(values: dict) -> bytes:
    """Body of an onMetaData script tag."""
    return write0("onMetaData") + mixed_array(values)


def script(body: bytes) -> dict[str, Any]:
    """Name and value of a script tag's body."""
    r = Reader0(body)
    name = r.value()
    return {"name": name, "value": r.value() if r.at < len(body) else None}


class Reader3(Reader0):
    """AMF3 values."""

    def __init__(self, data: bytes, at: int = 0):
        super().__init__(data, at)
        self.strings: list[str] = []
        self.traits: list[tuple] = []

    def u29(self) -> int:
        n = 0
        for i in range(4):
            b = self.u(1)
            if i == 3:
                return n << 8 | b
            n = n << 7 | b & 127
            if b < 128:
                return n
        return n

    def string(self) -> str:
        n = self.u29()
        if not n & 1:
            return self.strings[n >> 1]
        s = self.take(n >> 1).decode("utf-8", "replace")
        if s:
            self.strings.append(s)
        return s

    def value(self) -> Any:
        kind = self.u(1)
        if kind in (0, 1):
            return None
        if kind in (2, 3):
            return kind == 3
        if kind == 4:
            n = self.u29()
            return n - (1 << 29) if n >> 28 else n
        if kind == 5:
            return self.double()
        if kind == 6:
            return self.string()
        if kind not in (7, 8, 9, 10, 11, 12):
            raise ValueError(f"AMF3 marker {kind}")
        n = self.u29()
        if not n & 1:
            return self.objects[n >> 1]
        n >>= 1
        if kind in (7, 11):
            self.objects.append(out := self.take(n).decode("utf-8", "replace"))
            return out
        if kind == 8:
            self.objects.append(date := ("date", self.double()))
            return date
        if kind == 12:
            self.objects.append(raw := self.take(n))
            return raw
        if kind == 9:
            own: dict = {}
            items: list = []
            at = len(self.objects)
            self.objects.append(items)
            while name := self.string():
                own[name] = self.value()
            items.extend(self.value() for _ in range(n))
            if own:
                self.objects[at] = out = own | {str(i): x for i, x in enumerate(items)}
                return out
            return items
        if not n & 1:
            traits = self.traits[n >> 1]
        else:
            traits = (self.string(), bool(n >> 1 & 1), bool(n >> 2 & 1), [self.string() for _ in range(n >> 3)])
            self.traits.append(traits)
        name, external, dynamic, members = traits
        obj: dict = {"__class__": name} if name else {}
        self.objects.append(obj)
        if external:
            obj["__external__"] = self.value()
            return obj
        for m in members:
            obj[m] = self.value()
        if dynamic:
            while key := self.string():
                obj[key] = self.value()
        return obj


def _u29(n: int) -> bytes:
    n &= (1 << 29) - 1
    if n < 1 << 7:
        return bytes([n])
    if n < 1 << 14:
        return bytes([n >> 7 | 128, n & 127])
    if n < 1 << 21:
        return bytes([n >> 14 | 128, n >> 7 & 127 | 128, n & 127])
    return bytes([n >> 22 | 128, n >> 15 & 127 | 128, n >> 8 & 127 | 128, n & 255])


def _string3(s: str) -> bytes:
    raw = s.encode()
    return _u29(len(raw) << 1 | 1) + raw


def write3(v: Any) -> bytes:
    """AMF3 without references."""
    if v is None:
        return b"\x01"
    if isinstance(v, bool):
        return b"\x03" if v else b"\x02"
    if isinstance(v, int) and -(1 << 28) <= v < 1 << 28:
        return b"\x04" + _u29(v)
    if isinstance(v, int | float):
        return b"\x05" + struct.pack(">d", v)
    if isinstance(v, str):
        return b"\x06" + _string3(v)
    if isinstance(v, bytes):
        return b"\x0c" + _u29(len(v) << 1 | 1) + v
    if isinstance(v, tuple):
        return b"\x08\x01" + struct.pack(">d", v[1])
    if isinstance(v, list):
        return b"\x09" + _u29(len(v) << 1 | 1) + b"\x01" + b"".join(map(write3, v))
    if isinstance(v, dict):
        body = b"".join(_string3(k) + write3(x) for k, x in v.items() if k != "__class__")
        # References number strings as they come; this writer repeats them in full.
        return b"\x0a\x0b" + _string3(v.get("__class__", "")) + body + b"\x01"
    raise TypeError(f"no AMF3 form of {type(v).__name__}")
