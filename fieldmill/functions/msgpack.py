"""A decoder of MessagePack values, as JSON-ready Python values."""

from __future__ import annotations

import base64
import struct

_FIXED = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I"), 0xC7: ("ext", ">B"), 0xC8: ("ext", ">H"), 0xC9: ("ext", ">I")}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the value is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def sized(self, kind: str, n: int):
        if kind == "str":
            return self.take(n).decode("utf-8", "replace")
        if kind == "bin":
            return base64.b64encode(self.take(n)).decode()
        if kind == "ext":
            self.take(1)
            return base64.b64encode(self.take(n)).decode()
        if kind == "list":
            return [self.value() for _ in range(n)]
        out = {}
        for _ in range(n):
            key = self.value()
            out[key if isinstance(key, str) else str(key)] = self.value()
        return out

    def value(self):
        b = self.take(1)[0]
        if b <= 0x7F:
            return b
        if b >= 0xE0:
            return b - 256
        if b <= 0x8F:
            return self.sized("map", b & 0x0F)
        if b <= 0x9F:
            return self.sized("list", b & 0x0F)
        if b <= 0xBF:
            return self.sized("str", b & 0x1F)
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in _FIXED:
            return self.number(_FIXED[b])
        if b in _LENGTHS:
            kind, form = _LENGTHS[b]
            return self.sized(kind, self.number(form))
        if 0xD4 <= b <= 0xD8:
            return self.sized("ext", 1 << (b - 0xD4))
        raise ValueError(f"unknown leading byte {b:#x}")


def unpack(data: bytes):
    """The first value in data. Binary parts come out in base64."""
    return _Reader(bytes(data)).value()


def pack(value) -> bytes:
    """A value as MessagePack, for round trips."""
    if value is None or isinstance(value, bool):
        return bytes([{None: 0xC0, False: 0xC2, True: 0xC3}[value]])
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value)
        return b"\xd3" + struct.pack(">q", value) if value < 2**63 else b"\xcf" + struct.pack(">Q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        return b"\xdb" + struct.pack(">I", len(data)) + data
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, dict):
        return b"\xdf" + struct.pack(">I", len(value)) + b"".join(pack(k) + pack(v) for k, v in value.items())
    return b"\xdd" + struct.pack(">I", len(value)) + b"".join(map(pack, value))
