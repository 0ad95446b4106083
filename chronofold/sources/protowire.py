"""A bounded reader (and a plain writer) of the protocol-buffer wire format, driven by small message descriptions."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: A message: field number -> (name, kind, repeated); kind is int, sint, bool, fixed64, double, string, bytes, ints, or a message.
Message = dict[int, tuple]
WIRE = {"int": 0, "bool": 0, "fixed64": 1, "double": 1, "string": 2, "bytes": 2, "ints": 2}


class TooLarge(ValueError):
    """A structural limit is exceeded; the reading stopped there."""


class Malformed(ValueError):
    """Not the wire format, or not the described message."""


@dataclass
class Budget:
    """Counts of one body over all its nested messages."""

    fields: int = 300_000
    objects: int = 70_000
    depth: int = 12
    seen: dict[str, int] = field(default_factory=lambda: {"fields": 0, "objects": 0})

    def take(self, what: str) -> None:
        self.seen[what] += 1
        if self.seen[what] > getattr(self, what):
            raise TooLarge(what)


def _varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while at < end and shift < 70:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & (1 << 64) - 1, at
        shift += 7
    raise Malformed("varint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def read(data: bytes, message: Message, budget: Budget | None = None, at: int = 0, end: int | None = None, depth: int = 0) -> dict:
    """Field values by name: lists for repeated fields, the last value for others, unknown fields skipped but counted."""
    budget = budget or Budget()
    end = len(data) if end is None else end
    budget.take("objects")
    if depth > budget.depth:
        raise TooLarge("depth")
    out: dict = {}
    while at < end:
        tag, at = _varint(data, at, end)
        number, wire = tag >> 3, tag & 7
        budget.take("fields")
        if number == 0:
            raise Malformed("field number")
        value: object = None
        start = at
        if wire == 0:
            value, at = _varint(data, at, end)
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
        elif wire == 2:
            size, start = _varint(data, at, end)
            at = start + size
        else:
            raise Malformed("wire type")
        if at > end:
            raise Malformed("truncated")
        known = message.get(number)
        if known is None:
            continue
        name, kind, repeated = known
        if kind == "ints" and wire == 0:  # an unpacked element
            out.setdefault(name, []).append(_signed(value))
            continue
        if wire != (2 if isinstance(kind, dict) else WIRE[kind]):
            raise Malformed(name)
        if isinstance(kind, dict):
            value = read(data, kind, budget, start, at, depth + 1)
        elif kind == "string":
            try:
                value = data[start:at].decode()
            except UnicodeDecodeError:
                raise Malformed(name) from None
        elif kind == "bytes":
            value = data[start:at]
        elif kind == "ints":
            k = start
            while k < at:
                budget.take("fields")
                n, k = _varint(data, k, at)
                out.setdefault(name, []).append(_signed(n))
            continue
        elif kind == "fixed64":
            value = struct.unpack_from("<Q", data, start)[0]
        elif kind == "double":
            value = struct.unpack_from("<d", data, start)[0]
        elif kind == "bool":
            value = bool(value)
        else:
            value = _signed(value)
        if repeated:
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def _number(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def write(values: dict, message: Message) -> bytes:
    """The wire form of field values as ``read`` gives them, in field order."""
    out = []
    for number, (name, kind, repeated) in sorted(message.items()):
        if name not in values:
            continue
        for value in values[name] if repeated and kind != "ints" else [values[name]]:
            if isinstance(kind, dict):
                body = write(value, kind)
            elif kind == "string":
                body = value.encode()
            elif kind == "ints":
                body = b"".join(map(_number, value))
            else:
                body = value
            wire = 2 if isinstance(kind, dict) else WIRE[kind]
            out.append(_number(number << 3 | wire))
            if wire == 2:
                out += [_number(len(body)), body]
            elif wire == 1:
                out.append(struct.pack("<d" if kind == "double" else "<Q", value))
            else:
                out.append(_number(int(value)))
    return b"".join(out)
