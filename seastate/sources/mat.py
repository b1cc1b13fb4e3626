"""MAT files of version 5 without a library: tagged elements, packed ones too, and arrays of numbers."""

from __future__ import annotations

import datetime as dt
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from ..frame import EFTH
from ..grid import Grid

#: Kinds of elements by number: those of numbers, a matrix, and a packed element. Fixed values.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, PACKED = 14, 15
#: Classes of arrays: those of numbers. Fixed values.
FIRST_CLASS, LAST_CLASS = 6, 15


def elements(raw: bytes, order: str, most: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(kind, data) of the elements that follow one another; a small one has its data in its tag."""
    at = 0
    while at + 8 <= len(raw) and (most is None or most > 0):
        (word,) = struct.unpack_from(f"{order}I", raw, at)
        if word >> 16:
            kind, size, begin, step = word & 0xFFFF, word >> 16, at + 4, 8
        else:
            (size,) = struct.unpack_from(f"{order}I", raw, at + 4)
            kind, begin = word, at + 8
            step = 8 + size + (-size % 8 if kind != PACKED else 0)
        if begin + size > len(raw):
            raise ValueError("a damaged MAT file")
        yield kind, raw[begin : begin + size]
        at += step
        most = None if most is None else most - 1


def matrix(raw: bytes, order: str) -> tuple[str, np.ndarray | None]:
    """(name, values) of an array of real numbers; None for other arrays."""
    parts = elements(raw, order)
    flags, (_, dims), (_, name) = next(parts)[1], next(parts), next(parts)
    (word,) = struct.unpack_from(f"{order}I", flags)
    shape = np.frombuffer(dims, f"{order}i4")
    if not FIRST_CLASS <= word & 0xFF <= LAST_CLASS or word & 0x800:
        return name.decode(), None
    kind, data = next(parts)
    return name.decode(), np.frombuffer(data, order + NUMBERS[kind]).astype(float).reshape(shape, order="F")


def parse(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of real numbers in a file, by name."""
    mark = raw[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of version 5")
    order, out = "<" if mark == b"IM" else ">", {}
    for kind, data in elements(raw[128:], order):
        inner = elements(zlib.decompress(data), order) if kind == PACKED else [(kind, data)]
        for own, content in inner:
            if own == MATRIX and content:
                name, values = matrix(content, order)
                if values is not None:
                    out[name] = values
    return out


def parse_xwaves(raw: bytes, name: str = "") -> tuple[Grid, list[dict]]:
    """Spectra per radian over time (rows of year, month, day, hour, minute, second), frequency and direction."""
    found = parse(raw)
    if lacking := {"td", "fd", "thetad", "spec2d"} - set(found):
        raise ValueError(f"{name} has no {', '.join(sorted(lacking))}")
    grid = Grid(tuple(found["fd"].ravel()), tuple(found["thetad"].ravel()))
    times = [dt.datetime(*map(int, t[:5])) + dt.timedelta(seconds=float(t[5]) if len(t) > 5 else 0) for t in found["td"]]
    blocks = found["spec2d"].reshape(len(times), grid.nf, grid.nd) * (math.pi / 180)
    return grid, [{"time": t, EFTH: b} for t, b in zip(times, blocks)]
