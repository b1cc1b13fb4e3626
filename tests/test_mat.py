"""MAT files that the test makes, byte by byte."""

import datetime as dt
import struct
import zlib

import numpy as np
import pytest

from seastate.frame import EFTH
from seastate.sources import mat, plugins

R = np.random.default_rng(3)


def element(kind, data, order="<"):
    if len(data) <= 4:
        return struct.pack(f"{order}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, values, code=9, kind="f8", order="<", of=6):
    values = np.asarray(values)
    body = element(6, struct.pack(f"{order}II", of, 0), order) + element(5, np.array(values.shape, f"{order}i4").tobytes(), order)
    body += element(1, name.encode(), order) + element(code, values.astype(order + kind).tobytes(order="F"), order)
    return element(14, body, order)


def file(parts, order="<", packed=False):
    if packed:
        parts = [struct.pack(f"{order}II", 15, len(z)) + z for z in map(zlib.compress, parts)]
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI") + b"".join(parts)


@pytest.mark.parametrize(("order", "packed"), [("<", False), (">", False), ("<", True)])
def test_arrays(order, packed):
    made = {"a": R.normal(size=(3, 4, 2)), "fd": np.array([[7]]), "longer_name": np.arange(6.0).reshape(2, 3)}
    text = element(14, element(6, struct.pack(f"{order}II", 4, 0), order) + element(5, np.array([1, 2], f"{order}i4").tobytes(), order) + element(1, b"note", order) + element(4, "ab".encode("utf-16-le"), order), order)
    raw = file([array("a", made["a"], order=order), array("fd", made["fd"], 2, "u1", order), text, array("longer_name", made["longer_name"], 7, "f4", order)], order, packed)
    got = mat.parse(raw)
    assert set(got) == set(made) and all((got[k] == v).all() and got[k].shape == v.shape for k, v in made.items())
    with pytest.raises(ValueError, match="damaged"):
        mat.parse(raw[: len(raw) - 20])
    with pytest.raises(ValueError, match="version 5"):
        mat.parse(b"\x89HDF" + b" " * 200)


def test_spectra(spark, tmp_path):
    e = R.uniform(0, 9, (3, 4, 5))
    td = [[2020, 1, 2, 3, 4, 5.5], [2020, 1, 2, 4, 0, 0], [2020, 12, 31, 23, 59, 59]]
    parts = [array("td", td), array("fd", [[0.05, 0.1, 0.2, 0.3]]), array("thetad", np.arange(5.0)[:, None] * 72, 4, "u2"), array("spec2d", e)]
    (tmp_path / "x.mat").write_bytes(file(parts, packed=True))
    back = plugins.load(spark, "xwaves", f"{tmp_path}/*.mat")
    rows = back.df.orderBy("time").collect()
    assert [r["time"] for r in rows] == [dt.datetime(2020, 1, 2, 3, 4, 5, 500000), dt.datetime(2020, 1, 2, 4), dt.datetime(2020, 12, 31, 23, 59, 59)]
    np.testing.assert_allclose([r[EFTH] for r in rows], e.reshape(3, -1) * np.pi / 180)
    assert back.grid.dir == (0.0, 72.0, 144.0, 216.0, 288.0)
    (tmp_path / "y.mat").write_bytes(file(parts[:2]))
    with pytest.raises(Exception, match="spec2d, thetad"):
        plugins.load(spark, "xwaves", f"{tmp_path}/y.mat")
