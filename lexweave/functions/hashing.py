"""FarmHash fingerprint of 64 bits, on whole Arrow batches: strings of one length are hashed together as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
# The constants of the public algorithm.
K0, K1, K2 = _U(0xC3A5C85C97CB3127), _U(0xB492B66FBE98F273), _U(0x9AE16A3B2F90404F)


def _turn(v, n):
    return (v >> _U(n)) | (v << _U(64 - n))


def _fold(v):
    return v ^ (v >> _U(47))


def _pair(u, v, mul):
    a = _fold((u ^ v) * mul)
    return _fold((v ^ a) * mul) * mul


class _Block:
    """Strings of one length as a matrix of bytes."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, rows.shape[1]

    def word(self, at: int, size: int = 8):
        return np.ascontiguousarray(self.rows[:, at : at + size]).view(f"<u{size}").ravel().astype(_U)

    def byte(self, at: int):
        return self.rows[:, at].astype(_U)


def _to_16(b: _Block):
    n = b.n
    mul = K2 + _U(2 * n)
    if n >= 8:
        first, last = b.word(0) + K2, b.word(n - 8)
        return _pair(_turn(last, 37) * mul + first, (_turn(first, 25) + last) * mul, mul)
    if n >= 4:
        return _pair(_U(n) + (b.word(0, 4) << _U(3)), b.word(n - 4, 4), mul)
    if n:
        y, z = b.byte(0) + (b.byte(n >> 1) << _U(8)), _U(n) + (b.byte(n - 1) << _U(2))
        return _fold((y * K2) ^ (z * K0)) * K2
    return np.full(len(b.rows), K2)


def _to_32(b: _Block):
    n = b.n
    mul = K2 + _U(2 * n)
    p, q, r, s = b.word(0) * K1, b.word(8), b.word(n - 8) * mul, b.word(n - 16) * K2
    return _pair(_turn(p + q, 43) + _turn(r, 30) + s, p + _turn(q + K2, 18) + r, mul)


def _to_64(b: _Block):
    n = b.n
    mul = K2 + _U(2 * n)
    p, q, r, s = b.word(0) * K2, b.word(8), b.word(n - 8) * mul, b.word(n - 16) * K2
    y = _turn(p + q, 43) + _turn(r, 30) + s
    z = _pair(y, p + _turn(q + K2, 18) + r, mul)
    e, f = b.word(16) * mul, b.word(24)
    g, h = (y + b.word(n - 32)) * mul, (z + b.word(n - 24)) * mul
    return _pair(_turn(e + f, 43) + _turn(g, 30) + h, e + _turn(f + p, 18) + g, mul)


def _weak(b: _Block, at: int, p, q):
    w, x, y, z = (b.word(at + 8 * i) for i in range(4))
    p = p + w
    q = _turn(q + p + z, 21)
    c = p
    p = p + x + y
    return p + z, q + _turn(p, 44) + c


def _long(b: _Block):
    n, seed = b.n, _U(81)
    x = seed * K2 + b.word(0)
    y = np.full(len(b.rows), seed * K1 + _U(113))
    z = _fold(y * K2 + _U(113)) * K2
    v = w = (np.zeros(len(b.rows), _U), np.zeros(len(b.rows), _U))

    def step(at, mul, nine):
        nonlocal x, y, z, v, w
        x = _turn(x + y + v[0] + b.word(at + 8), 37) * mul
        y = _turn(y + v[1] + b.word(at + 48), 42) * mul
        x = x ^ (w[1] * nine)
        y = y + v[0] * nine + b.word(at + 40)
        z = _turn(z + w[0], 33) * mul
        v = _weak(b, at, v[1] * mul, x + w[0])
        w = _weak(b, at + 32, z + w[1], y + b.word(at + 16))
        x, z = z, x

    for at in range(0, (n - 1) // 64 * 64, 64):
        step(at, K1, _U(1))
    mul = K1 + ((z & _U(0xFF)) << _U(1))
    w = (w[0] + _U((n - 1) & 63), w[1])
    v = (v[0] + w[0], v[1])
    w = (w[0] + v[0], w[1])
    step(n - 64, mul, _U(9))
    return _pair(_pair(v[0], w[0], mul) + _fold(y) * K0 + z, _pair(v[1], w[1], mul) + x, mul)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers; 0 for null."""
    raw = [b"" if t is None else t.encode() for t in texts]
    out = np.zeros(len(raw), _U)
    sizes = np.array([len(r) for r in raw])
    with np.errstate(over="ignore"):
        for n in np.unique(sizes):
            which = np.flatnonzero(sizes == n)
            block = _Block(np.frombuffer(b"".join(raw[i] for i in which), np.uint8).reshape(len(which), n))
            out[which] = (_to_16 if n <= 16 else _to_32 if n <= 32 else _to_64 if n <= 64 else _long)(block)
    return out.view(np.int64)


def farmhash64(text: Column | str) -> Column:
    """The fingerprint as a long (the same 64 bits, signed); null for null."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series(fingerprints([None if t is None else t for t in texts]), dtype="Int64")
        return out.mask(texts.isna().to_numpy())

    return run(F.col(text) if isinstance(text, str) else text)
