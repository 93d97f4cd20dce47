"""Bounded random numbers and strings that depend on a seed and a key only, so that a lost task repeats them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded(key: Column, limit: int, seed: int = 0) -> Column:
    """From 0 to limit - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(limit))


def u16(key: Column, seed: int = 0) -> Column:
    return bounded(key, 1 << 16, seed)


def u24(key: Column, seed: int = 0) -> Column:
    return bounded(key, 1 << 24, seed)


def u64(key: Column, seed: int = 0) -> Column:
    """64 bits, as a signed long."""
    return F.xxhash64(F.lit(seed), key)


def string(key: Column, length: int, seed: int = 0) -> Column:
    """Of the characters a-z, A-Z and 0-9."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    places = F.sequence(F.lit(1), F.lit(length))
    return F.array_join(F.transform(places, lambda i: F.substr(alphabet, (F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(62)) + 1).cast("int"), F.lit(1))), "")
