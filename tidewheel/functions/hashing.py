"""Key groups and salts.

Keys are dealt to 128 groups by a hash that is fixed, so that a key's group is the same in every process and run, and
groups to subtasks in contiguous ranges. Integer arithmetic stays in 32 bits within longs, as ANSI mode allows no
overflow. The salts that must equal given ones bit for bit need 64-bit products and are computed in numpy batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

KEY_GROUPS = 128
SALTS = 16

# The constants of the public 32-bit Murmur3 and 64-bit SplitMix finalisers, in the order of use.
MURMUR = (0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35)
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_MASK = (1 << 32) - 1


def _times(a: Column, factor: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers."""
    low, high = factor & 0xFFFF, factor >> 16
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _fold(a: Column, bits: int) -> Column:
    return a.bitwiseXOR(F.shiftrightunsigned(a, bits))


def string_hash(text: Column) -> Column:
    """The 31-polynomial hash of a string's UTF-16 units, as an unsigned 32-bit number; 0 for null and empty."""
    unit = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.ascii(c).cast("long"))
    mask = F.lit(_MASK)

    def add(total: Column, c: Column) -> Column:
        wide = c - 0x10000
        pair = (total * 31 + 0xD800 + F.shiftright(wide, 10)).bitwiseAND(mask) * 31 + 0xDC00 + wide.bitwiseAND(F.lit(0x3FF))
        return F.when(c > 0xFFFF, pair).otherwise(total * 31 + c).bitwiseAND(mask)

    return F.aggregate(unit, F.lit(0).cast("long"), add)


def long_hash(value: Column) -> Column:
    """The two halves of a long, xored, as an unsigned 32-bit number."""
    return value.bitwiseXOR(F.shiftrightunsigned(value, 32)).bitwiseAND(F.lit(_MASK))


def key_group(hashed: Column) -> Column:
    """The group (0 to 127) of a key by its unsigned 32-bit hash."""
    x = _times(hashed, MURMUR[0])
    x = F.shiftleft(x, 15).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftrightunsigned(x, 17))
    x = _fold(_times(x, MURMUR[1]), 16)
    x = _fold(_times(x, MURMUR[2]), 13)
    x = _fold(_times(x, MURMUR[3]), 16)
    signed = F.when(x > 0x7FFFFFFF, x - (1 << 32)).otherwise(x)
    # the least number has no positive counterpart in 32 bits; its remainder is 0 either way
    return (F.abs(signed) % KEY_GROUPS).cast("int")


def subtask(group: Column, parallelism: int) -> Column:
    return F.floor(group * parallelism / KEY_GROUPS).cast("int")


def salt(*columns: Column, buckets: int = SALTS) -> Column:
    """A salt that depends on the payload alone, so that a replay gives the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(SPLITMIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SPLITMIX[2])
    return x ^ (x >> np.uint64(31))


def _payload_salt(member: pd.Series, item: pd.Series, term: pd.Series, kind: pd.Series, millis: pd.Series) -> pd.Series:
    x = np.full(len(millis), SPLITMIX[0], np.uint64)
    for hashed in (member, item, term, kind):
        # a 32-bit hash is signed, and widened as such
        x = _mixed(x ^ hashed.to_numpy(np.int64).astype(np.uint32).view(np.int32).astype(np.int64).view(np.uint64))
    x = _mixed(x ^ millis.to_numpy(np.int64).view(np.uint64))
    low = (x ^ (x >> np.uint64(32))).astype(np.uint32).view(np.int32)
    return pd.Series(np.mod(low, SALTS).astype(np.int32))


def payload_salt(member: Column, item: Column, term: Column, kind: Column, millis: Column) -> Column:
    """The fixed 16-way salt of a click: strings' hashes and the time, mixed in turn."""
    salted = F.pandas_udf(_payload_salt, "int")
    return salted(*(string_hash(c) for c in (member, item, term, kind)), millis)
