"""String hashes: thirteen published 32-bit functions as column expressions.

Each takes a string or binary column and gives a BIGINT in [0, 2**32); null for
null. Bytes count as unsigned. Only names and signatures of these functions are
given by what this engine stands in for; where more than one variant of a
function has been published, the docstring says which one this is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinfold.functions.bytes import long
from twinfold.functions.lanes import chained

HashFunction = Callable[[Column], Column]


def ap_hash(data: Column) -> Column:
    """Alternating steps for even and odd places, from 0xAAAAAAAA."""

    def step(h, c, j):
        if j % 2 == 0:
            return h ^ (((h << 7) ^ c * (h >> 3)) & 0xFFFFFFFF)
        return h ^ (~((h << 11) + (c ^ (h >> 5))) & 0xFFFFFFFF)

    return chained(data, lambda n: 0xAAAAAAAA, step)


def bkdr_hash(data: Column) -> Column:
    """h * 131 + c."""
    return chained(data, lambda n: 0, lambda h, c, j: (h * 131 + c) & 0xFFFFFFFF)


def bp_hash(data: Column) -> Column:
    """(h << 7) ^ c."""
    return chained(data, lambda n: 0, lambda h, c, j: ((h << 7) & 0xFFFFFFFF) ^ c)


def djb_hash(data: Column) -> Column:
    """h * 33 + c from 5381."""
    return chained(data, lambda n: 5381, lambda h, c, j: (h * 33 + c) & 0xFFFFFFFF)


def djb2_hash(data: Column) -> Column:
    """(h * 33) ^ c from 5381, the XOR variant."""
    return chained(data, lambda n: 5381, lambda h, c, j: ((h * 33) & 0xFFFFFFFF) ^ c)


def dek_hash(data: Column) -> Column:
    """Rotation by five bits, XOR c, from the length in bytes."""
    return chained(data, lambda n: n & 0xFFFFFFFF, lambda h, c, j: ((h << 5) & 0xFFFFFFFF) ^ (h >> 27) ^ c)


def elf_hash(data: Column) -> Column:
    """The symbol hash of object files: shift by four, add c, XOR the top four
    bits in 24 places down and clear them."""

    def step(h, c, j):
        h = ((h << 4) + c) & 0xFFFFFFFF
        return (h ^ (h >> 28 << 4)) & 0x0FFFFFFF

    return chained(data, lambda n: 0, step)


def fnv_hash(data: Column) -> Column:
    """FNV-1: multiply, then XOR, from the published offset."""
    return chained(data, lambda n: 2166136261, lambda h, c, j: ((h * 16777619) & 0xFFFFFFFF) ^ c)


def js_hash(data: Column) -> Column:
    """h ^= (h << 5) + c + (h >> 2), from 1315423911."""
    return chained(data, lambda n: 1315423911, lambda h, c, j: h ^ (((h << 5) + c + (h >> 2)) & 0xFFFFFFFF))


def pjw_hash(data: Column) -> Column:
    """Shift by four, add c, fold the top four bits: equal to ELF for 32 bits."""
    return elf_hash(data)


def rs_hash(data: Column) -> Column:
    """h * a + c with a multiplier that is itself multiplied at every byte."""

    def step(h, c, j):
        # the multiplier depends on the place alone; places come in order
        if j == 0 or j != step.at:
            step.at, step.a = j, 63689 * pow(378551, j, 1 << 32) & 0xFFFFFFFF
        # two halves, so that vectors of 64 bits do not overflow
        high, low = step.a >> 16, step.a & 0xFFFF
        h = (((h * high & 0xFFFF) << 16) + h * low + c) & 0xFFFFFFFF
        step.at, step.a = j + 1, step.a * 378551 & 0xFFFFFFFF
        return h

    step.at, step.a = 0, 63689
    return chained(data, lambda n: 0, step)


def sdbm_hash(data: Column) -> Column:
    """c + (h << 6) + (h << 16) - h, which is h * 65599 + c."""
    return chained(data, lambda n: 0, lambda h, c, j: (h * 65599 + c) & 0xFFFFFFFF)


def crc_hash(data: Column) -> Column:
    """CRC-32 of IEEE 802.3."""
    return F.crc32(data.cast("binary"))


#: Every hash by its name; the type of an entry is ``Column -> Column``.
HASHES: dict[str, HashFunction] = {
    "ap": ap_hash,
    "bkdr": bkdr_hash,
    "bp": bp_hash,
    "djb": djb_hash,
    "djb2": djb2_hash,
    "dek": dek_hash,
    "elf": elf_hash,
    "fnv": fnv_hash,
    "js": js_hash,
    "pjw": pjw_hash,
    "rs": rs_hash,
    "sdbm": sdbm_hash,
    "crc": crc_hash,
}


def bucket(key: Column, size: int, hash_function: HashFunction = rs_hash) -> Column:
    """Bucket number of a key in a table of ``size`` buckets."""
    return F.pmod(hash_function(key), long(size))
