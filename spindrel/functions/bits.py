"""Bit packing of small numbers.

Three layouts are in use and kept apart: nibbles with the even position in the high half, nibbles with the even
position in the low half, and n-bit fields whose bits run from the least significant on, packed into bytes from the
most significant bit on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def nibbles_to_hex(codes: Column, even_high: bool = True) -> Column:
    """Numbers 0-15 as the hex text of their bytes; an odd count is filled with 0."""
    digit = lambda x: F.lower(F.hex(x.cast("int")))
    full = F.when(F.size(codes) % 2 == 1, F.concat(codes.cast("array<int>"), F.array(F.lit(0)))).otherwise(codes.cast("array<int>"))
    if even_high:
        return F.array_join(F.transform(full, digit), "")
    pairs = F.transform(F.sequence(F.lit(0), (F.size(full) / 2).cast("int") - 1), lambda i: F.concat(digit(full[i * 2 + 1]), digit(full[i * 2])))
    return F.when(F.size(full) > 0, F.array_join(pairs, "")).otherwise(F.lit(""))


def pack_nibbles(codes: Column, even_high: bool = True) -> Column:
    """Numbers 0-15, two per byte."""
    return F.unhex(nibbles_to_hex(codes, even_high))


def unpack_nibbles(packed: Column, n: Column | None = None, even_high: bool = True) -> Column:
    """The numbers of packed nibbles; the first ``n`` of them, if given."""
    digits = F.split(F.lower(F.hex(packed)), "(?<=.)(?=.)")
    value = F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int"))
    if not even_high:
        value = F.transform(value, lambda x, i: value[F.when(i % 2 == 0, i + 1).otherwise(i - 1)])
    value = F.when(F.octet_length(packed) > 0, value).otherwise(F.array().cast("array<int>"))
    return value if n is None else F.slice(value, F.lit(1), n)


def pack_fields(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of numbers below 2**bits as rows of bytes; bits is 1, 2, 4 or 8."""
    spread = (codes[..., None] >> np.arange(bits)) & 1
    return np.packbits(spread.reshape(*codes.shape[:-1], -1).astype(np.uint8), axis=-1)


def unpack_fields(packed: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of each row of bytes."""
    spread = np.unpackbits(packed, axis=-1)[..., : n * bits].reshape(*packed.shape[:-1], n, bits)
    return (spread.astype(np.int64) << np.arange(bits)).sum(-1)


def byte_table(bits: int) -> np.ndarray:
    """The numbers that each of the 256 bytes holds, as a table of 256 rows of 8 // bits."""
    return unpack_fields(np.arange(256, dtype=np.uint8)[:, None], bits, 8 // bits)


def fields_to_hex(codes: Column, bits: int) -> Column:
    """The same layout as an expression: hex text of the bytes, an incomplete one filled with zero bits."""
    text = F.array_join(F.transform(codes.cast("array<int>"), lambda x: F.reverse(F.lpad(F.conv(x.cast("string"), 10, 2), bits, "0"))), "")
    bytes_ = F.ceil(F.length(text) / 8).cast("int")
    padded = F.rpad(text, bytes_ * 8, F.lit("0"))
    return F.when(bytes_ > 0, F.array_join(F.transform(F.sequence(F.lit(0), bytes_ - 1), lambda i: F.lower(F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))), "")).otherwise(F.lit(""))
