"""Binary codes as Columns: byte strings of up to 32 bytes, packed into four left-aligned 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 32


def word(hex_text: Column, i: int) -> Column:
    """The i-th 64-bit word of a hexadecimal text of 64 digits (two halves: a whole one would overflow)."""
    half = lambda at: F.conv(F.substring(hex_text, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(16 * i + 1), 32).bitwiseOR(half(16 * i + 9))


def pack(code: Column) -> Column:
    """struct<words array<bigint>, bits int> of a binary code; beyond 32 bytes the code is cut."""
    cut = F.substring(code, 1, MAX_BYTES)
    text = F.rpad(F.hex(cut), 2 * MAX_BYTES, "0")
    return F.when(code.isNotNull(), F.struct(F.array(*[word(text, i) for i in range(4)]).alias("words"), (8 * F.length(cut)).alias("bits")))


def sign_code(vec: Column) -> Column:
    """The signs of a vector of 64 components as one word: bit 63 - i is set where component i isn't negative."""
    return F.aggregate(F.transform(vec, lambda x: F.when(x >= 0, F.lit(1)).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def from_word(w: Column, bits: Column) -> Column:
    """A packed code of the first `bits` bits of one word."""
    zero = F.lit(0).cast("bigint")
    return F.struct(F.array(w, zero, zero, zero).alias("words"), bits.cast("int").alias("bits"))


def pad(code: Column, nbytes: int) -> Column:
    """One byte with the code's own length, then the code cut or zero-filled to `nbytes`."""
    head = F.unhex(F.lpad(F.hex(F.length(code).cast("bigint")), 2, "0"))
    return F.concat(head, F.unhex(F.rpad(F.hex(F.substring(code, 1, nbytes)), 2 * nbytes, "0")))


def unpad(padded: Column) -> Column:
    """The code of a padded one: as many bytes as its first says, at most those that are there."""
    n = F.conv(F.hex(F.substring(padded, 1, 1)), 16, 10).cast("int")
    return F.substring(padded, F.lit(2), n)


def composite_key(hi: Column, lo: Column) -> Column:
    """Two 64-bit numbers as one 16-byte key, big-endian."""
    return F.unhex(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def key_parts(key: Column) -> tuple[Column, Column]:
    """The two 64-bit numbers of a 16-byte key."""
    text = F.hex(key)
    return word(text, 0), word(text, 1)
