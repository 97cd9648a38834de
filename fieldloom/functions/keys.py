"""Keys by which runs, fields and calibrations are told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 2166136261, 16777619


def canonical(*parts: Column) -> Column:
    """The parts as one JSON object in the given order, nulls included."""
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def identity(text: Column) -> Column:
    """The hexadecimal SHA-256 of a text."""
    return F.sha2(text.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """Length and FNV-1a hash of a text by its 16-bit code units, as ``length:hex``."""
    code = lambda c: F.ascii(c).cast("long")
    high = lambda c: F.lit(0xD800) + F.shiftright(code(c) - 0x10000, 10)
    low = lambda c: F.lit(0xDC00) + (code(c) - 0x10000).bitwiseAND(F.lit(0x3FF))
    units = F.flatten(F.transform(F.split(text, ""), lambda c: F.when(code(c) > 0xFFFF, F.array(high(c), low(c))).otherwise(F.array(code(c)))))
    units = F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(units)
    hashed = F.aggregate(units, F.lit(FNV_START).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * FNV_PRIME, F.lit(1 << 32)))
    return F.concat_ws(":", F.size(units).cast("string"), F.lower(F.hex(hashed)))


def sampled(values: Column, parts: int = 256) -> Column:
    """``parts`` + 1 evenly spaced items of an array, ends included; of an empty one none."""
    n = F.size(values) - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.get(values, F.floor(i * n / parts).cast("int")))
    return F.when(n >= 0, picks).otherwise(F.slice(values, 1, 0))
