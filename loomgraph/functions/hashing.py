"""FNV-1a 64 and hash comparison columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of FNV-1a 64.
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes) -> str:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return f"{h:016x}"


@F.pandas_udf(StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a(t.encode("utf-8", "surrogatepass")))


def hash_content(text: Column) -> Column:
    """16 hex digits over the UTF-8 bytes; null stays null. Arrow batches: the bytewise loop has no built-in."""
    return _fnv(text)


def hash_file(path: Column, content: Column) -> Column:
    """The hash of path, a NUL, and content."""
    return hash_content(F.concat(path, F.lit("\0"), content))


def hash_content_native(text: Column) -> Column:
    """The same hash in built-in expressions: the state as two 32-bit limbs, since Spark's multiply does not wrap."""
    data = text.cast("binary")
    n = F.length(data)
    at = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    state = lambda hi, lo: F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))

    def step(s: Column, i: Column) -> Column:
        x = s["lo"].bitwiseXOR(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
        return state(low(s["hi"] * 435 + x * 256 + F.shiftright(x * 435, 32)), low(x * 435))

    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(at, state(F.lit(OFFSET >> 32), F.lit(OFFSET & 0xFFFFFFFF)), step, lambda s: F.concat(digits(s["hi"]), digits(s["lo"])))
