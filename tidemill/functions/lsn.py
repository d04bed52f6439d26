"""Log sequence numbers: text `HEX/HEX`, an unsigned 64-bit position, DECIMAL(20,0) in tables.

Python functions for the driver, column functions for plans. Text order isn't position order
("0/A" < "0/10"), so everything compares positions."""

from __future__ import annotations

import re
import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN_TYPE = "decimal(20,0)"
PATTERN = r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"
SEGMENT = 1 << 32


def parse(text: str) -> int:
    if not isinstance(text, str) or not re.fullmatch(PATTERN[1:-1], text):
        raise ValueError(f"invalid LSN: {text!r}")
    high, low = text.split("/")
    return int(high, 16) * SEGMENT + int(low, 16)


def to_text(lsn: int) -> str:
    if not 0 <= lsn < 1 << 64:
        raise ValueError(f"LSN out of range: {lsn}")
    return f"{lsn // SEGMENT:X}/{lsn % SEGMENT:X}"


def compare(a: str, b: str) -> int:
    x, y = parse(a), parse(b)
    return (x > y) - (x < y)


def latest(*candidates: str | None) -> str | None:
    """The furthest of the given positions; None if there is none."""
    known = [c for c in candidates if c is not None]
    return reduce(lambda a, b: a if compare(a, b) >= 0 else b, known) if known else None


def at_or_past(lsn: str | None, boundary: str) -> bool:
    return lsn is not None and compare(lsn, boundary) >= 0


def lag_bytes(received: int, applied: int) -> int:
    return max(received - applied, 0)


def encode_binary(lsn: str | int) -> bytes:
    """The eight bytes of the wire form, from text or a number."""
    return struct.pack(">Q", parse(lsn) if isinstance(lsn, str) else lsn)


def decode_binary(raw: bytes) -> str:
    return to_text(struct.unpack(">Q", raw)[0])


def lsn_from_text(text: Column, strict: bool = True) -> Column:
    """Position of a text column. Malformed text fails the query, or gives null if not strict."""
    half = lambda k: F.conv(F.split_part(text, F.lit("/"), F.lit(k)), 16, 10).cast(LSN_TYPE)
    value = (half(1) * F.lit(SEGMENT).cast("decimal(10,0)") + half(2)).cast(LSN_TYPE)
    bad = F.raise_error(F.concat(F.lit("invalid LSN: "), text)).cast(LSN_TYPE) if strict else F.lit(None).cast(LSN_TYPE)
    return F.when(text.isNull(), None).when(text.rlike(PATTERN), value).otherwise(bad)


def lsn_to_text(lsn: Column) -> Column:
    """Whole division by `div`: decimal `/` rounds and gives the wrong segment near its end."""
    x = lsn.cast(LSN_TYPE)
    seg = F.lit(SEGMENT).cast("decimal(20,0)")
    return F.concat(F.hex(F.call_function("div", x, seg)), F.lit("/"), F.hex((x % seg).cast("bigint")))


def lag_column(received: Column, applied: Column) -> Column:
    return F.greatest(received - applied, F.lit(0).cast(LSN_TYPE))
