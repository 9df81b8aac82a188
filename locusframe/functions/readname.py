"""Fragment ids out of read names, and flags of alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three layouts of read names.
ILLUMINA = r"^([^: #/]+):([0-9]+):([0-9]+):([0-9]+):([0-9]+)(?:[ #/].*)?$"
CASAVA = r"^([^: #/]+:[^: #/]+:[^: #/]+):([0-9]+):([0-9]+):([0-9]+):([0-9]+)(?:[ #/].*)?$"
NUMERIC = r"^([0-9]+)(?:[ #/].*)?$"

#: Flag bits of alignment records.
FLAGS = {
    "multi_fragment": 0x1, "all_mapped": 0x2, "unmapped": 0x4, "next_unmapped": 0x8, "reverse": 0x10, "next_reverse": 0x20,
    "first": 0x40, "last": 0x80, "secondary": 0x100, "failed": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}
FIELDS = ("flowcell", "lane", "tile", "x", "y")


def fragment_id(name: Column) -> Column:
    """struct(flowcell, lane, tile, x, y) of a read name; a numeric name is (null, 0, 0, 0, id); other names are null."""

    def parts(pattern: str) -> Column:
        numbers = [F.regexp_extract(name, pattern, i).cast("long").alias(f) for i, f in enumerate(FIELDS[1:], 2)]
        return F.struct(F.regexp_extract(name, pattern, 1).alias("flowcell"), *numbers)

    zero = F.lit(0).cast("long")
    number = F.struct(F.lit(None).cast("string").alias("flowcell"), zero.alias("lane"), zero.alias("tile"), zero.alias("x"), F.regexp_extract(name, NUMERIC, 1).cast("long").alias("y"))
    return F.when(name.rlike(ILLUMINA), parts(ILLUMINA)).when(name.rlike(CASAVA), parts(CASAVA)).when(name.rlike(NUMERIC), number)


def flag_columns(flag: Column) -> list[Column]:
    """One boolean column for each flag bit."""
    return [((flag.bitwiseAND(F.lit(bit))) != 0).alias(k) for k, bit in FLAGS.items()]


def pack_flags(**bits: Column) -> Column:
    """The flag value of boolean columns named as in ``FLAGS``."""
    total = F.lit(0)
    for k, c in bits.items():
        total = total + F.when(c, F.lit(FLAGS[k])).otherwise(F.lit(0))
    return total


def flag_filter(flag: Column, text: str) -> Column:
    """Filter from letters: m/M mapped no/yes, p/P properly paired, q/Q passing, d/D duplicate."""
    want: dict[int, bool] = {}
    for c in text:
        want |= {"m": {0x4: True}, "M": {0x4: False}, "p": {0x2: False}, "P": {0x2: True}, "q": {0x200: True}, "Q": {0x200: False}, "d": {0x400: False}, "D": {0x400: True}}[c]
    mask = sum(want)
    value = sum(b for b, on in want.items() if on)
    return flag.bitwiseAND(F.lit(mask)) == value


#: Bits of (lane, tile, x, y) in a packed key; the flowcell's ordinal stands above them.
KEY_BITS = (8, 14, 21, 20)


def pack_key(lane: Column, tile: Column, x: Column, y: Column) -> Column:
    """One number that orders like (lane, tile, x, y), where each fits its bits (``KEY_BITS``, 63 in all)."""
    packed = lane.cast("long")
    for value, bits in zip((tile, x, y), KEY_BITS[1:], strict=True):
        packed = F.shiftleft(packed, bits).bitwiseOR(value.cast("long"))
    return packed


def unpack_key(key: Column) -> list[Column]:
    """The columns lane, tile, x and y of a packed key."""
    out, shift = [], 0
    for name, bits in zip(FIELDS[:0:-1], KEY_BITS[::-1], strict=True):
        out.append(F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias(name))
        shift += bits
    return out[::-1]
