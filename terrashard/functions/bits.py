"""Availability views: struct<constant BOOLEAN, bits BINARY>, a constant or a bitstream, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEW = "struct<constant:boolean,bits:binary>"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once and written once into the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held(value: Column) -> Column:
    """value, computed where it stands: the optimiser moves no filter below it, and so writes it out once, however often a plan asks for it."""
    return F.when(F.spark_partition_id() >= 0, value)


def constant(value: bool | Column) -> Column:
    value = F.lit(value) if isinstance(value, bool) else value
    return F.struct(value.alias("constant"), F.lit(None).cast("binary").alias("bits"))


def bitstream(bits: Column) -> Column:
    return F.struct(F.lit(None).cast("boolean").alias("constant"), bits.alias("bits"))


def byte_at(bits: Column, index: Column) -> Column:
    """Byte of a BINARY at an index from 0; null beyond its end."""
    return F.conv(F.nullif(F.hex(F.substr(bits, (index + 1).cast("int"), F.lit(1))), F.lit("")), 16, 10).cast("int")


def little_endian(bits: Column, offset: int, width: int) -> Column:
    """Unsigned number of width bytes from a fixed offset, as DECIMAL(20, 0): it may pass 2 ** 63."""
    digits = F.concat(*(F.hex(F.substr(bits, F.lit(offset + 1 + i), F.lit(1))) for i in reversed(range(width))))
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def to_little_endian(number: Column, width: int) -> Column:
    """BINARY of width bytes of a BIGINT."""
    digits = F.lpad(F.hex(number.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width)))))


def is_set(view: Column, bit: Column) -> Column:
    """Whether a bit is set; beyond the end of a bitstream it isn't."""
    byte = byte_at(view["bits"], F.call_function("div", bit, F.lit(8)))
    on = F.call_function("shiftright", F.coalesce(byte, F.lit(0)), (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.coalesce(view["constant"], on)


def expand_constant(view: Column, n_bits: Column) -> Column:
    """A constant as a bitstream of n_bits, in whole bytes (padding bits are set like the others)."""
    n = F.ceil(n_bits / 8).cast("int")
    filled = F.when(view["constant"], F.unhex(F.repeat(F.lit("FF"), n))).otherwise(F.unhex(F.repeat(F.lit("00"), n)))
    return F.when(view["constant"].isNotNull(), bitstream(filled)).otherwise(view)


def set_bit(view: Column, bit: Column, value: Column) -> Column:
    """The view with one bit changed; unchanged if it is a constant or the bit lies beyond it."""
    at = F.call_function("div", bit, F.lit(8)).cast("int")
    byte, one = byte_at(view["bits"], at), F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))
    new = F.when(value, byte.bitwiseOR(one)).otherwise(byte.bitwiseAND(F.bitwise_not(one)))
    size = F.octet_length(view["bits"])
    text = F.concat(F.hex(F.substr(view["bits"], F.lit(1), at)), F.lpad(F.hex(new.cast("bigint")), 2, "0"), F.hex(F.substr(view["bits"], at + 2, F.greatest(size - at - 1, F.lit(0)))))
    return F.when(view["constant"].isNull() & (at < size), bitstream(F.unhex(text))).otherwise(view)


#: Bytes of a block in a rank directory, and blocks that are summed at a time.
BLOCK, GROUP = 64, 64


def word(bits: Column, start: Column, size: Column | int = 8) -> Column:
    """Set bits in up to eight bytes from an index (from 0); 0 beyond the end."""
    taken = F.hex(F.substr(bits, (start + 1).cast("int"), (F.lit(size) if isinstance(size, int) else size).cast("int")))
    return F.coalesce(F.call_function("bit_count", F.conv(F.nullif(taken, F.lit("")), 16, -10).cast("bigint")), F.lit(0))


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def words_before(bits: Column, first: Column, end: Column) -> Column:
    """Set bits from the byte first (a multiple of eight) up to the bit end, eight bytes a step."""
    n = F.call_function("div", end - 8 * first, F.lit(64)).cast("int")
    whole = F.when(n > 0, added(F.transform(F.sequence(F.lit(0), n - 1), lambda i: word(bits, first + 8 * i)))).otherwise(F.lit(0))
    at = first + 8 * n
    rest = F.call_function("div", end, F.lit(8)) - at
    below = F.call_function("shiftleft", F.lit(1), (end % 8).cast("int")) - 1
    last = F.call_function("bit_count", F.coalesce(byte_at(bits, F.call_function("div", end, F.lit(8))), F.lit(0)).bitwiseAND(below))
    return whole + F.when(rest > 0, word(bits, at, rest)).otherwise(F.lit(0)) + last


def rank_before(bits: Column, bit: Column) -> Column:
    """Set bits before a position, counted eight bytes at a time from the beginning. Where many are asked of one bitstream, see directory()."""
    return words_before(bits, F.lit(0), F.least(bit, 8 * F.octet_length(bits)))


def count(view: Column, first: int, end: int) -> Column:
    """Set bits of a view from first up to (without) end; a null view has none."""
    streamed = rank_before(view["bits"], F.lit(end)) - rank_before(view["bits"], F.lit(first)) if first else rank_before(view["bits"], F.lit(end))
    return F.when(view["constant"].isNotNull(), F.when(view["constant"], end - first).otherwise(0)).otherwise(F.coalesce(streamed, F.lit(0))).cast("bigint")


def directory(bits: Column) -> Column:
    """Set bits before each block of BLOCK bytes, and last those of all: an array to store beside a bitstream."""
    n = F.ceil(F.octet_length(bits) / BLOCK).cast("int")
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda i: added(F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 8 - 1)), lambda j: word(bits, BLOCK * i + 8 * j)))
    groups = lambda c: F.transform(upto(F.ceil(F.size(c) / GROUP).cast("int")), lambda g: added(F.slice(c, g * GROUP + 1, F.lit(GROUP))))
    # Sums before each group, then within groups: appending to one array for each block would copy it each time.
    starts = lambda g: F.aggregate(g, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    within = lambda c, s: F.flatten(F.transform(upto(F.ceil(F.size(c) / GROUP).cast("int")), lambda g: F.slice(F.aggregate(F.slice(c, g * GROUP + 1, F.lit(GROUP)), F.array(F.get(s, g)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), F.lit(1), F.least(F.size(c) - g * GROUP, F.lit(GROUP)))))
    return let(F.transform(upto(n), block), lambda c: let(starts(groups(c)), lambda s: F.concat(within(c, s), F.array(F.element_at(s, -1)))))


def rank(bits: Column, found: Column, bit: Column) -> Column:
    """Set bits before a position, by the bitstream's directory(): one entry and a block's words, however long the bitstream is."""
    block = F.call_function("div", bit, F.lit(8 * BLOCK)).cast("int")
    beyond = bit >= 8 * F.octet_length(bits)
    return F.when(beyond, F.element_at(found, -1)).otherwise(F.get(found, block) + words_before(bits, BLOCK * block, bit))


def any_set(bits: Column, start: Column, end: Column) -> Column:
    """Whether a bit from start up to (without) end is set: the outer bytes are masked, those between are looked at as one text."""
    first, last = F.call_function("div", start, F.lit(8)).cast("int"), F.call_function("div", end - 1, F.lit(8)).cast("int")
    byte = lambda i: F.coalesce(byte_at(bits, i), F.lit(0))
    from_, upto = F.call_function("shiftleft", F.lit(255), (start % 8).cast("int")), F.call_function("shiftright", F.lit(255), (7 - (end - 1) % 8).cast("int"))
    between = F.rlike(F.hex(F.substr(bits, first + 2, F.greatest(last - first - 1, F.lit(0)))), F.lit("[1-9A-F]"))
    one = byte(first).bitwiseAND(from_).bitwiseAND(upto) != 0
    more = (byte(first).bitwiseAND(from_) != 0) | (byte(last).bitwiseAND(upto) != 0) | between
    return F.when(end <= start, F.lit(False)).when(first == last, one).otherwise(more)
