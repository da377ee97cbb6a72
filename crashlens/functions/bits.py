"""Dispatch values, status cells and byte strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once a row; a lambda that names a column's expression computes it for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bit_index(value: Column) -> Column:
    """The place of the only bit that is set; null for none or several (SCL-19)."""
    return F.when(F.bit_count(value) == 1, F.bit_count(value - 1).cast("int"))


def stratum(value: Column) -> Column:
    """always for no bits, else gated (SCL-19)."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, "always").otherwise("gated")


def little_endian(text: Column) -> Column:
    """The number of a hex string's bytes, least first; up to eight bytes (SCL-18)."""
    n = (F.char_length(text) / 2).cast("int")
    swapped = F.array_join(F.transform(F.when(n > 0, F.sequence(n, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i * 2 - 1, F.lit(2))), "")
    return F.conv(swapped, 16, 10).try_cast("long")


def set_bits(text: Column) -> Column:
    """Places of the bits set in a hex string of bytes, least byte first; any width (SCL-18)."""
    n = (F.char_length(text) / 2).cast("int")
    return once(text, lambda t: _set_bits(t, n))


def _set_bits(text: Column, n: Column) -> Column:
    bytes_ = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i - 1).alias("i"), F.conv(F.substr(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int").alias("b")))
    return F.flatten(F.transform(bytes_, lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.getbit(x["b"], k) == 1, x["i"] * 8 + k)), lambda k: k.isNotNull())))


def byte_width(bits: Column) -> Column:
    """Bytes for so many bits, one at least (WIN-10)."""
    return F.greatest(F.lit(1), F.ceil(bits / 8)).cast("long")


def status_cell(confidence: Column, live: Column) -> Column:
    """`0|1` to `1|0` (SCL-20)."""
    return F.concat_ws("|", F.when(confidence >= 1, "1").when(confidence > 0, "0.5").otherwise("0"), live.cast("int").cast("string"))


def status_rank(status: Column) -> Column:
    """2 for a sure trigger, 1 for a likely one that is live, else 0 (FLT-09)."""
    return F.when(status.isin("1|1", "1|0"), 2).when(status == "0.5|1", 1).otherwise(0)


def _bit(place: Column) -> Column:
    """A place's bit in its byte, as a number."""
    return F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")


def mask(place: Column, width: Column) -> Column:
    """A bit set of so many bytes, least first, with one bit; any width. A null place gives no bit (WIN-10)."""
    byte = F.floor(place / 8).cast("int")
    one = F.concat(F.repeat(F.lit("00"), byte), F.lpad(F.hex(_bit(place)), 2, "0"), F.repeat(F.lit("00"), width.cast("int") - 1 - byte))
    return F.unhex(F.when(place.isNotNull(), one).otherwise(F.repeat(F.lit("00"), width.cast("int"))))


def mask_of(places: Column, width: Column) -> Column:
    """A bit set of so many bytes with all bits of an array (SCL-19); places beyond it are left out. Linear in both, apart from a sort."""
    byte = lambda p: F.floor(p / 8).cast("int")

    def joined(x: Column) -> Column:
        """Bytes that have bits, each after the zeros that part it from the one before, and the zeros at the end."""
        p, w = x["p"], x["w"]

        def one(at: Column, i: Column) -> Column:
            own = F.filter(F.slice(p, i + 1, 8), lambda q: byte(q) == byte(at))
            before = F.when(i > 0, byte(F.get(p, i - 1))).otherwise(-1)
            value = F.concat(F.repeat(F.lit("00"), byte(at) - before - 1), F.lpad(F.hex(F.aggregate(own, F.lit(0), lambda a, q: a.bitwiseOR(_bit(q)))), 2, "0"))
            return F.when(byte(at) > before, value).otherwise("")

        last = F.coalesce(byte(F.array_max(p)), F.lit(-1))
        return F.unhex(F.concat(F.array_join(F.transform(p, one), ""), F.repeat(F.lit("00"), w - 1 - last)))

    w = width.cast("int")
    kept = F.array_sort(F.array_distinct(F.filter(places, lambda p: (p >= 0) & (p < w * 8))))
    return once(F.struct(kept.alias("p"), w.alias("w")), joined)


def places(mask_: Column) -> Column:
    """Places of the bits in a bit set, rising (SCL-18)."""

    def each(m: Column) -> Column:
        n = F.octet_length(m)
        bytes_ = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.conv(F.hex(F.substring(m, i + 1, F.lit(1))), 16, 10).cast("int").alias("b")))
        return F.flatten(F.transform(F.filter(bytes_, lambda x: x["b"] > 0), lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.getbit(x["b"], k) == 1, x["i"] * 8 + k)), lambda k: k.isNotNull())))

    return once(mask_, each)


def has_bit(mask_: Column, place: Column) -> Column:
    """Whether a bit is set; never beyond the last byte (SCL-19)."""
    byte = F.substring(mask_, F.floor(place / 8).cast("int") + 1, F.lit(1))
    return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)) & (F.octet_length(byte) > 0)


def _bytewise(a: Column, b: Column, how) -> Column:
    """Four bytes at a time."""
    four = lambda m, i: F.conv(F.rpad(F.hex(F.substring(m, i * 4 + 1, F.lit(4))), 8, "0"), 16, 10).cast("long")

    def each(x: Column) -> Column:
        n = F.greatest(F.octet_length(x["a"]), F.octet_length(x["b"]))
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.substring(F.unhex(F.array_join(F.transform(blocks, lambda i: F.lpad(F.hex(how(four(x["a"], i), four(x["b"], i))), 8, "0")), "")), F.lit(1), n)

    return once(F.struct(a.alias("a"), b.alias("b")), each)


def mask_or(a: Column, b: Column) -> Column:
    """Bits of either; the shorter counts as filled up with zeros."""
    return _bytewise(a, b, lambda x, y: x.bitwiseOR(y))


def mask_and(a: Column, b: Column) -> Column:
    """Bits of both."""
    return _bytewise(a, b, lambda x, y: x.bitwiseAND(y))


def lone_bit(mask_: Column) -> Column:
    """The place of the only bit of a bit set; null for none or several (SCL-19). The half that has it is halved until a byte is left."""

    def found(m: Column) -> Column:
        def halved(s: Column, _: Column) -> Column:
            half = F.ceil(s["n"] / 2).cast("int")
            here = F.bitmap_count(F.substring(m, s["at"] + 1, half)) == 1
            return F.struct(F.when(here, s["at"]).otherwise(s["at"] + half).alias("at"), F.when(here, half).otherwise(s["n"] - half).alias("n"))

        start = F.struct(F.lit(0).alias("at"), F.octet_length(m).alias("n"))
        byte = lambda s: F.conv(F.hex(F.substring(m, s["at"] + 1, F.lit(1))), 16, 10).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, lambda s, i: halved(s, i), lambda s: (s["at"] * 8 + bit_index(byte(s))).cast("int"))

    return F.when(F.bitmap_count(mask_) == 1, once(mask_, found))
