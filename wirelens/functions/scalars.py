"""Column helpers for packets, addresses, names and dissector text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens import dims


def spi_hex(spi: Column) -> Column:
    """A 32-bit SPI as eight lower-case hex digits."""
    return F.lpad(F.lower(F.hex(spi)), 8, "0")


def is_flow_packet(proto: Column, spi: Column) -> Column:
    return proto.isin("esp", "ah") & spi.isNotNull()


def address_pair_id(src: Column, dst: Column) -> Column:
    """Stable 32-bit stand-in for an SPI: base-131 polynomial over ``src>dst``.

    Addresses are at most 45 characters, so the fold is short.
    """
    chars = F.split(F.concat(src, F.lit(">"), dst), "")
    return F.aggregate(
        F.filter(chars, lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: (acc * F.lit(131) + F.ascii(c)).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )


def file_stem(name: Column) -> Column:
    """Last path element without its last suffix."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)


def label_from_name(name: Column) -> Column:
    """Traffic class encoded in a capture's file name, null when none matches."""
    stem = F.lower(file_stem(name))
    expr = None
    for pattern, label in dims.NAME_LABELS:
        test = stem.rlike(pattern)
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr


def is_tunnelled(name: Column) -> Column:
    return file_stem(name).rlike(r"(?i)^vpn[_-]")


def config_name(session_name: Column) -> Column:
    return F.regexp_replace(session_name, r"-r[0-9]+$", "")


def rating(total: Column) -> Column:
    expr = None
    for bound, name in dims.RATING_BANDS:
        expr = F.when(total >= bound, name) if expr is None else expr.when(total >= bound, name)
    return expr.otherwise("critical")


def inner_header_bytes(ip_version: Column) -> Column:
    return F.when(ip_version == 6, F.lit(40.0)).otherwise(F.lit(20.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tolerant_number(text: Column) -> Column:
    """Integer from the renderings a dissector uses, as ``decimal(38,0)``.

    Decimal, ``0x`` hex, colon-separated octets (big endian), or ``NAME (n)``;
    anything else is null, and so are values of more than 38 digits.
    """
    number = "decimal(38,0)"

    def wide(digits: Column) -> Column:
        """Hex digits of any number, fifteen at a time."""
        short = F.conv(digits, 16, 10).cast(number)
        return F.when(F.length(digits) <= 15, short).otherwise(let(F.regexp_replace(digits, "^0+(?=.)", ""), long))

    def long(d: Column) -> Column:
        part = lambda start: F.coalesce(F.conv(F.substring(F.lpad(d, 45, "0"), start, 15), 16, 10).cast(number), F.lit(0).cast(number))
        unit = F.lit(str(16**15)).cast("decimal(19,0)")
        high = (part(1) * unit).try_cast(number)
        value = ((high + part(16)).try_cast("decimal(19,0)") * unit).try_cast(number) + part(31)
        return F.when(F.length(d) <= 31, value.try_cast(number))

    def hexa(t: Column) -> Column:
        return F.when(t.rlike(r"(?i)^0x[0-9a-f]+$"), wide(F.substring(t, 3, 1_000_000)))

    def plain(t: Column) -> Column:
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast(number))

    def parse(t: Column) -> Column:
        octets = F.when(t.rlike(r"(?i)^[0-9a-f]{2}(:[0-9a-f]{2})+$"), wide(F.replace(t, F.lit(":"), F.lit(""))))
        named = let(F.trim(F.regexp_extract(t, r"\(([^()]*)\)$", 1)), lambda n: F.coalesce(plain(n), hexa(n)))
        return F.when(t.endswith(")"), named).when(t.contains(":"), octets).otherwise(F.coalesce(plain(t), hexa(t)))

    return let(F.trim(text), parse)


def tolerant_int(text: Column) -> Column:
    """``tolerant_number`` for fields of fixed width; null where 64 bits do not hold it."""
    return tolerant_number(text).try_cast("bigint")


_PLAIN, _HEX = re.compile(r"^[+-]?[0-9]+$"), re.compile(r"^0[xX][0-9a-fA-F]+$")
_OCTETS, _NAMED = re.compile(r"^[0-9a-fA-F]{2}(:[0-9a-fA-F]{2})+$"), re.compile(r"\(([^()]*)\)$")


def whole_number(text: str) -> int | None:
    """``tolerant_int`` of one text, for code that reads dumps in Python."""
    t = text.strip(" ")
    if t.endswith(")"):
        found = _NAMED.search(t)
        t = found[1].strip(" ") if found else ""
    elif ":" in t:
        return in_64_bits(_digits(t.replace(":", ""), 16)) if _OCTETS.match(t) else None
    if _PLAIN.match(t):
        n = _digits(t.lstrip("+-"), 10)
        return in_64_bits(-n if n is not None and t[0] == "-" else n)
    return in_64_bits(_digits(t[2:], 16)) if _HEX.match(t) else None


def _digits(text: str, base: int) -> int | None:
    """Numbers of twenty digits and more are left unread: 64 bits do not hold them."""
    digits = text.strip().lstrip("0")
    return int(digits or "0", base) if len(digits) < 20 else None


def in_64_bits(n: int | None) -> int | None:
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def algorithm(version: Column, code: Column, kinds: dict[str, str]) -> Column:
    """Registry name for ``code``; ``kinds`` maps version to registry kind.

    Unlisted codes are ``unknown``; a missing code stays null.
    """
    expr = F.lit(None).cast("string")
    for ver, kind in kinds.items():
        table = dims.TRANSFORM_IDS[(ver, kind)]
        expr = F.when(version == ver, dims.lookup(table, code, F.lit("unknown"))).otherwise(expr)
    return F.when(code.isNotNull(), expr)


def key_bits(negotiated: Column, alg: Column) -> Column:
    """The negotiated key length, else the one the cipher fixes."""
    return F.coalesce(negotiated.cast("int"), dims.lookup(dims.FIXED_KEY_BITS, alg).cast("int"))


def strength(alg: Column, bits: Column) -> Column:
    """Comparable strength; -1 marks an unknown cipher."""
    rank = dims.lookup(dims.WEAK_FAMILY_RANK, alg, F.lit(dims.STRONG_FAMILY_RANK))
    return F.struct(rank.alias("rank"), F.coalesce(bits, F.lit(0)).alias("bits"))


def nearest_rank(n: Column, percent: int) -> Column:
    """1-based rank of the nearest-rank percentile: ``round((n-1)*q)+1`` in integers."""
    return F.floor(((n - 1) * percent + 50) / 100).cast("bigint") + 1
