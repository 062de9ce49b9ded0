"""Scalar functions as column expressions: they stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOD = 65521


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_attempt(task, retry) -> Column:
    """A task number in the high 32 bits, its attempt in the low ones."""
    return F.shiftleft(_c(task).cast("long"), 32).bitwiseOR(_c(retry).cast("long"))


def key_successor(key) -> Column:
    """The least key above ``key`` in byte order."""
    return F.concat(_c(key).cast("binary"), F.unhex(F.lit("00")))


def block_start(offset, size: int) -> Column:
    return _c(offset) - F.pmod(_c(offset), F.lit(size))


def adler32(data, seed: int = 1) -> Column:
    """Adler-32 of a binary column; ``seed`` continues an earlier checksum. Null stays null."""
    data = _c(data)
    n = F.octet_length(data).cast("long")
    h = F.hex(data)
    byte = F.transform(
        F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))),
        lambda i: F.when(n >= i, F.conv(F.substring(h, (2 * i - 1).cast("int"), F.lit(2)), 16, 10).cast("long")).otherwise(F.lit(0).cast("long")),
    )
    total = F.aggregate(
        byte, F.struct(F.lit(seed % 65536).cast("long").alias("a"), F.lit(seed // 65536).cast("long").alias("b")),
        lambda s, x: F.struct(((s.a + x) % MOD).alias("a"), ((s.b + s.a + x) % MOD).alias("b")), lambda s: s.a + s.b * 65536,
    )
    return F.when(data.isNotNull(), F.when(n == 0, F.lit(seed).cast("long")).otherwise(total))


def _in_units(s: Column, shift: int) -> Column:
    """``s / 2**shift`` with two digits, ties to the even one as C's printf has them.

    ``s`` holds whole numbers as doubles. Java's formatter rounds ties up, and the shortest decimal
    of a value at that; here hundredths and what is left of them are exact integers.
    """
    size = F.abs(s)
    whole = F.floor(size / (1 << shift))
    cents = (size - whole * F.lit(float(1 << shift))).cast("long") * 100
    low, left, half = F.shiftright(cents, shift), cents.bitwiseAND((1 << shift) - 1), 1 << (shift - 1)
    up = (left > half) | ((left == half) & (low % 2 == 1))
    n = whole * 100 + low + F.when(up, 1).otherwise(0)
    return F.concat(F.when(s < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def human_size(size) -> Column:
    """KB under 1 MiB, MB under 1 GiB, else GB, with two digits."""
    s = _c(size).cast("double")
    return (
        F.when(s < 1 << 20, F.concat(_in_units(s, 10), F.lit(" KB")))
        .when(s < 1 << 30, F.concat(_in_units(s, 20), F.lit(" MB")))
        .otherwise(F.concat(_in_units(s, 30), F.lit(" GB")))
    )


def readable_bytes(size) -> Column:
    """PB, TB, GB or MB, each only above its unit; the plain number below."""
    s, out = _c(size).cast("double"), _c(size).cast("string")
    for unit, shift in (("MB", 20), ("GB", 30), ("TB", 40), ("PB", 50)):
        out = F.when(s > 1 << shift, F.concat(_in_units(s, shift), F.lit(f" {unit}"))).otherwise(out)
    return out


def ip_rack(ip) -> Column:
    """The third number of an address."""
    return F.get(F.split(_c(ip), "[.]"), F.lit(2)).cast("int")


def host_distance(a, b) -> Column:
    """Difference of the digits in two host names, read as numbers."""
    number = lambda x: F.coalesce(F.nullif(F.regexp_replace(_c(x), "[^0-9]", ""), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.abs(number(a) - number(b))


def legal_name(name) -> Column:
    return F.coalesce((F.length(_c(name)) > 0) & ~F.contains(_c(name), F.lit("/")), F.lit(False))


def worm_allows(name) -> Column:
    """In write-once mode only names with ``.tmp`` anywhere may change."""
    return F.coalesce(F.instr(_c(name), ".tmp") > 0, F.lit(False))


def utilisation(used, total) -> Column:
    return F.when(_c(total) == 0, F.lit(0.0)).otherwise(_c(used) / _c(total))


def master_by_parity(ip) -> Column:
    """Servers with an odd last number of their address may be masters."""
    return F.coalesce(F.get(F.split(_c(ip), "[.]"), F.lit(3)).cast("int") % 2 == 1, F.lit(False))


def sec_usec(micros) -> Column:
    """``seconds/microseconds`` as logs and checkpoints write a time."""
    m = _c(micros)
    return F.concat_ws("/", F.floor(m / F.lit(10**6)).cast("string"), F.pmod(m, F.lit(10**6)).cast("string"))


def time_text(micros) -> Column:
    """A time in GMT as ``Tue Jan  2 03:04:05 2024``; the session's time zone must be UTC."""
    at = F.timestamp_micros(_c(micros))
    return F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss yyyy"))
