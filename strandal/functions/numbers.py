"""Numbers from and to text, bits and hashes as column expressions."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, EMPTY, OVERFLOW, UNDERFLOW = 0, -1, 0x10000, 0x10001
_LITERAL = "^([+-]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+)(?:(\\.[0-9]*)?(?:[eE]([+-]?[0-9]+))?))"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parse_number(s: Column, low: int, high: int) -> Column:
    """(status, value) of an integer, hexadecimal, decimal or exponent literal within a range.

    Status: 0, -1 for an empty text, the 1-based position of a bad character, or over- and underflow. Whole
    numbers are exact, hexadecimal ones wrap at 64 bits; a fraction is a double, its mantissa times a power of ten. The
    value is a long, or a ``decimal(20,0)`` where the range goes beyond.
    """
    wide = T.DecimalType(38, 0)
    bounds = [F.lit(Decimal(x)).cast(wide) for x in (low, high)]

    def value(m):
        negative, hexa, digits, fraction, exponent = (F.get(m, i) for i in range(1, 6))
        whole = F.coalesce(digits.try_cast(wide), F.lit(Decimal(10) ** 37).cast(wide))
        hexa = F.conv(F.right(hexa, F.lit(16)), 16, 10).cast(wide)
        broken = (F.length(fraction) > 0) | (F.length(exponent) > 0)
        power = F.coalesce(exponent.try_cast("int"), F.when(exponent.startswith("-"), -99999).otherwise(99999))
        # past this, a double neither has more digits nor more range
        scaled = F.coalesce(F.concat(digits, fraction).try_cast("double"), F.lit(0.0)) * F.pow(F.lit(10.0), F.when(F.length(exponent) > 0, F.least(F.greatest(power, F.lit(-400)), F.lit(400))).otherwise(0))
        exact = F.when(F.length(F.get(m, 2)) > 0, hexa).otherwise(whole)
        sign = F.when(negative == "-", -1).otherwise(1)
        return F.struct(broken.alias("broken"), (sign * exact).cast(wide).alias("exact"), (sign * scaled).alias("scaled"))

    def judged(v):
        far = F.when(v["broken"], v["scaled"] > float(high)).otherwise(v["exact"] > bounds[1])
        near = F.when(v["broken"], v["scaled"] < float(low)).otherwise(v["exact"] < bounds[0])
        small, large = F.abs(v["scaled"]) < 9e15, F.abs(v["scaled"]) < 1e20  # from 2**53 on doubles are whole
        cut = F.when(small, F.when(small, v["scaled"]).cast("long").cast(wide)).when(large, F.when(large, v["scaled"]).cast(wide))
        out = F.when(v["broken"], cut).otherwise(v["exact"])
        kind = "long" if -(1 << 63) <= low and high < 1 << 63 else "decimal(20,0)"
        status = F.when(far, OVERFLOW).when(near, UNDERFLOW).otherwise(OK)
        return F.struct(status.alias("status"), F.when(status == OK, out).try_cast(kind).alias("value"))

    def of(lit):
        groups = F.array(*[F.regexp_extract(lit, _LITERAL, i) for i in range(6)])
        return let(groups, lambda m: F.struct(F.length(F.get(m, 0)).alias("good"), let(value(m), judged).alias("got")))

    empty = F.coalesce(F.length(s), F.lit(0)) == 0
    none = F.lit(None).cast("long" if -(1 << 63) <= low and high < 1 << 63 else "decimal(20,0)")
    return F.when(empty, F.struct(F.lit(EMPTY).alias("status"), none.alias("value"))).otherwise(
        let(of(s), lambda x: F.when(x["good"] < F.length(s), F.struct((x["good"] + 1).alias("status"), none.alias("value"))).otherwise(x["got"]))
    )


def to_integer(s: Column, low: int = -(1 << 63), high: int = (1 << 63) - 1) -> Column:
    """(status, value) of a whole number with blanks around it and a lower-case ``0x``: status 1 when bad, 2 beyond the range."""
    text = F.btrim(s, F.lit(" \t"))
    got = parse_number(text, low, high)
    good = text.rlike("^-?(0x[0-9a-fA-F]+|[0-9]+)$")
    return F.struct(F.when(~F.coalesce(good, F.lit(False)), 1).when(got["status"] != OK, 2).otherwise(0).alias("status"), F.when(good, got["value"]).alias("value"))


def integer_text(x: Column) -> Column:
    return x.cast("string")


def float_text(x: Column) -> Column:
    return F.printf(F.lit("%f"), x)


def limits(kind: str) -> tuple[int, int]:
    """Least and largest value of ``int8`` to ``uint64``."""
    bits = int(kind.lstrip("uint"))
    return (0, (1 << bits) - 1) if kind.startswith("u") else (-(1 << bits - 1), (1 << bits - 1) - 1)


def interval_relation(left: Column, left_size: Column, right: Column, right_size: Column) -> Column:
    """0 apart, 1 the left lies in the right, 2 the right in the left, 3 the left begins in the right and goes on, 4 the reverse."""
    left_end, right_end = left + left_size, right + right_size
    return (
        F.when(left < right, F.when(left_end <= right, 0).when(right_end <= left_end, 2).otherwise(4))
        .when(left == right, F.when(left_end <= right_end, 1).otherwise(2))
        .otherwise(F.when(right_end <= left, 0).when(left_end <= right_end, 1).otherwise(3))
    )


def hex_runs(s: Column) -> Column:
    """Bytes of runs of 2, 4 or 8 hexadecimal digits, each little-endian; ``0x`` before a run is dropped. Null with other runs."""
    pair = lambda r: F.array_join(F.reverse(F.regexp_extract_all(r, F.lit("(..)"), 1)), "")
    good = lambda runs: F.forall(runs, lambda r: F.length(r).isin(2, 4, 8))
    return let(F.regexp_extract_all(s, F.lit("(?:0x)?([0-9A-Fa-f]+)"), 1), lambda runs: F.when(good(runs), F.unhex(F.array_join(F.transform(runs, pair), ""))))


def pack_bits(bits: Column) -> Column:
    """Bytes of an array of 0 and 1, the first bit lowest."""

    def whole(bits):
        byte = lambda i: reduce(add, (F.coalesce(F.get(bits, i * 8 + j), F.lit(0)) * (1 << j) for j in range(8)))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(bits) / 8).cast("int") - 1), lambda i: F.lpad(F.hex(byte(i).cast("long")), 2, "0"))

    # a lambda computes what it names for each element anew, so the bits are bound first
    return let(bits, lambda b: F.when(F.size(b) > 0, F.unhex(F.array_join(whole(b), ""))).otherwise(F.lit(b"")))


def unpack_bits(data: Column) -> Column:
    """The bits of bytes, the lowest first."""

    def bits(text):
        byte = lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        each = lambda i: let(byte(i), lambda v: F.array(*[F.shiftright(v, j).bitwiseAND(1) for j in range(8)]))
        return F.when(F.length(text) > 0, F.flatten(F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), each))).otherwise(F.array().cast("array<int>"))

    return let(F.hex(data), bits)


def bit_set(members: Column) -> Column:
    """A set of small numbers (0 to 255) as a sorted array; unions, intersections and differences are those of arrays."""
    return F.array_sort(F.array_distinct(F.filter(members, lambda x: (x >= 0) & (x < 256))))


def ip_text(address: Column) -> Column:
    """Dotted decimal text of 4 bytes in storage order."""
    return F.concat_ws(".", *[F.conv(F.substring(F.hex(address), 2 * i + 1, 2), 16, 10) for i in range(4)])


def mac_text(address: Column) -> Column:
    """Colon-separated text of 6 bytes in storage order."""
    return F.concat_ws(":", *[F.lower(F.substring(F.hex(address), 2 * i + 1, 2)) for i in range(6)])


def narrow(x: Column, low: int, high: int) -> Column:
    """Status of fitting a number into a range."""
    return F.when(x > high, OVERFLOW).when(x < low, UNDERFLOW).otherwise(OK)


def unsigned32(x: Column) -> Column:
    """What ``%u`` prints for a 32-bit integer."""
    return F.pmod(x.cast("long"), F.lit(1 << 32))


def to_hex(data: Column, lower: bool = True) -> Column:
    return F.lower(F.hex(data)) if lower else F.hex(data)


def ones(x: Column) -> Column:
    return F.bit_count(x)


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def digest(data: Column, algorithm: str = "md5", rounds: int = 1) -> Column:
    """The raw digest, hashed ``rounds`` times over."""
    one = (lambda x: F.unhex(F.md5(x))) if algorithm == "md5" else (lambda x: F.unhex(F.sha2(x, 256)))
    out = one(data)
    for _ in range(rounds - 1):
        out = one(out)
    return out


def stretch(data: Column, size: int, algorithm: str = "md5") -> Column:
    """Key bytes: the digest, then the digest of all so far appended, until there are ``size``."""
    out, n = digest(data, algorithm), 16 if algorithm == "md5" else 32
    while n < size:
        out, n = F.concat(out, digest(out, algorithm)), n + (16 if algorithm == "md5" else 32)
    return F.substring(out, 1, size)


def digest_again(data: Column, times: int = 1, algorithm: str = "md5") -> Column:
    """The digest, and ``times`` times the digest of that."""
    return digest(data, algorithm, 1 + times)


def spread_digest(data: Column, size: int, rounds: int, algorithm: str = "md5") -> Column:
    """``size`` bytes over which the digests of all rounds are written one after another, round and round."""
    width = 16 if algorithm == "md5" else 32
    digests = [digest(data, algorithm, r) for r in range(1, rounds + 1)]
    if size <= width:
        return F.substring(digests[-1], 1, size)
    written = width * rounds
    line = F.concat(*digests)
    if written <= size:
        return F.concat(line, F.lit(bytes(size - written)))
    last = written % size  # the place of the next write
    tail = F.substring(line, written - size + 1, size)  # the last bytes written, the oldest first, which is at `last`
    return F.concat(F.substring(tail, size - last + 1, last), F.substring(tail, 1, size - last))


_FNV_START, _FNV_FACTOR = np.uint64(2166136261), np.uint64(16777619)


def _fnv(rows: list[bytes | None]) -> list[Decimal | None]:
    """Byte places in turn, all rows at once; rows that have ended drop out."""
    order = sorted((i for i, r in enumerate(rows) if r is not None), key=lambda i: -len(rows[i]))
    sizes = np.array([len(rows[i]) for i in order], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(order) else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(rows[i] for i in order), np.uint8)
    h = np.full(len(order), _FNV_START)
    for j in range(int(sizes[0]) if len(order) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))
        h[:n] = h[:n] * _FNV_FACTOR ^ data[at[:n] + j]
    out: list = [None] * len(rows)
    for i, x in zip(order, h.tolist()):
        out[i] = Decimal(x)
    return out


@F.pandas_udf(T.DecimalType(20, 0))
def fnv64(data: pd.Series) -> pd.Series:
    """Multiply, then exclusive-or, over the bytes, in 64 bits; start and factor are those of the 32-bit FNV hash."""
    return pd.Series(_fnv([None if r is None else r if isinstance(r, bytes) else str(r).encode() for r in data]), dtype=object)


@F.pandas_udf(T.DecimalType(20, 0))
def fnv64_folded(text: pd.Series) -> pd.Series:
    """The same over the upper-cased text's UTF-16 units, so that case doesn't matter."""
    return pd.Series(_fnv([None if t is None else t.upper().encode("utf-16-le", "surrogatepass") for t in text]), dtype=object)


def zero_pad(data: Column, block: int = 16) -> Column:
    """Bytes filled up with zeros to whole blocks."""
    missing = F.pmod(-F.octet_length(data), F.lit(block))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), missing)))


def frame(payload: Column) -> Column:
    """Little-endian size, MD5 of the payload, payload."""
    n = F.octet_length(payload)
    size = F.unhex(F.lpad(F.hex(n), 8, "0"))
    return F.concat(_swap4(size), F.unhex(F.md5(payload)), payload)


def _swap4(b: Column) -> Column:
    return F.concat(*[F.substring(b, i, 1) for i in (4, 3, 2, 1)])


def unframe(framed: Column) -> Column:
    """(ok, payload): size and digest are checked; a size of 0 needs no digest."""
    size = F.conv(F.hex(_swap4(F.substring(framed, 1, 4))), 16, 10).cast("long")
    # a size that no payload has is as wrong as any other
    payload = F.substring(framed, F.lit(21), F.least(size, F.octet_length(framed).cast("long")).cast("int"))
    ok = (F.octet_length(framed) >= 20) & (F.octet_length(payload) == size) & ((size == 0) | (F.hex(F.substring(framed, 5, 16)) == F.upper(F.md5(payload))))
    return F.struct(ok.alias("ok"), F.when(ok, payload).alias("payload"))


_PAD = b"\x10" * 16


def encrypt(data: Column, key: Column, mode: str = "ECB", iv: Column | None = None) -> Column:
    """AES without padding, of data whose size is a multiple of 16."""
    if mode == "ECB":
        return F.substring(F.aes_encrypt(data, key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.octet_length(data))
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(17), F.octet_length(data))


def decrypt(data: Column, key: Column, mode: str = "ECB", iv: Column | None = None) -> Column:
    """The reverse: the padding block that Spark expects is encrypted and put behind the data first."""
    pad = F.lit(_PAD)
    if mode == "ECB":
        return F.aes_decrypt(F.concat(data, encrypt(pad, key)), key, F.lit("ECB"), F.lit("PKCS"))
    last = F.substring(data, F.octet_length(data) - 15, F.lit(16))
    return F.aes_decrypt(F.concat(iv, data, encrypt(pad, key, "CBC", last)), key, F.lit("CBC"), F.lit("PKCS"))


@F.pandas_udf(T.BinaryType())
def xor(a: pd.Series, b: pd.Series) -> pd.Series:
    rows = [None if x is None or y is None else (bytes(x), bytes(y)[: len(x)]) for x, y in zip(a, b)]
    whole = [r for r in rows if r is not None]
    both = np.frombuffer(b"".join(x for x, _ in whole), np.uint8) ^ np.frombuffer(b"".join(y for _, y in whole), np.uint8)
    data, ends = both.tobytes(), np.cumsum([len(x) for x, _ in whole]).tolist()
    parts = iter([data[i:j] for i, j in zip([0, *ends], ends)])
    return pd.Series([None if r is None else next(parts) for r in rows], dtype=object)


def counter_mode(data: Column, key: Column, iv: Column) -> Column:
    """AES in counter mode, its own reverse: encrypted big-endian counters from ``iv``, xored with the data."""
    blocks = F.ceil(F.octet_length(data) / 16)
    # the upper 8 bytes of the counter stay; the lower 8 count on from the iv as an unsigned number
    low = F.conv(F.hex(F.substring(iv, 9, 8)), 16, 10).cast("decimal(20,0)")
    one = lambda i: F.concat(F.hex(F.substring(iv, 1, 8)), F.lpad(F.conv(F.pmod(low + i, F.lit(Decimal(1 << 64))).cast("string"), 10, 16), 16, "0"))
    counters = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), one), ""))
    return xor(data, encrypt(counters, key))
